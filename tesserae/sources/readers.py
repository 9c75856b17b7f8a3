"""Readers: media folders, formats, category settings, tag registry, hash cache."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions.media import detect_format, extension, is_supported

SPECIAL_FOLDERS = ("Discarded", "Low-Quality", "Duplicates", "Unsorted")
CATEGORY_SCHEMA = "category string, tags array<string>, prompt string, palette map<string,double>, expected string, managed boolean"
DEFAULT_EXPECTED = {
    "aspect_ratios": ["horizontal", "vertical", "square"], "file_kinds": ["image", "video", "animated"], "min_resolution": [0, 0], "color_palette": [],
    "style_keywords": [], "exclude_keywords": [], "source": "default",
}


def scan(spark: SparkSession, folder: str, recursive: bool = True, animations: bool = True, skip: tuple[str, ...] = SPECIAL_FOLDERS) -> DataFrame:
    """``path, name, parent, ext, size_bytes, mtime`` of the media files below a folder; contents are not read.

    Hidden files and folders, fixed project files and the special folders are left out.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    df = df.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"))
    df = df.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("parent", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    inside = F.substring("path", F.lit(len(folder.rstrip("/")) + 1), F.lit(1 << 30))
    ok = is_supported(F.col("name"), animations) & ~inside.rlike(r"/\.") & ~F.col("parent").isin(*skip)
    return df.where(ok).select("path", "name", "parent", extension(F.col("path")).alias("ext"), "size_bytes", "mtime")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, md5, format`` of the files below a folder, from their bytes on the executors; the format is null if unknown."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.md5("content").alias("md5"), detect_format(F.substring("content", 1, 32)).alias("format"))


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """``path, width, height`` of the images the JVM can decode; 0 and 0 for others."""
    df = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    side = lambda c: F.greatest(F.col(f"image.{c}"), F.lit(0))
    return df.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), side("width").alias("width"), side("height").alias("height"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``path, width, height, channels, data`` (rows of BGR bytes) of the images the JVM can decode."""
    df = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return df.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def categories(spark: SparkSession, root: str, always: tuple[str, ...] = ("NSFW",)) -> DataFrame:
    """The categories below a folder: sub-folders with a ``.category.json``, and those of ``always`` that exist.

    The settings are hidden files, which Spark's readers skip, so they are read on
    the driver; their number is that of the folders.  Broken files count as empty.
    """
    rows = []
    for folder in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        if folder.name.startswith(".") or folder.name in SPECIAL_FOLDERS:
            continue
        config = folder / ".category.json"
        if not config.exists() and folder.name not in always:
            continue
        try:
            c = json.loads(config.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            c = {}
        c = c if isinstance(c, dict) else {}
        expected = DEFAULT_EXPECTED | (c.get("expected") or {})
        palette = {str(k): float(v) for k, v in (c.get("palette_weights") or {}).items()}
        rows.append((folder.name, [str(t).lower() for t in c.get("tags") or []], c.get("prompt") or "", palette, json.dumps(expected), folder.name in always))
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)


def write_category(root: str, name: str, settings: dict, merge: bool = True) -> dict:
    """Write the settings of one category atomically, merged into what is there; returns them."""
    folder = Path(root) / name.strip().replace(" ", "_")
    folder.mkdir(parents=True, exist_ok=True)
    config = folder / ".category.json"
    old = {}
    if merge and config.exists():
        try:
            old = json.loads(config.read_text(encoding="utf-8"))
        except ValueError:
            old = {}
    new = old | settings
    held = config.with_suffix(".tmp")
    held.write_text(json.dumps(new, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(held, config)
    return new


def tag_registry(spark: SparkSession, path: str) -> DataFrame:
    """``tag``: the distinct lower-cased tags of a JSON file of groups; no rows if there is no file."""
    try:
        groups = json.loads(Path(path).read_text(encoding="utf-8")).get("groups", {})
    except (OSError, ValueError, AttributeError):
        groups = {}
    found = sorted({str(t).strip().lower() for tags in groups.values() for t in tags if str(t).strip()})
    return spark.createDataFrame([(t,) for t in found], "tag string")


def settings(defaults: dict, path: str | None = None, prefix: str = "TESSERAE_") -> dict:
    """Defaults, over them a JSON file, over it the environment (converted to the default's type)."""
    out = dict(defaults)
    if path and os.path.exists(path):
        try:
            out |= json.loads(Path(path).read_text(encoding="utf-8"))
        except ValueError:
            pass
    for key, value in defaults.items():
        given = os.environ.get(prefix + key.upper())
        if given is not None:
            out[key] = given.lower() in ("1", "true", "yes", "on") if isinstance(value, bool) else type(value)(given) if value is not None else given
    return out


CACHE_SCHEMA = "path string, sig string, md5 string, size_bytes bigint, size array<int>"


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache stored as one JSON object from path to entry; broken or missing files give no rows."""
    text = spark.read.text(path, wholetext=True) if os.path.exists(path) else spark.createDataFrame([], "value string")
    entry = "map<string,struct<sig:string,md5:string,size_bytes:bigint,size:array<int>>>"
    rows = text.select(F.explode(F.from_json("value", entry)).alias("path", "e"))
    return rows.select("path", "e.sig", "e.md5", "e.size_bytes", "e.size")


def write_cache(cache: DataFrame, path: str) -> None:
    """The cache as a Parquet table, replaced as a whole by Spark's committer."""
    cache.write.mode("overwrite").parquet(path)


#: Every known extension with its group.
FORMATS = [(e, "static") for e in fixed.STATIC_EXTENSIONS] + [(e, "animated") for e in fixed.ANIMATED_EXTENSIONS] + [(e, "plugin") for e in fixed.PLUGIN_EXTENSIONS]
