"""The files beside a library: category folders, statistics, settings, tag registry, backups.

All of them are few and small (one per category or per library), so they are read
and written by the driver.
"""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.media import extension
from tesserae.sources import readers

ADULT = "NSFW"
#: One-level listing of a folder by its images only.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff")
PROJECT = ("TESSERAE_TAGS", "tags.json")


def browsable(files: DataFrame) -> DataFrame:
    """The files that a browser lists: none in a special folder, at any depth, and no hidden ones."""
    special = "|".join(readers.SPECIAL_FOLDERS)
    return files.where(~F.col("path").rlike(rf"/({special})/") & ~F.col("path").rlike(r"/\.[^/]*(/|$)"))


def images_of(files: DataFrame, folder: str) -> DataFrame:
    """The images directly in a folder, by extension."""
    return files.where((F.regexp_replace("path", "/[^/]*$", "") == folder.rstrip("/")) & F.lower(extension(F.col("path"))).isin(*IMAGE_EXTENSIONS))


def folder_counts(files: DataFrame, categories: DataFrame, unconfigured: bool = False) -> DataFrame:
    """``category, n, configured``: media per category; with ``unconfigured`` also folders that are no category."""
    n = files.groupBy(F.col("parent").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    met = n.join(categories.select("category", F.lit(True).alias("k")), "category", "full")
    out = met.select("category", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("k", F.lit(False)).alias("configured"))
    return out if unconfigured else out.where("configured")


def with_defaults(categories: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The settings of one category: its row, or empty defaults (with a fixed prompt for the managed adult folder)."""
    prompt = "Managed folder: files arrive by score and may be moved out by hand." if name == ADULT else ""
    default = spark.createDataFrame([(name, [], prompt, {}, name == ADULT)], "category string, tags array<string>, prompt string, palette map<string,double>, managed boolean")
    have = categories.where(F.col("category") == name).select("category", "tags", "prompt", "palette", F.lit(name == ADULT).alias("managed"))
    return have.unionByName(default.join(have.select("category"), "category", "left_anti"))


def create_category(root: str, name: str) -> bool:
    """Make the folder and settings of a new category; False if it exists. Blanks become underscores."""
    folder = Path(root) / name.strip().replace(" ", "_")
    if folder.exists():
        return False
    readers.write_category(root, folder.name, {"name": folder.name, "tags": [], "prompt": "", "palette_weights": {}} | ({"managed": True} if folder.name == ADULT else {}))
    return True


def delete_category(root: str, name: str) -> bool:
    """Remove a category's folder with all in it; False for the managed folder, for none and for anything but a folder's own name."""
    plain = name not in ("", ".", "..") and Path(name).name == name
    folder = Path(root) / name
    if not plain or name == ADULT or folder.is_symlink() or not folder.is_dir():
        return False
    shutil.rmtree(folder)
    return True


def _write(path: str, data: object) -> None:
    held = f"{path}.tmp"
    Path(held).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(held, path)


def save_settings(values: dict, path: str) -> None:
    _write(path, values)


def save_tags(groups: dict[str, list[str]], path: str) -> None:
    """The tag registry, in the form that `readers.tag_registry` reads: lower case, distinct, sorted."""
    _write(path, {"groups": {g: sorted({t.strip().lower() for t in tags if t and t.strip()}) for g, tags in groups.items()}})


def registry_path(project: str, bundled: str) -> str:
    """Where the tag registry is: as the environment says, else in the project, else the bundled one."""
    given = os.environ.get(PROJECT[0])
    own = os.path.join(project, PROJECT[1])
    return given if given and os.path.isfile(given) else own if os.path.isfile(own) else bundled


def destination(root: str, given: str | None, default: str = "WP") -> str:
    """An absolute destination as it is, a relative one below the project; the default where none is given."""
    return given if given and os.path.isabs(given) else os.path.join(root, given or default)


def cache_path(destination_dir: str, given: str | None = None) -> str:
    return given or os.path.join(destination_dir, ".hash_cache.json")


STATS_SCHEMA = "feature string, mean double, std double, within_std double, samples bigint"


def load_global_stats(spark: SparkSession, folder: str, name: str = ".heuristic_global_stats.json") -> DataFrame:
    """The statistics over all categories of a library; no rows if the file is missing, broken or of another shape."""
    try:
        features = json.loads((Path(folder) / name).read_text(encoding="utf-8"))["features"]
        rows = [(k, *(float(v[c]) if v.get(c) is not None else None for c in ("mean", "std", "within_std")), int(v.get("samples") or 0)) for k, v in features.items() if isinstance(v, dict)]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, STATS_SCHEMA)


def save_global_stats(stats: DataFrame, folder: str, name: str = ".heuristic_global_stats.json") -> None:
    """One row per feature, written as JSON beside the library."""
    rows = stats.collect()
    _write(str(Path(folder) / name), {"features": {r["feature"]: {c: r[c] for c in stats.columns if c != "feature"} for r in rows}})


def backups(root: str) -> list[str]:
    """The settings backups below a library."""
    return sorted(str(p) for p in Path(root).rglob(".category.json.bak"))


def remove_backups(root: str) -> int:
    """How many backups were removed."""
    done = 0
    for path in backups(root):
        try:
            os.remove(path)
            done += 1
        except OSError:
            pass
    return done


def delete_files(paths: list[str], limit: int) -> int:
    """Remove local files, at most ``limit``; how many went. Missing ones don't count."""
    if len(paths) > limit:
        raise ValueError(f"more than {limit} files")
    done = 0
    for p in paths:
        try:
            os.remove(p)
            done += 1
        except OSError:
            pass
    return done


def duplicates_plan(groups: DataFrame, existing: DataFrame, root: str, scratch, keep_first: bool = True) -> DataFrame:
    """``path, target``: duplicates into one folder under free names; all but the kept file of each group, or all."""
    from tesserae.plans.renames import free_targets

    chosen = groups.where("not is_keep") if keep_first else groups
    wanted = chosen.select("path", F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("wanted")).distinct()
    return free_targets(wanted, existing, scratch)
