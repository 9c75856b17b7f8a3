"""Command line: python -m tesserae.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib.util
import json

from pyspark.sql import functions as F

from tesserae.operators import analysis, duplicates, tags
from tesserae.plans import renames
from tesserae.session import Scratch, local_session
from tesserae.sources import library, readers

OPTIONAL = ("duckdb", "pyarrow", "pandas", "numpy")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("--report", help="write the result to this JSON file")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("modes", help="the analysis modes")
    sub.add_parser("deps", help="which packages are there")
    c = sub.add_parser("config", help="the settings in force, or set the destination")
    c.add_argument("--file", default="settings.json")
    c.add_argument("--set-dest")
    d = sub.add_parser("duplicates", help="groups of equal files below a folder")
    d.add_argument("folder")
    f = sub.add_parser("flatten", help="the plan that moves all files into one folder")
    f.add_argument("folder")
    f.add_argument("--apply", type=int, default=0, metavar="MOST", help="carry the plan out if it has at most so many rows")
    o = sub.add_parser("organize", help="images to categories")
    o.add_argument("folder")
    o.add_argument("--library", required=True)
    o.add_argument("--mode", choices=sorted(analysis.ANALYZERS), default="lowlevel")
    t = sub.add_parser("clean-tags", help="what a cleaning of the tags removes")
    t.add_argument("library")
    t.add_argument("--threshold", type=float, default=0.5)
    t.add_argument("--max-tags", type=int, default=25)
    t.add_argument("--analyse", action="store_true", help="only the polluted tags")
    t.add_argument("--apply", action="store_true")
    return p


def run(args: argparse.Namespace, spark=None) -> tuple[int, object]:
    """Exit code (0 done, 1 nothing found, 2 failed) and result."""
    if args.command == "modes":
        return 0, sorted(analysis.ANALYZERS)
    if args.command == "deps":
        return 0, {name: importlib.util.find_spec(name) is not None for name in OPTIONAL}
    if args.command == "config":
        values = readers.settings({"dest_dir": "WP", "quality_min": 0.0}, args.file)
        if args.set_dest:
            values["dest_dir"] = args.set_dest
            library.save_settings(values, args.file)
        return 0, values
    spark = spark or local_session()
    if args.command == "clean-tags":
        cats = readers.categories(spark, args.library)
        if args.analyse:
            rows = tags.polluted(cats, args.threshold).collect()
        else:
            rows = analysis.cleaned_categories(cats, args.threshold, args.max_tags).collect()
            if args.apply:
                have = {r["category"]: r["tags"] for r in cats.collect()}
                for r in rows:
                    if r["removed"]:
                        readers.write_category(args.library, r["category"], {"tags": [t for t in have[r["category"]] if t not in r["removed"]][: args.max_tags]})
        return (0 if rows else 1), [r.asDict() for r in rows]
    found = readers.scan(spark, args.folder)
    if args.command == "duplicates":
        files = found.join(readers.contents(spark, args.folder).select("path", "md5"), "path")
        rows = duplicates.exact_members(files).collect()
        return (0 if rows else 1), [r.asDict() for r in rows]
    if args.command == "flatten":
        plan = renames.flatten_plan(found, found.select("path"), args.folder.rstrip("/"), Scratch(spark, "flatten"))
        if args.apply:
            return 0, renames.apply_plan(plan, args.apply)
        rows = plan.where(F.col("path") != F.col("target")).collect()
        return (0 if rows else 1), [r.asDict() for r in rows]
    cats = readers.categories(spark, args.library)
    stats = spark.createDataFrame([], "category string, feature string, mean double, std double, min double, max double, samples bigint")
    out = analysis.analysed(readers.pixels(spark, args.folder), cats, stats, Scratch(spark, "organize"), "lowlevel" if args.mode in ("clip", "fusion") else args.mode)
    rows = out.collect()
    return (0 if rows else 1), [r.asDict() for r in rows]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        code, result = run(args)
    except (OSError, ValueError) as e:
        code, result = 2, str(e)
    text = json.dumps(result, indent=2, ensure_ascii=False, default=str)
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
