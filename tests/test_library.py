"""Files beside a library, and the command line."""

import json

import pytest

from tesserae import cli
from tesserae.operators import analysis
from tesserae.session import Scratch
from tesserae.sources import library, readers


def test_categories_are_made_and_removed(spark, tmp_path):
    root = str(tmp_path)
    assert library.create_category(root, " Deep Sea ") and not library.create_category(root, "Deep Sea") and library.create_category(root, "NSFW")
    assert {r["category"] for r in readers.categories(spark, root).collect()} == {"Deep_Sea", "NSFW"}
    (tmp_path / "link").symlink_to(tmp_path / "Deep_Sea")
    assert not any(library.delete_category(root, n) for n in ("NSFW", "..", ".", "", "none", "link", "Deep_Sea/..", "/tmp"))
    assert library.delete_category(root, "Deep_Sea") and not (tmp_path / "Deep_Sea").exists()


def test_defaults_of_a_category(spark):
    cats = spark.createDataFrame([("A", ["x"], "p", {"Red": 1.0})], "category string, tags array<string>, prompt string, palette map<string,double>")
    assert library.with_defaults(cats, spark, "A").first()["tags"] == ["x"]
    adult = library.with_defaults(cats, spark, "NSFW").collect()
    assert len(adult) == 1 and adult[0]["managed"] and adult[0]["prompt"] and adult[0]["tags"] == []


def test_listings(spark):
    f = spark.createDataFrame([("/l/A/a.jpg", "A"), ("/l/Duplicates/b.jpg", "Duplicates"), ("/l/A/.c.jpg", "A"), ("/l/A/d.mp4", "A"), ("/l/A/s/e.PNG", "s")], "path string, parent string")
    assert {r["path"] for r in library.browsable(f).collect()} == {"/l/A/a.jpg", "/l/A/d.mp4", "/l/A/s/e.PNG"}
    assert {r["path"] for r in library.images_of(f, "/l/A/").collect()} == {"/l/A/a.jpg", "/l/A/.c.jpg"}
    cats = spark.createDataFrame([("A",), ("B",)], "category string")
    assert {tuple(r) for r in library.folder_counts(f, cats).collect()} == {("A", 3, True), ("B", 0, True)}
    assert {r["category"] for r in library.folder_counts(f, cats, True).collect()} == {"A", "B", "Duplicates", "s"}


def test_statistics_settings_tags_and_backups(spark, tmp_path, monkeypatch):
    s = spark.createDataFrame([("sharpness", 1.0, 2.0, 0.5, 9)], library.STATS_SCHEMA)
    library.save_global_stats(s, str(tmp_path))
    assert library.load_global_stats(spark, str(tmp_path)).collect() == s.collect()
    (tmp_path / "x.json").write_text('{"features": [1]}')
    assert library.load_global_stats(spark, str(tmp_path), "x.json").count() == 0 and library.load_global_stats(spark, str(tmp_path), "none").count() == 0
    library.save_tags({"g": ["B ", "a", "b"]}, str(tmp_path / "tags.json"))
    assert [r["tag"] for r in readers.tag_registry(spark, str(tmp_path / "tags.json")).orderBy("tag").collect()] == ["a", "b"]
    assert library.registry_path(str(tmp_path), "bundled") == str(tmp_path / "tags.json") and library.registry_path("/none", "bundled") == "bundled"
    monkeypatch.setenv("TESSERAE_TAGS", str(tmp_path / "x.json"))
    assert library.registry_path(str(tmp_path), "bundled") == str(tmp_path / "x.json")
    library.save_settings({"a": 2}, str(tmp_path / "s.json"))
    assert readers.settings({"a": 1}, str(tmp_path / "s.json")) == {"a": 2}
    assert library.destination("/p", None) == "/p/WP" and library.destination("/p", "/q") == "/q" and library.cache_path("/q") == "/q/.hash_cache.json"
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / ".category.json.bak").write_text("{}")
    assert library.remove_backups(str(tmp_path)) == 1 and library.backups(str(tmp_path)) == []
    (tmp_path / "f").write_text("")
    with pytest.raises(ValueError):
        library.delete_files(["a", "b"], 1)
    assert library.delete_files([str(tmp_path / "f"), str(tmp_path / "g")], 5) == 1


def test_duplicates_move_to_free_names(spark):
    g = spark.createDataFrame([("/a/x.jpg", True), ("/b/x.jpg", False), ("/c/x.jpg", False)], "path string, is_keep boolean")
    there = spark.createDataFrame([("/dup/x.jpg",)], "path string")
    plan = lambda first: {r["path"]: r["target"] for r in library.duplicates_plan(g, there, "/dup", Scratch(spark, "d"), first).collect()}
    assert plan(True) == {"/b/x.jpg": "/dup/x_1.jpg", "/c/x.jpg": "/dup/x_2.jpg"} and len(set(plan(False).values())) == 3


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["modes"]) == 0 and json.loads(capsys.readouterr().out) == sorted(analysis.ANALYZERS)
    assert cli.main(["--report", str(tmp_path / "r.json"), "config", "--file", str(tmp_path / "s.json"), "--set-dest", "/x"]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["dest_dir"] == "/x"
    for name, tags in (("A", ["x", "y"]), ("B", ["x", "z"])):
        readers.write_category(str(tmp_path / "lib"), name, {"tags": tags}) if (tmp_path / "lib").mkdir(exist_ok=True) is None else None
    code, rows = cli.run(cli.parser().parse_args(["clean-tags", str(tmp_path / "lib"), "--apply", "--threshold", "0.9"]), spark)
    assert code == 0 and {r["category"]: r["removed"] for r in rows} == {"A": ["x"], "B": []}
    assert {r["category"]: r["tags"] for r in readers.categories(spark, str(tmp_path / "lib")).collect()} == {"A": ["y"], "B": ["x", "z"]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jpg").write_bytes(b"same")
    (tmp_path / "m" / "b.jpg").write_bytes(b"same")
    code, rows = cli.run(cli.parser().parse_args(["duplicates", str(tmp_path / "m")]), spark)
    assert code == 0 and sorted(r["is_keep"] for r in rows) == [False, True]
    assert cli.main(["config", "--file", str(tmp_path)]) == 2
