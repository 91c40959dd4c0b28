from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from linehaul.operators.search import (
    count_lines,
    count_lines_by_file,
    search_lines,
    search_lines_by_file,
)
from linehaul.sources import lines, listing
from linehaul.sources.lines import full_match, list_files, list_objects, read_lines, s3a_options


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\nabc\nxyz")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"q\r\nr\rs\n")
    (tmp_path / "_h.txt").write_bytes(b"ab\n")
    return tmp_path


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_one_file(spark, folder):
    lines = read_lines(spark, str(folder / "a.txt"))
    assert pairs(lines) == [("a.txt", "ab"), ("a.txt", "abc"), ("a.txt", "xyz")]
    assert search_lines(lines, "ab").first().n_matching == 2
    assert search_lines(lines, "").first().n_matching == 3
    assert search_lines(lines, "AB").first().n_matching == 0
    assert search_lines(lines, "a.").first().n_matching == 0


def test_folder_counts_every_file(spark, folder):
    lines, files = read_lines(spark, str(folder)), list_files(spark, str(folder))
    assert pairs(search_lines_by_file(lines, "ab", files)) == [
        ("a.txt", 2),
        ("b.txt", 0),
        ("c.txt", 0),
    ]
    assert pairs(search_lines_by_file(lines, "r")) == [("a.txt", 0), ("c.txt", 1)]
    assert count_lines(lines).first().n_lines == 6
    assert pairs(count_lines_by_file(lines)) == [("a.txt", 3), ("c.txt", 3)]


def test_missing_folder_is_no_failure(spark, tmp_path, caplog):
    lines = read_lines(spark, str(tmp_path / "none"))
    assert lines.columns == ["file", "line"] and lines.count() == 0
    assert "no files in" in caplog.text
    files = list_files(spark, str(tmp_path / "none"))
    assert pairs(search_lines_by_file(lines, "a", files)) == []


def test_key_regex_matches_whole_key_and_prunes_files(spark, tmp_path):
    names = ["x/a1.csv", "x/a2.csv", "x/deep/a3.csv", "y/a1.csv", "y/b+c d%.csv", "a1.csv.bak"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"{n}\n")

    def found(regex):
        lines = read_lines(spark, str(tmp_path), regex, recursive=True)
        got = pairs(lines)
        assert all(f == line for f, line in got)
        return sorted(f for f, _ in got)

    assert found(None) == sorted(names)
    assert found("a1") == []
    assert found(r"x/a\d\.csv") == ["x/a1.csv", "x/a2.csv"]
    assert found(r"x/.*|y/b\+c d%\.csv") == sorted(names[:3] + names[4:5])

    lines = read_lines(spark, str(tmp_path), r"y/.*", recursive=True)
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 2


def test_escaped_characters_in_the_folder(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    (folder / "x y").mkdir(parents=True)
    (folder / "x y" / "é%.txt").write_text("1\n")
    (folder / "z+.txt").write_text("2\n3\n")
    lines = read_lines(spark, str(folder), recursive=True)
    files = list_files(spark, str(folder), recursive=True)
    want = [("x y/é%.txt", 1), ("z+.txt", 2)]
    assert pairs(count_lines_by_file(lines)) == want
    assert sorted(r.file for r in files.collect()) == [f for f, _ in want]


def test_patterns_and_lists_of_paths(spark, tmp_path):
    for n in ("g/x1/f.txt", "g/x2/f.txt", "g/y/f.txt", "h/k.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"{n}\n")
    pattern = f"{tmp_path}/g/x*/f.txt"
    assert sorted(pairs(read_lines(spark, pattern))) == [
        ("x1/f.txt", "g/x1/f.txt"), ("x2/f.txt", "g/x2/f.txt"),
    ]
    assert pairs(read_lines(spark, pattern, r"x2/.*")) == [("x2/f.txt", "g/x2/f.txt")]
    both = f"{tmp_path}/g/{{x1,y}},{tmp_path}/h/k.txt"
    assert sorted(pairs(read_lines(spark, both))) == [
        ("k.txt", "h/k.txt"), ("x1/f.txt", "g/x1/f.txt"), ("y/f.txt", "g/y/f.txt"),
    ]
    assert sorted(r.file for r in list_files(spark, both).collect()) == ["k.txt", "x1/f.txt", "y/f.txt"]
    found = list_files(spark, str(tmp_path / "g"), r"y/.*", recursive=True)
    assert pairs(found) == [("y/f.txt",)]


def test_a_path_relative_to_the_working_folder(spark, folder, monkeypatch):
    relative = os.path.relpath(folder)
    assert sorted({f for f, _ in pairs(read_lines(spark, relative))}) == ["a.txt", "c.txt"]


def test_lines_without_their_file(spark, folder):
    lines = read_lines(spark, str(folder), with_file=False)
    assert lines.columns == ["line"] and lines.count() == 6
    assert "file_path" not in lines._jdf.queryExecution().executedPlan().toString()
    some = read_lines(spark, str(folder), r"a\..*", with_file=False)
    assert sorted(r.line for r in some.collect()) == ["ab", "abc", "xyz"]
    assert read_lines(spark, str(folder / "none"), with_file=False).columns == ["line"]


def test_full_match_has_no_anchor_surprises(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",), ("b",)], "k string")
    got = [r.m for r in df.select(full_match("k", "a|ab").alias("m")).collect()]
    assert got == [True, False, False, False] or got == [True] + [False] * 3


def test_object_store_options():
    o = s3a_options("id", "secret", region="us-west-1")
    assert o == {
        "fs.s3a.access.key": "id",
        "fs.s3a.secret.key": "secret",
        "fs.s3a.connection.maximum": "5000",
        "fs.s3a.endpoint.region": "us-west-1",
    }
    assert s3a_options() == {"fs.s3a.connection.maximum": "5000"}


def test_reader_options_reach_the_file_system(spark, folder):
    lines = read_lines(spark, str(folder), options=s3a_options("id", "secret"))
    assert lines.count() == 6


def test_a_file_with_most_lines_is_counted_in_parts(spark):
    lines = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("file"),
        F.lit("some text").alias("line"),
    )
    by_file = search_lines_by_file(lines, "text")
    assert by_file.filter("file = 'hot'").first().n_matching == 20_000
    plan = by_file._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_listing_in_tasks_agrees_with_the_index(spark, tmp_path):
    names = ["a.txt", "x/b.txt", "x/y/c d%é+.txt", "x/y/z/e.txt", "_h/i.txt", "x/.k.txt", "x/_l.txt", "p=1/m.txt", "p=1/q=2/n.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "x" / "empty.txt").touch()
    for path, recursive in [("", True), ("/x", False), ("/x", True), ("/x/y/*", True), ("/{x,p=1}/*.txt", False), ("/x/[!b]*.txt", False), ("/?/b.txt", False)]:
        path = str(tmp_path) + path
        index = lines._indexed(spark, [path], recursive, None)
        key = lines.object_key(F.col("uri"), lines._root(spark, path))
        want = sorted(r.file for r in index.select(key.alias("file")).collect())
        got = list_objects(spark, path, recursive=recursive).collect()
        assert sorted(r.file for r in got) == want and want, path
        assert all(r.length == (0 if r.file.endswith("empty.txt") else (tmp_path / r.file).stat().st_size) for r in got if path == str(tmp_path))


def test_many_files_are_listed_by_tasks(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"d{k}").mkdir()
        for n in range(100):
            (tmp_path / f"d{k}" / f"{n}.txt").touch()
    listed = list_objects(spark, str(tmp_path), recursive=True)
    assert listed.count() == 2000 and listed.agg(F.sum("length")).first()[0] == 0
    # The names come from files that tasks wrote; the plan holds none of them.
    assert "LocalTableScan" not in listed._jdf.queryExecution().executedPlan().toString()
    assert listing.root_of("viewfs://x/y") is None and listing.root_of("file:/a/{b/c,d}") is None
