"""Paths, globs, keys and URIs."""

from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakestrata.functions import paths as p

GOOD = {"foo/bar": "foo/bar", "foo/bar/": "foo/bar", "  foo/bar  ": "foo/bar", "file.txt": "file.txt", "a/b/c/d.txt": "a/b/c/d.txt", "...": "...", "a..b/c": "a..b/c"}
BAD = {
    "/foo/bar/": "cannot be absolute", "": "cannot be empty", "  ": "cannot be empty", ".": "cannot traverse", "..": "cannot traverse",
    "../foo": "cannot traverse", "foo/../bar": "cannot traverse", "foo/..": "cannot traverse", "/etc/passwd": "cannot be absolute",
    "foo\0bar": "null bytes", "foo\nbar": "control characters", "foo\tbar": "control characters", "foo//bar": "empty components",
}


@pytest.mark.parametrize("raw", GOOD)
def test_normalizes(raw):
    assert p.normalize_path(raw) == GOOD[raw]


@pytest.mark.parametrize("raw", BAD)
def test_rejects(raw):
    with pytest.raises(ValueError, match=BAD[raw]):
        p.normalize_path(raw)
    with pytest.raises(ValueError, match=BAD[raw]):
        p.normalize_patterns([raw])


def test_lists():
    assert p.normalize_paths(["b", "a/", "b"]) == ["b", "a"]
    assert p.normalize_patterns(None) == [] and p.normalize_patterns(["data/*"]) == ["data/*"]


def test_column_rules(spark):
    rows = [(x,) for x in [*GOOD, *BAD, "a/./b", "a\\b", "é/ü"]]
    df = spark.createDataFrame(rows, "path string")
    got = {r["path"]: r["ok"] for r in df.select("path", p.is_entry_path(df.path).alias("ok")).collect()}
    assert {k for k, ok in got.items() if ok} == {"foo/bar", "  foo/bar  ", "file.txt", "a/b/c/d.txt", "...", "a..b/c", "é/ü", "  "}


def test_prefixes(spark):
    df = spark.createDataFrame([("dir_0",), ("dir_0/x",), ("dir_000/x",)], "path string")
    assert [r["path"] for r in df.filter(p.under(df.path, "dir_0")).collect()] == ["dir_0", "dir_0/x"]
    assert df.select(p.ancestors(df.path).alias("a")).collect()[1]["a"] == ["dir_0", "dir_0/x"]


names = st.text("ab.", min_size=1, max_size=3).filter(lambda s: s not in (".", ".."))
globs = st.lists(st.text("ab*?.", min_size=1, max_size=3).filter(lambda s: s not in (".", "..") and "**" not in s), min_size=1, max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(names, min_size=1, max_size=4), globs, st.booleans())
def test_globs_match_as_paths_do(parts, pattern, anywhere):
    import re

    glob = "/".join(["**"] * anywhere + pattern)
    path = PurePosixPath("/".join(parts))
    want = path.match(glob) or (anywhere and len(path.parts) == 1 and len(pattern) == 1 and path.match(pattern[0]))
    assert bool(re.search(p.glob_regex(glob), str(path))) == bool(want), (glob, path)


def test_glob_classes(spark):
    df = spark.createDataFrame([("a1.txt",), ("ab.txt",), ("x/a2.txt",), ("a[.txt",)], "path string")
    find = lambda g: [r["path"] for r in df.filter(p.matches_glob(df.path, [g])).collect()]
    assert find("a[0-9].txt") == ["a1.txt", "x/a2.txt"] and find("a[!0-9].txt") == ["ab.txt", "a[.txt"] and find("x/*") == ["x/a2.txt"]
    assert len(df.filter(p.matches_glob(df.path, [])).collect()) == 4


def test_keys(spark):
    rows = [("in/a.txt", 1), ("in/sub/", 0), ("in", 5), ("/in/b/c", 2), ("in/", 0)]
    df = spark.createDataFrame(rows, "key string, size long")
    assert [r["p"] for r in df.select(p.relative_key(df.key, df["size"], "in/").alias("p")).collect()] == ["a.txt", None, "in", "b/c", None]
    bad = spark.createDataFrame([("other/x", 1)], "key string, size long")
    with pytest.raises(Exception, match="outside import prefix"):
        bad.select(p.relative_key(bad.key, bad["size"], "in").alias("p")).collect()


def test_uris():
    assert p.parse_uri("strata://ds@main/path/to/file.txt") == p.DatasetURI("ds", "main", "path/to/file.txt")
    assert p.parse_uri("strata://ds@feature+staged/path") == p.DatasetURI("ds", "feature", "path", True)
    assert p.parse_uri("strata://ds@main", allow_empty_path=True).path == "" == p.parse_uri("strata://ds@main/", allow_empty_path=True).path
    assert p.parse_uri("strata://ds@feat/ure/path") == p.DatasetURI("ds", "feat", "ure/path")
    assert p.parse_uri("strata://ds@main//foo/bar").path == "foo/bar"


@pytest.mark.parametrize("uri, error", [
    ("", "cannot be empty"), ("strata://ds", "must include a ref"), ("strata://@main/path", "dataset cannot be empty"), ("strata://ds@/path", "ref cannot be empty"),
    ("strata://ds@+staged/path", "ref cannot be empty"), ("strata://ds@main", "must include a logical file path"), ("strata://ds/sub@main/path", "dataset cannot contain path separators"),
    ("strata://..@main/path", "dataset"), ("strata://.@main/path", "dataset"), ("strata://ds@../path", "ref"), ("strata://ds@main/../etc/passwd", "cannot traverse"),
    ("strata://ds\0@main/path", "null bytes"), ("strata://ds@ma\0in/path", "null bytes"), ("strata://ds\n@main/path", "control characters"), ("strata://ds@main/foo//bar", "empty components"),
])
def test_bad_uris(uri, error):
    with pytest.raises(ValueError, match=error):
        p.parse_uri(uri)
