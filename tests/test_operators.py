"""Snapshot, merge, pruning and graph operators against small models."""

import random

import pytest
from pyspark.sql import functions as F

from lakestrata import schema
from lakestrata.functions.identity import content_hash, meta_hash_of
from lakestrata.operators import diff, graph, merge, prune, snapshot, tree


def entries(spark, rows):
    """Entries of {path: content}; content 'meta:n' is a meta entry of n bytes."""
    out = []
    for path, text in rows.items():
        if text.startswith("meta:"):
            n = int(text[5:])
            out.append((path, meta_hash_of(path, n), n, 1, "meta", None, f"mem://{path}", None))
        else:
            digest = f"{abs(hash(text)) % 16**12:064x}"
            out.append((path, digest, len(text), 1, "content", digest, None, None))
    return spark.createDataFrame(out, schema.ENTRY)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


# base, ours, theirs -> result, conflict
TRUTH = {
    "same": ("b", "x", "x", "x", False), "same-new": (None, "x", "x", "x", False), "theirs-edits": ("b", "b", "t", "t", False),
    "ours-edits": ("b", "o", "b", "o", False), "both-edit": ("b", "o", "t", "o", True), "both-add": (None, "o", "t", "o", True),
    "ours-adds": (None, "o", None, "o", False), "theirs-removes": ("b", "b", None, None, False), "edit-remove": ("b", "o", None, "o", True),
    "theirs-adds": (None, None, "t", "t", False), "ours-removes": ("b", None, "b", None, False), "remove-edit": ("b", None, "t", "t", True),
    "both-remove": ("b", None, None, None, False), "untouched": ("b", "b", "b", "b", False),
}


def test_merge_truth_table(spark):
    sides = [entries(spark, {k: row[i] for k, row in TRUTH.items() if row[i] is not None}) for i in range(3)]
    merged = {r["path"]: (r["hash"], r["conflict"]) for r in merge.three_way_merge(*sides).collect()}
    by_text = {t: r["hash"] for t in "bxot" for r in entries(spark, {"p": t}).collect()}
    assert merged == {k: (by_text[row[3]], row[4]) for k, row in TRUTH.items() if row[3] is not None}
    assert paths(merge.conflicts(*sides)) == sorted(k for k, row in TRUTH.items() if row[4])


def test_random_diff_and_merge(spark):
    rng = random.Random(1)
    for _ in range(3):
        three = [{f"d{i % 5}/f{i}": rng.choice("abc") for i in range(40) if rng.random() < 0.7} for _ in range(3)]
        b, o, t = three
        got = {r["path"]: r["change"] for r in diff.diff(entries(spark, b), entries(spark, o)).collect()}
        assert got == {p: "added" if p not in b else "removed" if p not in o else "modified" for p in {*b, *o} if b.get(p) != o.get(p)}
        merged = {r["path"]: r["hash"] for r in merge.three_way_merge(*(entries(spark, x) for x in three)).collect()}
        want = {}
        for p in {*b, *o, *t}:
            x, y, z = b.get(p), o.get(p), t.get(p)
            pick = y if y == z or z == x else z if y == x else y or z
            if pick:
                want[p] = pick
        assert set(merged) == set(want)


def test_order_traps(spark):
    parent = entries(spark, {"a/x": "1", "a.txt": "2", "data/x": "3", "data-1/y": "4"})
    out = snapshot.overlay(parent, entries(spark, {"0": "n", "a/x": "new", "data/y": "kept"}), ["data"])
    assert paths(out) == ["0", "a.txt", "a/x", "data-1/y", "data/y"]
    by_table = snapshot.remove(parent, spark.createDataFrame([("data",), ("a.txt",)], "path string"))
    assert paths(by_table) == ["a/x", "data-1/y"]
    assert paths(snapshot.select_under(parent, spark.createDataFrame([("data",)], "path string"))) == ["data/x"]


def test_move_keeps_content_identity_and_renews_meta(spark):
    out = {r["path"]: r for r in snapshot.move(entries(spark, {"d/a": "x", "d/m": "meta:7", "e": "y"}), "d", "n/d").collect()}
    assert set(out) == {"n/d/a", "n/d/m", "e"} and out["n/d/m"]["hash"] == meta_hash_of("n/d/m", 7)
    assert schema.violations(snapshot.move(entries(spark, {"d/m": "meta:7"}), "d", "f")).count() == 0


def test_invariants(spark):
    good = {"path": "a", "hash": "0" * 64, "size": 1, "mtime_ns": 1, "identity_mode": "content", "blob_hash": None, "source_uri": None, "footer": None}
    bad = [{"path": "../a"}, {"path": "/a"}, {"path": "a//b"}, {"hash": "X" * 64}, {"hash": "0" * 63}, {"size": -1}, {"mtime_ns": -1}, {"identity_mode": "x"}, {"identity_mode": "meta"}, {"blob_hash": "1" * 64}, {"footer": "1" * 64}, {"source_uri": " "}]
    for change in bad:
        df = spark.createDataFrame([{**good, **change}], schema.ENTRY)
        assert schema.violations(df).count() >= 1, change
    assert schema.violations(spark.createDataFrame([good], schema.ENTRY)).count() == 0
    assert [r["rule"] for r in schema.violations(spark.createDataFrame([good, good], schema.ENTRY)).collect()] == ["unique"]


def test_prefix_filter_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "snap")
    entries(spark, {f"d{i}/f": "x" for i in range(50)}).orderBy("path").write.parquet(path)
    plan = snapshot.with_prefix(snapshot.scan(spark, path), "d1").select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,d1)" in plan and "blob_hash" not in plan
    plan = snapshot.lookup(snapshot.scan(spark, path), "d1/f")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path,d1/f)" in plan


def test_merkle(spark):
    one = {"a/b/c": "1", "a/d": "2", "e": "3", "f/g": "4"}
    digests = lambda rows: {r["dir"]: r["digest"] for r in tree.merkle(entries(spark, rows), 2).collect()}
    a, b = digests(one), digests({**one, "a/b/c": "changed"})
    assert set(a) == {"", "a", "a/b", "f"}
    assert a["f"] == b["f"] and all(a[d] != b[d] for d in ("", "a", "a/b"))
    assert tree.root_digest(entries(spark, one)) == a[""] and tree.depth_of(entries(spark, one)) == 2
    assert len(tree.root_digest(entries(spark, {"x": "1"}).limit(0))) == 64


def test_deep_and_wide_trees_fold_alike(spark, monkeypatch):
    rows = {"/".join(f"d{j % 3}" for j in range(i % 7)) + f"/f{i}": "x" for i in range(60)}
    rows = {p.lstrip("/"): t for p, t in rows.items()}
    few = {r["dir"]: r["digest"] for r in tree.merkle(entries(spark, rows), 6).collect()}
    monkeypatch.setattr(tree, "FEW", 0)
    plans = []
    real = tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")) or real(df, label))
    by_level = {r["dir"]: r["digest"] for r in tree.merkle(entries(spark, rows), 6).collect()}
    assert by_level == few and set(few) == {"/".join(p.split("/")[:i]) for p in rows for i in range(len(p.split("/")))}
    assert max(plans) <= 1 + sum(range(tree.LEVELS + 1)) + tree.LEVELS  # whatever the depth
    assert tree._folded_rows([("/".join("x" * 500), "f00", "0" * 64)])[""]


def groups(spark, rows, **lanes):
    """RG_STATS of one column c: (rows, min, max, nulls) for each group."""
    out = []
    for i, (n, least, most, nulls) in enumerate(rows):
        lane = {bool: "b", int: "l", float: "d", str: "s"}[type(least)] if least is not None else None
        out.append({"path": "f", "footer": "0", "rg": i, "rows": n, "col": "c", "typ": "x", **({f"min_{lane}": least, f"max_{lane}": most} if lane else {}), "nulls": nulls, "exact": True, **lanes})
    return spark.createDataFrame([{**dict.fromkeys(schema.RG_STATS.fieldNames()), **r} for r in out], schema.RG_STATS)


RANGES = [(100, 0, 99, 0), (100, 100, 199, 0), (100, 200, 299, 0)]
CASES = [
    ("c >= 100 AND c < 200", RANGES, [1]), ("c = 150", RANGES, [1]), ("c = 400", RANGES, []), ("c < 100", RANGES, [0]), ("c <= 100", RANGES, [0, 1]), ("c > 199", RANGES, [2]),
    ("c >= 99.5", RANGES, [1, 2]), ("c != 5", [(10, 5, 5, 0), (10, 5, 6, 0), (10, 5, 5, 2)], [1, 2]), ("c IS NULL", [(100, 0, 9, 10), (100, 0, 9, 0), (100, None, None, 100)], [0, 2]),
    ("c IS NOT NULL", [(100, 0, 9, 10), (100, None, None, 100)], [0]), ("c IS NULL", [(5, 0, 9, None)], [0]), ("other = 1", RANGES, [0, 1, 2]), ("c = 'abc'", RANGES, [0, 1, 2]),
    ("c = true", RANGES, [0, 1, 2]), ("c = true", [(1, False, False, 0), (1, False, True, 0)], [1]), ("c = 'm'", [(1, "a", "k", 0), (1, "l", "z", 0)], [1]),
    ("c = 3", [(1, 1.0, 2.5, 0), (1, 2.5, 3.5, 0)], [1]), ("c = null", RANGES, [0, 1, 2]), ("c > 5", [(1, None, None, 0)], [0]),
]


@pytest.mark.parametrize("where, stats, kept", CASES)
def test_pruning(spark, where, stats, kept):
    assert prune.prune(groups(spark, stats), prune.parse_where(where)).first()["kept"] == kept


def test_truncated_bounds_decide_no_inequality(spark):
    assert prune.prune(groups(spark, [(9, "ab", "ab", 0)], exact=False), prune.parse_where("c != 'ab'")).first()["kept"] == [0]


def test_where():
    P = prune.Predicate
    assert prune.parse_where("id >= 100 AND active = true AND name = 'foo bar'") == [P("id", ">=", 100), P("active", "=", True), P("name", "=", "foo bar")]
    assert prune.parse_where("a IS  NULL and b is not null") == [P("a", "IS NULL"), P("b", "IS NOT NULL")]
    assert prune.parse_where("x <> 1.5 AND y.z = \"q AND 'r'\"") == [P("x", "!=", 1.5), P("y.z", "=", "q AND 'r'")]
    assert prune.parse_where("a = 'it''s' AND b=-3 AND c = word AND d = 'x OR y'")[0::3] == [P("a", "=", "it's"), P("d", "=", "x OR y")]
    for bad in ("", "  ", "id =", "a = 1 OR b = 2", "= 3", "a IS", "a IS NOT 3", "a = 1 AND", "a 1", "a = 'x"):
        with pytest.raises(ValueError):
            prune.parse_where(bad)


def commits(spark, parents):
    level = {}
    for c, ps in parents.items():
        level[c] = max((level[p] + 1 for p in ps), default=0)
    return spark.createDataFrame([(c, ps, level[c]) for c, ps in parents.items()], "id string, parents array<string>, generation int")


def test_graph(spark):
    dag = commits(spark, {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["c", "d"], "f": ["e"], "x": []})
    head = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert [(r["id"], r["distance"]) for r in graph.first_parent_log(dag, head("f")).orderBy("distance").collect()] == [("f", 0), ("e", 1), ("c", 2), ("b", 3), ("a", 4)]
    assert sorted(r["id"] for r in graph.ancestors(dag, head("f", "x")).collect()) == list("abcdefx")
    assert [r["id"] for r in graph.merge_base(dag, head("c"), head("d")).collect()] == ["b"]
    assert [r["id"] for r in graph.merge_base(dag, head("f"), head("d")).collect()] == ["d"]
    assert graph.merge_base(dag, head("f"), head("x")).count() == 0
    assert graph.ancestors(dag, head("nowhere")).count() == 0
    assert sorted(r["id"] for r in graph.commits_to_push(dag, head("f"), head("a", "b", "c")).collect()) == ["d", "e", "f"]


def test_long_chain(spark):
    chain = commits(spark, {str(i): [str(i - 1)] if i else [] for i in range(400)})
    assert graph.first_parent_log(chain, spark.createDataFrame([("399",)], "id string")).count() == 400


def test_hash_agrees_with_python(spark):
    import hashlib

    row = spark.createDataFrame([("é\n",)], "t string").select(content_hash(F.col("t").cast("binary")).alias("h")).first()
    assert row["h"] == hashlib.sha256("é\n".encode()).hexdigest()


def test_manifest_lines(spark, tmp_path):
    from lakestrata.sources import manifest

    rows = entries(spark, {'odd "name"\\t': "x", "b": "y", "m/é": "meta:9"}).filter("path not like '%\\\\\\\\%'")
    with_footer = rows.withColumn("footer", F.when(F.col("path") == "b", F.lit("f" * 64)))
    manifest.write(with_footer, str(tmp_path / "m"))
    back = manifest.read(spark, str(tmp_path / "m"))
    assert sorted(map(str, back.select(schema.ENTRY_COLUMNS).collect())) == sorted(map(str, with_footer.select(schema.ENTRY_COLUMNS).collect()))
    (tmp_path / "bad.txt").write_text('["b","ok","' + "0" * 64 + '",1,2]\n\n{"no"\n["b","short"]\n["m","p","' + "0" * 64 + '","x",2,"u"]\n')
    found = manifest.read(spark, str(tmp_path / "bad.txt"), strict=False)
    assert found.filter("corrupt is null").count() == 1 and found.filter("corrupt is not null").count() == 3
    with pytest.raises(ValueError, match=r"corrupt manifest line: .*bad\.txt:[346]: "):
        manifest.read(spark, str(tmp_path / "bad.txt")).collect()


def test_manifest_lookup(spark, tmp_path):
    from lakestrata.sources import manifest

    rows = {f"d{i % 7}/{'long' * (i % 40)}{i}": "x" for i in range(300)}
    manifest.write(entries(spark, rows), str(tmp_path / "m"))
    for path in rows:
        assert manifest.lookup(str(tmp_path / "m"), path).startswith(f'["b","{path}",')
    for path in ("a", "z", "d1", "d3/longlong"):
        assert manifest.lookup(str(tmp_path / "m"), path) is None
    assert manifest.lookup(str(tmp_path / "none"), "a") is None


def test_intermediate_tables_can_be_discarded(spark):
    import os

    from lakestrata.shared import discard, materialize

    discard(spark)
    kept = materialize(spark.range(5).toDF("n"), "five")
    path = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 5 and os.path.isdir(path)
    assert discard(spark) == 1 and not os.path.exists(path)
