"""Repositories end to end, over real files."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakestrata.cli import run
from lakestrata.config import Config
from lakestrata.errors import MergeConflict, NonFastForward, NotARepository, OptimisticLock, RefConflict, StrataError
from lakestrata.repository import Repository
from lakestrata.sources.files import describe, list_files, open_stream
from lakestrata.sources.versioned import VersionedSource, VirtualFiles, read


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_txt", ".txt")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.fixture
def repo(spark, tmp_path):
    return Repository.init(spark, str(tmp_path / "a"))


@pytest.fixture
def root(repo, tmp_path):
    return tmp_path / "a"


def test_listing_keeps_hidden_files(spark, tmp_path):
    names = ["a.txt", ".dot", "_under.txt", "sub/d.txt", ".hid/e.txt", "_u/f.txt", "data=1.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / ".strata").mkdir()
    (tmp_path / ".strata" / "no").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    assert paths(list_files(spark, str(tmp_path))) == sorted(names)
    assert describe(str(tmp_path / "a.txt"))[0] == 5
    with pytest.raises(ValueError):
        describe(str(tmp_path / "sub"))
    with pytest.raises(FileNotFoundError):
        describe(str(tmp_path / "nope"))
    with open_stream(f"file://{tmp_path}/a.txt") as f:
        assert f.read() == b"a.txt"


def test_commit_log_diff_cat(repo, root):
    put(root, a_txt="alpha", dir__b_txt="beta")
    first = repo.commit("one")
    put(root, a_txt="alpha2", c_txt="new")
    second = repo.commit("two")
    assert [c.id for c in repo.log()] == [second, first]
    assert [c.generation for c in repo.log()] == [1, 0]
    assert [(r["path"], r["change"]) for r in repo.diff(first, second).collect()] == [("a.txt", "modified"), ("c.txt", "added")]
    assert repo.cat("a.txt", first) == b"alpha" and repo.cat("a.txt") == b"alpha2"
    assert paths(repo.entries("main", prefix="d")) == ["dir/b.txt"]
    assert [r["operation"] for r in repo.reflog().collect()] == ["commit", "commit"]
    assert repo.lookup("dir/b.txt")["size"] == 4 and repo.lookup("dir") is None


def test_unchanged_trees_are_shared_and_times_kept(repo, root):
    put(root, a_txt="alpha")
    a = repo.commit("one")
    before = repo.lookup("a.txt")["mtime_ns"]
    put(root, a_txt="alpha")
    b = repo.commit("two")
    assert repo.store.commit(a).tree == repo.store.commit(b).tree
    assert repo.lookup("a.txt")["mtime_ns"] == before


def test_staging(repo, root, tmp_path):
    put(root, a_txt="alpha", dir__b_txt="beta", dir__c_txt="gamma")
    repo.commit("one")
    put(root, z_txt="zeta", dir__b_txt="changed")
    repo.add(["z.txt"], target="0/z.txt")
    repo.rm(["dir"])
    repo.add(["dir/b.txt"])
    assert paths(repo.entries(staged=True)) == ["0/z.txt", "a.txt", "dir/b.txt"]
    status = repo.status()
    assert status.added == ["0/z.txt", "dir/b.txt"] and status.removed == ["dir"]
    assert ("dir/b.txt", "modified") in status.staged_changes
    repo.commit("staged", staged_only=True)
    assert paths(repo.entries()) == ["0/z.txt", "a.txt", "dir/b.txt"]
    assert repo.cat("dir/b.txt") == b"changed"
    assert repo.status().added == []
    with pytest.raises(StrataError, match="nothing is staged"):
        repo.commit("again", staged_only=True)
    with pytest.raises(StrataError, match="blank"):
        repo.commit("  ")
    with pytest.raises(StrataError, match="exactly one"):
        repo.add(["a.txt", "z.txt"], target="x")
    with pytest.raises(StrataError, match="no such file"):
        repo.add(["missing.txt"])


def test_add_folder_and_uri(repo, root, tmp_path):
    put(tmp_path / "out", x_txt="x", sub__y_txt="y")
    repo.add([f"file://{tmp_path}/out"], target="in")
    repo.add([f"file://{tmp_path}/out/x.txt"], identity="meta", target="m.txt")
    repo.commit("external", staged_only=True)
    assert paths(repo.entries()) == ["in/sub/y.txt", "in/x.txt", "m.txt"]
    assert repo.lookup("m.txt")["identity_mode"] == "meta" and repo.cat("m.txt") == b"x"


def test_move_and_remove(repo, root):
    put(root, a_txt="alpha", dir__b_txt="beta", dir__c_txt="gamma")
    repo.commit("one")
    for source, target, error in (("a.txt", "a.txt", "same"), ("dir", "dir/x", "into itself"), ("no", "x", "no entries"), ("a.txt", "dir/b.txt", "already there")):
        with pytest.raises(StrataError, match=error):
            repo.move(source, target, "bad")
    repo.move("dir", "new/dir", "moved")
    assert paths(repo.entries()) == ["a.txt", "new/dir/b.txt", "new/dir/c.txt"]
    repo.mv("new/dir/b.txt", "b.txt")
    repo.commit("staged move", staged_only=True)
    assert paths(repo.entries()) == ["a.txt", "b.txt", "new/dir/c.txt"] and repo.cat("b.txt") == b"beta"
    repo.remove_paths(["new"], "gone")
    assert paths(repo.entries()) == ["a.txt", "b.txt"]
    with pytest.raises(StrataError, match="no entries"):
        repo.remove_paths(["new"], "gone")


def test_branches_and_merge(repo, root):
    put(root, shared_txt="s")
    repo.commit("base")
    repo.branch("feature")
    for bad in ("", "a/b", ".x", "feature"):
        with pytest.raises(StrataError):
            repo.branch(bad)
    repo.checkout("feature")
    put(root, feature_txt="f")
    repo.add(["feature.txt"])
    feature = repo.commit("feature", staged_only=True)
    repo.checkout("main")
    put(root, main_txt="m")
    repo.add(["main.txt"])
    main = repo.commit("main", staged_only=True)
    result = repo.merge("feature")
    assert result.kind == "merge" and repo.store.commit(result.commit_id).parents == (main, feature)
    assert paths(repo.entries()) == ["feature.txt", "main.txt", "shared.txt"]
    assert repo.merge("feature").kind == "up-to-date"
    assert repo.merge("main", "feature").kind == "fast-forward"
    assert repo.merge_base(main, feature) == repo.log()[-1].id
    assert [(r["branch"], r["message"]) for r in repo.catalog().collect()] == [("feature", "Merge feature into main"), ("main", "Merge feature into main")]


def test_merge_conflict_names_paths(repo, root):
    put(root, shared_txt="s")
    repo.commit("base")
    repo.branch("feature")
    put(root, shared_txt="ours")
    repo.commit("ours")
    repo.checkout("feature")
    put(root, shared_txt="theirs")
    repo.commit("theirs")
    with pytest.raises(MergeConflict) as e:
        repo.merge("main")
    assert e.value.paths == ["shared.txt"]


def test_compare_and_set(repo, root, monkeypatch):
    put(root, a_txt="a")
    repo.commit("one")
    head, version = repo.store.ref("main")
    assert repo.store.set_ref("main", head, version) == version + 1
    with pytest.raises(OptimisticLock):
        repo.store.set_ref("main", head, version)
    # Another writer moves the branch while a staged commit is on its way: it is tried again on the new head.
    put(root, b_txt="b")
    repo.add(["b.txt"])
    real, calls = repo.store.put_tree, []

    def racing(entries):
        digest = real(entries)
        if not calls:
            calls.append(1)
            at, n = repo.store.ref("main")
            other = repo._commit_tree(repo.store.commit(at).tree, "other", [at], "main")
            repo.store.set_ref("main", other, n)
        return digest

    monkeypatch.setattr(repo.store, "put_tree", racing)
    repo.commit("staged", staged_only=True)
    assert [c.message for c in repo.log()] == ["staged", "other", "one"]
    calls.clear()
    put(root, c_txt="c")
    with pytest.raises(RefConflict):
        repo.commit("full")


def test_meta_identity_and_verify(repo, root):
    repo.set_config("identity", "meta")
    put(root, a_txt="alpha", d__b_txt="beta")
    repo.commit("meta")
    entry = repo.lookup("a.txt")
    assert entry["identity_mode"] == "meta" and entry["blob_hash"] is None
    assert repo.status(True).worktree == []
    assert repo.verify(dry_run=True).__dict__ == {"commit_id": None, "verified": 0, "candidates": 2, "total": 2}
    result = repo.verify(prefixes=["d"])
    assert (result.verified, result.candidates, result.total) == (1, 1, 2)
    assert repo.lookup("d/b.txt")["identity_mode"] == "content" and repo.lookup("a.txt")["identity_mode"] == "meta"
    (root / "d" / "b.txt").unlink()
    assert repo.cat("d/b.txt") == b"beta"


def test_status_and_restore(repo, root):
    put(root, a_txt="alpha", b_txt="beta")
    repo.commit("one")
    put(root, a_txt="changed", c_txt="new")
    (root / "b.txt").unlink()
    assert repo.status(True).worktree == [("a.txt", "modified"), ("b.txt", "removed"), ("c.txt", "added")]
    assert repo.restore(paths=["a.txt", "b.txt", "unknown"]) == 1
    assert (root / "a.txt").read_text() == "changed" and (root / "b.txt").read_text() == "beta"
    assert repo.restore(paths=["a.txt"], force=True) == 1
    assert (root / "a.txt").read_text() == "alpha"


def test_gc(repo, root):
    put(root, a_txt="alpha")
    repo.commit("one")
    repo.branch("dead")
    repo.checkout("dead")
    put(root, x_txt="orphan")
    repo.commit("two")
    repo.checkout("main")
    repo.store.delete("refs", "heads", "dead")
    assert repo.gc() == {"blob": (1, 1), "commit": (1, 1), "tree": (1, 1)}
    assert repo.gc(dry_run=False) == {}  # all is too new
    assert repo.gc() == {"blob": (1, 1), "commit": (1, 1), "tree": (1, 1)}
    repo.gc(dry_run=False, grace=0)
    assert repo.gc() == {"blob": (1, 0), "commit": (1, 0), "tree": (1, 0)}
    assert repo.cat("a.txt") == b"alpha"


def test_gc_of_statistics_keeps_the_rest(spark, repo, root):
    repo.set_config("parquet_footer", "true")
    table = lambda name, n: pq.write_table(pa.table({"x": list(range(n))}), root / name)
    root.mkdir(exist_ok=True)
    table("a.parquet", 3)
    first = repo.commit("one")
    table("b.parquet", 5)
    repo.commit("two")
    _, version = repo.store.ref("main")
    repo.store.set_ref("main", first, version)
    assert repo.gc()["footer"] == (1, 1)
    repo.gc(dry_run=False, grace=0)
    assert repo.gc()["footer"] == (1, 0) and repo.store.footers().count() == 1
    report = repo.prune("main", "", "x > 9 AND nope = 1 AND x < 100").collect()
    assert [(r["kept"], r["pruned"], r["applicable"], r["inapplicable"]) for r in report] == [([], [0], ["x", "x"], ["nope"])]


def test_listing_of_one_deep_folder_has_many_tasks(spark, tmp_path):
    for i in range(12):
        put(tmp_path / "only" / "one" / f"d{i}", f_txt="x")
    put(tmp_path / "only", g_txt="x")
    found = list_files(spark, str(tmp_path))
    assert found.count() == 13 and found.rdd.getNumPartitions() >= 12
    assert list_files(spark, str(tmp_path / "only" / "one" / "d3")).count() == 1


def test_long_histories_are_read_as_a_table(repo, monkeypatch):
    from lakestrata import repository

    tree = repo.store.put_tree(repo.store.empty())
    ids = []
    for i in range(12):
        ids.append(repo._commit_tree(tree, f"c{i}", ids[-1:], "main"))
    side = repo._commit_tree(tree, "side", [ids[5]], "side")
    top = repo._commit_tree(tree, "top", [ids[-1], side], "main")
    ask = lambda: ([c.id for c in repo.log(top)], repo.is_ancestor(ids[2], top), repo.is_ancestor(side, ids[-1]), repo.merge_base(side, ids[-1]), repo._ancestors(side))
    walked = ask()
    assert walked == ([top, *reversed(ids)], True, False, ids[5], {side, *ids[:6]})
    monkeypatch.setattr(repository, "WALKED", 3)
    assert ask() == walked


def test_manifest_of_a_ref_is_kept(repo, root):
    from lakestrata.sources import manifest

    put(root, a_txt="alpha", d__b_txt="beta")
    repo.commit("one")
    uri = repo.export_manifest()
    assert repo.export_manifest("main") == uri and manifest.lookup(uri, "d/b.txt") and manifest.lookup(uri, "c") is None
    assert manifest.read(repo.spark, uri).count() == 2


def test_diff_reads_changed_directories_only(repo, root, monkeypatch):
    from lakestrata.operators import diff

    put(root, a_txt="alpha", same__b_txt="beta", gone__c_txt="gamma")
    first = repo.commit("one")
    put(root, a_txt="alpha2", new__d_txt="delta")
    repo.commit("two")
    second = repo.remove_paths(["gone"], "three")
    want = [("a.txt", "modified"), ("gone/c.txt", "removed"), ("new/d.txt", "added")]
    asked = lambda: [(r["path"], r["change"]) for r in repo.diff(first, second).collect()]
    assert asked() == want and repo.diff(first, first).count() == 0
    monkeypatch.setattr(diff, "NAMED", 1)
    assert asked() == want
    repo.store.delete("directories", repo.store.commit(first).tree)
    assert asked() == want


def test_object_store_names():
    from lakestrata.sources.files import hadoop_uri, open_fs

    assert hadoop_uri("s3://b/k") == "s3a://b/k" and hadoop_uri("hdfs://h/k") == "hdfs://h/k" and hadoop_uri("/local") == "/local"
    for scheme in ("s3", "s3a"):
        fs, path = open_fs(f"{scheme}://bucket/some/key")
        assert fs.type_name == "s3" and path == "bucket/some/key"


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lakestrata.shared import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))


def test_push_fetch_pull(spark, repo, root, tmp_path):
    put(root, a_txt="alpha")
    repo.commit("one")
    remote = Repository.init(spark, str(tmp_path / "remote"))
    sent = repo.push(remote)
    assert (sent.commits, sent.blobs, sent.moved) == (1, 1, True)
    assert not repo.push(remote).moved and remote.cat("a.txt") == b"alpha"
    clone = Repository.init(spark, str(tmp_path / "clone"))
    assert not clone.fetch(remote).moved and clone.store.ref("main")[0] is None
    assert clone.pull(remote).moved and clone.cat("a.txt") == b"alpha"
    put(tmp_path / "clone", a_txt="alpha", b_txt="beta")
    clone.commit("two")
    clone.push(remote)
    put(root, c_txt="other")
    repo.commit("diverged")
    with pytest.raises(NonFastForward):
        repo.push(remote)
    with pytest.raises(NonFastForward):
        repo.pull(remote)
    lines = [r["command"] for r in repo.transfer_commands("s3://b/x").collect()]
    assert any("blobs/" in x for x in lines) and any("commits/" in x for x in lines)
    back = [r["command"] for r in repo.transfer_commands("s3://b/x", download=True, metadata=False).collect()]
    assert back and all(x.startswith("cp 's3://b/x/blobs/") for x in back)
    seen = []
    other = Repository.init(spark, str(tmp_path / "other"))
    repo.push(other, progress=lambda kind, n: seen.append((kind, n)))
    assert seen == [("blob", 2), ("tree", 2), ("commit", 2)] and other.store.directories(repo.store.commit(repo.resolve()).tree) is not None


def test_import_with_filters(repo, tmp_path):
    put(tmp_path / "in", a_txt="a", sub__b_txt="b")
    (tmp_path / "in" / "c.csv").write_text("c")
    repo.import_source(f"file://{tmp_path}/in", "imported", patterns=["*.txt"])
    assert paths(repo.entries()) == ["a.txt", "sub/b.txt"]
    with pytest.raises(StrataError, match="no files"):
        repo.import_source(f"file://{tmp_path}/in", "none", patterns=["*.zip"])


def test_footers_pruning_and_catalog(spark, repo, root):
    repo.set_config("parquet_footer", "true")
    root.mkdir(exist_ok=True)
    rows = pa.table({"id": range(10240), "lbl": [f"v{i}" for i in range(10240)]})
    pq.write_table(rows, root / "t.parquet", row_group_size=2048)
    put(root, n_txt="no parquet")
    commit = repo.commit("data")
    stats = repo.statistics().filter("col = 'id'").orderBy("rg").collect()
    assert [(r["rows"], r["min_l"], r["max_l"], r["nulls"]) for r in stats][0] == (2048, 0, 2047, 0)
    found = repo.prune("main", "", "id >= 6144").collect()
    assert [(r["path"], r["kept"], r["pruned"]) for r in found] == [("t.parquet", [3, 4], [0, 1, 2])]
    assert repo.scan("main", "t", "id >= 6144 AND lbl = 'v7000'").count() == 1
    repo.move("t.parquet", "u.parquet", "keeps the footer")
    assert repo.lookup("u.parquet")["footer"]
    assert repo.build_catalog(commit) == commit
    assert [r["path"] for r in repo.sql("SELECT path FROM files WHERE path LIKE '%.txt' AND size > 2").collect()] == ["n.txt"]
    assert repo.sql("SELECT count(DISTINCT rg) AS n FROM rg_stats").first()["n"] == 5
    repo.drop_catalog()
    repo.drop_catalog()


def test_views(spark, repo, root):
    put(root, a_txt="alpha", dir__b_txt="beta")
    repo.commit("one")
    put(root, s_txt="staged")
    repo.add(["s.txt"])
    files = VirtualFiles(spark, {"ds": str(root)})
    with files.open("strata://ds@main/dir/b.txt") as f:
        assert f.read() == b"beta"
    assert files.exists("strata://ds@main/a.txt") and not files.exists("strata://ds@main/s.txt")
    assert files.exists("strata://ds@main+staged/s.txt") and not files.exists("strata://ds@main/../x")
    assert files.ls("strata://ds@main+staged/", detail=False) == [f"strata://ds@main/{p}" for p in ("a.txt", "dir/b.txt", "s.txt")]
    assert files.info("strata://ds@main/a.txt")["size"] == 5
    with pytest.raises(FileNotFoundError):
        files.ls("strata://other@main/")
    spark.dataSource.register(VersionedSource)
    df = spark.read.format("strata").option("root", str(root)).option("ref", "main").load()
    assert paths(df) == ["a.txt", "dir/b.txt"]
    assert paths(df.filter(df.path.startswith("dir"))) == ["dir/b.txt"] and paths(df.filter("path = 'a.txt'")) == ["a.txt"]


@pytest.mark.parametrize("allowed", ["false", "true"])
def test_source_whether_or_not_filters_may_be_pushed(spark, repo, root, allowed):
    put(root, a_txt="alpha", dir__b_txt="beta", dir__c_txt="c", other_txt="o")
    repo.commit("one")
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, allowed)
    try:
        spark.dataSource.register(VersionedSource)
        plain = spark.read.format("strata").option("root", str(root)).load()
        for df in (plain, read(spark, str(root))):
            assert len(paths(df)) == 4
            assert paths(df.filter(df.path.startswith("dir"))) == ["dir/b.txt", "dir/c.txt"] and paths(df.filter("path = 'a.txt'")) == ["a.txt"]
            assert paths(df.filter("size = 1")) == ["dir/c.txt", "other.txt"] and paths(df.filter("path = 'a.txt' AND path LIKE 'dir%'")) == []
        assert paths(read(spark, str(root), prefix="dir")) == ["dir/b.txt", "dir/c.txt"]
    finally:
        spark.conf.set(key, before)


def test_source_pushes_filters_where_the_setting_allows_it_when_run(spark, repo, root):
    put(root, a_txt="alpha", dir__b_txt="beta", dir__c_txt="c")
    repo.commit("one")
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.dataSource.register(VersionedSource)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    try:
        for asked in "true", "false":
            for run in "true", "false":
                for load in lambda: spark.read.format("strata").option("root", str(root)).load(), lambda: read(spark, str(root)):
                    spark.conf.set(key, asked)
                    df = load().filter("path LIKE 'dir%'")
                    spark.conf.set(key, run)
                    assert paths(df) == ["dir/b.txt", "dir/c.txt"]
                    assert ("Filter StartsWith" in plan(df)) == (run == "false")
    finally:
        spark.conf.set(key, before)


def test_reflog_stream(spark, repo, root, tmp_path):
    from lakestrata.streaming.reflog import activity, updates

    for text in ("1", "2", "3"):
        put(root, a_txt=text)
        repo.commit(text)
    stream = updates(repo.store, "main")
    query = stream.writeStream.format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("updates").count() == 3
    query = activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("activity").groupBy().sum("updates").first()[0] == 3


def test_config_and_errors(spark, tmp_path):
    with pytest.raises(NotARepository):
        Repository.open(spark, str(tmp_path))
    for text, error in (('{"format_version": 9}', "newer"), ('{"format_version": 0}', "no longer"), ("{", "unreadable"), ('{"format_version": 1, "x": 1}', "unknown")):
        with pytest.raises(StrataError, match=error):
            Config.loads(text)
    for key, value in (("identity", "x"), ("nope", "1"), ("s3.nope", "1"), ("parquet_footer", "maybe"), ("backend", "s3")):
        with pytest.raises(StrataError):
            Config().with_value(key, value)
    assert dict(Config().with_value("s3.prefix", "p").items())["s3.prefix"] == "p"


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "r"
    put(root, a_txt="alpha")

    def do(*argv, code=0):
        assert run([*argv[:1], *argv[1:], "--repo", str(root)], spark) == code
        return capsys.readouterr()

    assert "fatal:" in do("log", code=1).err
    do("init")
    first = json.loads(do("commit", "-m", "one", "--json").out)["commit"]
    put(root, b_txt="beta")
    do("add", "b.txt")
    assert "staged added: b.txt" in do("status").out
    do("commit", "-m", "two", "--staged")
    assert do("diff", first, "main").out == "A b.txt\n"
    assert [x["path"] for x in json.loads(do("list", "--json").out)] == ["a.txt", "b.txt"]
    assert len(json.loads(do("log", "--json").out)) == 2
    do("branch", "f")
    do("checkout", "f")
    do("mv", "a.txt", "c.txt", "-m", "moved")
    do("checkout", "main")
    assert "fast-forward" in do("merge", "f").out
    do("rm", "c.txt", "-m", "gone")
    assert "2 branches" not in do("catalog").out
    assert "orphaned" in do("gc").out
    assert run(["query", "sql", "SELECT path FROM files", "--repo", str(root)], spark) == 0
    assert capsys.readouterr().out == "path\nb.txt\n"
    assert run(["query", "prune", "main", "", "--where", "a = 1 OR b = 2", "--repo", str(root)], spark) == 1
    assert "query prune error:" in capsys.readouterr().err
    assert run(["config", "set", "identity", "meta", "--repo", str(root)], spark) == 0
    assert run(["config", "list", "--repo", str(root)], spark) == 0
    assert "identity = meta" in capsys.readouterr().out
    assert "verified 0 of 0" in do("verify", "--dry-run").out
    assert "restored" in do("restore", "--force").out
    assert len(do("reflog").out.splitlines()) == 4
    other = tmp_path / "other"
    Repository.init(spark, str(other))
    assert "commits" in do("push", str(other)).out
    assert "cp " in do("transfer", "s3://x/y").out
    assert run(["query", "build", "--parquet", "--output-dir", str(tmp_path / "cat"), "--repo", str(root)], spark) == 0
