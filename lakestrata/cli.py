"""The command line: `python -m lakestrata <command>`. Errors print `<command> error: ...` and exit with 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import SparkSession

from .config import Config, S3Options
from .errors import NotARepository
from .repository import Repository

VERSION = "0.1.0"
COMMANDS: dict[str, Callable] = {}


def command(f: Callable) -> Callable:
    COMMANDS[f.__name__.rstrip("_").replace("_", " ")] = f
    return f


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lakestrata", description="Versioned datasets on Spark.")
    parser.add_argument("--version", action="version", version=f"lakestrata {VERSION}")
    commands = parser.add_subparsers(dest="command", required=True, metavar="command")

    def add(name: str, help_: str, *arguments: tuple, parent=commands) -> argparse.ArgumentParser:
        p = parent.add_parser(name, help=help_)
        p.add_argument("--repo", default=".", help="repository root")
        p.add_argument("--json", action="store_true", help="print structured JSON")
        for names, options in arguments:
            p.add_argument(*names.split(), **options)
        return p

    text = lambda names, **o: (names, o)
    flag = lambda names, help_: (names, {"action": "store_true", "help": help_})
    message = text("-m --message", required=True, help="commit message")
    add("commit", "commit the working tree and the stage", message, flag("--staged", "commit the stage alone"), text("--import", dest="import_uri", help="commit the files below a URI instead"), text("--path", action="append", default=[], help="glob filter of an import"), text("--identity", choices=("content", "meta")))
    add("add", "stage files, folders or URIs", text("paths", nargs="+"), text("--as", dest="target", help="path to stage one source under"), text("--identity", choices=("content", "meta")))
    add("rm", "stage removals, or commit them with a message", text("paths", nargs="+"), text("-m --message"))
    add("mv", "stage a rename, or commit it with a message", text("source"), text("target"), text("-m --message"))
    add("status", "staged changes, and changed files", flag("--working-tree", "compare the working files"))
    add("branch", "create a branch", text("name"))
    add("diff", "changes between two refs", text("before"), text("after"))
    add("merge", "merge a ref into a branch", text("source"), text("--into"), text("-m --message"))
    add("verify", "read sources and store the bytes of unverified entries", text("prefixes", nargs="*"), text("--ref"), flag("--dry-run", "count only"))
    add("gc", "count, or delete, what no branch reaches", flag("--delete", "delete orphans"), text("--grace", type=float, default=24.0, help="hours for which new objects are left alone"))
    query = commands.add_parser("query", help="catalog and pruning").add_subparsers(dest="query", required=True)
    add("build", "export the catalog of the current branch", text("--output-dir"), flag("--parquet", "write files as parquet"), parent=query)
    add("prune", "row groups that can hold matching rows", text("ref"), text("path"), text("--where", required=True), parent=query)
    add("sql", "run SQL over files, entries, commits, refs, reflog, rg_stats", text("sql"), text("--ref"), parent=query)
    add("log", "first-parent history", text("ref", nargs="?"))
    add("list", "entries of the current branch", text("path", nargs="?", default=""), flag("--staged", "with staged changes"), text("--ref"))
    add("cat", "print a file's bytes", text("path"), text("--ref"))
    add("reflog", "moves of a branch, newest first", text("branch", nargs="?"))
    add("catalog", "branches and their commits")
    add("checkout", "make a branch current", text("branch"))
    add("restore", "write files of a ref", text("paths", nargs="*"), text("--ref"), flag("--force", "overwrite"))
    add("init", "create a repository", text("--branch", default="main"))
    config = commands.add_parser("config", help="settings").add_subparsers(dest="config", required=True)
    add("init", "write default settings", text("--backend", default="local"), text("--bucket", default=""), text("--prefix", default=""), parent=config)
    add("set", "change a setting", text("key"), text("value"), parent=config)
    add("list", "print settings", parent=config)
    for name in ("push", "pull", "fetch"):
        add(name, f"{name} a branch", text("remote"), text("branch", nargs="?"))
    add("transfer", "print the copy commands of a ref", text("target"), text("--ref"), flag("--download", "copy from the target"), flag("--blobs-only", "leave out snapshot, statistics and commit"))
    return parser


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _show(args, payload, lines) -> None:
    if args.json:
        print(json.dumps(payload, indent=2, default=str))
    else:
        for line in lines:
            print(line)


@command
def commit(repo, a):
    if a.import_uri:
        found = repo.import_source(a.import_uri, a.message, a.identity, a.path)
    else:
        found = repo.commit(a.message, a.staged)
    _show(a, {"commit": found, "branch": repo.branch_name}, [found])


@command
def add(repo, a):
    found = repo.add(a.paths, a.identity, a.target)
    _show(a, {"added": found}, [f"staged {p}" for p in found])


@command
def rm(repo, a):
    if a.message:
        found = repo.remove_paths(a.paths, a.message)
        return _show(a, {"commit": found}, [found])
    found = repo.rm(a.paths)
    _show(a, {"removed": found}, [f"staged removal of {p}" for p in found])


@command
def mv(repo, a):
    if a.message:
        found = repo.move(a.source, a.target, a.message)
        return _show(a, {"commit": found}, [found])
    n = repo.mv(a.source, a.target)
    _show(a, {"moved": n}, [f"staged {n} renames"])


@command
def status(repo, a):
    s = repo.status(a.working_tree)
    lines = [f"on branch {s.branch}", *(f"  staged {change}: {path}" for path, change in s.staged_changes), *(f"  {change}: {path}" for path, change in s.worktree or [])]
    _show(a, asdict(s), lines)


@command
def branch(repo, a):
    at = repo.branch(a.name)
    _show(a, {"branch": a.name, "commit": at}, [f"branch {a.name} at {at or 'no commit'}"])


@command
def diff(repo, a):
    rows = _rows(repo.diff(a.before, a.after))
    mark = {"added": "A", "removed": "D", "modified": "M"}
    _show(a, rows, [f"{mark[r['change']]} {r['path']}" for r in rows])


@command
def merge(repo, a):
    r = repo.merge(a.source, a.into, a.message)
    _show(a, asdict(r), [f"{r.kind} {r.commit_id}"])


@command
def verify(repo, a):
    r = repo.verify(a.ref, a.prefixes, a.dry_run)
    _show(a, asdict(r), [f"verified {r.verified} of {r.candidates} candidates, {r.total} entries"])


@command
def gc(repo, a):
    found = repo.gc(dry_run=not a.delete, grace=3600 * a.grace)
    _show(a, {k: {"reachable": live, "orphaned": dead} for k, (live, dead) in found.items()}, [f"{k}: {live} reachable, {dead} orphaned" for k, (live, dead) in sorted(found.items())])


@command
def query_build(repo, a):
    out = a.output_dir or f"{repo.store.uri}/catalog"
    found = repo.build_catalog(export=out if a.parquet or a.output_dir else None)
    _show(a, {"commit": found, "output": out}, [f"files of {found} in {out}" if a.parquet or a.output_dir else found])


@command
def query_prune(repo, a):
    rows = _rows(repo.prune(a.ref, a.path, a.where).orderBy("path"))
    kept, total = sum(len(r["kept"]) for r in rows), sum(r["total_row_groups"] for r in rows)
    _show(a, {"files": rows, "row_groups": total, "kept": kept, "pruned": total - kept}, [*(f"{r['path']}: keep {r['kept']} of {r['total_row_groups']}" for r in rows), f"{kept} of {total} row groups in {len(rows)} files"])


@command
def query_sql(repo, a):
    repo.build_catalog(a.ref)
    df = repo.sql(a.sql)
    rows = _rows(df)
    _show(a, rows, ["\t".join(df.columns), *("\t".join(str(v) for v in r.values()) for r in rows)])


@command
def log(repo, a):
    found = repo.log(a.ref)
    _show(a, [asdict(c) for c in found], [f"{c.id[:12]} {c.created_at} {c.message}" for c in found])


@command
def list_(repo, a):
    columns = ["path", "hash", "size", "identity_mode", "blob_hash", "source_uri"]
    rows = _rows(repo.entries(a.ref, a.staged, a.path).select(columns).orderBy("path"))
    _show(a, rows, [r["path"] for r in rows])


@command
def cat(repo, a):
    sys.stdout.buffer.write(repo.cat(a.path, a.ref))


@command
def reflog(repo, a):
    rows = _rows(repo.reflog(a.branch))
    _show(a, rows, [f"{r['ts']} {r['operation']} {(r['old'] or '-')[:12]} -> {(r['new'] or '-')[:12]}" for r in rows])


@command
def catalog(repo, a):
    rows = _rows(repo.catalog())
    _show(a, rows, [f"{r['branch']} {(r['commit_id'] or '-')[:12]} {r['message'] or ''}".rstrip() for r in rows])


@command
def checkout(repo, a):
    repo.checkout(a.branch)
    _show(a, {"branch": a.branch}, [f"on branch {a.branch}"])


@command
def restore(repo, a):
    n = repo.restore(a.ref, a.paths or None, a.force)
    _show(a, {"restored": n}, [f"restored {n} files"])


@command
def config_set(repo, a):
    repo.set_config(a.key, a.value)
    _show(a, {a.key: a.value}, [f"{a.key} = {a.value}"])


@command
def config_list(repo, a):
    _show(a, dict(repo.config.items()), [f"{k} = {v}" for k, v in repo.config.items()])


def _sync(name: str) -> None:
    def run(repo, a):
        r = getattr(repo, name)(Repository.open(repo.spark, a.remote), a.branch)
        _show(a, asdict(r), [f"{name} {r.branch}: {r.commits} commits, {r.blobs} blobs"])

    COMMANDS[name] = run


for _name in ("push", "pull", "fetch"):
    _sync(_name)


@command
def transfer(repo, a):
    lines = [r["command"] for r in repo.transfer_commands(a.target, a.ref, a.download, not a.blobs_only).collect()]
    _show(a, lines, lines)


def _session() -> SparkSession:
    made = SparkSession.builder.appName("lakestrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = build_parser().parse_args(argv)
    name = " ".join(x for x in (a.command, getattr(a, "query", None) if a.command == "query" else None, getattr(a, "config", None) if a.command == "config" else None) if x)
    try:
        spark = spark or _session()
        if name in ("init", "config init"):
            chosen = Config(default_branch=a.branch) if name == "init" else Config(backend=a.backend, s3=S3Options(a.bucket, a.prefix))
            repo = Repository.init(spark, a.repo, chosen)
            _show(a, {"root": repo.root, "branch": repo.branch_name}, [f"repository at {repo.root}"])
        else:
            COMMANDS[name](Repository.open(spark, a.repo), a)
        return 0
    except NotARepository as e:
        print(f"fatal: {e}", file=sys.stderr)
    except (ValueError, OSError) as e:
        print(f"{name} error: {e}", file=sys.stderr)
    return 1
