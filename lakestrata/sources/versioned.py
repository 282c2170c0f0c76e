"""Read-only views of repositories by URI: as files (open, exists, info, ls), and as a Spark data source.

    spark.dataSource.register(VersionedSource)
    spark.read.format("strata").option("root", "/data/set").option("ref", "main").load("images/")

Spark refuses readers that take filters unless spark.sql.python.filterPushdown.enabled is true when a query runs, and a source
can't see that setting. But Spark asks for the reader that it pushes filters to from a worker of its own, which runs only where
the setting allows it. There the reader takes filters; otherwise Spark filters what is read, and the prefix given to load()
alone narrows the scan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions.paths import DatasetURI, parse_uri
from ..schema import ENTRY, ENTRY_COLUMNS
from .store import Store, meta_uri

#: The module of Spark's worker that pushes filters.
PUSHING = "pyspark.sql.worker.data_source_pushdown_filters"


class VirtualFiles:
    """Files of registered repositories as scheme://dataset@ref[+staged]/path."""

    def __init__(self, spark: SparkSession, roots: dict[str, str], scheme: str = "strata"):
        self.spark, self.roots, self.scheme = spark, dict(roots), scheme
        self._open: dict[str, object] = {}

    def _parse(self, uri: str, allow_empty_path: bool = False):
        from ..repository import Repository

        found = parse_uri(uri, self.scheme, allow_empty_path)
        if found.dataset not in self.roots:
            raise FileNotFoundError(f"unknown dataset: {found.dataset}")
        if found.dataset not in self._open:
            self._open[found.dataset] = Repository(self.spark, self.roots[found.dataset])
        return found, self._open[found.dataset]

    def open(self, uri: str, mode: str = "rb"):
        if mode != "rb":
            raise ValueError("these files are read-only")
        found, repo = self._parse(uri)
        if repo.lookup(found.path, found.ref, found.staged) is None:
            raise FileNotFoundError(uri)
        return repo.open_entry(found.path, found.ref, found.staged)

    def exists(self, uri: str) -> bool:
        try:
            self.info(uri)
            return True
        except (FileNotFoundError, ValueError):
            return False

    def _described(self, found: DatasetURI, e: dict) -> dict:
        name = f"{self.scheme}://{found.dataset}@{found.ref}/{e['path']}"
        return {"name": name, "type": "file", **{k: e[k] for k in ("size", "hash", "mtime_ns", "identity_mode")}}

    def info(self, uri: str) -> dict:
        found, repo = self._parse(uri)
        entry = repo.lookup(found.path, found.ref, found.staged)
        if entry is None:
            raise FileNotFoundError(uri)
        return self._described(found, entry)

    def ls(self, uri: str, detail: bool = True) -> list:
        """All files at or below a path ('*' and '' are the root), sorted; names leave out the stage mark."""
        found, repo = self._parse(uri.removesuffix("*"), allow_empty_path=True)
        rows = repo.entries(found.ref, found.staged)
        if found.path:
            from ..operators.snapshot import within

            rows = within(rows, found.path)
        files = [self._described(found, r.asDict()) for r in rows.orderBy("path").toLocalIterator()]
        return files if detail else [f["name"] for f in files]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ref, self.prefix = options["root"], options.get("ref", "main"), options.get("prefix", options.get("path", ""))
        self.equal: list[str] = []
        self.prefixes: list[str] = [self.prefix] if self.prefix else []

    def partitions(self) -> list[_File]:
        store = Store(None, meta_uri(self.root))
        found = store.ref(self.ref)
        commit_id = found[0] if found else self.ref
        if commit_id is None:
            return []
        tree = store.commit(commit_id).tree
        return [_File(store.url("snapshots", tree, n)) for n in store.names("snapshots", tree) if n.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator:
        from .files import open_fs

        fs, path = open_fs(partition.path)
        wanted = None
        for value in self.equal:
            wanted = (ds.field("path") == value) if wanted is None else wanted & (ds.field("path") == value)
        for value in self.prefixes:
            # A range, which row-group statistics decide, around the exact test.
            one = (ds.field("path") >= value) & pc.starts_with(ds.field("path"), pattern=value)
            wanted = one if wanted is None else wanted & one
        yield from ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=ENTRY_COLUMNS, filter=wanted)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.equal.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f


class VersionedSource(DataSource):
    """Entries of a ref. Where Spark pushes filters, equalities and prefixes of the path go to the snapshot's files."""

    @classmethod
    def name(cls) -> str:
        return "strata"

    def schema(self):
        return ENTRY

    def reader(self, schema) -> _Reader:
        caller = sys._getframe(1).f_globals.get("__spec__")
        return (_PushedReader if caller and caller.name == PUSHING else _Reader)(dict(self.options))


def read(spark: SparkSession, root: str, ref: str = "main", prefix: str = "") -> DataFrame:
    """Entries of a ref below a prefix; filters on them are pushed where the session's setting allows it."""
    spark.dataSource.register(VersionedSource)
    return spark.read.format("strata").options(root=root, ref=ref, prefix=prefix).load()
