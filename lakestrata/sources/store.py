"""A store: snapshots, commits, refs, footers, blobs, stages and logs below one directory URI.

    snapshots/<tree>/         entries as parquet, sorted by path; the name is the root digest, so equal trees are shared
    directories/<tree>/       the digest of each of its directories, with all below it, as parquet
    footers/                  statistics as parquet, appended
    blobs/<2>/<62>            file bytes by digest
    commits/<id>.json         one object each
    refs/heads/<branch>/<n>   versions of a branch; the highest n counts, and creating n+1 is the compare-and-set
    client/                   head, stages and reflogs of this client

No name begins with a dot or an underscore, so Spark's readers see all of it. A snapshot is written before the commit
that names it, and a commit before the ref that names it, so a lost writer leaves orphans and nothing else.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..errors import ObjectMissing, OptimisticLock, StorageUnavailable
from ..functions.paths import directory
from ..operators import tree
from ..shared import materialize
from .files import META_DIR, hadoop_uri, list_files, open_fs
from .footers import capture

#: Rows of a snapshot file: small enough that a point lookup reads little.
ROWS_PER_FILE = 1_000_000


@dataclass(frozen=True)
class Commit:
    id: str
    message: str
    tree: str
    parents: tuple[str, ...]
    created_at: str
    branch: str
    generation: int


class Store:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.fs, self.root = open_fs(self.uri)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self._commits: dict[str, Commit] = {}

    # Bytes

    def url(self, *parts: str) -> str:
        """A URI that Spark's readers and writers take."""
        base = f"file://{self.root}" if self.local else hadoop_uri(self.uri)
        return "/".join([base, *parts])

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def read(self, *parts: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(self._path(*parts)) as f:
                return f.read()
        except FileNotFoundError:
            return None
        except OSError as e:
            raise StorageUnavailable(str(e)) from e

    def write(self, data: bytes, *parts: str) -> None:
        """Replaces a file; locally in one step."""
        path = self._path(*parts)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part" if self.local else path
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        if self.local:
            os.replace(part, path)

    def create(self, data: bytes, *parts: str) -> bool:
        """Creates a file whole, unless it exists; of several writers exactly one succeeds."""
        path = self._path(*parts)
        if self.local:
            self.fs.create_dir(os.path.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        # A create without overwriting is exclusive on HDFS by itself, and on S3A if the write is asked to be conditional.
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.url(*parts))
        hadoop = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if hadoop.exists(target):
            return False
        try:
            out = hadoop.createFile(target).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
            out.write(bytearray(data))
            out.close()
            return True
        except Exception as e:
            if "AlreadyExists" in str(e) or "PreconditionFailed" in str(e) or "412" in str(e):
                return False
            raise StorageUnavailable(str(e)) from e

    def delete(self, *parts: str) -> None:
        info = self.fs.get_file_info(self._path(*parts))
        if info.type == pafs.FileType.Directory:
            self.fs.delete_dir(info.path)
        elif info.type == pafs.FileType.File:
            self.fs.delete_file(info.path)

    def names(self, *parts: str) -> list[str]:
        """The names in a folder, sorted; none if it isn't there."""
        found = self.fs.get_file_info(pafs.FileSelector(self._path(*parts), allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.endswith(".part"))

    # Snapshots

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], schema.ENTRY)

    def has_tree(self, digest: str) -> bool:
        return "_SUCCESS" in self.names("snapshots", digest)

    def put_tree(self, entries: DataFrame) -> str:
        """Writes a snapshot and its directories' digests, and returns the root's. Invalid entries are an error, and
        nothing is written. Depth and broken rules are counted while the snapshot is written; what is read again is
        what directory digests need."""
        entries = entries.select(schema.ENTRY_COLUMNS)
        pending = self.url("snapshots", f"pending-{uuid.uuid4().hex}")
        seen = Observation()
        deepest = F.max(tree.depth(directory(F.col("path")))).alias("depth")
        ordered = entries.repartitionByRange("path").sortWithinPartitions("path").observe(seen, deepest, F.count_if(~schema.valid()).alias("bad"))
        ordered.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(pending)
        written = self.spark.read.schema(schema.ENTRY).parquet(pending)
        name = pending.rpartition("/")[2]
        try:
            counts = seen.get
            shards = materialize(tree.file_shards(written), "shards")
            if counts.get("bad") or not shards.filter("repeats > 0").isEmpty():
                bad = schema.violations(written).limit(5).collect()
                raise ValueError("invalid entries: " + ", ".join(f"{r['path']} ({r['rule']})" for r in bad))
            digests = tree.folded(shards, counts.get("depth") or 0)
            digest = tree.root_of(digests)
            if not self.has_tree(digest):
                self.delete("snapshots", digest)
                digests.write.mode("overwrite").parquet(self.url("directories", digest))
                self.fs.move(self._path("snapshots", name), self._path("snapshots", digest))
            return digest
        finally:
            self.delete("snapshots", name)

    def directories(self, digest: str) -> DataFrame | None:
        """dir, digest of a snapshot's directories, each with all below it; None where they weren't stored."""
        if "_SUCCESS" not in self.names("directories", digest):
            return None
        return self.spark.read.schema("dir string, digest string").parquet(self.url("directories", digest))

    def entries(self, digest: str | None) -> DataFrame:
        if digest is None:
            return self.empty()
        if not self.has_tree(digest):
            raise ObjectMissing(f"no snapshot {digest}")
        return self.spark.read.schema(schema.ENTRY).parquet(self.url("snapshots", digest))

    # Commits

    def put_commit(self, commit: Commit) -> None:
        self.create(json.dumps(asdict(commit), sort_keys=True).encode(), "commits", f"{commit.id}.json")

    def commit(self, commit_id: str) -> Commit:
        """A commit by id. Commits never change, so those read once are kept."""
        if commit_id not in self._commits:
            data = self.read("commits", f"{commit_id}.json")
            if data is None:
                raise ObjectMissing(f"no commit {commit_id}")
            fields = json.loads(data)
            self._commits[commit_id] = Commit(**{**fields, "parents": tuple(fields["parents"])})
        return self._commits[commit_id]

    def has_commit(self, commit_id: str) -> bool:
        return commit_id in self._commits or self.read("commits", f"{commit_id}.json") is not None

    def commits(self) -> DataFrame:
        """All commits as a table."""
        if not self.names("commits"):
            return self.spark.createDataFrame([], schema.COMMIT)
        return self.spark.read.schema(schema.COMMIT).json(self.url("commits"))

    # Refs

    def branches(self) -> list[str]:
        return self.names("refs", "heads")

    def ref(self, branch: str) -> tuple[str | None, int] | None:
        """The commit (null before the first one) and version of a branch; None if there is no such branch."""
        versions = [n for n in self.names("refs", "heads", branch) if n.isdigit()]
        if not versions:
            return None
        data = self.read("refs", "heads", branch, versions[-1])
        if data is None:  # another writer has dropped old versions meanwhile
            return self.ref(branch)
        return json.loads(data)["commit_id"], int(versions[-1])

    def set_ref(self, branch: str, commit_id: str | None, expected: int) -> int:
        """Moves a branch from version expected (0: not yet there) to the next one, or raises OptimisticLock."""
        version = expected + 1
        if (self.ref(branch) or (None, 0))[1] != expected or not self.create(json.dumps({"commit_id": commit_id}).encode(), "refs", "heads", branch, f"{version:012d}"):
            raise OptimisticLock(f"branch '{branch}' was moved by another writer")
        if version > 2:
            self.delete("refs", "heads", branch, f"{version - 2:012d}")
        return version

    def refs(self) -> DataFrame:
        rows = [(b, *(r[0], str(r[1]))) for b in self.branches() if (r := self.ref(b))]
        return self.spark.createDataFrame(rows, schema.REF)

    # Footers and blobs

    def footers(self) -> DataFrame:
        if not self.names("footers"):
            return self.spark.createDataFrame([], schema.FOOTER)
        return self.spark.read.schema(schema.FOOTER).parquet(self.url("footers"))

    def capture_footers(self, files: DataFrame) -> DataFrame:
        """source_uri, footer of those files that are parquet; statistics that the store lacks are appended."""
        found = materialize(capture(files), "footers")
        new = found.drop("source_uri").dropDuplicates(["footer"]).join(self.footers().select("footer"), "footer", "left_anti").select(schema.FOOTER.fieldNames())
        if not new.isEmpty():
            new.write.mode("append").parquet(self.url("footers"))
        return found.select("source_uri", "footer")

    def blob_url(self, digest: str) -> str:
        return self.url("blobs", digest[:2], digest[2:])

    def open_blob(self, digest: str):
        try:
            return self.fs.open_input_file(self._path("blobs", digest[:2], digest[2:]))
        except FileNotFoundError as e:
            raise ObjectMissing(f"no blob {digest}") from e

    def objects(self, before_ns: int | None = None) -> DataFrame:
        """kind, id of every stored object; with before_ns, of those written before that time. Blobs are listed by tasks."""
        old = lambda t: before_ns is None or (t or 0) < before_ns
        listed = lambda part: [i for i in self.fs.get_file_info(pafs.FileSelector(self._path(part), allow_not_found=True)) if not i.base_name.endswith(".part") and old(i.mtime_ns)]
        small = [("commit", i.base_name.removesuffix(".json")) for i in listed("commits")] + [("tree", i.base_name) for i in listed("snapshots")]
        footers = self.footers()
        if before_ns is not None and self.names("footers"):
            written = F.unix_micros("_metadata.file_modification_time") * 1000
            footers = self.spark.read.schema(schema.FOOTER).parquet(self.url("footers")).groupBy("footer").agg(F.max(written).alias("at")).filter(F.col("at") < before_ns)
        out = self.spark.createDataFrame(small, "kind string, id string").unionByName(footers.select(F.lit("footer").alias("kind"), F.col("footer").alias("id")).distinct())
        if not self.names("blobs"):
            return out
        blobs = list_files(self.spark, self.url("blobs").removeprefix("file://") if self.local else self.url("blobs"))
        blobs = blobs if before_ns is None else blobs.filter(F.col("mtime_ns") < before_ns)
        return out.unionByName(blobs.filter(~F.col("path").endswith(".part")).select(F.lit("blob").alias("kind"), F.regexp_replace("path", "/", "").alias("id")))

    def forget_footers(self, gone: DataFrame) -> None:
        """Drops statistics (footer). What stays of the files that held them is written first, and the files are deleted
        then: a crash in between leaves rows twice, which readers take as one, and loses none."""
        held = self.spark.read.schema(schema.FOOTER).parquet(self.url("footers")).select("*", F.col("_metadata.file_name").alias("file"))
        touched = materialize(held.join(gone, "footer", "left_semi").select("file").distinct(), "touched")
        kept = materialize(held.join(touched, "file", "left_semi").join(gone, "footer", "left_anti").select(schema.FOOTER.fieldNames()), "footers")
        names = [r["file"] for r in touched.toLocalIterator()]
        kept.write.mode("append").parquet(self.url("footers"))
        for name in names:
            self.delete("footers", name)

    def manifest(self, digest: str) -> str:
        """The URI of a snapshot's manifest, which is written once and kept beside the snapshots."""
        from . import manifest

        if "_SUCCESS" not in self.names("manifests", digest):
            self.delete("manifests", digest)
            manifest.write(self.entries(digest), self.url("manifests", digest))
        return self.url("manifests", digest)

    # This client's state

    def head(self) -> str | None:
        data = self.read("client", "head")
        return data.decode() if data else None

    def set_head(self, branch: str) -> None:
        self.write(branch.encode(), "client", "head")

    def stage(self, branch: str) -> list[dict]:
        """Staged changes, sorted by path."""
        data = self.read("client", "stage", f"{branch}.json")
        return json.loads(data) if data else []

    def set_stage(self, branch: str, changes: list[dict]) -> None:
        if changes:
            self.write(json.dumps(sorted(changes, key=lambda c: c["path"])).encode(), "client", "stage", f"{branch}.json")
        else:
            self.delete("client", "stage", f"{branch}.json")

    def log_ref(self, branch: str, old: str | None, new: str | None, operation: str, ts: str) -> None:
        """Appends to the reflog: a file for each line, numbered, so that logs can be read as a stream of files."""
        line = json.dumps({"branch": branch, "old": old, "new": new, "operation": operation, "ts": ts}).encode() + b"\n"
        number = len(self.names("client", "reflog", branch))
        while not self.create(line, "client", "reflog", branch, f"{number:09d}.json"):
            number += 1

    def reflog(self, branch: str) -> DataFrame:
        """REFLOG rows of a branch with seq, newest first."""
        if not self.names("client", "reflog", branch):
            return self.spark.createDataFrame([], "seq int, " + ", ".join(f"{f.name} string" for f in schema.REFLOG))
        rows = self.spark.read.schema(schema.REFLOG).json(self.url("client", "reflog", branch))
        seq = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("int")
        return rows.select(seq.alias("seq"), "*").orderBy(F.desc("seq"))


def meta_uri(root: str) -> str:
    """Where a repository at root keeps its store."""
    return f"{root.rstrip('/')}/{META_DIR}"
