"""Listing, hashing and copying files, on executors, for any URI that pyarrow's file systems open.

Listings are our own: Spark's file sources skip names that begin with a dot or an underscore, which a versioned
dataset may well hold, and round modification times.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that a repository keeps below its root; no listing enters it.
META_DIR = ".strata"
CHUNK = 1 << 20
#: Directories that tasks walk, about.
SEEDS = 256
LISTING = pa.schema([("path", pa.string()), ("source_uri", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64())])
LISTING_DDL = "path string, source_uri string, size long, mtime_ns long"


#: One object store, two names of its scheme: Arrow's file systems take the first, Hadoop's the second.
ARROW_SCHEME, HADOOP_SCHEME = "s3", "s3a"


def hadoop_uri(uri: str) -> str:
    """uri as Spark's readers and writers take it."""
    scheme, sep, rest = uri.partition("://")
    return f"{HADOOP_SCHEME}://{rest}" if sep and scheme == ARROW_SCHEME else uri


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or local path. An S3 endpoint of one's own is named by AWS_ENDPOINT_URL, which
    Arrow reads where the file system is opened, on the driver and in tasks."""
    scheme, sep, rest = uri.partition("://")
    if not sep and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if scheme in (ARROW_SCHEME, HADOOP_SCHEME):
        endpoint = os.environ.get("AWS_ENDPOINT_URL")
        return pafs.S3FileSystem(**({"endpoint_override": endpoint} if endpoint else {})), rest
    return pafs.FileSystem.from_uri(uri)


def open_stream(uri: str):
    """A readable, seekable binary file for any URI."""
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def describe(uri: str) -> tuple[int, int]:
    """Size and mtime_ns of one file; FileNotFoundError if there is none, ValueError for a directory."""
    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type != pafs.FileType.File:
        raise ValueError(f"not a file: {uri}")
    return info.size, info.mtime_ns or 0


def _local(top: str, start: str, deep: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """Regular files below start, sorted by name in each directory; without links, what can't be read, and META_DIR."""
    try:
        found = sorted(os.scandir(start), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        try:
            if e.is_symlink():
                continue
            if e.is_dir():
                if e.name != META_DIR and deep:
                    yield from _local(top, e.path)
                continue
            info = e.stat(follow_symlinks=False)
        except OSError:
            continue
        if stat.S_ISREG(info.st_mode):
            yield os.path.relpath(e.path, top).replace(os.sep, "/"), e.path, info.st_size, info.st_mtime_ns


def walk(root: str, start: str | None = None, deep: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """path (relative to root), source_uri, size, mtime_ns of each file below start, or directly in it."""
    fs, top = open_fs(root)
    begin = open_fs(start)[1] if start else top
    if isinstance(fs, pafs.LocalFileSystem):
        yield from ((p, f"file://{full}", n, t) for p, full, n, t in _local(top, begin, deep))
        return
    base = root.rstrip("/")
    for info in sorted(fs.get_file_info(pafs.FileSelector(begin, recursive=deep)), key=lambda i: i.path):
        path = info.path[len(top.rstrip("/")) + 1 :]
        # Object stores list directory markers as files of no size.
        if info.type == pafs.FileType.File and META_DIR not in path.split("/") and not (info.path.endswith("/") and not info.size):
            yield path, f"{base}/{path}", info.size, info.mtime_ns or 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _folders(fs: pafs.FileSystem, path: str) -> list[str]:
    """The directories directly in a directory, without links and META_DIR."""
    local = isinstance(fs, pafs.LocalFileSystem)
    try:
        infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    except OSError:  # one that can't be read has nothing to list
        return []
    return [i.path for i in infos if i.type == pafs.FileType.Directory and i.base_name != META_DIR and not (local and os.path.islink(i.path))]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file below root. Directories are walked by tasks: the driver opens them, from the top and breadth
    first, until there are SEEDS to walk or it has opened as many, so a single folder on top is no single task."""
    fs, top = open_fs(root)
    prefix = "" if isinstance(fs, pafs.LocalFileSystem) else root.split("://")[0] + "://"
    opened, waiting = [], [top]
    while waiting and len(waiting) < SEEDS and len(opened) < SEEDS:
        opened.append(waiting.pop(0))
        waiting += _folders(fs, opened[-1])
    starts = [(prefix + d, False) for d in opened] + [(prefix + d, True) for d in waiting]
    seeds = spark.createDataFrame(starts, "start string, deep boolean").repartition(len(starts))

    def run(batches):
        for batch in batches:
            for start, deep in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(walk(root, start, deep), LISTING)

    return seeds.mapInArrow(run, LISTING_DDL)


def digest_stream(stream, new: Callable = hashlib.sha256) -> tuple[str, int]:
    made, size = new(), 0
    while chunk := stream.read(CHUNK):
        made.update(chunk)
        size += len(chunk)
    return made.hexdigest(), size


def digests(files: DataFrame, new: Callable = hashlib.sha256) -> DataFrame:
    """source_uri, digest, n_bytes of each distinct source_uri that can be read; chunk by chunk, on executors."""
    schema = pa.schema([("source_uri", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())])

    def rows(uris):
        for uri in uris:
            try:
                with open_stream(uri) as f:
                    yield (uri, *digest_stream(f, new))
            except OSError:
                continue

    def run(batches):
        for batch in batches:
            yield from _batches(rows(batch.column(0).to_pylist()), schema, 256)

    wanted = files.select("source_uri").filter("source_uri is not null").distinct()
    return wanted.mapInArrow(run, "source_uri string, digest string, n_bytes long")


def build_entries(listing: DataFrame, new: Callable = hashlib.sha256) -> DataFrame:
    """Entries in content mode of listed files: path, hash, size (of what was read), mtime_ns, source_uri."""
    known = digests(listing, new)
    return listing.join(known, "source_uri").select(
        "path", F.col("digest").alias("hash"), F.col("n_bytes").alias("size"), "mtime_ns", F.lit("content").alias("identity_mode"),
        F.lit(None).cast("string").alias("blob_hash"), "source_uri", F.lit(None).cast("string").alias("footer"),
    )


def blob_path(root: str, digest: str) -> str:
    return f"{root.rstrip('/')}/{digest[:2]}/{digest[2:]}"


def put(fs: pafs.FileSystem, path: str, source) -> None:
    """Copies a stream to path through a temporary name, so that no reader sees half a file."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
    with fs.open_output_stream(part) as out:
        while chunk := source.read(CHUNK):
            out.write(chunk)
    fs.move(part, path)


def copy_objects(objects: DataFrame, replace: bool = False) -> DataFrame:
    """Copies `source` to `target` for each row unless the target exists (or replaces it); target, copied. Rows are
    spread over tasks, and a repeated task finds its files there already."""
    schema = pa.schema([("target", pa.string()), ("copied", pa.bool_())])

    def rows(pairs):
        for source, target in pairs:
            fs, path = open_fs(target)
            there = fs.get_file_info(path).type == pafs.FileType.File
            if replace or not there:
                with open_stream(source) as f:
                    put(fs, path, f)
            yield target, replace or not there

    def run(batches):
        for batch in batches:
            yield from _batches(rows(zip(*(c.to_pylist() for c in batch.columns))), schema, 256)

    return objects.select("source", "target").dropDuplicates(["target"]).mapInArrow(run, "target string, copied boolean")


def store_blobs(entries: DataFrame, blob_root: str) -> DataFrame:
    """Copies the bytes of content entries (hash, source_uri) to content-addressed files, each digest once."""
    wanted = entries.filter("source_uri is not null").groupBy("hash").agg(F.min("source_uri").alias("source"))
    target = F.concat(F.lit(blob_root.rstrip("/") + "/"), F.left("hash", F.lit(2)), F.lit("/"), F.substring("hash", 3, 64))
    return copy_objects(wanted.select("source", target.alias("target")))
