"""Manifests as text, for interchange: a JSON array per line, tagged by how an entry is stored.

    ["b", path, hash, size, mtime_ns]                       bytes stored
    ["bp", path, hash, size, mtime_ns, footer]              the same, parquet with statistics
    ["m", path, hash, size, mtime_ns, source_uri]           a pointer to a source
    ["mp", path, hash, size, mtime_ns, source_uri, footer]  the same, parquet with statistics
"""

from __future__ import annotations

import io
import json
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONTENT, ENTRY_COLUMNS, META
from .files import open_fs

#: Bytes that a lookup reads at a time; a manifest line should fit.
PAGE = 1 << 16


def _json(c: str) -> Column:
    """A string as a JSON literal."""
    one = F.to_json(F.array(F.col(c)))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def line(entries: DataFrame) -> Column:
    """The line of each entry of a DataFrame."""
    meta, footer = F.col("identity_mode") == META, F.col("footer").isNotNull()
    tag = F.concat(F.when(meta, "m").otherwise("b"), F.when(footer, "p").otherwise(""))
    tail = F.concat(F.when(meta, F.concat(F.lit(","), _json("source_uri"))).otherwise(""), F.when(footer, F.concat(F.lit(","), _json("footer"))).otherwise(""))
    return F.concat(F.lit('["'), tag, F.lit('",'), _json("path"), F.lit(","), _json("hash"), F.lit(","), F.col("size").cast("string"), F.lit(","), F.col("mtime_ns").cast("string"), tail, F.lit("]"))


def write(entries: DataFrame, path: str) -> None:
    """Lines in files that are sorted by path, over all and within."""
    entries.repartitionByRange("path").sortWithinPartitions("path").select(line(entries).alias("value")).write.text(path)


def parse(lines: DataFrame, *more: str) -> DataFrame:
    """ENTRY columns and `corrupt`, which is null for good lines and else holds the line, of rows with `value`; and more."""
    a = F.from_json("value", "array<string>")
    tag, n = F.try_element_at(a, F.lit(1)), F.size(a)
    size = F.create_map(*(F.lit(x) for pair in {"b": 5, "bp": 6, "m": 6, "mp": 7}.items() for x in pair))
    at = lambda i: F.try_element_at(a, F.lit(i))
    meta = tag.isin("m", "mp")
    number = lambda i: F.try_to_number(at(i), F.lit("9" * 19)).cast("long")
    good = F.coalesce((n == F.try_element_at(size, tag)) & at(2).isNotNull() & at(3).rlike("^[0-9a-f]{64}$") & number(4).isNotNull() & number(5).isNotNull(), F.lit(False))
    return lines.select(
        at(2).alias("path"), at(3).alias("hash"), number(4).alias("size"), number(5).alias("mtime_ns"), F.when(meta, META).otherwise(CONTENT).alias("identity_mode"),
        F.when(~meta, at(3)).alias("blob_hash"), F.when(meta, at(6)).alias("source_uri"), F.when(tag == "bp", at(6)).when(tag == "mp", at(7)).alias("footer"),
        F.when(~good, F.col("value")).alias("corrupt"), *more,
    )


def _line_number(uri: str, text: str) -> int | None:
    """Where a line stands in a file, counted from 1."""
    fs, path = open_fs(unquote(uri))
    with fs.open_input_stream(path) as f:
        lines = io.TextIOWrapper(f, "utf-8", "replace", newline="\n")
        return next((n for n, line_ in enumerate(lines, 1) if line_.rstrip("\r\n") == text), None)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The entries of manifest files. With strict all lines are checked first, and a corrupt one is an error that names its
    file and line number; else see `corrupt`."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    if not strict:
        return parse(lines)
    bad = parse(lines, "file").filter("corrupt is not null").select("file", "corrupt").orderBy("file", "corrupt").first()
    if bad:
        raise ValueError(f"corrupt manifest line: {bad['file']}:{_line_number(bad['file'], bad['corrupt'])}: {bad['corrupt']}")
    return parse(lines).select(ENTRY_COLUMNS)


def _line_after(f, at: int, size: int) -> tuple[int, bytes]:
    """The first whole line that begins at `at` or later, and where it begins; (size, b"") if there is none."""
    start = at
    if at:
        f.seek(at - 1)
        while page := f.read(PAGE):
            if (cut := page.find(b"\n")) >= 0:
                start += cut
                break
            start += len(page)
        else:
            return size, b""
    f.seek(start)
    line_ = b""
    while (page := f.read(PAGE)) and b"\n" not in page:
        line_ += page
    return start, (line_ + page).partition(b"\n")[0]


def _path_of(text: bytes) -> str:
    return json.loads(text)[1]


def lookup(manifest: str, path: str) -> str | None:
    """The line of one path in a manifest that write() made, or None. A binary search by bytes, which reads a few pages:
    files are sorted among each other and within, so no index is kept. None also if there is no such manifest."""
    fs, top = open_fs(manifest)
    found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))
    want = path.encode()
    for info in sorted((i for i in found if i.base_name.startswith("part-") and i.size), key=lambda i: i.base_name, reverse=True):
        with fs.open_input_file(info.path) as f:
            if _path_of(_line_after(f, 0, info.size)[1]).encode() > want:
                continue
            low, high = 0, info.size  # the line sought begins at low or later, and before high
            while low < high:
                middle = (low + high) // 2
                start, text = _line_after(f, middle, info.size)
                if start >= high or not text:
                    high = middle
                    continue
                here = _path_of(text).encode()
                if here == want:
                    return text.decode()
                if here < want:
                    low = start + 1
                else:
                    high = middle
            return None
    return None
