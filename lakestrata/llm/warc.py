"""WARC archives: captures written as records, and read back into one nested row for each capture.

Writing: each capture gives a request, a response (or a revisit, where an earlier capture has the same payload) and a
metadata record; request and metadata name the response in WARC-Concurrent-To. Spark's text writer stores them, with
the record terminator as line separator, so archives go through its commit protocol to any file system.

Reading: files of bounded size are unpacked and parsed as a stream, by Content-Length, a record at a time; transactions are assembled by
joining request and metadata to the response or revisit through the concurrent-to identifiers.

Edge cases: null html is an empty payload, and a null url an empty one; control characters are left out of URLs. Each row
is a capture: rows with a null or repeated page_id are told apart by a number, and of equal payloads those with a null id
come last; they are revisits of the first, which is then one of them only if all lack an id. An empty table gives no
rows; other columns are ignored. A payload of any length is one record, and read by itself.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, materialize, new_path

#: Payloads of fewer bytes are never revisits.
MIN_DEDUP_BYTES = 0
#: Characters of records, before compression, after which an archive file ends; a longer record has a file of its own.
FILE_CHARS = 32 << 20
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
_CONTROL = re.compile("[\x00-\x1f\x7f]")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html of each row, and n, which tells rows of one page_id, or of none, apart: 0 where there are no
    such rows, else a number, for which the rows are written out."""
    rows = pages.select("page_id", "url", "html")
    if rows.groupBy("page_id").count().filter(F.col("page_id").isNull() | (F.col("count") > 1)).isEmpty():
        return rows.withColumn("n", F.lit(0).cast("long"))
    return materialize(rows.withColumn("n", F.monotonically_increasing_id()), "captures")


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, n and refers_to: the captures whose payload an earlier capture has, and that one's page_id and n. The
    first of a payload is found with map-side sums; only ids and digests are shuffled, and AQE splits the join of a
    payload with many copies."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = rows.select("page_id", "n", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size")).filter(F.col("size") >= MIN_DEDUP_BYTES)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first")
    firsts = keys.groupBy("sha", "size").agg(first, F.count(F.lit(1)).alias("copies"))
    others = keys.join(firsts.filter(F.col("copies") > 1), ["sha", "size"]).filter(~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("n") == F.col("first.n"))))
    return others.select("page_id", "n", F.struct("first.page_id", "first.n").alias("refers_to"))


def _block(kind: str, headers: list[tuple[str, object]], body: str) -> str:
    head = [("WARC-Type", kind), *headers, ("Content-Length", len(body.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + body


def _name(kind: str, page_id: int | None, n: int) -> str:
    return f"<urn:x-lakestrata:{kind}:{'' if page_id is None else page_id}:{n}>"


def _records(page_id: int | None, url: str | None, html: str | None, n: int, refers_to: dict | None) -> Iterator[str]:
    html, target = html or "", _CONTROL.sub("", url or "")
    payload = html.encode()
    ids = {k: _name(k, page_id, n) for k in ("request", "capture", "metadata")}
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    yield _block("request", [("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["capture"]), *common, ("Content-Type", "application/http; msgtype=request")], f"GET {target} HTTP/1.1\r\nUser-Agent: lakestrata\r\n\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    main = [("WARC-Record-ID", ids["capture"]), *common, ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        yield _block("response", main, http + html)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _block("revisit", [*main, ("WARC-Profile", profile), ("WARC-Refers-To", _name("capture", refers_to["page_id"], refers_to["n"]))], http)
    yield _block("metadata", [("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["capture"]), *common, ("Content-Type", "application/warc-fields")], f"pageId: {'' if page_id is None else page_id}\r\n")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes gzipped archives under path: a folder for each number that a task's files get, as they reach FILE_CHARS."""
    rows = captures(pages)
    known = materialize(revisits(rows), "revisits")
    schema = pa.schema([("value", pa.string()), ("file", pa.int32())])

    def run(batches):
        file = chars = 0
        for batch in batches:
            values, files = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for value in _records(*row):
                    if chars and chars + len(value) > FILE_CHARS:
                        file, chars = file + 1, 0
                    chars += len(value)
                    values.append(value)
                    files.append(file)
                if len(values) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.int32())], schema=schema)
                    values, files = [], []
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.int32())], schema=schema)

    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("n") == F.col("_n"))
    joined = rows.join(known.withColumnsRenamed({"page_id": "_p", "n": "_n"}), same, "left").select("page_id", "url", "html", "n", "refers_to")
    records = mapped(joined, run, "value string, file int")
    records.write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path)


class _Buffered:
    """Reads a stream up to a mark, or so many bytes, holding one record at most."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def _more(self) -> bool:
        try:
            piece = self.stream.read(max(1 << 16, len(self.held)))
        except (EOFError, zlib.error) as e:
            raise ValueError("truncated archive") from e
        self.held += piece
        return bool(piece)

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is passed too; None if it doesn't come."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        found, self.held = self.held[:n], self.held[n:]
        return found


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, gzipped (in any number of members) or plain, one at a time."""
    reader = _Buffered(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while reader.upto(b"WARC/") is not None:
        head = reader.upto(END.encode())
        if head is None:
            raise ValueError("truncated record")
        fields = {k.strip().lower(): v.removeprefix(" ") for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields["content-length"])
        block = reader.take(size)
        if len(block) < size:
            raise ValueError(f"truncated record {fields.get('warc-record-id')}")
        yield fields, block


_READ = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _read_row(fields: dict[str, str], block: bytes) -> tuple:
    kind, digest, size, intact, payload = fields.get("warc-type"), None, len(block), None, block
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(END.encode())
        digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
        size = len(payload)
        if kind == "revisit":
            sizes = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            size = int(sizes[0]) if sizes else None
        else:
            intact = _digest(payload) == digest
            digest = digest or _digest(payload)
    return kind, *(fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-concurrent-to", "warc-refers-to")), fields.get("warc-target-uri"), digest, size, intact, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives under path; payload is null for responses if not payloads."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in parse(data.as_py()):
                    row = _read_row(fields, block)
                    rows.append(row if payloads or row[0] not in ("response", "revisit") else (*row[:-1], None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    ddl = "warc_type string, record_id string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, intact boolean, payload binary"
    # A file is a task's unit; the reader must not pack many of them into one batch.
    return mapped(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), run, ddl)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit, its request and its metadata."""
    main = records.filter(F.col("warc_type").isin("response", "revisit"))
    side = lambda kind: records.filter(F.col("warc_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("target_uri", "payload")).alias(kind))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select(
        F.struct("record_id", "warc_type", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "intact", "payload").alias("capture"), "request", "metadata"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages, reads it back, and tells of each capture what the archive holds."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    # A record's id ends in a page_id, if there is one, and a number.
    page = lambda c: F.nullif(F.regexp_extract(c, r":capture:(-?\d*):\d+$", 1), F.lit("")).cast("long")
    told = F.concat(F.lit("pageId: "), F.coalesce(page("capture.record_id").cast("string"), F.lit("")), F.lit("\r\n"))
    return assemble(read_archives(spark, path, payloads=False)).select(
        page("capture.record_id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        F.when(F.col("capture.refers_to_id").isNotNull(), page("capture.refers_to_id")).alias("refers_to"),
        F.col("request.target_uri").alias("url"),
        (F.col("metadata.payload").cast("string") == told).alias("complete"),
    )
