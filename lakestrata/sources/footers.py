"""Parquet footers as tables of row-group statistics. Only footers are read, by pyarrow, on executors."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FOOTER
from .files import open_stream

#: Footers above this size are left uncaptured.
MAX_FOOTER = 64 << 20
_COLUMN = [("path", pa.string()), ("typ", pa.string()), ("min_l", pa.int64()), ("max_l", pa.int64()), ("min_d", pa.float64()), ("max_d", pa.float64()), ("min_s", pa.string()), ("max_s", pa.string()), ("min_b", pa.bool_()), ("max_b", pa.bool_()), ("nulls", pa.int64()), ("exact", pa.bool_())]
_ARROW = pa.schema([
    ("source_uri", pa.string()), ("footer", pa.string()), ("schema_hash", pa.string()), ("created_by", pa.string()),
    ("schema", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
    ("row_groups", pa.list_(pa.struct([("rows", pa.int64()), ("columns", pa.list_(pa.struct(_COLUMN)))]))),
])


def _lane(value) -> tuple[str, object] | None:
    """The lane of a statistic, and its value there; None for what has no safe order."""
    if isinstance(value, bool):
        return "b", value
    if isinstance(value, int):
        return ("l", value) if -(1 << 63) <= value < 1 << 63 else None
    if isinstance(value, float):
        return ("d", value) if value == value else None
    if isinstance(value, decimal.Decimal):
        return None
    if isinstance(value, str):
        return "s", value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "s", value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, bytes):
        try:
            return "s", value.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return None


def _column(c: pq.ColumnChunkMetaData) -> dict:
    out = dict.fromkeys((name for name, _ in _COLUMN)) | {"path": c.path_in_schema, "typ": c.physical_type}
    stats = c.statistics
    if stats is None:
        return out
    out["nulls"] = stats.null_count if stats.has_null_count else None
    # Orders of these physical types aren't those of their decoded values.
    if stats.has_min_max and c.physical_type not in ("INT96", "FIXED_LEN_BYTE_ARRAY"):
        least, most = _lane(stats.min), _lane(stats.max)
        if least and most and least[0] == most[0]:
            out[f"min_{least[0]}"], out[f"max_{most[0]}"] = least[1], most[1]
            exact = [getattr(stats, f"is_{m}_value_exact", None) for m in ("min", "max")]
            out["exact"] = False if False in exact else True if c.physical_type != "BYTE_ARRAY" or exact == [True, True] else None
    return out


def read_footer(uri: str) -> dict | None:
    """FOOTER fields of a parquet file; None for other files, damaged footers, and footers above MAX_FOOTER."""
    try:
        with open_stream(uri) as f:
            size = f.size()
            if size < 12:
                return None
            f.seek(size - 8)
            tail = f.read(8)
            if tail[4:] != b"PAR1" or int.from_bytes(tail[:4], "little") > min(MAX_FOOTER, size - 12):
                return None
            f.seek(0)
            meta = pq.read_metadata(f)
    except (OSError, pa.ArrowInvalid):
        return None
    leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
    names = [{"name": c.name, "type": c.physical_type} for c in leaves]
    groups = [{"rows": g.num_rows, "columns": [_column(g.column(i)) for i in range(g.num_columns)]} for g in (meta.row_group(i) for i in range(meta.num_row_groups))]
    body = {"schema_hash": hashlib.sha256(json.dumps(names, separators=(",", ":")).encode()).hexdigest(), "created_by": meta.created_by, "schema": names, "row_groups": groups}
    return {"footer": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), **body}


def capture(files: DataFrame) -> DataFrame:
    """source_uri and FOOTER fields of those files (source_uri) that are parquet."""

    def rows(uris: list[str]) -> Iterator[dict]:
        for uri in uris:
            if (found := read_footer(uri)) is not None:
                yield {"source_uri": uri, **found}

    def run(batches):
        for batch in batches:
            uris = batch.column(0).to_pylist()
            for i in range(0, len(uris), 64):
                if part := list(rows(uris[i : i + 64])):
                    yield pa.RecordBatch.from_pylist(part, schema=_ARROW)

    ddl = "source_uri string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FOOTER)
    return files.select("source_uri").filter("source_uri is not null").distinct().mapInArrow(run, ddl)


def to_json(footers: DataFrame) -> DataFrame:
    """footer, body: statistics as JSON text."""
    return footers.select("footer", F.to_json(F.struct(*[f.name for f in FOOTER if f.name != "footer"])).alias("body"))


def from_json(rows: DataFrame) -> DataFrame:
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FOOTER if f.name != "footer")
    return rows.select("footer", F.from_json("body", body).alias("b")).select("footer", "b.*")


def row_group_stats(footers: DataFrame) -> DataFrame:
    """RG_STATS without a path: a row for each column of each row group."""
    groups = footers.select("footer", F.posexplode("row_groups").alias("rg", "g"))
    return groups.select("footer", "rg", F.col("g.rows").alias("rows"), F.explode("g.columns").alias("c")).select("footer", "rg", "rows", F.col("c.path").alias("col"), *(f"c.{n}" for n, _ in _COLUMN[1:]))
