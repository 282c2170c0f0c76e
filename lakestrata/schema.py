"""The schemas of a repository's tables, and the invariants of its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.paths import is_entry_path

CONTENT, META = "content", "meta"

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType())}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """A schema from `name type[!]` items; `!` is not null. Needs no running session, unlike a DDL string."""
    fields = []
    for item in text.split(", "):
        name, kind = item.split(" ")
        fields.append(T.StructField(name, nested.get(kind) or _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


ENTRY = _struct("path string!, hash string!, size long!, mtime_ns long!, identity_mode string!, blob_hash string, source_uri string, footer string")
TREE_NODE = _struct("tree_hash string, name string, kind string, hash string, size long, mtime_ns long, source_uri string, footer string")
COMMIT = _struct("id string, message string, tree string, parents strings, created_at string, branch string, generation int")
REF = _struct("branch string, commit_id string, version_token string")
STAGE = _struct("path string, action string, identity_mode string, source_uri string, blob_hash string, size long")
REFLOG = _struct("branch string, old string, new string, operation string, ts string")
#: Typed lanes of a statistic: long, double, string, boolean.
LANES = "min_l long, max_l long, min_d double, max_d double, min_s string, max_s string, min_b boolean, max_b boolean, nulls long, exact boolean"
_COLUMN = _struct(f"path string, typ string, {LANES}")
_GROUP = _struct("rows long, columns columns", columns=T.ArrayType(_COLUMN))
FOOTER = _struct("footer string, schema_hash string, created_by string, schema names, row_groups groups", names=T.ArrayType(_struct("name string, type string")), groups=T.ArrayType(_GROUP))
RG_STATS = _struct(f"path string, footer string, rg int, rows long, col string, typ string, {LANES}")
DIFF = _struct("path string, change string, before_hash string, after_hash string, before_size long, after_size long")
PRUNE = _struct("path string, footer string, total_row_groups int, kept ints, pruned ints")
FILES = _struct("path string, hash string, size long, mtime_ns long, footer string, commit_id string, branch string")
ENTRY_COLUMNS = ENTRY.fieldNames()

_DIGEST = "^[0-9a-f]{64}$"


def invariants() -> dict[str, Column]:
    """A condition for each rule that every entry keeps. A condition that is null counts as broken."""
    digest = lambda c: F.col(c).isNull() | F.col(c).rlike(_DIGEST)
    content = F.col("identity_mode") == CONTENT
    return {
        "path": is_entry_path(F.col("path")),
        "digests": F.col("hash").rlike(_DIGEST) & digest("blob_hash") & digest("footer"),
        "numbers": (F.col("size") >= 0) & (F.col("mtime_ns") >= 0),
        "mode": F.col("identity_mode").isin(CONTENT, META),
        "meta": content | (F.col("blob_hash").isNull() & F.col("source_uri").isNotNull()),
        "blob": ~content | F.col("blob_hash").isNull() | (F.col("blob_hash") == F.col("hash")),
        "footer": ~content | F.col("footer").isNull() | F.col("blob_hash").isNotNull(),
        "source": F.col("source_uri").isNull() | (F.trim("source_uri") != ""),
    }


def valid() -> Column:
    """Whether an entry keeps every rule that a row alone can break."""
    out = F.lit(True)
    for ok in invariants().values():
        out = out & F.coalesce(ok, F.lit(False))
    return out


def violations(entries: DataFrame) -> DataFrame:
    """path, rule: a row for each rule that an entry breaks, `unique` among them for a path that occurs twice."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in invariants().items()))
    rules = entries.select("path", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))
    twice = entries.groupBy("path").count().filter("count > 1").select("path", F.lit("unique").alias("rule"))
    return rules.unionByName(twice)
