"""Row-group pruning from parquet statistics alone: which row groups of which files can hold matching rows.

Statistics (RG_STATS) have a lane for each kind of value: long, double, string, boolean. A predicate is decided in the
lane of its literal; numbers compare across the two numeric lanes; anything else, and missing statistics, leave the
group undecided, and undecided groups are kept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("=", "!=", "<", "<=", ">", ">=", "IS NULL", "IS NOT NULL")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: str | int | float | bool | None = None


_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<op><=|>=|!=|<>|=|<|>)|(?P<word>[^\s'"=<>!]+))""")
_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?")


def _literal(token: str, quoted: bool) -> str | int | float | bool | None:
    if quoted:
        return token[1:-1].replace(token[0] * 2, token[0])
    lower = token.lower()
    if lower in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[lower]
    if _INT.fullmatch(token):
        return int(token)
    return float(token) if _FLOAT.fullmatch(token) else token


def parse_where(text: str) -> list[Predicate]:
    """Predicates of `column op literal` and `column IS [NOT] NULL`, joined by AND. OR, or anything else, is an error."""
    tokens, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read predicate at: {text[at:]}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        raise ValueError("WHERE clause cannot be empty")
    out, i = [], 0
    word = lambda k: tokens[k][1].upper() if k < len(tokens) and tokens[k][0] == "word" else None
    while True:
        if i >= len(tokens) or tokens[i][0] == "op" or word(i) in ("AND", "OR"):
            raise ValueError(f"a column is expected in: {text}")
        column = tokens[i][1] if tokens[i][0] == "word" else tokens[i][1][1:-1]
        if word(i + 1) == "IS":
            no = word(i + 2) == "NOT"
            if word(i + 2 + no) != "NULL":
                raise ValueError(f"IS must be followed by NULL or NOT NULL in: {text}")
            out.append(Predicate(column, "IS NOT NULL" if no else "IS NULL"))
            i += 3 + no
        elif i + 2 < len(tokens) and tokens[i + 1][0] == "op" and tokens[i + 2][0] != "op":
            kind, token = tokens[i + 2]
            op = tokens[i + 1][1].replace("<>", "!=")
            out.append(Predicate(column, op, _literal(token, kind == "quoted")))
            i += 3
        else:
            raise ValueError(f"an operator and a value are expected after {column}")
        if i == len(tokens):
            return out
        if word(i) != "AND":
            raise ValueError(f"only AND is supported, not {tokens[i][1]}")
        i += 1


def possible(p: Predicate) -> Column:
    """Whether a row group can hold a row that p accepts: true, false, or null where statistics don't tell."""
    nulls, rows = F.col("nulls"), F.col("rows")
    if p.op == "IS NULL":
        return nulls > 0
    if p.op == "IS NOT NULL":
        return nulls < rows
    least = most = F.lit(None).cast("string")
    value = F.lit(p.value)
    if isinstance(p.value, bool):
        least, most = F.col("min_b"), F.col("max_b")
    elif isinstance(p.value, int) and -(1 << 63) <= p.value < 1 << 63:
        least, most = F.coalesce("min_l", "min_d"), F.coalesce("max_l", "max_d")
        # A long compares with the long lane exactly, with the double lane as a double.
        long_, double = F.lit(p.value).cast("long"), F.lit(float(p.value))
        return F.when(F.col("min_l").isNotNull() | F.col("max_l").isNotNull(), _decide(p.op, F.col("min_l"), F.col("max_l"), long_)).otherwise(_decide(p.op, F.col("min_d"), F.col("max_d"), double))
    elif isinstance(p.value, (int, float)):
        least, most = F.coalesce(F.col("min_d"), F.col("min_l").cast("double")), F.coalesce(F.col("max_d"), F.col("max_l").cast("double"))
        value = F.lit(float(p.value))
    elif isinstance(p.value, str):
        least, most = F.col("min_s"), F.col("max_s")
    else:
        value = F.lit(None).cast("string")
    return _decide(p.op, least, most, value)


def _decide(op: str, least: Column, most: Column, value: Column) -> Column:
    known = least.isNotNull() & most.isNotNull() & value.isNotNull()
    if op == "=":
        return F.when(known, (least <= value) & (value <= most))
    if op == "!=":
        # Only exact bounds prove that every value equals the literal; null rows count as unequal.
        only = F.when(known & F.coalesce(F.col("exact"), F.lit(True)), ~((least == value) & (most == value)))
        return F.when(F.col("nulls") > 0, True).when(F.col("nulls") == 0, only).otherwise(F.when(~only, F.lit(None).cast("boolean")).otherwise(only))
    bound = most if op[0] == ">" else least
    return F.when(bound.isNotNull() & value.isNotNull(), {"<": bound < value, "<=": bound <= value, ">": bound > value, ">=": bound >= value}[op])


def decided(stats: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """path, footer, rg, keep for each row group: false only where some predicate is impossible. One pass over stats."""
    verdict = F.lit(None).cast("boolean")
    for p in predicates:
        here = F.when(F.col("col") == p.column, possible(p))
        verdict = F.when(~F.coalesce(here, F.lit(True)), False).otherwise(F.coalesce(verdict, F.lit(True)))
    return stats.groupBy("path", "footer", "rg").agg(F.bool_and(F.coalesce(verdict, F.lit(True))).alias("keep"))


def prune(stats: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """PRUNE rows: for each file with statistics, the numbers of its row groups that stay and that go."""
    each = decided(stats, predicates)
    numbers = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("rg")))).alias
    return each.groupBy("path", "footer").agg(F.count(F.lit(1)).cast("int").alias("total_row_groups"), numbers(F.col("keep"))("kept"), numbers(~F.col("keep"))("pruned"))


def applicability(stats: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """path, footer, column, applicable: whether each predicate's column decided any of a file's row groups. A file
    whose groups don't all decide it has a row for both, as some groups were kept for want of statistics."""
    files = stats.select("path", "footer", "rg").distinct()
    out = None
    for i, p in enumerate(predicates):
        mine = stats.filter(F.col("col") == p.column).select("path", "rg", possible(p).alias("_p"))
        known = files.join(mine, ["path", "rg"], "left").select("path", "footer", F.lit(i).alias("n"), F.lit(p.column).alias("column"), F.col("_p").isNotNull().alias("applicable")).distinct()
        out = known if out is None else out.unionByName(known)
    return out


def summary(pruned: DataFrame) -> DataFrame:
    """One row: files, row groups, kept and pruned ones."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return pruned.agg(F.count(F.lit(1)).alias("files"), total("total_row_groups").alias("row_groups"), total(F.size("kept")).alias("kept"), total(F.size("pruned")).alias("pruned"))


def planned(entries: DataFrame, stats: DataFrame, prefix: str, predicates: Sequence[Predicate]) -> DataFrame:
    """PRUNE rows of the entries below a path prefix that have statistics; stats are keyed by footer."""
    wanted = entries.filter(F.col("path").startswith(prefix) & F.col("footer").isNotNull()).select("path", "footer")
    return prune(wanted.join(stats.drop("path"), "footer"), predicates)


def report(entries: DataFrame, stats: DataFrame, prefix: str, predicates: Sequence[Predicate]) -> DataFrame:
    """planned() with `applicable`, the columns that decided some row group (in the order of the predicates, each as often as
    it stands there), and `inapplicable`, sorted, those that left some undecided."""
    wanted = entries.filter(F.col("path").startswith(prefix) & F.col("footer").isNotNull()).select("path", "footer")
    mine = wanted.join(stats.drop("path"), "footer")
    used = applicability(mine, predicates).groupBy("path").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("applicable"), F.struct("n", "column")))), lambda x: x["column"]).alias("applicable"),
        F.sort_array(F.collect_set(F.when(~F.col("applicable"), F.col("column")))).alias("inapplicable"),
    )
    return prune(mine, predicates).join(used, "path", "left")


def scan_plan(entries: DataFrame, stats: DataFrame, prefix: str, predicates: Sequence[Predicate]) -> DataFrame:
    """Every entry below prefix that may hold matching rows: files without statistics stay, with null row groups."""
    wanted = entries.filter(F.col("path").startswith(prefix)).select("path", "footer", "blob_hash", "source_uri")
    report = planned(entries, stats, prefix, predicates).select("path", "kept")
    return wanted.join(report, "path", "left").filter(F.col("kept").isNull() | (F.size("kept") > 0))


def where_column(predicates: Sequence[Predicate]) -> Column:
    """The predicates as an ordinary filter, for the scan of what pruning leaves."""
    out = F.lit(True)
    for p in predicates:
        c = F.col(".".join(f"`{part}`" for part in p.column.split(".")))
        one = {"IS NULL": c.isNull(), "IS NOT NULL": c.isNotNull(), "=": c == F.lit(p.value), "!=": c != F.lit(p.value)}.get(p.op)
        if one is None:
            one = {"<": c < p.value, "<=": c <= p.value, ">": c > p.value, ">=": c >= p.value}[p.op]
        out = out & one
    return out
