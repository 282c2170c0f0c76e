"""Quality rules: per-document rules, and host-level verdicts from rates that are shrunk to an empirical beta prior.

Each document is measured once in Python (bytes.split is exactly the contract's word rule). Rule failures are then
counted by host (the `source` column), each host's failure rate is shrunk towards a beta prior that is fitted to all
hosts by the method of moments, and the verdict is joined back. A document is rejected if it fails the base rules, or
if its host is bad and it fails a soft rule itself; clean documents of a bad host stay.

Edge cases: null text has no words and fails; a null host is a host of its own; every row is measured by itself, so
repeated rows and ids each give a row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, mapped, materialize, null_safe_key, per_row

#: A host is bad if more than this share of its documents is expected to fail, after shrinkage.
BAD_HOST_RATE = 0.5
#: Pseudo-documents of the prior where the hosts' rates do not vary.
EVEN_PRIOR = 100.0

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_ARROW = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in MEASURES)])
_MEASURES = StructType([StructField(m, LongType()) for m in MEASURES])
_DDL = "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    text = text or b""
    words = text.split()
    spaces = len(text) - len(text.translate(None, SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text.decode("utf-8", "replace")) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host (null-safe key of source) and the six measures, a row for each input row."""
    rows = docs.select("doc_id", null_safe_key("source").alias("host"), F.col("text").cast("binary").alias("text"))
    return mapped(rows, per_row(_ARROW, lambda doc_id, host, text: (doc_id, host, *measure(text))), _DDL)


def annotated(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct of the six measures under name, row by row."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            found = pa.array([dict(zip(MEASURES, measure(t))) for t in texts], kind)
            yield batch.append_column(name, found)

    return mapped(docs, run, StructType([*docs.schema.fields, StructField(name, _MEASURES)]))


def rule_conditions(m: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """Whether a document fails the base rules, and whether it fails a soft one, from m of each measure's name."""
    words, repeated = m("n_words"), m("n_repeat_words")
    base = (words < 50) | (100 * repeated > 50 * words)
    soft = (10 * m("n_symbols") > m("word_chars")) | (10 * m("n_dup_lines") > 3 * m("n_lines")) | (100 * repeated > 20 * words)
    return base, soft | (m("word_chars") < 3 * words) | (m("word_chars") > 10 * words)


def ruled(stats: DataFrame) -> DataFrame:
    """Adds base_failed and soft_failed to measured documents."""
    base, soft = rule_conditions()
    return stats.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_verdicts(rules: DataFrame) -> DataFrame:
    """A row for each host: n_host, host_rate (shrunk), host_bad. Sums are made map-side, so a hot host costs no more."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"), F.sum(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_host")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    even = F.col("m") * (1 - F.col("m"))
    strength = F.when((F.col("v") > 1e-12) & (F.col("v") < even), even / F.col("v") - 1).otherwise(F.lit(EVEN_PRIOR))
    # One row of two numbers joins every host: a scalar, not a cross join of tables.
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_host") + F.col("k"))
    return (
        hosts.crossJoin(F.broadcast(prior.withColumn("k", strength)))
        .select("host", "n_host", shrunk.alias("rate"))
        .select("host", "n_host", F.round("rate", 6).alias("host_rate"), (F.round("rate", 6) > BAD_HOST_RATE).alias("host_bad"))
    )


def judge(docs: DataFrame) -> DataFrame:
    """The decision and its grounds for each document."""
    rules = ruled(materialize(measured(docs), "quality"))
    # Written out, the hosts' size is known before the join: few hosts are broadcast and no document is shuffled, and
    # the documents of a hot host stay where they are; many are joined by a shuffle, which AQE splits where it skews.
    hosts = materialize(host_verdicts(rules), "hosts")
    return (
        rules.join(hosts, "host")
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed")))
        .select("doc_id", *MEASURES[:5], "base_failed", "kept", "soft_failed", "host_rate", "host_bad")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Each row is judged by itself, whatever its doc_id. Rows
    are written with their measures, so no text is measured twice or shuffled.

    Rows with a null text go; so does nothing else that lacks a value; an empty table stays one; columns of any other
    names are kept as they are."""
    name, host, bad = fresh(docs.columns, "measures", "host", "host_bad")
    rows = materialize(annotated(docs, name), "annotated")
    # What is counted has no other columns, so none can clash.
    hosts = host_verdicts(ruled(rows.select(null_safe_key("source").alias("host"), F.col(f"{name}.*"))))
    hosts = materialize(hosts.filter("host_bad"), "hosts").select(F.col("host").alias(host), F.col("host_bad").alias(bad))
    base, soft = rule_conditions(lambda m: F.col(f"{name}.{m}"))
    rows = rows.withColumn(host, null_safe_key("source")).join(hosts, host, "left")
    return rows.filter(~base & ~(F.coalesce(F.col(bad), F.lit(False)) & soft)).select([F.col(f"`{c}`") for c in docs.columns])
