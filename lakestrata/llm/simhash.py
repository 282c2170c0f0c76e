"""SimHash fingerprints and their neighbours. DataFrame functions only.

A text's terms are its shingles of WORDS words, weighted by how often they occur. A fingerprint has two halves of 64
bits; in each, the terms' 64-bit hashes vote on the signs of the bits. Votes are counted eight bits to a long:
(hash >>> i) & LANES holds bits i, i + 8, ... i + 56 in lanes of 8 bits, which LANE_TERMS terms cannot overflow. A
fingerprint is one expression over a row, so neither a long text nor a common term makes a hot group.

A bit differs between two texts of Jaccard similarity 0.8 with a chance of about 0.15, so their fingerprints are about 19
bits apart; RADIUS holds nearly all such pairs, and unrelated texts, 64 bits apart, stay out. Neighbours are found in
permuted block tables: each table's permutation brings some of the BLOCKS blocks of bits to the front, and fingerprints
whose fronts agree meet there. So many blocks stand in front that a front has few fingerprints by chance, whatever their
number, and there are so many tables that a pair DESIGN bits apart meets in one of them with a chance of FOUND; nearer
pairs, which are most, are surer. Pairs that meet are compared exactly, and a pair comes from the first table where it
meets, so none is made twice. Both sides grow with the number of fingerprints times the number of tables, which grows as
its 0.23rd power. A fingerprint stands for its rows: equal ones are found by equality, all of them.

No set of tables finds every pair at such a radius with fronts of more than 4 bits: of 28 differing bits some may lie in
each block. The pairs within RADIUS that meet in no table are found by a scan, which holds SCAN_QUERIES queries at a time
against every fingerprint: two XORs and bit counts, some 4 ns, a pair. So no pair is left out, and this part grows as the
queries times the fingerprints.

Edge cases: a null text is empty, and a text without words has fingerprint 0; fewer than WORDS words are one term;
a null doc_id comes last in descending order; rows that share a doc_id, or have none, follow each other by a digest of
their text, and equal rows follow each other; with one document the next is itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WORDS = 5
BITS = 128
RADIUS = 28
#: Blocks of a fingerprint; a distance, and the chance that tables find a pair so far apart.
BLOCKS = 64
DESIGN = 25
FOUND = 0.96
#: Blocks in front so many that 2 to the power of their bits is at least the fingerprints over FRONT.
FRONT = 16
#: Fronts of queries that may be broadcast, some 150 bytes each.
BROADCAST_FRONTS = 400_000
#: Queries that a scan holds at once, some 50 bytes each, which a core's cache should keep.
SCAN_QUERIES = 16_000
SEED = 20240611
LANES = 0x0101010101010101
LANE_TERMS = 127
NO_ID = -(1 << 63)
_KEY = ["k", "j"]


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h):
        each = F.transform(F.sequence(F.lit(1), F.size(h) - (WORDS - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + n) for n in range(WORDS))))
        few = F.array(F.aggregate(h, _long(0), lambda a, w: F.xxhash64(a, w)))
        return F.when(F.size(h) >= WORDS, each).when(F.size(h) > 0, few).otherwise(F.array().cast("array<long>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _second_hashes(first: Column) -> Column:
    return F.transform(first, lambda h: F.xxhash64(h, F.lit(2)))


def term_hashes(text: Column) -> list[Column]:
    """The 64-bit hashes of the shingles of text for each half of a fingerprint."""
    first = _first_hashes(text)
    return [first, _second_hashes(first)]


def _votes(terms: Column) -> Column:
    """64 bits: whether more than half of the terms' hashes have each set."""

    def lane(part, i):
        return F.aggregate(part, _long(0), lambda a, h: a + F.shiftrightunsigned(h, i).bitwiseAND(_long(LANES)))

    def lanes(part):
        return F.array(*(lane(part, i) for i in range(8)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(terms) - 1) / LANE_TERMS).cast("int")), lambda p: F.slice(terms, p * LANE_TERMS + 1, LANE_TERMS))

    def bits(sums):
        def bit(b):
            shift = (F.floor(b / 8) * 8).cast("int")
            ones = F.aggregate(sums, _long(0), lambda a, s: a + F.call_function("shiftrightunsigned", F.element_at(s, (b % 8 + 1).cast("int")), shift).bitwiseAND(_long(255)))
            return F.when(2 * ones > F.size(terms), F.call_function("shiftleft", _long(1), b)).otherwise(_long(0))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), _long(0), lambda a, x: a.bitwiseOR(x))

    return F.when(F.size(terms) == 0, _long(0)).otherwise(_let(F.transform(parts, lanes), bits))


def fingerprint(text: Column) -> Column:
    """The SimHash of text: a struct of its halves, lo and hi."""
    return _let(_first_hashes(text), lambda t: F.struct(_votes(t).alias("lo"), _let(_second_hashes(t), _votes).alias("hi")))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1.0 - distance(a, b) / float(BITS)


def keyed(docs: DataFrame) -> DataFrame:
    """k, j, text, copies: a row for each doc_id and text. j tells texts of one doc_id apart, and copies is how many rows
    are equal; only where there are several rows of a doc_id, or of none, are they looked for."""
    rows = docs.select(F.coalesce("doc_id", _long(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("k").count().filter("count > 1").isEmpty():
        return rows.select("k", F.lit("").alias("j"), "text", F.lit(1).cast("long").alias("copies"))
    return rows.groupBy("k", F.md5(F.col("text").cast("binary")).alias("j")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def successors(keys: DataFrame) -> DataFrame:
    """k, j, next_k, next_j by descending k (ascending j); the last row's next is the first. Keys are dealt by range;
    windows run within a range, and across the ranges' first keys."""
    down = F.bitwise_not("k").alias("down")  # ascending where k descends, without overflow
    ranged = materialize(keys.select(down, "j").repartitionByRange("down", "j").select("*", F.spark_partition_id().alias("part")), "keys")
    pair = F.struct("down", "j")
    inner = ranged.withColumn("inner", F.lead(pair).over(Window.partitionBy("part").orderBy("down", "j")))
    heads = ranged.groupBy("part").agg(F.min(pair).alias("head"))
    first = F.first("head").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), first).alias("head"))
    after = inner.join(F.broadcast(heads), "part").select("down", "j", F.coalesce("inner", "head").alias("n"))
    return after.select(F.bitwise_not("down").alias("k"), "j", F.bitwise_not("n.down").alias("next_k"), F.col("n.j").alias("next_j"))


def _edited(text: Column, head: Column) -> Column:
    return F.concat(F.left(text, F.char_length(text) - F.floor(F.char_length(text) / 2).cast("int")), head)


def fingerprints(docs: DataFrame) -> DataFrame:
    """k, j, copies, next_k, next_j, n_chars, edited_sha256, fp, edited_fp for each doc_id and text. Of several equal rows
    these hold for the last; again_sha256 and again_fp are those of the others, each of which an equal row follows. Texts
    are shuffled once whole, by their key, and once as the heads that the documents before them ask for."""
    rows = keyed(docs)
    next_of = materialize(successors(rows.select(*_KEY)), "successors")
    half = F.floor(F.char_length("text") / 2).cast("int")
    asked = rows.select(*_KEY, half.alias("half")).join(next_of, _KEY).select(F.col("next_k").alias("k"), F.col("next_j").alias("j"), F.col("k").alias("by_k"), F.col("j").alias("by_j"), "half")
    heads = rows.join(asked, _KEY).select(F.col("by_k").alias("k"), F.col("by_j").alias("j"), F.left(F.col("text"), F.col("half")).alias("head"))
    both = rows.join(heads, _KEY).select(*_KEY, "copies", F.char_length("text").cast("long").alias("n_chars"), "text", _edited(F.col("text"), F.col("head")).alias("edited"))
    again = _edited(F.col("text"), F.left(F.col("text"), half))
    prints = both.select(
        *_KEY, "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"),
        F.when(F.col("copies") > 1, F.sha2(again, 256)).alias("again_sha256"), F.when(F.col("copies") > 1, fingerprint(again)).alias("again_fp"),
    )
    return materialize(prints, "fingerprints").join(next_of, _KEY)


def tables(n: int) -> list[tuple[int, int]]:
    """The masks (lo, hi) of the blocks that stand in front in each permuted table, for n fingerprints."""
    size = BITS // BLOCKS
    front = min(BLOCKS, max(1, -(-max(0, math.ceil(math.log2(max(n, 1) / FRONT))) // size)))
    meets = (1 - DESIGN / BITS) ** (front * size)
    draw, out = random.Random(SEED), []
    for _ in range(max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - meets))) if meets < FOUND else 1):
        mask = sum((1 << size) - 1 << b * size for b in draw.sample(range(BLOCKS), front))
        out.append(tuple(m - (1 << 64) if m >> 63 else m for m in (mask & (1 << 64) - 1, mask >> 64)))
    return out


def neighbours(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """Each pair q, fp of a queried and a stored distinct fingerprint at most RADIUS bits apart, equal ones included, with
    the other columns of prints, whose fp is distinct. Equal ones are joined as such; others meet in permuted tables, or in
    none and are scanned for."""
    spark, chosen = prints.sparkSession, tables(prints.count())
    masks = F.array(*(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in chosen))

    def fronts(df: DataFrame, fp: str) -> DataFrame:
        each = df.select("*", F.posexplode(masks).alias("table", "mask"))
        front = F.xxhash64("table", F.col(f"{fp}.lo").bitwiseAND(F.col("mask.lo")), F.col(f"{fp}.hi").bitwiseAND(F.col("mask.hi")))
        return each.withColumn("front", front).drop("mask")

    # Fingerprints are few bytes and much work, so their partitions must not be coalesced.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = materialize(queries.select(F.col("fp").alias("q")).distinct(), "queries")
    n_queries, stored = distinct.count(), prints.select("fp").repartition(parts)
    asked = fronts(distinct, "q").drop("table")
    # The planner takes exploded rows for few: their number says whether they are broadcast or both sides are dealt.
    asked = F.broadcast(asked) if n_queries * len(chosen) <= BROADCAST_FRONTS else asked.hint("merge")
    met = fronts(stored, "fp").join(asked, "front")
    differ = lambda half: F.col(f"q.{half}").bitwiseXOR(F.col(f"fp.{half}"))
    agree = lambda m: (F.col("lo").bitwiseAND(m["lo"]) == 0) & (F.col("hi").bitwiseAND(m["hi"]) == 0)
    apart = F.bit_count("lo") + F.bit_count("hi")
    near = met.select("q", "fp", "table", differ("lo").alias("lo"), differ("hi").alias("hi")).filter((apart <= RADIUS) & (apart > 0))
    # The first table where they meet; a front's digest may bring others together, which is no table's doing.
    first = F.array_position(F.transform(masks, agree), True) - 1
    near = near.filter(first == F.col("table")).select("q", "fp").unionByName(distinct.select("q", F.col("q").alias("fp")))
    for pairs in scanned(distinct, n_queries, stored):
        alone = pairs.select("q", "fp", differ("lo").alias("lo"), differ("hi").alias("hi")).filter(first < 0)
        near = near.unionByName(alone.select("q", "fp"))
    return near.join(prints, "fp").select("q", *prints.columns)


def scanned(queries: DataFrame, n_queries: int, stored: DataFrame) -> list[DataFrame]:
    """The pairs q, fp of a query and a stored fingerprint that are 1 to RADIUS bits apart, by comparing all: a written
    table for each share of the queries, one after the other, as each is broadcast."""
    half = lambda c, h: F.coalesce(F.col(f"{c}.{h}"), _long(0)).alias(f"{c}_{h}")
    shares, out = -(-n_queries // SCAN_QUERIES), []
    flat = stored.select(half("fp", "lo"), half("fp", "hi"))
    differ = lambda h: F.bit_count(F.col(f"q_{h}").bitwiseXOR(F.col(f"fp_{h}")))
    apart = differ("lo") + differ("hi")
    whole = lambda c: F.struct(F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")).alias(c)
    for share in range(shares):
        asked = queries.filter(F.pmod(F.xxhash64("q"), F.lit(shares)) == share).select(half("q", "lo"), half("q", "hi"))
        # The radius, which few pass, is asked first; what else is asked of pairs is asked once they are written.
        pairs = flat.join(F.broadcast(asked), (apart <= RADIUS) & (apart > 0))
        out.append(materialize(pairs.select(whole("q"), whole("fp")), "scan"))
    return out


def simhash(docs: DataFrame, every: int = 50) -> DataFrame:
    """The contract's columns, and the search: for documents whose id `every` divides, n_near is how many others lie within
    RADIUS, and near_ids has the smallest doc_id of each other fingerprint there. first_id, in every row, is the smallest
    doc_id that has the row's fingerprint, so near_ids and first_id give all pairs; null where only null ids have it."""
    prints = materialize(fingerprints(docs), "simhash")
    nexts = prints.select(F.col("k").alias("next_k"), F.col("j").alias("next_j"), F.col("fp").alias("next_fp"))
    asked = (F.col("k") != NO_ID) & (F.col("k") % every == 0)
    real = F.when(F.col("k") != NO_ID, F.col("k"))
    groups = materialize(prints.groupBy("fp").agg(F.sum("copies").alias("n"), F.min(real).alias("first_id")), "groups")
    other = F.when(F.col("q") != F.col("fp"), F.struct("first_id"))
    ids = F.transform(F.sort_array(F.collect_list(other)), lambda x: x["first_id"])
    near = neighbours(prints.filter(asked), groups).groupBy("q").agg((F.sum("n") - 1).alias("n_near"), ids.alias("near_ids")).withColumnRenamed("q", "fp")
    hexed = lambda c: F.concat(*(F.lower(F.lpad(F.hex(f"{c}.{half}"), 16, "0")) for half in ("hi", "lo")))
    rows = prints.join(nexts, ["next_k", "next_j"]).join(groups.select("fp", "first_id").join(near, "fp", "left"), "fp")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    last = lambda c, again: F.when(F.col("copy") == 1, F.col(c)).otherwise(again)
    rows = rows.withColumns({"edited_sha256": last("edited_sha256", F.col("again_sha256")), "edited_fp": last("edited_fp", F.col("again_fp")), "next_fp": last("next_fp", F.col("fp"))})
    return rows.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
        F.when(asked, F.col("near_ids")).alias("near_ids"),
        "first_id",
    )
