"""Mixing sources to target weights. DataFrame functions only.

The words of a source, its documents in a pseudorandom order, are packed into blocks of BLOCK words. A mix is a number of
slots, a block each, dealt to output shards of SHARD_SLOTS slots. How many slots of a shard each source gets is a
multinomial draw, given that over all shards a source gets its quota: slots are numbered source by source, and a
pseudorandom permutation of all slots says where each one goes, by counter alone, so any task can draw any slot. (Draws
that ignored the quotas would miss the target of a source of n slots by some sqrt(n) of them.) The j-th slot of a source
is its pass j div n_blocks, and its block is the place of j mod n_blocks under that pass's pseudorandom permutation
(swap-or-not rounds, which permute any range). Blocks are then joined to the documents by index.

A target stops at MOST_PASSES times its source's size and the excess is shared by weight (water filling); quotas end
there too, so no document is taken more than MOST_PASSES times. Sources may be many: their ranks, targets and places are
found by ranges and sums, not in one task.

Edge cases: null text has size 0 and nothing is taken of it; a null source is a source of its own, the last; repeated
rows are documents each, and so are rows with a null doc_id; a very long text lies in many blocks, which need not stay
together; an empty table gives no rows; other columns are ignored, or, by mixed(), kept, whatever their names. Ties in the
order of documents are between rows with equal id and size, whose results are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running

BLOCK = 64
SHARD_SLOTS = 8192
MOST_PASSES = 3
WEIGHTS = (5, 2, 1)
SEED = 20240607
ROUNDS = 16
#: Numbers that one row is exploded to at a time.
STEP = 8192
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of each row, and row, a number that breaks ties."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row"))


def _by_source() -> Column:
    return F.col("source").asc_nulls_last()


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, n_blocks for each source."""
    by_source = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rank = running(by_source, [_by_source()], {"rank": "1"})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = materialize(rank.select("source", "source_size", weight.alias("weight"), (F.lit(float(MOST_PASSES)) * F.col("source_size")).alias("cap")), "weights")
    # The level of the water rises until no further source is above its cap: some rounds of sums over the sources.
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        free = F.when(~full, F.col("weight"))
        n, rest, share = rows.agg(F.count_if(full), F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(free)).first()
        if n == capped or not rest or not share:
            break
        level, capped = rest / share, n
    target = F.least("cap", F.lit(level) * F.col("weight"))
    n_blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    return rows.select("source", "source_size", "weight", target.alias("target"), n_blocks.alias("n_blocks"))


def _numbers(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """rows with name, each number below n: by steps, so that no array has more than STEP numbers (or n / STEP / STEP)."""
    steps = lambda size: F.ceil(n / size).cast("long") - 1
    upto = lambda start, last: F.explode(F.sequence(start, F.greatest(start, last)))
    out = rows.filter(n > 0).withColumn(name, upto(F.lit(0).cast("long"), steps(STEP * STEP)))
    out = out.withColumn(name, upto(F.col(name) * STEP, F.least((F.col(name) + 1) * STEP - 1, steps(STEP))))
    # Few and small rows stand for many numbers: they are dealt to all tasks by number, which AQE doesn't coalesce.
    out = out.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", name)
    return out.withColumn(name, upto(F.col(name) * STEP, F.least((F.col(name) + 1) * STEP - 1, n - 1)))


def slots(goals: DataFrame) -> DataFrame:
    """source, block, pass, shard: a row for each slot of the mix."""
    share = F.col("target") * F.col("n_blocks") / F.col("source_size")
    # What is left of a slot is drawn, so that small sources get their share on average.
    chance = F.pmod(F.xxhash64(F.lit(SEED), "source"), F.lit(1 << 30)) / float(1 << 30)
    quota = F.least(F.floor(share + chance).cast("long"), F.col("n_blocks") * MOST_PASSES)
    quotas = goals.filter(F.col("source_size") > 0).select("source", "n_blocks", quota.alias("quota"))
    rows = materialize(running(quotas, [_by_source()], {"first": "quota"}), "quotas")
    every = rows.agg(F.sum("quota")).first()[0] or 0
    drawn = _numbers(rows, F.col("quota"), "slot")
    place = _permuted(F.col("first") + F.col("slot"), F.lit(every).cast("long"), F.lit(SEED))
    turn = F.floor(F.col("slot") / F.col("n_blocks")).cast("long")
    numbered = drawn.select("source", "n_blocks", turn.alias("pass"), (F.col("slot") % F.col("n_blocks")).alias("index"), F.floor(place / SHARD_SLOTS).cast("long").alias("shard"))
    return numbered.select("source", _permuted(F.col("index"), F.col("n_blocks"), F.col("source"), F.col("pass")).alias("block"), "pass", "shard")


def _permuted(index, n, *key):
    """index under a permutation of 0 .. n-1 that key picks: in each round index and its partner (k - index) mod n
    swap places or not, by a bit that both of them hash to."""

    def turn(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + 1), r, *key), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 2), r, F.greatest(x, partner), *key).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def placed(sizes: DataFrame) -> DataFrame:
    """sizes (source, size, doc_id, row) with `at`, the number of words of the source before the document, in an order
    that is pseudorandom by doc_id. It tells the rows of a source that have words apart."""
    order = [_by_source(), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size")), F.col("row")]
    rows = materialize(running(sizes, order, {"at": "size"}), "placed")
    starts = rows.groupBy("source").agg(F.min("at").alias("start")).withColumnRenamed("source", "_source")
    return rows.join(starts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("at", (F.col("at") - F.col("start")).cast("long")).drop("_source", "start")


def doc_blocks(rows: DataFrame) -> DataFrame:
    """For each document with words and each block that it lies in: from, to (its words, `to` exclusive) and block."""
    end = F.col("at") + F.col("size")
    spread = rows.filter(F.col("size") > 0).select("*", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    low, high = F.greatest("at", F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    return spread.withColumn("from", low - F.col("at")).withColumn("to", high - F.col("at"))


def _by_block(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins by block index. Slots come from a row for each source, which says nothing of their number: estimates of it
    must not choose a broadcast."""
    right = right.hint("merge").withColumnsRenamed({"source": "_source", "block": "_block"})
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs, and first_shard, the first that has a word of it."""
    sizes = materialize(sized(docs), "sizes")
    goals = materialize(targets(sizes), "targets")
    rows = placed(sizes)
    times = slots(goals).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    words = ((F.col("to") - F.col("from")) * F.col("times")).alias("words")
    found = _by_block(doc_blocks(rows), times).select("source", "at", words, "shard").groupBy("source", "at").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    have = rows.filter(F.col("size") > 0).join(
        found.withColumnsRenamed({"source": "_s", "at": "_a"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_a")), "left"
    ).select("doc_id", "source", "size", "taken", "first_shard")
    every = have.unionByName(sizes.filter(F.col("size") == 0).select("doc_id", "source", "size"), allowMissingColumns=True)
    goal = goals.select(F.col("source").alias("_s"), "source_size", "target")
    return every.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_shard"
    )


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs) and row, which tells rows apart: the doc_id, or where that is null or repeated
    somewhere a number, for which the rows are written out."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("row", F.col("doc.doc_id").cast("long"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and pass the words of its taken blocks (the whole text where all are),
    with the other columns of docs. Documents without words, and those of which nothing is taken, go."""
    told = _told_apart(docs)
    size = F.coalesce(F.regexp_count(F.col("doc.text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(told.select("doc.doc_id", "doc.source", size.alias("size"), "row"), "sizes")
    rows = placed(sizes)
    taken = _by_block(doc_blocks(rows), slots(materialize(targets(sizes), "targets")).select("source", "block", "pass"))
    runs = taken.groupBy("row", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs")).drop("pass")
    joined = told.join(runs, "row")
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"]) == F.col("size")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    some = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")), 1)
    joined = joined.withColumn("text", F.when(whole, F.col("doc.text")).otherwise(some))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
