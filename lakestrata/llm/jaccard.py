"""Jaccard self-join of word n-gram sets, and the connected components of its links.

Equal sets are joined first: from then on there is one row for each distinct set (`sid`, a digest of the set). Two sets
that link share a token among the first n - ceil(t n) + 1 of each, in any fixed order of tokens; the order puts long shingles
first and the corpus's most frequent ones last, so that prefixes hold rare ones. Sets that share a prefix token meet in
tiles: by token, by band of sizes (sets that link are in the same band or in adjacent ones) and, for large groups, by
pairs of hashed blocks, so that no task gathers an unbounded group. Two members are compatible if their sizes, and the
places of the shared token in both, allow a link. The differing bits of two hashed bitmaps are a lower bound of the
sets' symmetric difference, and so bound their overlap from above. Pairs that pass are verified by exact intersection of
the sorted arrays.

Only links that components need are verified, in two rounds. In the first, each set joins the tiles of a few of its
shared tokens (CHOSEN), and each tile asks for a spanning forest of the pairs that pass, closest pairs first. In the
second, which leaves out nothing, every pair that passes in the tile of any shared token and still lies across two
components is verified. So a dense group of near copies costs about as many verifications as it has members, and yet no
link between components is missed.

Edge cases: null or wordless text has an empty set, links with nothing and is its own component; fewer words than a
shingle are one shingle; rows that share a doc_id are separate sets with that id; rows with a null doc_id link as any
others, and a component of such rows alone has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, mapped, materialize
from .graph import components
from .shingles import shingle_sets

#: Tokens that are held at a time to be counted: 16 MB, and those of one document more.
HELD = 1 << 21
#: Tokens in at least LOCAL_OFTEN of the sets held are counted over the corpus; at most FREQUENT of them, the most
#: frequent, are ordered by their counts, after all other tokens. The order affects speed alone; its table is bounded.
LOCAL_OFTEN = 3
FREQUENT = 1 << 18
#: Compatible pairs for each member up to which a tile gives its pairs; a denser tile gives its members.
SPARSE = 2
#: Members of a block; a tile holds two blocks of two bands at most.
BLOCK = 512
#: Shared tokens of a set, the most and the least frequent so many, whose tiles it joins in the first round.
CHOSEN = 2
#: Ids that may be broadcast to pick texts for verification; beyond, a shuffled join does.
BROADCAST_IDS = 400_000
NO_ID = -(1 << 63)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    return shingle_sets([t or b"" for t in batch.column("text").to_pylist()], words)


def _sid(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Bit (token mod width) for each token; the width, a power of two, is at least four times the number of tokens, so
    that few differing tokens share a bit with others."""
    width = max(256, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[tokens & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _docs(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id without nulls, text as bytes, and row, a digest that tells rows of one doc_id apart."""
    row = F.lit(0).cast("long") if row is None else row
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc_id"), F.col("text").cast("binary").alias("text"), row.alias("row"))


def measured(docs: DataFrame, words: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each document: doc_id, row, sid, n, bitmap; and token, count of tokens that are frequent somewhere."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()), ("token", pa.int64())])

    def counted(every):
        tokens = np.sort(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        counts = np.diff(starts, append=len(tokens))
        often = counts >= LOCAL_OFTEN
        return [(None, None, None, int(c), None, int(t)) for t, c in zip(tokens[starts[often]].view(np.int64), counts[often])]

    def parts(rows):
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096]), schema)], schema=schema)

    def run(batches):
        every, held = [], 0
        for batch in batches:
            rows = []
            for doc_id, key, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), _sets(batch, words)):
                rows.append((doc_id, key, _sid(tokens) if len(tokens) else None, len(tokens), _bitmap(tokens) if len(tokens) else None, None))
                every.append(tokens)
                held += len(tokens)
                if held >= HELD:
                    rows += counted(every)
                    every, held = [], 0
            yield from parts(rows)
        yield from parts(counted(every))

    both = materialize(mapped(_docs(docs, row), run, "doc_id long, row long, sid long, n long, bitmap binary, token long"), "shingled")
    counts = both.filter("token is not null").groupBy("token").agg(F.sum("n").alias("count"))
    return both.filter("token is null").drop("token"), counts


def most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their ranks, rarest first: those above the lowest count (in steps of
    12 %) that no more than FREQUENT tokens reach. No task sorts them, and the driver gathers at most FREQUENT."""
    level = F.floor(F.log2(F.col("count").cast("double")) * 6).cast("int")
    counts = materialize(counts.withColumn("level", level), "counts")
    least, n = None, 0
    for at, here in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        n += here
        if n > FREQUENT:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.filter(F.col("level") >= least).select("token", "count").toArrow()
    tokens, often = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(tokens)
    ranks = np.empty(len(tokens), np.int64)
    ranks[np.lexsort((tokens, often))] = np.arange(len(tokens))
    return tokens[order], ranks[order]


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """token, sid, n, pos for the first tokens of each set. frequent: tokens, sorted, and their ranks, rarest first."""
    order = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        known, rank = order.value
        for batch in batches:
            out = []
            for tokens in _sets(batch, words):
                if not len(tokens):
                    continue
                size = _prefix_length(len(tokens), percent)
                at = np.searchsorted(known, tokens)
                late = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == tokens) if len(known) else np.zeros(len(tokens), bool)
                # Tokens are sorted, so the early ones are in order as they are.
                first = tokens[~late][:size]
                if len(first) < size:
                    rest = tokens[late]
                    first = np.concatenate((first, rest[np.argsort(rank[at[late]], kind="stable")][: size - len(first)]))
                out.append((first, _sid(tokens), len(tokens)))
            if out:
                sizes = [len(f) for f, _, _ in out]
                columns = (np.concatenate([f for f, _, _ in out]).view(np.int64), np.repeat([s for _, s, _ in out], sizes), np.repeat(np.array([n for _, _, n in out], np.int32), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))
                whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                for i in range(0, whole.num_rows, 65536):
                    yield whole.slice(i, 65536)

    return mapped(_docs(docs), run, "token long, sid long, n int, pos int")


def shared_tokens(entries: DataFrame) -> DataFrame:
    """token, sid, n, pos, c for tokens that more than one set has; c, the number of entries, is pre-aggregated."""
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("least"), F.max("sid").alias("most")).filter("least < most")
    return entries.join(counts.select("token", "c"), "token").groupBy("token", "sid", "n").agg(F.min("pos").alias("pos"), F.max("c").alias("c"))


def chosen_tokens(shared: DataFrame) -> DataFrame:
    """The rows of shared for each set's CHOSEN most frequent and CHOSEN least frequent tokens."""
    rank = lambda *order: F.row_number().over(Window.partitionBy("sid").orderBy(*order))
    ranked = shared.withColumn("_most", rank(F.desc("c"), "token")).withColumn("_least", rank("c", "token"))
    return ranked.filter((F.col("_most") <= CHOSEN) | (F.col("_least") <= CHOSEN)).drop("_most", "_least")


def tiles(shared: DataFrame, percent: int) -> DataFrame:
    """token, band, low, high (the tile) for each row of shared, with its block and whether the set's band is the
    tile's (own). A large group is dealt to pairs of blocks."""
    # Bands a little wider than the threshold's ratio, so that rounding never parts two sets that link.
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100 - 0.01)).cast("int")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = shared.withColumn("own_band", band).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("band", F.explode(F.array(F.col("own_band"), F.col("own_band") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("own", F.col("band") == F.col("own_band"))
    return dealt.drop("own_band", "blocks", "other", "c")


#: Columns of a tile's member, in the order of the tuples below; a bitmap may follow.
MEMBER = ["block", "sid", "n", "own", "comp", "pos"]
TILE = ["token", "band", "low", "high"]
BLOCKN, SID, N, OWN, COMP, POS, BITMAP = range(7)


def _fold(bitmap: bytes, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, width // 8), axis=0)


def _pairs_of_few(members: list[tuple], apart: bool, percent: int) -> list[tuple[int, int]]:
    """The compatible pairs of a small tile: what _Tile says, without arrays."""
    found = []
    for i in range(1, len(members)):
        a = members[i]
        for j in range(i):
            b = members[j]
            if a[COMP] == b[COMP] or not (a[OWN] or b[OWN]) or (apart and a[BLOCKN] == b[BLOCKN]):
                continue
            n, m = a[N], b[N]
            least = -(-percent * (n + m) // (100 + percent))
            if 100 * min(n, m) >= percent * max(n, m) and a[POS] <= n - least and b[POS] <= m - least:
                found.append((i, j))
    return found


class _Tile:
    """The members of a tile as arrays."""

    def __init__(self, members: list[tuple], apart: bool, percent: int):
        self.apart, self.percent = apart, percent
        block, _, n, own, comp, pos = zip(*(m[:BITMAP] for m in members))
        self.block, self.n, self.own, self.comp, self.pos = np.array(block), np.array(n, np.int64), np.array(own), np.array(comp), np.array(pos, np.int64)

    def compatible(self, i: int) -> np.ndarray:
        """The members j before i that may link with i: of another component, this tile's concern, near enough in size,
        and with no more tokens before the shared one, in either, than two sets that link can have apart."""
        n, m = self.n[:i], self.n[i]
        least = -(-self.percent * (n + m) // (100 + self.percent))  # tokens that both must have
        can = (self.own[:i] | self.own[i]) & (self.comp[:i] != self.comp[i]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        can &= (self.pos[:i] <= n - least) & (self.pos[i] <= m - least)
        if self.apart:
            can &= self.block[:i] != self.block[i]
        return np.flatnonzero(can)


def _streamed(batches, columns: list[str]):
    """Groups of equal tiles from batches that are sorted by TILE: the tile and its members' tuples."""
    tile, members = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in TILE)), zip(*(batch.column(c).to_pylist() for c in columns))):
            if key != tile:
                if members:
                    yield tile, members
                tile, members = key, []
            members.append(row)
    if members:
        yield tile, members


def _dealt(tiled: DataFrame, columns: list[str]) -> DataFrame:
    return tiled.select(*TILE, *columns).repartition(*TILE).sortWithinPartitions(*TILE, "sid")


def met(tiled: DataFrame, percent: int) -> DataFrame:
    """What meets in tiles. A tile with few compatible pairs for its members (SPARSE each) gives the pairs: a, b. A
    dense one gives its members that have a compatible partner, for bitmaps to sort out: the tile and MEMBER."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("band", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("sid", pa.int64()), ("n", pa.int32()), ("own", pa.bool_()), ("comp", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        rows: list[tuple] = []

        def flush():
            part = [(*p, *[None] * 10) for p in seen] + rows
            seen.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

        for tile, members in _streamed(batches, MEMBER):
            if len(members) < 2 or not any(m[OWN] for m in members):
                continue
            apart = tile[2] != tile[3]
            if len(members) <= 8:
                found = _pairs_of_few(members, apart, percent)
                total, used = len(found), {i for pair in found for i in pair}
            else:
                t = _Tile(members, apart, percent)
                found, total, used = [], 0, set()
                for i in range(1, len(members)):
                    js = t.compatible(i).tolist()
                    total += len(js)
                    if js:
                        used.update(js, (i,))
                    if total <= SPARSE * len(members):
                        found += [(i, j) for j in js]
            if total <= SPARSE * len(members):
                seen.update((min(members[i][SID], members[j][SID]), max(members[i][SID], members[j][SID])) for i, j in found)
            else:
                rows.extend((None, None, *tile, *members[i]) for i in sorted(used))
            if len(seen) + len(rows) > 50_000:
                yield flush()
        if seen or rows:
            yield flush()

    return mapped(_dealt(tiled, MEMBER), run, "a long, b long, token long, band int, low int, high int, block int, sid long, n int, own boolean, comp long, pos int")


def _overlap(differ, n, m):
    """No more tokens than these are in both of two sets whose bitmaps differ in so many bits."""
    return (n + m - differ) // 2


def _passing(members: list[tuple], apart: bool, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member i of a tile: the members j before it whose pair with i passes the bound, and the differing bits."""
    width = min(len(m[BITMAP]) for m in members)
    bits = np.stack([_fold(m[BITMAP], width) for m in members])
    t = _Tile(members, apart, percent)
    for i in range(1, len(members)):
        j = t.compatible(i)
        if len(j):
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            both = _overlap(differ, t.n[j], t.n[i])
            ok = 100 * both >= percent * (t.n[j] + t.n[i] - both)
            if ok.any():
                yield i, j[ok], differ[ok]


def _forest(members: list[tuple], apart: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that pass, those with the fewest differing bits for their size first."""
    edges = [(float(d) / (members[i][N] + members[j][N]), i, int(j)) for i, js, ds in _passing(members, apart, percent) for j, d in zip(js, ds)]
    edges.sort()
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for _, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            chosen.append((i, j))
    return chosen


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast where it is small, which spares shuffling wide rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _picked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids (one column of that name)."""
    return rows.join(_small(materialize(ids.distinct(), "ids")), key, "left_semi")


def candidates(tiled: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Distinct pairs a < b of sids that pass the bitmaps' bound: of sparse tiles all; of dense ones a spanning forest,
    or all if whole. sets has sid, n, bitmap, any number of times for a sid."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    found = materialize(met(tiled, percent), "met")
    ids = found.filter("a is not null").select(F.col("a").alias("sid")).union(found.filter("b is not null").select("b")).union(found.filter("sid is not null").select("sid"))
    bitmaps = _picked(sets.select("sid", "n", "bitmap"), "sid", ids).dropDuplicates(["sid"])

    def bounded(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
                width = min(len(x), len(y))
                differ = int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())
                both = _overlap(differ, n, m)
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def dense(batches):
        seen: set[tuple[int, int]] = set()
        for tile, members in _streamed(batches, [*MEMBER, "bitmap"]):
            apart = tile[2] != tile[3]
            pairs = ((i, j) for i, js, _ in _passing(members, apart, percent) for j in js) if whole else _forest(members, apart, percent)
            seen.update((min(members[i][SID], members[j][SID]), max(members[i][SID], members[j][SID])) for i, j in pairs)
            if len(seen) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], schema=schema)
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen)], schema=schema)

    side = lambda k, n, x: bitmaps.select(F.col("sid").alias(k), F.col("n").alias(n), F.col("bitmap").alias(x))
    pairs = found.filter("b is not null").select("a", "b").distinct().join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    sparse = mapped(pairs.select("a", "b", "n", "m", "x", "y"), bounded, "a long, b long")
    rows = found.filter("b is null").drop("a", "b").join(bitmaps.select("sid", "bitmap"), "sid")
    return sparse.unionByName(mapped(_dealt(rows, [*MEMBER, "bitmap"]), dense, "a long, b long")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, linked: pairs with the exact verdict, from the sorted token arrays of both sets."""
    pairs = materialize(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid").select(F.col("rep").alias("doc_id"))
    schema = pa.schema([("sid", pa.int64()), ("tokens", pa.binary())])

    def sets(batches):
        for batch in batches:
            rows = [(_sid(t), t.tobytes()) for t in _sets(batch, words) if len(t)]
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 512]), schema)], schema=schema)

    # A doc_id may have several texts; each is a set, and only asked sets find a pair.
    known = mapped(_picked(_docs(docs), "doc_id", asked), sets, "sid long, tokens binary").dropDuplicates(["sid"])
    joined = pairs.join(known.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a").join(known.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def check(batches):
        for batch in batches:
            verdicts = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                verdicts.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(verdicts, pa.bool_())], schema=out)

    return materialize(mapped(joined.select("a", "b", "x", "y"), check, "a long, b long, linked boolean"), "verdicts")


def linked(docs: DataFrame, words: int, percent: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id (NO_ID for null), row, sid and n of each row of docs; and sid, rep, component_id of each distinct set: the
    smallest doc_id that has it, and the smallest in its component."""
    found, counts = measured(docs, words, row)
    frequent = most_frequent(counts)

    keyed = found.filter("n > 0")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    reps = materialize(keyed.groupBy("sid").agg(F.coalesce(F.min(real), F.lit(NO_ID)).alias("rep")), "sets")
    shared = materialize(shared_tokens(prefixes(docs, words, percent, frequent)), "shared")

    # Components are of sids; their ids are turned into the smallest doc_id at the end.
    start = chosen_tokens(shared).withColumn("comp", F.col("sid"))
    first = verified(candidates(tiles(start, percent), keyed, percent, False), docs, reps, words, percent)
    links = first.filter("linked").select("a", "b")
    joined = components(links).withColumnRenamed("node", "sid")
    spread = shared.join(joined, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    split = spread.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token")
    left = materialize(spread.join(split, "token", "left_semi"), "left")
    more = candidates(tiles(left, percent), keyed, percent, True).join(first.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(verified(more, docs, reps, words, percent).filter("linked").select("a", "b"))

    by_sid = reps.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    # Null ids come last: a component's id is null only where all its rows' are.
    real = F.when(F.col("rep") != NO_ID, F.col("rep"))
    least = by_sid.groupBy("comp").agg(F.min(real).alias("component_id"))
    return found.drop("bitmap"), materialize(by_sid.join(least, "comp").select("sid", "rep", "comp", "component_id"), "components")


def similar(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: sets link when 100 |x and y| >= percent |x or y|."""
    found, sets = linked(docs, words, percent)
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    alone = F.when(F.col("sid").isNull(), real)
    return found.join(sets.select("sid", "component_id"), "sid", "left").select(real.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id"))


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest doc_id (null last), of several the one
    with the smallest digest of its values, of rows that are equal in all values one. Rows without words have no links,
    and all stay, as do all columns, whatever their names. Rows are told apart by doc_id and digest, so neither a null
    nor a repeated doc_id makes a hot key."""
    digest = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema))
    found, sets = linked(docs, words, percent, digest)
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    rows = found.filter("sid is not null").join(sets.select("sid", "comp"), "sid").groupBy("comp", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(real.isNull().alias("none"), F.col("doc_id"), F.col("row"))
    best = rows.groupBy("comp").agg(F.min(order).alias("best")).select("comp", "best.doc_id", "best.row")
    # The rows that go are fewer than those that stay.
    gone = materialize(rows.join(best, ["comp", "doc_id", "row"], "left_anti").select("doc_id", "row"), "gone")
    again = materialize(rows.filter("copies > 1").join(best, ["comp", "doc_id", "row"], "left_semi").select("doc_id", "row"), "again")
    id_, row = fresh(docs.columns, "id", "row")
    keyed = docs.withColumn(row, digest).withColumn(id_, F.coalesce("doc_id", F.lit(NO_ID).cast("long")))
    named = lambda t: _small(t.select(F.col("doc_id").alias(id_), F.col("row").alias(row)))
    kept = keyed.join(named(gone), [id_, row], "left_anti")
    whole = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return kept.select(whole)
    # Equal rows of a kept key: one is taken, by an aggregation that meets them on the map side.
    twice = kept.join(named(again), [id_, row], "left_semi").groupBy(id_, row).agg(F.first(F.struct(*whole)).alias("doc")).select("doc.*")
    return kept.join(named(again), [id_, row], "left_anti").select(whole).unionByName(twice)
