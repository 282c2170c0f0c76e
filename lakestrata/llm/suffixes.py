"""Removal of repeated passages: every byte of a LENGTH-byte string that also starts earlier goes.

Suffixes are dealt into buckets such that equal LENGTH-byte strings share a bucket, and one bucket is sorted at a time:

1. Documents are dealt to slots by their id, once; the same shuffle serves all steps over texts.
2. The anchor of a LENGTH-byte window is the place of its smallest GRAM-byte hash, so equal windows have equal anchors.
   Windows of one anchor are neighbours and form a run. Each slot sends the distinct anchor hashes that it holds, and
   how many distinct texts each one's runs have.
3. Hashes of more than one slot go back to their slots. All other windows are unique, as far as other slots go.
4. Each slot sends the runs of repeated anchors as short segments of text to their anchor's bucket, one for each
   distinct text in the slot; other copies in the slot are covered. Runs of anchors with very many segments would
   fill a bucket: steps 2 and 3 are repeated for them with longer grams, and they are sent by those anchors, in parts.
   Where such an anchor has very many segments too, its windows are sent one by one, to buckets by their own hash.
5. A bucket drops equal segments and sorts the suffixes of the rest (see `sort_suffixes`): by their first bytes, and
   long ties by the ranks of a difference cover's sample. Equal windows are then neighbours; all but the first in
   document order are covered.
6. Covered spans go back to the slots, where each document's spans are united and its remaining bytes hashed.

Edge cases: null text is empty; a null doc_id counts as the smallest; rows that share a doc_id are documents in the order
of their texts; texts under LENGTH bytes lose nothing; a run of one byte is its own copy, and keeps its first LENGTH
bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir
from .shingles import mix

LENGTH = 100
GRAM = 32
SLOT_BYTES = 4 << 20
#: Buckets for each slot: a bucket's suffixes are sorted in memory, by arrays of many times its text.
BUCKETS_PER_SLOT = 4
#: Anchors with so many segments, added over slots, are dealt by longer grams, then window by window, as a bucket takes up
#: to 11 KB for each; so are those that as many slots hold.
HOT_SEGMENTS = 1 << 14
HOT_SLOTS = HOT_SEGMENTS
CHUNK = 1 << 20
NO_ID = -(1 << 63)

#: A perfect difference set. Each residue modulo PERIOD is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: _SHIFT[r, s]: the least d such that r + d and s + d are both in the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD] and _IN_COVER[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])

_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, n.bit_length())
    if size not in _tables:
        _tables.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[size] = np.cumprod(up), np.cumprod(down)
    return _tables[size]


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of data: the place of its anchor, and the hash of each gram of data."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])
    # The place in the lower half makes the minimum the leftmost of equal hashes.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size, chunk = 0, 0, []
    for i, text in enumerate(texts):
        if chunk and size + len(text) > CHUNK:
            yield first, chunk
            first, size, chunk = i, 0, []
        chunk.append(text)
        size += len(text)
    if chunk:
        yield first, chunk


def runs(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of all texts, in order, in parts: text number, first window, number of windows, anchor hash."""
    for first, chunk in _chunks(texts):
        data = np.frombuffer(b"".join(chunk), np.uint8)
        if len(data) < length:
            continue
        with np.errstate(over="ignore"):
            at, hashes = anchors(data, length, gram)
        sizes = np.array([len(t) for t in chunk])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(chunk)), sizes)[: len(at)]
        inside = np.arange(len(at)) + length <= (begin + sizes)[owner]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
        start = np.flatnonzero(new & inside)
        if not len(start):
            continue
        # A run ends before the next one, or where the text's windows end.
        stop = np.minimum(np.append(start[1:], len(at)), (begin + sizes)[owner[start]] - length + 1)
        yield owner[start] + first, start - begin[owner[start]], stop - start, hashes[at[start]]


def distinct_segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes of all texts' runs, and for each how many distinct texts its runs have."""
    pieces = list(runs(texts, length, gram))
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    owner, start, windows, hashes = (np.concatenate(c) for c in zip(*pieces))
    distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    place = np.flatnonzero(counts[which] > 1)
    if len(place):
        seen = {(k, texts[i][a : a + n - 1 + length]) for k, i, a, n in zip(*(c[place].tolist() for c in (which, owner, start, windows)))}
        several = np.bincount(np.fromiter((k for k, _ in seen), np.int64, len(seen)), minlength=len(distinct))
        counts = np.where(counts > 1, several, counts)
    return distinct, counts.astype(np.uint32)


# Sorting a bucket's suffixes


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The 8 bytes at each of the first count places as a number, first byte first."""
    view = np.lib.stride_tricks.as_strided(data, (count, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _refine(words: np.ndarray, at: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """order, and the numbers of the groups of equal ones, sharpened by the 8 bytes at depth after each place."""
    key = words[at[order] + depth]
    if depth:
        sharper = np.lexsort((key, group))
    else:
        sharper = np.argsort(key, kind="stable")
    order, key, group = order[sharper], key[sharper], group[sharper]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return order, np.cumsum(new) - 1


def _sort_to(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the places `at` by at least depth bytes, and group numbers of equal ones. Only ties go on."""
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    order, group = _refine(words, at, order, group, 0)
    for d in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] = same
        tied[:-1] |= same
        place = np.flatnonzero(tied)
        if not len(place):
            break
        sub, _ = _refine(words, at, order[place], group[place], d)
        # Tied places are sorted among themselves; groups keep their extent, so each stays in its range.
        order[place] = sub
        key = words[at[order] + d]
        new = np.ones(len(order), bool)
        new[1:] = ~same | (tied[1:] & tied[:-1] & (key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
    return order, group


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of data's suffixes at the places `at` by their first length bytes, and group numbers of those whose
    first length bytes are equal. data must go on for length + 2 * PERIOD + 16 bytes after every place.

    Suffixes are sorted by their first PERIOD bytes. The places of data whose residue is in the cover are ranked first,
    once; two tied suffixes i and j are then compared by the ranks at i + d and j + d, where d < PERIOD brings both into
    the cover. Ties are split around a pivot, all groups at a time.
    """
    count = int(at.max()) + length + 2 * PERIOD + 8
    words = _words(data, count)
    order, group = _sort_to(words, at, PERIOD)
    sizes = np.bincount(group)
    if sizes.max() > 1:
        needed = np.zeros(count, bool)
        for d in range(PERIOD):
            needed[at[order[sizes[group] > 1]] + d] = True
        sample = np.flatnonzero(needed & _IN_COVER[np.arange(count) % PERIOD])
        ranked, rank_group = _sort_to(words, sample, length)
        rank = np.zeros(count, np.int64)
        rank[sample[ranked]] = rank_group
        open_ = sizes[group] > 1
        while open_.any():
            place = np.flatnonzero(open_)
            g = group[place]
            first = np.ones(len(place), bool)
            first[1:] = g[1:] != g[:-1]
            mine = at[order[place]]
            pivot = mine[np.flatnonzero(first)[np.cumsum(first) - 1]]
            d = _SHIFT[mine % PERIOD, pivot % PERIOD]
            side = np.sign(rank[mine + d] - rank[pivot + d])
            turn = np.lexsort((side, g))
            order[place] = order[place][turn]
            side, g = side[turn], g[turn]
            # Sub-groups get numbers between their group's and the next one's.
            whole = 3 * group
            whole[place] += side + 1
            new = np.ones(len(whole), bool)
            new[1:] = whole[1:] != whole[:-1]
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            decided = np.zeros(len(order), bool)
            decided[place] = side == 0
            open_ = open_ & ~decided & (sizes[group] > 1)
    # The ranks see past length bytes, so neighbours may differ there alone: compare the bytes themselves.
    a, b = at[order[1:]], at[order[:-1]]
    same = np.ones(len(a), bool)
    for d in [*range(0, length - 8, 8), length - 8]:
        same &= words[a + d] == words[b + d]
    return order, np.concatenate(([0], np.cumsum(~same)))


def bucket_spans(segments: list[tuple[int, int, int, int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Covered spans (doc_id, j, start, end) of a bucket's segments (anchor, doc_id, j, start, windows, text)."""
    segments = sorted(segments, key=lambda s: s[1:4])
    firsts: dict[tuple[int, bytes], int] = {}
    variants: dict[int, list[int]] = {}
    for i, (anchor, doc_id, j, start, windows, text) in enumerate(segments):
        if (anchor, text) in firsts:
            yield doc_id, j, start, start + windows - 1 + length
        else:
            firsts[anchor, text] = i
            variants.setdefault(anchor, []).append(i)
    chosen = sorted(i for v in variants.values() if len(v) > 1 for i in v)
    if not chosen:
        return
    texts = [segments[i][5] for i in chosen]
    data = np.frombuffer(b"".join(texts) + bytes(length + 2 * PERIOD + 24), np.uint8)
    begin = np.cumsum([0, *(len(t) for t in texts[:-1])])
    windows = np.array([segments[i][4] for i in chosen])
    owner = np.repeat(np.arange(len(chosen)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, group = sort_suffixes(data, begin[owner] + inner, length)
    # Places ascend in document order, so the least place of a group is its first occurrence.
    least = np.full(group[-1] + 1, len(owner))
    np.minimum.at(least, group, order)
    covered = np.zeros(len(owner), bool)
    covered[order] = order != least[group]
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edge[::2], edge[1::2]):
        # A run of covered windows may go on into the next segment of the buffer.
        for k in range(owner[a], owner[b - 1] + 1):
            part = np.flatnonzero(owner[a:b] == k) if owner[a] != owner[b - 1] else np.arange(b - a)
            _, doc_id, j, start, _, _ = segments[chosen[k]]
            low, high = start + int(inner[a + part[0]]), start + int(inner[a + part[-1]])
            yield doc_id, j, low, high + length


def _ordered(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(doc_id, j, text) of a slot's documents in document order."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), (t or b"" for t in table.column("text").to_pylist())))
    out, last, j = [], None, 0
    for doc_id, text in rows:
        j = j + 1 if doc_id == last else 0
        last = doc_id
        out.append((doc_id, j, text))
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slot_bytes: int = SLOT_BYTES, hot_slots: int = HOT_SLOTS, texts: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; with texts also kept, the remaining bytes."""
    shared_dir(docs.sparkSession)
    bounded(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-size // slot_bytes))
    parts, buckets = max(1, -(-slots // 4)), slots * BUCKETS_PER_SLOT
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")).repartition(parts, "slot")

    wide = (gram + length) // 2

    held_schema = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def held(table: pa.Table) -> pa.Table:
        return packed(table, *distinct_segments([t for _, _, t in _ordered(table)], length, gram))

    def packed(table: pa.Table, hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
        if not len(hashes):
            return _table([], held_schema)
        slot = table.column("slot")[0].as_py()
        bucket = hashes % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, counts, bucket = hashes[order], counts[order], bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets), append=np.uint64(buckets)))
        return _table([(int(bucket[a]), slot, hashes[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edge, edge[1:])], held_schema)

    back_schema = pa.schema([("slot", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])

    def shared(table: pa.Table) -> pa.Table:
        owners = table.column("slot").to_pylist()
        parts_ = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
        owner = np.repeat(np.arange(len(parts_)), [len(p) for p in parts_])
        hashes = np.concatenate(parts_)
        order = np.argsort(hashes, kind="stable")
        hashes, owner, counts = hashes[order], owner[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        size = np.diff(first, append=len(hashes))
        common = (size >= hot_slots) | (np.add.reduceat(counts, first, dtype=np.int64) >= hot_segments)
        repeated, common = np.repeat(size > 1, size), np.repeat(common, size)
        told = repeated | common
        hashes, owner, repeated, common = hashes[told], owner[told], repeated[told], common[told]
        order = np.argsort(owner, kind="stable")
        hashes, owner, repeated, common = hashes[order], owner[order], repeated[order], common[order]
        edge = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        return _table([(owners[owner[a]], hashes[a:b][repeated[a:b]].tobytes(), hashes[a:b][common[a:b]].tobytes()) for a, b in zip(edge, edge[1:])], back_schema)

    gather = lambda back, c: np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in back.column(c).to_pylist() if h)]))

    def held_again(table: pa.Table, back: pa.Table) -> pa.Table:
        hot = gather(back, "hot")
        if not len(hot):
            return _table([], held_schema)
        texts_ = [t for _, _, t in _ordered(table)]
        parts_: dict[bytes, None] = {}
        for owner, start, windows, hashes in runs(texts_, length, gram):
            place = np.flatnonzero(np.isin(hashes, hot))
            parts_.update((texts_[i][a : a + n - 1 + length], None) for i, a, n in zip(*(c[place].tolist() for c in (owner, start, windows))))
        return packed(table, *distinct_segments(list(parts_), length, wide))

    segment_schema = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("j", pa.int32()), ("start", pa.int64()), ("windows", pa.int64()), ("text", pa.binary())])

    def segments(table: pa.Table, back: pa.Table) -> pa.Table:
        """Segments for the buckets; without a text, spans that are covered already."""
        documents = _ordered(table)
        pieces = list(runs([t for _, _, t in documents], length, gram))
        if not pieces:
            return _table([], segment_schema)
        owner, start, windows, hashes = (np.concatenate(c) for c in zip(*pieces))
        elsewhere, hot, again, hot_again = (gather(back, c) for c in ("repeated", "hot", "again", "hot_again"))
        distinct, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        outside, common = np.isin(distinct, elsewhere, assume_unique=True), np.isin(distinct, hot, assume_unique=True)
        chosen = np.flatnonzero((outside | (count > 1))[which])
        first: set[tuple[int, bytes]] = set()
        variants: dict[int, int] = {}
        sent, split, spans = [], [], []

        def cover(i: int, a: int, m: int) -> None:
            doc_id, j, _ = documents[owner[i]]
            if spans and spans[-1][2] == doc_id and spans[-1][3] == j and spans[-1][4] <= a <= spans[-1][4] + spans[-1][5]:
                last = spans[-1]
                spans[-1] = (*last[:5], max(last[5], a + m - last[4]), None)
            else:
                spans.append((int(hashes[i] % np.uint64(buckets)), 0, doc_id, j, a, m, None))

        for i in chosen.tolist():
            k = int(which[i])
            doc_id, j, text = documents[owner[i]]
            a, m = int(start[i]), int(windows[i])
            part = text[a : a + m - 1 + length]
            if (k, part) in first:
                cover(i, a, m)
                continue
            first.add((k, part))
            if common[k]:
                split.append((i, part))
                continue
            variants[k] = variants.get(k, 0) + 1
            sent.append((k, int(hashes[i] % np.uint64(buckets)), int(hashes[i].view(np.int64)), doc_id, j, a, m, part))
        out = [row[1:] for row in sent if outside[row[0]] or variants[row[0]] > 1]
        pieces = list(runs([part for _, part in split], length, wide))
        if pieces:
            part_of, inner, size, wider = (np.concatenate(c) for c in zip(*pieces))
            values, value, times = np.unique(wider, return_inverse=True, return_counts=True)
            outside, common = np.isin(values, again, assume_unique=True), np.isin(values, hot_again, assume_unique=True)
            place = np.flatnonzero((outside | (times > 1))[value])
            first, variants, sent = set(), {}, []
            for p, low, n, k in zip(*(c[place].tolist() for c in (part_of, inner, size, value))):
                i, part = split[p]
                doc_id, j, _ = documents[owner[i]]
                for w, m in [(low, n)] if not common[k] else [(low + w, 1) for w in range(n)]:
                    piece, a = part[w : w + m - 1 + length], int(start[i]) + w
                    if (k, piece) in first:
                        cover(i, a, m)
                        continue
                    first.add((k, piece))
                    variants[k] = variants.get(k, 0) + 1
                    anchor = int(values[k].view(np.int64))
                    if common[k]:
                        anchor = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                    sent.append((k, (anchor & (1 << 64) - 1) % buckets, anchor, doc_id, j, a, m, piece))
            out += [row[1:] for row in sent if outside[row[0]] or variants[row[0]] > 1]
        return _table(out + spans, segment_schema)

    span_schema = pa.schema([("slot", pa.int32()), ("doc_id", pa.int64()), ("j", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def covered(table: pa.Table) -> pa.Table:
        names = ("anchor", "doc_id", "j", "start", "windows", "text")
        every = list(zip(*(table.column(c).to_pylist() for c in names)))
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc_id, j, start, end in bucket_spans([s for s in every if s[5] is not None], length):
            spans.setdefault((doc_id, j), []).append((start, end))
        for _, doc_id, j, start, windows, text in every:
            if text is None:
                spans.setdefault((doc_id, j), []).append((start, start + windows - 1 + length))
        return _table([(None, d, j, a, b) for (d, j), s in spans.items() for a, b in united(s)], span_schema)

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    result_schema = pa.schema(result + [("kept", pa.binary())] * texts)

    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc_id, j, start, end in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "j", "start", "end"))):
            gone.setdefault((doc_id, j), []).append((start, end))
        out = []
        for doc_id, j, text in _ordered(table):
            removed = united(gone.get((doc_id, j), []))
            kept, last = [], 0
            for start, end in removed:
                kept.append(text[last:start])
                last = end
            rest = b"".join([*kept, text[last:]])
            row = (doc_id if doc_id != NO_ID else None, len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(rest).hexdigest())
            out.append((*row, rest) if texts else row)
        return _table(out, result_schema)

    held_ddl, back_ddl = "bucket int, slot int, hashes binary, counts binary", "slot int, repeated binary, hot binary"
    back = dealt.groupBy("slot").applyInArrow(held, held_ddl).groupBy("bucket").applyInArrow(shared, back_ddl)
    once_more = dealt.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(held_again, held_ddl).groupBy("bucket").applyInArrow(shared, back_ddl)
    none = F.lit(None).cast("binary")
    back = back.withColumns({"again": none, "hot_again": none}).union(once_more.select("slot", none, none, "repeated", "hot"))
    sent = dealt.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(segments, "bucket int, anchor long, doc_id long, j int, start long, windows long, text binary")
    spans = sent.groupBy("bucket").applyInArrow(covered, "slot int, doc_id long, j int, start long, end long")
    spans = spans.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return dealt.groupBy("slot").cogroup(spans.groupBy("slot")).applyInArrow(finish, ddl)
