"""Cost-balanced packing of tokenized documents into sequences of at most SEQUENCE tokens.

Each task tokenizes its part of the table and packs it in groups of about GROUP_SEQUENCES sequences, so nothing is
shuffled and memory is bounded by a group and the longest document. In a group, documents longer than a sequence are
cut into whole sequences and a rest; the rests, in descending length, go to the sequence of the lowest estimated cost
(LINEAR * n + QUADRATIC * n * n over its pieces) that has room. What fits nowhere whole is cut over the cheapest
sequences with room. The group's last tokens go to sequences whose lengths are powers of two, which need no padding.

Edge cases: null or empty text is the end id alone; each row is a document, so repeated rows and ids each are packed;
an empty table gives no rows; other columns are ignored. Reruns over the same files agree.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import mapped

SEQUENCE = 2048
GROUP_SEQUENCES = 512
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 1024

_SPECIAL = "<|endoftext|>"
#: Beyond these letters the two libraries' tables of character classes may differ, so the slower library decides.
_RARE = re.compile("[^\x00-ɏ‐-‧]")


class Encoder:
    """Ids of the `tokenizers` file at path. Its rank file, read by tiktoken, gives the same ids faster; texts with the
    special token or rare characters go through `tokenizers` itself."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or _SPECIAL in text or _RARE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover documents of these lengths without padding."""
    pieces, rests, sequences = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            pieces.append((doc, start, size, sequences, 0))
            sequences += 1
        if n % size:
            rests.append((n % size, doc, n - n % size))
    total = sum(n for n, _, _ in rests)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
    room, used = np.array(room, np.int64), np.zeros(len(room), np.int64)
    spent = np.zeros(len(room))
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room - used >= n
            if not fits.any():
                fits = room > used
            k = int(np.where(fits, spent, np.inf).argmin())
            put = min(n, int(room[k] - used[k]))
            pieces.append((doc, start, put, sequences + k, int(used[k])))
            used[k] += put
            spent[k] += cost(put)
            start, n = start + put, n - put
    return pieces


_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("sequence_tokens", pa.int64()), ("sequence_cost", pa.float64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def _group(docs: list[tuple[int | None, np.ndarray]], first: int, size: int) -> tuple[pa.RecordBatch, int]:
    pieces = pack([len(ids) for _, ids in docs], size)
    n = 1 + max(p[3] for p in pieces)
    tokens, costs = np.zeros(n, np.int64), np.zeros(n)
    for _, _, length, sequence, _ in pieces:
        tokens[sequence] += length
        costs[sequence] += cost(length)
    rows = [
        (docs[d][0], start, length, zlib.crc32(docs[d][1][start : start + length].tobytes()), len(docs[d][1]), first + s, offset, int(tokens[s]), float(costs[s]))
        for d, start, length, s, offset in pieces
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW), first + n


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece. sequence_id holds the task in its upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks)
        group, tokens, first = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = array.array("I", encode(text or ""))
                ids.append(END_ID)
                group.append((doc_id, np.frombuffer(ids, np.uintc).astype("<u4", copy=False)))
                tokens += len(ids)
                if tokens >= GROUP_SEQUENCES * size:
                    out, first = _group(group, first, size)
                    yield out
                    group, tokens = [], 0
        if group:
            yield _group(group, first, size)[0]

    return mapped(docs.select("doc_id", "text"), run, _DDL)
