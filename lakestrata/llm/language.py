"""Language identification by compression.

Each language has a zstandard raw-content dictionary made from a bounded sample of its labelled documents. A text is
cut into blocks, every block is compressed with the dictionaries, and the language whose blocks come out smallest is
chosen. Every language is tried, so the work of a text grows with their number. Where there are more than SHORTLIST, those
whose dictionaries' byte trigrams fit the whole text best come first, and any language is given up once its blocks take
HOPELESS times the best size: it can be neither best nor second within MARGIN, and its part of the score is lost in a
double's rounding. So the result is that of trying all in full. `accepted` is false where the margin to the second best is
under MARGIN; lang_pred still names the best.

What is learned is bounded: DOCS_PER_LANG documents and DICT_BYTES of a language, and MODEL_BYTES of all languages, which
share them equally where they are many. No language is left out.

Edge cases: null text, or one without a letter, is `und` with score 0; with no labelled rows every text is `und`; a language
whose texts are all short, or empty, has a dictionary filled up with spaces; rows with a null doc_id are never learned
from; each row, repeated or not, is predicted by itself, and a very long text as a whole; an empty table gives no rows;
other columns are ignored. A tie goes to the language that comes first by code point.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, materialize

#: Bounds of what is learned: documents and bytes of dictionary for a language, and bytes for all.
DOCS_PER_LANG = 200
DICT_BYTES = 32 << 10
MODEL_BYTES = 32 << 20
BLOCK = 1024
LEVEL = 12
#: Languages that a text is compressed with first, buckets of byte trigrams, and compressors that a task holds.
SHORTLIST = 8
BUCKETS = 4096
HELD = 64
#: Sizes, of a text by a language, that a task holds; times the best size from which a language is given up.
SIZES = 1 << 20
HOPELESS = 3
#: Relative difference in size under which a prediction isn't accepted.
MARGIN = 0.01

_LETTER = re.compile(r"[^\W\d_]")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fair(texts: list[bytes], size: int) -> bytes:
    """Of each text as much as the others leave of size: short ones whole, and of the long ones equal parts."""
    rest, parts = size, {}
    for n, i in sorted((len(t), i) for i, t in enumerate(texts)):
        parts[i] = texts[i][: min(n, max(0, rest // (len(texts) - len(parts))))]
        rest -= len(parts[i]) + 1
    return b"\n".join(parts[i] for i in range(len(texts)))


def train(docs: DataFrame) -> dict[str, bytes]:
    """The dictionaries: MODEL_BYTES at most, of twice as much text that the driver gathers."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    # The rank is limited before the shuffle too (WindowGroupLimit), so no task gathers a language.
    draw = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), "doc_id")
    chosen = labelled.filter("text <> ''").select("doc_id", "lang").withColumn("draw", F.row_number().over(draw)).filter(F.col("draw") <= DOCS_PER_LANG)
    chosen = materialize(chosen, "sample")
    langs = materialize(labelled.select("lang").distinct(), "langs")
    size = max(8, min(DICT_BYTES, MODEL_BYTES // max(1, langs.count())))
    drawn = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    start = F.left(F.col("text"), F.ceil(2 * size / F.col("n")).cast("int"))
    # Of a repeated doc_id one row is learned from for each draw of it.
    rows = labelled.join(chosen, ["doc_id", "lang"]).join(drawn, "lang").groupBy("lang", "draw").agg(F.min(start).alias("text"))
    parts: dict[str, list] = {r[0]: [] for r in langs.toLocalIterator()}
    for lang, draw_no, text in rows.collect():
        parts[lang].append((draw_no, text))
    return {lang: _fair([t.encode() for _, t in sorted(got)], size) for lang, got in sorted(parts.items())}


def _trigrams(data: bytes) -> np.ndarray:
    """How often each bucket's byte trigrams occur."""
    at = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    return np.bincount((at[:-2] * 961 + at[1:-1] * 31 + at[2:]) % BUCKETS if len(at) > 2 else [], minlength=BUCKETS)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], shortlist: int = SHORTLIST):
        self.langs, self.shortlist = sorted(dictionaries), shortlist
        self.data = [dictionaries[k].rjust(8) for k in self.langs]
        self.compressor = functools.lru_cache(HELD)(self._compressor)
        if len(self.langs) > shortlist:
            counts = np.stack([_trigrams(d) for d in self.data]).astype(np.float32) + 0.1
            self.logs = np.log(counts / counts.sum(axis=1, keepdims=True))

    def _compressor(self, i: int):
        d = zstandard.ZstdCompressionDict(self.data[i], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def candidates(self, data: bytes) -> list[int]:
        if len(self.langs) <= self.shortlist:
            return list(range(len(self.langs)))
        return sorted(np.argsort(-(self.logs @ _trigrams(data).astype(np.float32)), kind="stable")[: self.shortlist].tolist())

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        return self.classify([text])[0]

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is accepted, for each text. Many texts share a compressor that isn't held."""
        out = [("und", 0.0, False)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        share = max(1, SIZES // max(1, len(self.langs)))
        for at in range(0, len(known), share):
            some = known[at : at + share]
            for i, sizes in zip(some, self._sizes([texts[i].encode("utf-8", "replace") for i in some])):
                out[i] = self._chosen(sizes.tolist())
        return out

    def _sizes(self, texts: list[bytes]) -> np.ndarray:
        """The compressed size of each text by each language, or one that is at least HOPELESS times the text's best."""
        sizes, best = np.zeros((len(texts), len(self.langs)), np.int64), [math.inf] * len(texts)
        cut = [[t[i : i + BLOCK] for i in range(0, len(t), BLOCK)] for t in texts]
        near = [set(self.candidates(t)) for t in texts]
        for first in (True, False):
            for lang in range(len(self.langs)):
                todo = [i for i, found in enumerate(near) if (lang in found) == first]
                compress = self.compressor(lang) if todo else None
                for i in todo:
                    size, limit = 0, HOPELESS * best[i]
                    for block in cut[i]:
                        size += len(compress(block))
                        if size >= limit:
                            break
                    sizes[i, lang], best[i] = size, min(size, best[i])
        return sizes

    def _chosen(self, sizes: list[int]) -> tuple[str, float, bool]:
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        # Sizes are code lengths: their differences are log likelihood ratios, tempered by the length.
        score = 1 / sum(math.exp(-20 * (s - best) / best) for s in sizes)
        return self.langs[order[0]], score, margin >= MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row. Only text is an input."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches):
        classifier = Classifier(model.value)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            if ids:
                columns = [ids, *zip(*classifier.classify(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, and predicts all."""
    return predict(docs, train(docs)).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "accepted")
