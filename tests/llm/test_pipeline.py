"""The pipeline's stages, and its run against a plain version of them."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakestrata.llm import jaccard, mixing, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run_agrees(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[4] > 0
    from tokenizers import Tokenizer
    import public_tokenizers

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect() for ids in [[*encode.encode(r["text"], add_special_tokens=False).ids, 1]])
    got = corpus_pipeline.run(spark, SF).collect()
    tokens: dict = {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert sum(tokens.values()) == sum(n for _, n, _ in want)
    whole = sorted((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"])
    assert set(whole) <= set(want) and len(whole) > 50


def words(text):
    return (text or "").encode().split()


def test_each_stage_against_a_plain_version(spark, tmp_path):
    """Every stage, on what the one before kept, against a version of it in plain Python; run() gives the last one's rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from . import brute

    docs, at = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = docs.collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = [r for r, keep in zip(rows, brute.kept([(r["source"], r["text"]) for r in rows])) if keep]
    assert sorted(at["quality"]) == sorted(good)
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in good], 5, 80)
    one = [r for r in good if groups[r["doc_id"]][1] == r["doc_id"]]
    assert sorted(at["near_duplicates"]) == sorted(one)
    # The corpus has no secret in an encoded layer, so the base patterns are all there is to mask.
    clean = {r["doc_id"]: brute.masked(r["text"]) for r in one}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in at["secrets"]} == {d: (t, len(t)) for d, t in clean.items()}
    want = brute.targets([(r["source"], len(words(r["text"]))) for r in at["secrets"]])
    taken: dict = {}
    for r in at["mixing"]:
        have = iter(words(clean[r["doc_id"]]))
        assert all(w in have for w in words(r["text"])) and r["n_chars"] == len(r["text"])  # in their order
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    assert all(abs(taken.get(s, 0) - t) <= max(3 * mixing.BLOCK, 0.05 * t) for s, t in want.items())
    assert all(sum(len(words(r["text"])) for r in at["mixing"] if r["doc_id"] == d) <= 3 * len(words(t)) for d, t in clean.items())
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted((r["doc_id"], [*encode.encode(r["text"], add_special_tokens=False).ids, 1]) for r in at["mixing"])
    assert sum(len(i) for _, i in ids) == sum(r["length"] for r in at["packing"])
    for r in at["packing"]:
        cut = lambda i: zlib.crc32(np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert any(d == r["doc_id"] and len(i) == r["doc_tokens"] and cut(i) == r["ids_crc32"] for d, i in ids)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in at["packing"]}


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    return docs


def test_stages_keep_rows_with_null_and_repeated_ids_and_odd_columns(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(90))
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, a), (None, b), (None, "too short"), (1, c), (4, c), (4, d), (4, d), (4, "bad " * 90), (None, c), (None, None), (9, ""), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t) if t else None) for i, t in rows], ROWS)
    odd = ["_rejected", "_kept", "_runs", "_k", "_j", "row", "id", "sid", "doc", "runs", "copy", "measures", "host", "host_bad", "size", "at", "_range", "copies", "comp"]
    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(odd)))
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good = quality.keep_good(docs)
    assert pairs(good) == sorted([r for r in rows if r[1] in (a, b, c, d)], key=str) and good.columns == docs.columns
    one = jaccard.keep_one(docs, 5, 80)
    assert pairs(one) == sorted([(None, a), (None, b), (None, "too short"), (1, c), (4, d), (4, "bad " * 90), (None, None), (9, "")], key=str)
    assert one.columns == docs.columns
    mix = mixing.mixed(good)
    assert mix.columns == docs.columns and {r["doc_id"] for r in mix.collect()} == {None, 1, 4}
    assert sum(len(r["text"].split()) for r in mix.collect()) == 90 * good.count()
    for out in (good, one, secrets.redacted(docs), mix, run_stages(spark, docs)):
        assert [r[n] for r in out.select(odd).distinct().collect() for n in odd] == list(range(len(odd)))


def test_empty_table(spark, monkeypatch):
    docs = spark.createDataFrame([], ROWS)
    assert run_stages(spark, docs).count() == 0 and run_stages(spark, docs).columns == docs.columns
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    assert corpus_pipeline.run(spark, SF).count() == 0


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    one = {r["doc_id"] for r in jaccard.keep_one(docs, 5, 80).collect()}
    from . import brute

    assert one == {d for d, (_, c) in brute.jaccard(list(rows.items()), 5, 80).items() if c == d}
    more = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in more.collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(more).collect()}
    assert any(masked[d] != t for d, t in rows.items())
    assert all((masked[d] == t) == (not secrets.scan(t)) for d, t in rows.items())


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
