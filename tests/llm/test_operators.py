"""The corpus operators on small inputs, against plain versions and planted cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakestrata.llm import jaccard, language, licenses, mixing, packing, quality, secrets, simhash, suffixes, warc
from lakestrata.llm.shingles import shingle_sets

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (doc_id, text) or longer rows, with extra columns whose names clash with results."""
    full = [(*r, *(None, "a", None)[len(r) - 2 :]) for r in rows]
    df = spark.createDataFrame(full, DOCS).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.withColumn("kept", F.lit("x")).withColumn("token", F.lit(1)).withColumn("size", F.lit("y")).withColumn("slot", F.lit(0)).withColumn("k", F.lit(0))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [None, "", " \t\n", "x", "é ü   a", "same same same " * 40, "퟿\U0001f600 word"]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd texts and ties."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts += texts[:6] + [t.upper() for t in texts[6:9]]
    for base in texts[10:16]:
        words = base.split()
        for _ in range(4):
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)]
    return list(enumerate(texts + ODD))


def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)


# 1


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    edited = mit.replace("free of charge", "gratis").replace("sublicense", "license again")
    rows = [
        (1, f"prose before\nReleased under the MIT License.\nprose after"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, f"intro\n{mit}\n\n\n\n\n\n\nLicensed under CC BY-NC 4.0.\nend"),
        (4, edited),
        (5, "You need a driving licence and a permission slip to enter."),
        (6, "Released under the MIT License.\nReleased under the MIT License."),
        *((10 + i, t) for i, t in enumerate(ODD)),
    ]
    found = {}
    for r in licenses.find_licenses(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["license"], r["exact"]))
        text = dict(rows)[r["doc_id"]][r["start"] : r["end"]]
        assert not r["exact"] or licenses._words(text) and [w for w, _, _ in licenses._words(text)] == licenses.Scanner().words[r["template"]]
    assert found[1] == [("MIT", True)] and found[2] == [("GPL-3.0", True)]
    assert found[3] == [("MIT-text", True), ("CC-BY-NC-4.0", True)]
    assert found[4] == [("MIT-text", False)]
    assert found[6] == [("MIT", True), ("MIT", True)]
    assert set(found) == {1, 2, 3, 4, 6}
    assert licenses.find_licenses(empty(spark)).count() == 0


def test_licenses_against_every_exact_notice():
    """Over a whole corpus: each place where a template's words stand as they are lies in a notice that is found, and each
    notice has the differences that it says."""
    import pyarrow.parquet as pq

    scan, n = licenses.Scanner(), 0
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        words, found = licenses._words(text or ""), scan(text)
        folded = [w for w, _, _ in words]
        line = " ".join(["", *folded, ""])
        for want in scan.words.values():
            if f" {' '.join(want)} " in line:
                for i in (i for i in range(len(words)) if folded[i : i + len(want)] == want):
                    n += 1
                    assert any(a <= words[i][1] and words[i + len(want) - 1][2] <= b for _, a, b, *_ in found), want
        for name, a, b, _, lacks, added in found:
            here = [w for w, _, _ in licenses._words(text[a:b])]
            assert len(here) == len(scan.words[name]) - lacks + added and (lacks or added or here == scan.words[name])
    assert n > 20


def test_licenses_wrapped_and_varied():
    scan = licenses.Scanner()
    names = lambda text: [h[0].partition(":")[0] for h in scan(text)]
    long = "filler words of no license\n" * 20_000
    for text, want in {
        "Released under the MIT\nLicense.": "MIT", "x\nTo the extent possible under law,\nthe author has waived all copyright and related or neighboring rights to this work.\ny": "CC0-1.0",
        "Licensed under\nCC BY 4.0.": "CC-BY-4.0", "Licensed under the MIT License": "MIT", "Licensed under the Apache License 2.0": "Apache-2.0", "# SPDX-License-Identifier: MIT": "MIT",
        "Copyright 2020 Nobody. All rights reserved.": "reserved", "Released under the terms of the MIT License": "MIT", long + "Licensed under the BSD License.\n" + long: "BSD",
    }.items():
        assert names(text) == [want], text[:80]
    for text in ("Licensed under CC BY-ND 4.0.", "Licensed under the License", "a license of no kind", ""):
        assert names(text) == [], text


# 2


@pytest.mark.parametrize("slot_bytes, hot", [(1 << 20, 99), (3000, 99), (1500, 2)])
def test_suffix_dedup(spark, corpus, slot_bytes, hot):
    rows = corpus + [(1000, "ab" * 400), (1001, "a" * 350), (1002, corpus[0][1]), (1003, "q" * 99), (1004, "q" * 99)]
    got = by_id(suffixes.deduplicated(frame(spark, rows), slot_bytes=slot_bytes, hot_slots=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows)


def test_suffix_dedup_edges(spark):
    text = prose(random.Random(1), 80)
    rows = [(None, text), (7, text), (7, text + " tail"), (8, None)]
    out = suffixes.deduplicated(frame(spark, rows), texts=True).orderBy(F.col("doc_id").asc_nulls_first(), "n_bytes").collect()
    assert [(r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in out] == [(None, 0, text.encode()), (7, len(text), b""), (7, len(text), b" tail"), (8, 0, b"")]
    assert suffixes.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [2, 40, 1 << 14])
def test_suffix_dedup_of_a_common_phrase(spark, corpus, hot):
    """Anchors are judged by their segments, not by the slots that hold them, of which there are few here."""
    rng = random.Random(8)
    line = lambda n, inner: "".join(rng.choice("abcdefgh") for _ in range(n)) + inner
    short, long = line(34, ""), line(75, "")
    lines = [line(rng.randint(20, 90), rng.choice([short, long])) for _ in range(300)]
    rows = corpus + [(2000 + i, "\n".join(rng.choice(lines) for _ in range(20))) for i in range(30)] + [(3000, "ab" * 400), (3001, "a" * 350)]
    for slot_bytes in (1 << 20, 9000):
        got = by_id(suffixes.deduplicated(frame(spark, rows), slot_bytes=slot_bytes, hot_segments=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.repeats(rows)


def test_distinct_segments_counts_texts():
    rng = random.Random(9)
    some = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(20, 200))).encode()
    phrase = some() + bytes(range(65, 125))
    texts = [some() + phrase + some() for _ in range(40)]
    texts += texts[:20] + [b"z" * 300]
    want = {}
    for owner, start, windows, hashes in suffixes.runs(texts, 100, 32):
        for i, a, n, h in zip(owner, start, windows, hashes):
            want.setdefault(int(h), set()).add(texts[i][a : a + n + 99])
    hashes, counts = suffixes.distinct_segments(texts, 100, 32)
    assert dict(zip(hashes.tolist(), counts.tolist())) == {h: len(t) for h, t in want.items()} and max(counts) > 1
    assert [len(c) for c in suffixes.distinct_segments([b"x" * 99], 100, 32)] == [0, 0]


def test_suffix_dedup_bounds_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for large in ("64m", "268435456b"):
            spark.conf.set(name, large)
            suffixes.deduplicated(frame(spark, [(1, "x")]))
            assert spark.conf.get(name) == str(4 << 20)
    finally:
        spark.conf.set(name, before)


def test_sort_suffixes_is_lexicographic():
    rng = random.Random(3)
    part = bytes(rng.choice(b"ab") for _ in range(200))
    data = b"".join(rng.choice([part, part[50:], b"a" * 150, bytes(rng.choice(b"abc") for _ in range(90))]) for _ in range(30))
    at = np.arange(len(data) - 100)
    padded = np.frombuffer(data + bytes(300), np.uint8)
    order, group = suffixes.sort_suffixes(padded, at)
    keys = [data[a : a + 100] for a in at]
    assert [keys[i] for i in order] == sorted(keys)
    assert len(set(zip(group.tolist(), (keys[i] for i in order)))) == len(set(keys)) == group[-1] + 1


# 3


def test_quality_measures(spark, corpus):
    got = by_id(quality.judge(frame(spark, corpus)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = corpus + [(5000, "a # b\na # b\n\n \nc")]
    got |= by_id(quality.judge(frame(spark, rows[-1:])), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {d: brute.quality(t) for d, t in rows}


def test_quality_hosts(spark):
    rng = random.Random(2)
    good, junk = lambda: prose(rng, 80), lambda: "$$$ ### " * 40 + prose(rng, 60)
    rows = [(i, good(), None, "clean") for i in range(20)] + [(100 + i, junk(), None, "dirty") for i in range(18)] + [(200, good(), None, "dirty"), (201, good(), None, None), (202, None, None, "dirty")]
    out = by_id(quality.judge(frame(spark, rows)), "kept", "host_bad")
    assert all(out[i] == (True, False) for i in range(20))
    assert not any(out[100 + i][0] for i in range(18)) and out[100][1]
    assert out[200] == (True, True) and out[201][0] and not out[202][0]
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {*range(20), 200, 201}
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


# 4


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_packing(spark, corpus, tokenizers):
    from tokenizers import Tokenizer

    rows = corpus + [(900, "long text " * 3000), (900, "again"), (901, "a<|endoftext|>b"), (902, "漢字 　 текст")]
    out = packing.packed(frame(spark, rows).coalesce(1), *tokenizers).collect()
    encode = Tokenizer.from_file(tokenizers[0])
    want = sorted((d, [*encode.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    pieces: dict = {}
    for r in out:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert sorted(pieces) == sorted((d, len(ids)) for d, ids in want)
    for d, ids in want:
        at = 0
        for start, length, crc in sorted(pieces[d, len(ids)]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.packed(empty(spark), *tokenizers).count() == 0


def test_packing_balances_cost():
    rng = random.Random(4)
    pieces = packing.pack([rng.randint(1, 1500) for _ in range(2000)])
    costs: dict = {}
    for _, _, length, sequence, _ in pieces:
        costs.setdefault(sequence, []).append(length)
    full = [sum(map(packing.cost, c)) for c in costs.values() if sum(c) == 2048]
    assert max(full) < 2 * sum(full) / len(full)


# 5


def test_secret_base_spans(spark):
    key = "AKIA" + "A1" * 8
    rows = [
        (1, f'x password = "abc123" {key} {"0f" * 12} é token:abcdef'),
        (2, 'API_KEY="short" apikey=longenough secret: ab'),
        (3, "token=token: abcdef PASSWD:  'hunter22'"),
        *((10 + i, t) for i, t in enumerate(ODD)),
    ]
    out = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert (out[1]["n_assign"], out[1]["n_access"], out[1]["n_hex"]) == (2, 1, 1)
    text = rows[0][1]
    for span in out[1]["spans"].split(","):
        kind, a, b = span.split(":")
        assert text[int(a) : int(b)].startswith({"assign": ("password", "token"), "access": "AKIA", "hex": "0f"}[kind])
    assert out[1]["base_sha256"] == hashlib.sha256(out[1]["spans"].encode()).hexdigest()
    assert (out[2]["n_assign"], out[3]["n_assign"]) == (1, 1)
    assert out[10]["spans"] == "" and secrets.find_secrets(empty(spark)).count() == 0


def test_secret_layers():
    plain = "password=hunter22"
    once = base64.b64encode(plain.encode()).decode()
    packed = base64.b64encode(gzip.compress(f"x {plain} y".encode())).decode()
    twice = base64.urlsafe_b64encode(f"see {once} there".encode()).decode()
    url = "".join(f"%{b:02X}" for b in plain.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    for wrapped in (once, packed, twice, url, escaped, base64.b64encode(url.encode()).decode(), url.replace("%", "%25")):
        text = f"before {wrapped} after"
        found = secrets.scan(text)
        assert [(k, text[a:b].strip("=")) for a, b, k in found] == [("decoded_assign", wrapped.strip("="))] or any(k == "decoded_assign" and 7 <= a and b <= 7 + len(wrapped) for a, b, k in found), wrapped
        assert "hunter22" not in secrets.redact(text) and secrets.redact(text).startswith("before ") and secrets.redact(text).endswith(" after")
    assert secrets.scan("%41" * 10 + " 100% plain text QUJDREVGR0hJSktMTU5PUA==") == []


def test_secrets_in_whole_layers():
    """Binary heads, deep nests, large and broken layers, and bytes that aren't UTF-8 hide nothing."""
    plain = b"password=hunter22"
    deep = plain
    for _ in range(12):
        deep = gzip.compress(deep, mtime=0)
    large = gzip.compress(b"a b " * (5 << 20) + plain + b" c d" * 1000)
    head = bytes(range(32)) * 200 + plain
    tail = gzip.compress(random.Random(1).randbytes(6000) + plain + b" " * 3000 + random.Random(2).randbytes(6000))
    layers = [head, deep, large, gzip.compress(large), zlib.compress(plain), plain + b"\xff", b"tar" + gzip.compress(plain), gzip.compress(b"x") + gzip.compress(plain), tail[:-2000]]
    for n, data in enumerate(layers):
        wrapped = base64.b64encode(data).decode()
        assert (7, 7 + len(wrapped), "decoded_assign") in secrets.scan(f"before {wrapped} after"), n
    for run in ("%FF" + "".join(f"%{b:02X}" for b in plain), "\\ud800" + "".join(f"\\x{b:02x}" for b in plain), "\\UFFFFFFFF" + "".join(f"\\x{b:02x}" for b in plain)):
        assert [k for *_, k in secrets.scan(f"before {run} after")] == ["decoded_assign"], run


def test_secrets_in_base64_anywhere():
    """Base64 after paths and words, at any phase and over line breaks."""
    plain = b"some text, password=hunter22 and more words so that the text goes on over several lines of base64"
    code = lambda data, n=0: "\n".join(re.findall(f".{{1,{n}}}", base64.b64encode(data).decode())) if n else base64.b64encode(data).decode()
    noise = random.Random(3).randbytes(300)
    for data in (b"password=hunter22", plain, gzip.compress(plain + noise), zlib.compress(plain + noise), zlib.compress(noise + plain, 1)):
        for head in ("", "x/y/", "a/", "ab_", "abc-", "word"):
            assert "decoded_assign" in {k for *_, k in secrets.scan(f"before {head}{code(data)} after")}, head
        for n in (8, 13, 64, 76):
            for text in (f"before\n{code(data, n)}\nafter", f"key: {code(data, n)}", f"a last word\r\n  {code(data, n)}".replace("\n", "\r\n  ")):
                assert "decoded_assign" in {k for *_, k in secrets.scan(text)}, (n, text)
                assert not any(k == "decoded_assign" for *_, k in secrets.scan(secrets.redact(text)))
    lines = code(b". " * 24 + b"password=hunter22 " + b", " * 45, 64)
    assert secrets.scan(f"one\n{lines}\ntwo") == [(69, 133, "decoded_assign")]


def test_planted_secrets_are_found_under_any_layers():
    """Recall over random nests of encodings, with the span that holds the whole nest and nothing beside it."""
    import bz2
    import lzma
    import urllib.parse

    import zstandard

    rng = random.Random(5)
    packers = [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress, lambda b: b.decode("latin-1").encode("utf-16"), lambda b: b.decode("latin-1").encode("utf-16-be")]
    coders = [
        lambda b: base64.b64encode(b).decode(), lambda b: base64.urlsafe_b64encode(b).decode(), lambda b: "".join(f"%{c:02X}" for c in b), lambda b: "".join(f"\\u{c:04x}" for c in b),
        lambda b: "".join(f"\\x{c:02x}" for c in b), lambda b: urllib.parse.quote(base64.b64encode(b).decode(), safe=""),
    ]
    found, clean = 0, 0
    for n in range(400):
        data = rng.choice([b"password=hunter22", b"AKIA" + b"Q7" * 9, b"deadbeef" * 4]) + b" and some text" * rng.randrange(4)
        for _ in range(rng.randrange(4)):
            data = rng.choice(packers)(data)
            data = rng.choice(coders)(data).encode()
        run = rng.choice(coders)(data)
        head = rng.choice(["before ", "https://x.io/get/", "key: ", "id-"])
        hits = [(a, b) for a, b, kind in secrets.scan(f"{head}{run} after") if kind.startswith("decoded")]
        found += bool(hits) and min(a for a, _ in hits) >= 0 and max(b for _, b in hits) <= len(head) + len(run)
        clean += not any(kind.startswith("decoded") for *_, kind in secrets.scan(f"{head}{rng.choice(coders)(b'nothing of note in here')} after"))
    print(f"secret layers: {found} of 400 found, {clean} of 400 clean ones left alone")
    assert found >= 392 and clean == 400


def test_redaction(spark):
    df = frame(spark, [(1, "token=abcdefgh and more"), (2, None), (3, "clean")])
    out = by_id(secrets.redacted(df), "text", "n_chars", "size")
    assert out == {1: ("[SECRET] and more", 17, "y"), 2: (None, None, "y"), 3: ("clean", 5, "y")}
    assert secrets.redacted(df).columns == df.columns


# 6


def simhash_of(text):
    """The fingerprint by its definition, from the terms' hashes."""
    votes = [0] * simhash.BITS
    for h in text:
        for i in range(simhash.BITS):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_simhash(spark, corpus):
    rows = corpus + [(2000, corpus[0][1])]
    df = frame(spark, rows)
    out = {r["doc_id"]: r for r in simhash.simhash(df, every=1).collect()}
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, reverse=True)
    following = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    edited = {d: t[: len(t) - len(t) // 2] + texts[following[d]][: len(t) // 2] for d, t in texts.items()}
    both = [(d, t) for d, t in texts.items()] + [(-d - 1, t) for d, t in edited.items()]
    halves = [r.asDict() for r in spark.createDataFrame(both, "d long, t string").select("d", *(h.alias(f"h{i}") for i, h in enumerate(simhash.term_hashes(F.col("t"))))).collect()]
    terms = {r["d"]: [sum((r[f"h{i}"][k] & (1 << 64) - 1) << 64 * i for i in range(simhash.BITS // 64)) for k in range(len(r["h0"]))] for r in halves}
    prints = {d: simhash_of(t) for d, t in terms.items()}
    for d, t in texts.items():
        r = out[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert int(r["fingerprint"], 16) == prints[d] and int(r["edited_fingerprint"], 16) == prints[-d - 1]
        alike = lambda a, b: 1 - (a ^ b).bit_count() / simhash.BITS
        assert r["near_edited"] == alike(prints[d], prints[-d - 1]) and r["near_next"] == alike(prints[d], prints[following[d]])
        assert r["n_near"] <= sum((prints[d] ^ prints[e]).bit_count() <= simhash.RADIUS for e in texts) - 1
    near = sum((prints[d] ^ prints[e]).bit_count() <= simhash.RADIUS for d in texts for e in texts) - len(texts)
    assert near and sum(r["n_near"] for r in out.values()) >= 0.9 * near
    assert out[0]["fingerprint"] == out[2000]["fingerprint"] and out[0]["n_near"] >= 1


def test_simhash_edges(spark):
    out = simhash.simhash(frame(spark, [(5, "one text"), (5, "another"), (None, "third")])).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in out) == [(False, 7), (False, 8), (True, 5)]
    # Null ids follow the smallest id, equal rows each other; the last row is followed by the first.
    rows = [(9, "first of all"), (None, "b c d"), (None, "b c d"), (None, "b c d"), (4, "")]
    out = [r for r in simhash.simhash(frame(spark, rows)).collect() if r["doc_id"] is None]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r["edited_sha256"] for r in out) == sorted([sha("b cb "), sha("b cb "), sha("b c" + "fi")]) and [r["near_next"] for r in out].count(1.0) == 2
    alone = simhash.simhash(frame(spark, [(3, "only one")])).collect()
    assert alone[0]["near_next"] == 1.0
    assert simhash.simhash(empty(spark)).count() == 0
    long = "w " * 40_000 + "x y z"
    assert simhash.simhash(frame(spark, [(1, long), (2, long)])).filter("near_next = 1").count() == 2


def test_simhash_tables_find_what_brute_force_finds(spark):
    """Over a whole corpus: what the block tables find, of all pairs of a query and another text within RADIUS."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["near_ids"], r["first_id"]) for r in simhash.simhash(docs).collect()}
    first = {f: i for f, _, i in got.values()}
    wanted = found = 0
    for f, near, _ in (v for d, v in got.items() if d % 50 == 0):
        want = {i for g, i in first.items() if g != f and (f ^ g).bit_count() <= simhash.RADIUS}
        assert set(near) <= want
        wanted, found = wanted + len(want), found + len(set(near))
    print(f"block tables: {found} of {wanted} neighbours")
    assert wanted > 20 and found >= 0.9 * wanted


def test_simhash_finds_near_copies(spark, monkeypatch):
    """Near copies of Jaccard 0.8 are within the radius, and the result names them; unrelated texts are not."""
    rng = random.Random(28)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        # Each of 7 changed words, far apart, replaces 5 of 300 shingles.
        other = [f"z{rng.randrange(10**6)}" if n % 44 == 20 else w for n, w in enumerate(words)]
        a, b = ({" ".join(t[n : n + 5]) for n in range(300)} for t in (words, other))
        assert 0.78 < len(a & b) / len(a | b) < 0.82
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(1000, rows[0][1]), (None, rows[2][1])]
    out = by_id(simhash.simhash(frame(spark, rows), every=2), "near_ids", "first_id", "n_near")
    assert out[1000][1] == out[0][1] == 0 and out[1000][0] == out[0][0] and out[None][1] == 2 and out[None][0] is None
    assert sum(out[2 * i][0] == [2 * i + 1] for i in range(60)) >= 54
    assert all(set(out[2 * i][0]) <= {2 * i + 1} for i in range(60))
    assert out[1][0] is None and out[0][2] == 1 + len(out[0][0])
    monkeypatch.setattr(simhash, "BROADCAST_FRONTS", 0)
    assert by_id(simhash.simhash(frame(spark, rows), every=2), "near_ids", "first_id", "n_near") == out


def test_simhash_leaves_no_neighbour_out(spark, monkeypatch):
    """Made fingerprints some bits apart, up to RADIUS and beyond: every pair within it is found, once, however queries are
    shared out."""
    rng = random.Random(31)
    queries = [rng.getrandbits(simhash.BITS) for _ in range(60)]
    stored = set(queries) | {rng.getrandbits(simhash.BITS) for _ in range(3000)}
    for q in queries:
        for apart in (1, 12, 20, 25, simhash.RADIUS - 1, simhash.RADIUS, simhash.RADIUS, simhash.RADIUS + 1):
            stored.add(q ^ sum(1 << b for b in rng.sample(range(simhash.BITS), apart)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = lambda x: {"lo": signed(x & (1 << 64) - 1), "hi": signed(x >> 64)}
    back = lambda r: (r["lo"] & (1 << 64) - 1) | (r["hi"] & (1 << 64) - 1) << 64
    frames = [spark.createDataFrame([(whole(x),) for x in xs], "fp struct<lo:long,hi:long>") for xs in (queries + queries[:5], sorted(stored))]
    want = sorted((q, f) for q in queries for f in stored if (q ^ f).bit_count() <= simhash.RADIUS)
    assert len(want) >= 60 * 8
    found = lambda: sorted((back(r["q"]), back(r["fp"])) for r in simhash.neighbours(*frames).collect())
    assert found() == want
    monkeypatch.setattr(simhash, "SCAN_QUERIES", 25)
    assert found() == want
    assert simhash.neighbours(frames[0].limit(0), frames[1]).count() == 0


# 7


def test_language(spark):
    rng = random.Random(6)
    vocabulary = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 11))) for _ in range(120)] for lang in ("aa", "bb", "cc")}
    rows = [(i, prose(rng, 60, vocabulary[lang]), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa", "s"), (501, "123 456!", "aa", "s"), (502, prose(rng, 50, vocabulary["bb"]), None, "s")]
    out = {r["doc_id"]: r for r in language.identify(frame(spark, rows)).collect()}
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows)
    held = [(d, lang) for d, _, lang, _ in rows[:120] if out[d]["held_out"]]
    assert len(held) > 10 and sum(out[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    assert out[500]["lang_pred"] == out[501]["lang_pred"] == "und" and out[502]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    flipped = frame(spark, [(d, t, lang if zlib.crc32(str(d).encode()) % 4 != 2 else "zz", s) for d, t, lang, s in rows])
    assert by_id(language.identify(flipped), "lang_pred") == by_id(language.identify(frame(spark, rows)), "lang_pred")
    assert language.identify(empty(spark)).count() == 0


# 8


def plain_language(text, dictionaries):
    """The language whose dictionary gives the smallest blocks, by a compressor made anew for each."""
    import zstandard

    def size(data, text):
        d = zstandard.ZstdCompressionDict(data.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=language.LEVEL)
        one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(one.compress(text[i : i + language.BLOCK])) for i in range(0, len(text), language.BLOCK))

    if not re.search(r"[^\W\d_]", text or ""):
        return "und"
    return min(sorted(dictionaries), key=lambda k: size(dictionaries[k], text.encode()))


def test_language_against_plain_compression_and_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.train(docs)
    assert set(models) == {r[0] for r in docs.select("lang").distinct().collect()} - {None} and all(len(m) > 30_000 for m in models.values())
    rows = docs.collect()
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[r["doc_id"]]["lang_pred"] == plain_language(r["text"], models) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    print(f"languages: {right} of {len(held)} held-out texts")
    assert right >= 0.95 * len(held)


def test_many_languages(spark):
    """More than any list of them: all can be predicted, from a shortlist, with few or short texts too."""
    rng = random.Random(9)
    vocabulary = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for i in range(300)}
    texts = {k: [prose(rng, 80, v) for _ in range(3)] for k, v in vocabulary.items()}
    models = {k: language._fair([t.encode() for t in v], 4096) for k, v in texts.items()} | {"short": b"hey", "empty": b""}
    classify = language.Classifier(models)
    fresh = [(k, prose(rng, 60, v)) for k, v in vocabulary.items()]
    assert sum(classify(t)[0] == k for k, t in fresh) >= 297
    assert all(len(classify.candidates(t.encode())) == language.SHORTLIST for _, t in fresh) and classify("x")[0] in models
    assert classify(" ".join(t for _, t in fresh) * 20)[0] in models
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, t, "long" if len(t) > 9 else "tiny", "s") for i, t in zip(learned, ("hello", "a text of more words " * 400) * 4)] + [(learned[9], "", "none", "s")]
    trained = language.train(frame(spark, rows))
    assert set(trained) == {"long", "tiny", "none"} and len(trained["long"]) > 20_000


def test_every_language_is_tried(monkeypatch):
    """The smallest of all languages' sizes wins, and all are in the score, whatever the trigrams put first."""
    import zstandard

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    passages = [prose(rng, 200, words) for _ in range(6)]
    noise = lambda: "".join(rng.choice("0123456789:;<=>?") for _ in range(4000))
    # Languages with the words, in other orders, and after them one for each passage, whole amid noise.
    models = {f"a{i:02}": prose(rng, 600, words).encode() for i in range(10)} | {f"b{i}": (noise() + p + noise()).encode() for i, p in enumerate(passages)}
    texts = [*passages, noise(), prose(rng, 30, words), "x", "12 34", None, "", passages[0] * 20, "überall Übung " * 300]

    def size(data, text):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        d.precompute_compress(level=language.LEVEL)
        return sum(len(one.compress(text[i : i + language.BLOCK])) for i in range(0, len(text), language.BLOCK))

    classify = language.Classifier(models)
    assert all(10 + i not in classify.candidates(p.encode()) for i, p in enumerate(passages))
    out = [classify(t) for t in texts]
    assert [o[0] for o in out[:6]] == [f"b{i}" for i in range(6)]
    for text, (lang, score, accepted) in zip(texts, out):
        assert lang == plain_language(text, models)
        if lang != "und":
            sizes = sorted(size(data, text.encode()) for data in models.values())
            assert abs(score - 1 / sum(math.exp(-20 * (s - sizes[0]) / sizes[0]) for s in sizes)) < 1e-12
            assert accepted == ((sizes[1] - sizes[0]) / sizes[1] >= language.MARGIN)
    monkeypatch.setattr(language, "HELD", 3)
    monkeypatch.setattr(language, "SIZES", 40)
    assert language.Classifier(models).classify(texts) == out


def test_mixing(spark):
    rng = random.Random(7)
    sources = ["big"] * 60 + ["mid"] * 25 + ["small"] * 10 + [None] * 5
    rows = [(i, prose(rng, rng.randint(5, 400)), None, s) for i, s in enumerate(sources)] + [(1000, None, None, "big"), (1000, "  ", None, "void")]
    df = frame(spark, rows)
    out = mixing.mixture(df).collect()
    assert len(out) == len(rows)
    sizes = [(s, len((t or "").split())) for _, t, _, s in rows]
    want, taken = brute.targets(sizes), {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= max(3 * mixing.BLOCK, 0.02 * t), s
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixture(df.repartition(3)).collect()), key=str)
    assert mixing.mixture(empty(spark)).count() == 0
    whole = mixing.mixed(df).collect()
    assert sum(len(r["text"].split()) for r in whole) == sum(taken.values())
    texts = {d: t for d, t, *_ in rows}
    assert all(set(r["text"].split()) <= set(texts[r["doc_id"]].split()) for r in whole)
    assert mixing.mixed(df).columns == df.columns


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(1)).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


# 9


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1"), (2, "http://b/", None), (3, None, "<p>é</p>\r\n\r\nWARC/1.1"), (4, "http://d/\n", ""), (9, "u", "solo"), (None, "x", "y"), (9, "z", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    found = warc.round_trip(pages).collect()
    assert sorted(r["payload_digest"] for r in found if r["page_id"] == 9) == sorted(map(digest, ("solo", "other")))
    out = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and set(out) == {1, 2, 3, 4, 9, None}
    first = rows[0][2]
    assert (out[1]["record_type"], out[1]["refers_to"], out[1]["payload_bytes"], out[1]["payload_digest"]) == ("response", None, len(first.encode()), digest(first))
    assert (out[3]["record_type"], out[3]["refers_to"], out[3]["payload_bytes"], out[3]["payload_digest"]) == ("revisit", 1, len(first.encode()), digest(first))
    assert (out[4]["record_type"], out[4]["refers_to"], out[4]["payload_bytes"]) == ("revisit", 2, 0)
    assert all(r["complete"] for r in found)
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    nested = warc.assemble(warc.read_archives(spark, path)).filter("capture.record_id like '%:1:0'").first()
    assert bytes(nested["capture"]["payload"]).decode() == first and nested["capture"]["intact"] and nested["request"]["target_uri"] == "http://a/"


def test_warc_parse_reads_gzip_members_and_refuses_truncation():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(record) + gzip.compress(record))] == [b"hello", b"hello"]
    with pytest.raises(ValueError):
        list(warc.parse(record[:-9]))


# 10


@pytest.mark.parametrize("words, percent, block", [(4, 85, 512), (5, 80, 4), (1, 50, 3)])
def test_jaccard(spark, corpus, words, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LOCAL_OFTEN", 3)
    got = by_id(jaccard.similar(frame(spark, corpus), words, percent), "n_shingles", "component_id")
    assert got == brute.jaccard(corpus, words, percent)


def test_jaccard_dense_group(spark):
    """Near copies of one text that link in chains, beyond what the first round's forests find."""
    rng = random.Random(8)
    base = prose(rng, 70).split()
    rows = []
    for i in range(120):
        copy = list(base)
        for k in rng.sample(range(70), rng.randint(0, 3)):
            copy[k] = f"e{rng.randint(0, 3)}"
        rows.append((i, " ".join(copy)))
    got = by_id(jaccard.similar(frame(spark, rows), 4, 85), "n_shingles", "component_id")
    assert got == brute.jaccard(rows, 4, 85)


def test_jaccard_edges(spark):
    text = prose(random.Random(9), 30)
    rows = [(None, text), (4, text), (4, "other text of few words"), (5, None), (6, ""), (7, "two words"), (8, "TWO  words")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, rows), 4, 85).collect()), key=str)
    assert (7, 1, 7) in out and (8, 1, 7) in out and (5, 0, 5) in out and (6, 0, 6) in out and len(out) == 7
    assert jaccard.similar(empty(spark), 4, 85).count() == 0
    kept = jaccard.keep_one(frame(spark, rows[3:]), 4, 85)
    assert {r["doc_id"] for r in kept.collect()} == {5, 6, 7} and kept.columns == frame(spark, rows).columns


def test_shingles_fold_only_ascii():
    a, b, c = shingle_sets([b"One Two three", b"one  two\tTHREE", "Éa b c".encode()], 3)
    assert len(a) == 1 and (a == b).all() and (a != c).all()
    assert list(shingle_sets(["Éa b c".encode()], 3))[0] != list(shingle_sets(["éa b c".encode()], 3))[0]


def test_warc_returns_every_row_and_bounds_files(spark, monkeypatch, tmp_path):
    """Null and repeated page_ids, odd URLs, and a file for each record where records are longer than a file may be."""
    rows = [(7, "http://a/ ", "same"), (7, "http://b/ ", "same"), (None, None, "same"), (None, "\x00x\x85", "other"), (None, "u", "other"), (3, "v", "é" * 100_000), (4, "", None), (9, "w", ""), (9, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["url"], r["payload_digest"], r["payload_bytes"]) for r in out) == sorted((str(p), (u or "").replace("\x00", ""), digest(h), len((h or "").encode())) for p, u, h in rows)
    kinds = lambda t: sorted((r["record_type"], str(r["refers_to"]), str(r["page_id"])) for r in out if r["payload_digest"] == digest(t))
    assert kinds("same") == [("response", "None", "7"), ("revisit", "7", "7"), ("revisit", "7", "None")]
    assert kinds("other") == [("response", "None", "None"), ("revisit", "None", "None")]
    assert kinds("") == [("response", "None", "4"), ("revisit", "4", "9"), ("revisit", "4", "9")]
    assert all(r["complete"] for r in out)
    monkeypatch.setattr(warc, "FILE_CHARS", 100)
    path = f"file://{tmp_path}/small"
    warc.write_archives(pages.coalesce(1), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert files.count() == 3 * len(rows) and warc.assemble(warc.read_archives(spark, path)).count() == len(rows)
