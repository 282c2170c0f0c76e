r"""Secret scans: base patterns over the text, and the same patterns over every layer that decoding uncovers.

A worklist starts with the text itself. Each layer is scanned; each encoded region in it (percent escapes, backslash
escapes, base64 or base64url runs, which may hold gzip, zlib, bz2, xz or zstandard data) yields a further layer, until
nothing new appears. A digest of each layer and place stops cycles. Every layer keeps, for each of its characters, the
code points of the original text that it came from, so a finding in any layer maps back to a span of the text; the
characters of a base64 or compressed layer all map to the whole encoded run. A base64 run goes on over line breaks, and
is decoded at all four phases; of a run over several lines, a finding spans the lines' parts that it comes from, and one
in compressed data all from the line where that begins.

Layers of bytes are read as Latin-1, and without zero bytes, as UTF-16 has them: patterns are ASCII, so no byte that isn't
text hides what lies beside it. Compressed
data is opened wherever its magic number stands in such a layer (zlib's weak one where encoded data begins), to any depth, and
broken data as far as it goes. Of decompressed data MAX_LAYER bytes are held at once; more is scanned in pieces that
share OVERLAP bytes, so only what is longer than that can be cut; compressed data of over MAX_LAYER bytes inside a
larger layer, not at its head, is opened as far as its piece goes.

Edge cases: null text is empty; each row, repeated or with a null doc_id, is scanned by itself, and a very long text as a
whole; an empty table gives no rows; other columns are ignored, or, by redacted(), kept, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, per_row

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate([*KINDS, *(f"decoded_{k}" for k in KINDS)])}
MAX_LAYER = 16 << 20
OVERLAP = PIECE = 1 << 20
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
_ESCAPE_1 = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
_ZEROS = re.compile(r"\0+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\A\x78[\x01\x5e\x9c\xda]")
_ZLIB_HEAD = re.compile(rb"\x78[\x01\x5e\x9c\xda]")
_PLAIN = str.maketrans("-_", "+/")
_WORD = re.compile(r"[A-Za-z0-9+/_-]+")
# A run of 16 characters, or one that goes on over line breaks.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+[A-Za-z0-9+/_-]++)++|(?<=[A-Za-z0-9+/_-]{16}))={0,2}")
_ZLIB = re.compile("eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base patterns' matches."""
    found = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


class _File:
    """Chunks as what zstandard reads from."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks = iter(chunks)

    def read(self, size: int = -1) -> bytes:
        return next(self.chunks, b"")


def _unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What compressed data holds, by its magic number, in pieces; as far as it is whole."""
    chunks = iter(chunks)
    head = next(chunks, b"")
    chunks = itertools.chain([head], chunks)
    try:
        if head[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(_File(chunks)) as reader:
                while piece := reader.read(PIECE):
                    yield piece
        elif head[:3] == b"BZh" or head[:2] == b"\xfd7":
            unzip = bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(memlimit=256 << 20)
            for chunk in chunks:
                yield unzip.decompress(chunk, PIECE)
                while not unzip.eof and not unzip.needs_input:
                    yield unzip.decompress(b"", PIECE)
                if unzip.eof:
                    return
        else:
            unzip = zlib.decompressobj(31 if head[:1] == b"\x1f" else 15)
            for chunk in chunks:
                while chunk and not unzip.eof:
                    # Small steps: what comes before an error is kept.
                    step, chunk = chunk[:4096], chunk[4096:] if len(chunk) > 4096 else b""
                    while step and not unzip.eof:
                        yield unzip.decompress(step, PIECE)
                        step = unzip.unconsumed_tail
                if unzip.eof:
                    return
            yield unzip.flush()
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


def _pieces(chunks: Iterable[bytes]) -> Iterator[str]:
    """What compressed data holds, whole or in overlapping pieces."""
    held, pieces, whole = bytearray(), _unpacked(chunks), True
    for piece in pieces:
        held += piece
        if len(held) > MAX_LAYER:
            if whole and _MAGIC.match(held):
                yield from _pieces(itertools.chain([bytes(held)], pieces))
                return
            whole = False
            yield held.decode("latin-1")
            del held[:-OVERLAP]
    if held:
        yield held.decode("latin-1")


def _span(places: list[tuple[int, int]] | tuple[int, int] | None, start: int, end: int) -> tuple[int, int]:
    """The span of the original text that a layer's characters come from. Places are None for the original itself, a span
    for each character, or one span for all."""
    if places is None:
        return start, end
    if isinstance(places, tuple):
        return places
    return min(p[0] for p in places[start:end]), max(p[1] for p in places[start:end])


def _replaced(text: str, places, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int]] | tuple[int, int]]:
    """text with each match of pattern decoded; the new characters come from the whole match."""
    if isinstance(places, tuple):
        return pattern.sub(lambda m: decode(m[0]), text), places
    places = [(i, i + 1) for i in range(len(text))] if places is None else places
    parts, origin, last = [], [], 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        parts += [text[last : m.start()], new]
        origin += places[last : m.start()]
        origin += [(places[m.start()][0], places[m.end() - 1][1])] * len(new)
        last = m.end()
    return "".join([*parts, text[last:]]), origin + places[last:]


def _unquote(run: str) -> str:
    return unquote_to_bytes(run).decode("latin-1")


def _unescape(run: str) -> str:
    code = lambda m: int(m[1] or m[2] or m[3], 16)
    return _ESCAPE_1.sub(lambda m: chr(code(m)) if code(m) < 0x110000 else "\ufffd", run)


def _unbase64(core: str) -> bytes:
    core = core[: len(core) - (len(core) % 4 == 1)]
    return base64.b64decode(core + "=" * (-len(core) % 4))


def _base64_layers(text: str, places, run: re.Match) -> Iterator[tuple[str, list[tuple[int, int]] | tuple[int, int]]]:
    """What a run holds at each of its four phases, as words before it, or a line's last one, may shift it. A layer's
    characters map to the run's parts in the lines that they come from."""
    parts = [(m.start() + run.start(), m.end() + run.start()) for m in _WORD.finditer(run[0])]
    core = "".join(text[a:b] for a, b in parts).translate(_PLAIN)
    if len(core) < 16:
        return
    one = _span(places, run.start(), run.end()) if len(parts) == 1 or isinstance(places, tuple) else None
    if not one:
        spans = [_span(places, a, b) for a, b in [*parts[:-1], (parts[-1][0], run.end())]]
        line = [span for span, (a, b) in zip(spans, parts) for _ in range(b - a)]
    for phase in range(4):
        data = _unbase64(core[phase:])
        at = one or [(line[c][0], line[c + 1][1]) for i in range(len(data)) for c in (phase + i // 3 * 4 + i % 3,)]
        yield data.decode("latin-1"), at
        if not one:
            for m in _MAGIC.finditer(data):
                for piece in _pieces([data[m.start() :]]):
                    yield piece, _span(at, m.start(), len(data))
    # zlib's magic number is weak: it is looked for where the encoded data may begin.
    for m in _ZLIB.finditer(core):
        for piece in _pieces([_unbase64(core[m.start() :])]):
            yield piece, one or (line[m.start()][0], line[-1][1])


def _unescaped_layers(text: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, tuple[int, int]]]:
    """What compressed data holds whose bytes were escaped, some of them or all. It goes on up to white space that wasn't;
    zlib's weak magic number counts where escapes begin."""
    data, wide = text.encode("latin-1", "replace"), [b - a > 1 for a, b in places]
    starts = [m.start() for m in _MAGIC.finditer(data) if m[0][:1] != b"x"]
    # Its first byte is a letter, which may or may not be escaped; the second one is no letter.
    starts += [at for m in _ZLIB_HEAD.finditer(data) if wide[(at := m.start()) + 1] and not (wide[at] and at and wide[at - 1])]
    for start in starts:
        end = next((i for i in range(start, len(text)) if not wide[i] and text[i].isspace()), len(text))
        for piece in _pieces([data[start:end]]):
            yield piece, _span(places, start, end)


def _layers(text: str, places) -> Iterator[tuple[str, list[tuple[int, int]] | tuple[int, int]]]:
    """The layers one step below: the whole layer with its escapes undone, what base64 runs hold, and, in a layer of
    bytes or one with escapes undone, what compressed data holds."""
    if "%" in text and _URL.search(text):
        yield _replaced(text, places, _URL, _unquote)
    if "\\" in text and _ESCAPE.search(text):
        yield _replaced(text, places, _ESCAPE, _unescape)
    if "\0" in text:
        # UTF-16 and UTF-32, of either order and phase: patterns are ASCII, whose other bytes are zero.
        yield _replaced(text, places, _ZEROS, lambda run: "")
    if isinstance(places, tuple):
        data = text.encode("latin-1", "replace")
        for m in _MAGIC.finditer(data):
            for piece in _pieces([data[m.start() :]]):
                yield piece, places
    elif places is not None:
        yield from _unescaped_layers(text, places)
    for m in _BASE64.finditer(text):
        yield from _base64_layers(text, places, m)


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text: the base ones, and those of decoded layers that no base span of that kind covers."""
    text = text or ""
    base = base_spans(text)
    found, seen = set(), set()
    # Depth first, and layers are made when their turn comes, so few are held.
    work = [_layers(text, None)]
    while work:
        if (below := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, places = below
        if not layer:
            continue
        key = hashlib.blake2b(f"{_span(places, 0, len(layer))}{layer}".encode("utf-8", "replace"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        for start, end, kind in base_spans(layer):
            at, to = _span(places, start, end)
            if not any(k == kind and s <= at and to <= e for s, e, k in base):
                found.add((at, to, f"decoded_{kind}"))
        work.append(_layers(layer, places))
    return sorted([*base, *found], key=lambda s: (s[0], ORDER[s[2]], s[1]))


def redact(text: str | None) -> str | None:
    """text with every span, overlapping ones joined, replaced by MASK."""
    if not text:
        return text
    out, last = [], 0
    for start, end, _ in scan(text):
        if start >= last:
            out += [text[last:start], MASK]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _row(doc_id: int, text: str | None) -> tuple:
    spans = scan(text)
    base = [s for s in spans if s[2] in KINDS]
    counts = [sum(s[2] == kind for s in base) for kind in KINDS]
    return doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: the counts, base_sha256 and spans of the contract."""
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return mapped(docs.select("doc_id", "text"), per_row(arrow, _row), ddl)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked; n_chars, where there, follows. Columns and other values stay."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    out = mapped(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
