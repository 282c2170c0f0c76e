"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def repeats(rows, length=100):
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256, of (doc_id, text) rows."""
    seen, out = set(), {}
    for doc_id, text in sorted((d, (t or "").encode()) for d, t in rows):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup, seen = 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def shingles(text, n):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(n))))


def jaccard(rows, n, percent):
    """doc_id -> size, component of (doc_id, text) rows."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target of each source of a list of (source, size): shares by weight, the excess over caps reshared."""
    total = Counter()
    for source, size in sizes:
        total[source] += size
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        rest = sum(total.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * total[s] + 1e-9]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * total[s] for s in over}


def kept(rows):
    """Whether the quality rules keep each of a list of (source, text) rows."""
    out, hosts = [], {}
    for source, text in rows:
        n, chars, symbols, dup, repeated = quality(text)
        lines = sum(1 for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line))
        base = n < 50 or 100 * repeated > 50 * n
        soft = 10 * symbols > chars or 10 * dup > 3 * lines or 100 * repeated > 20 * n or chars < 3 * n or chars > 10 * n
        out.append((source, base, soft))
        seen = hosts.setdefault(source, [0, 0])
        seen[0] += 1
        seen[1] += base or soft
    rates = [f / n for n, f in hosts.values()]
    mean = sum(rates) / len(rates) if rates else 0
    spread = sum((r - mean) ** 2 for r in rates) / len(rates) if rates else 0
    strength = mean * (1 - mean) / spread - 1 if 1e-12 < spread < mean * (1 - mean) else 100.0
    bad = {h for h, (n, f) in hosts.items() if round((f + mean * strength) / (n + strength), 6) > 0.5}
    return [not base and not (source in bad and soft) for source, base, soft in out]


def masked(text):
    """text with the base patterns' matches, overlapping ones joined, replaced."""
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [m.span() for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out, last = "", 0
    for a, b in sorted(spans):
        if a >= last:
            out += text[last:a] + "[SECRET]"
        last = max(last, b)
    return out + text[last:]
