"""License scans by conditional compression.

Lines with a license word seed candidate blocks. Each block, as it is and with the text around it (a notice may be wrapped
before or after its license word), is compressed with every template as a zstandard raw-content dictionary; templates are
ranked by how much of the block, or of the template where that is smaller, the dictionary saves. All that save at least
LEAST_SAVING are confirmed by their exact wording differences: the words of the template that the block lacks or changes,
and the words that it adds in between. The best of those that confirm names the license.

Edge cases: null or empty text has no block; a very long text is scanned whole, block by block; each row, repeated or with a
null doc_id, is scanned by itself; an empty table gives no rows; other columns are ignored; of templates that agree
equally well the one that comes first by name is taken.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import mapped

#: The least saving of a template that is compared exactly, and the most words that may differ in a hundred; in a template
#: of FEW_WORDS words or more one may always, though not of the license's name.
LEAST_SAVING = 0.3
MOST_DIFFERENT = 10
FEW_WORDS = 5
#: Lines without a license word that a block may span.
GAP = 4
LEVEL = 3

# Public license notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Names by which short notices call a license, by SPDX identifier.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSD": ("BSD License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
}
# What short notices say of a name.
FORMS = {
    "licensed": "Licensed under the {}",
    "released": "Released under the {}",
    "work": "This work is licensed under the {}",
    "bare": "Licensed under {}",
    "terms": "under the terms of the {}",
}
RESERVED = "All rights reserved."


def short_templates() -> dict[str, tuple[str, str]]:
    """Text and name of each form of short notice. `MIT:released` is the license and the form of its notice."""
    out = {"reserved:all": (RESERVED, RESERVED)}
    for license_, names in NAMES.items():
        out[f"{license_}:spdx"] = (f"SPDX-License-Identifier: {license_}", license_)
        for i, name in enumerate(names):
            out.update({f"{license_}:{form}{i or ''}": (text.format(name), name) for form, text in FORMS.items()})
    return out


_CUES = ("licen", "copyright", "redistribut", "permission", "warrant", "public domain", "unencumbered", "free software", "spdx", "rights reserved")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        short = {} if templates else short_templates()
        self.templates = dict(sorted(({k: text for k, (text, _) in short.items()} | (templates or TEMPLATES)).items()))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.empty = len(self.plain.compress(b""))
        self.words = {k: [w for w, _, _ in _words(v)] for k, v in self.templates.items()}
        #: Words of the license's name in a short notice, which it must have.
        self.named = {k: {w for w, _, _ in _words(name)} for k, (_, name) in short.items()}
        self.alone = {k: self.size(v) for k, v in self.templates.items()}
        self.around = 2 * max(map(len, self.templates.values()))
        self.given = {}
        for k, v in self.templates.items():
            # The template stands in a dictionary as it does in a block: folded, one space between words. A dictionary
            # has at least 8 bytes.
            d = zstandard.ZstdCompressionDict(self._fold(v).rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[k] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

    @staticmethod
    def _fold(text: str) -> bytes:
        return " ".join(text.lower().split()).encode("utf-8", "replace")

    def size(self, text: str) -> int:
        return max(1, len(self.plain.compress(self._fold(text))) - self.empty)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Spans of runs of lines that begin and end with a license word, at most GAP lines apart."""
        lower = text.lower()
        if not any(cue in lower for cue in _CUES):
            return []
        found, at, last = [], 0, -GAP - 2
        for i, line in enumerate(text.split("\n")):
            folded = line.lower()
            if any(cue in folded for cue in _CUES):
                if i - last <= GAP + 1:
                    found[-1] = (found[-1][0], at + len(line))
                else:
                    found.append((at, at + len(line)))
                last = i
            at += len(line) + 1
        return found

    def rank(self, block: str) -> list[tuple[float, str]]:
        data, alone = self._fold(block), self.size(block)
        saved = lambda k: (alone - max(0, len(self.given[k].compress(data)) - self.empty)) / min(alone, self.alone[k])
        return sorted(((saved(k), k) for k in self.templates), key=lambda s: (-s[0], s[1]))

    def confirm(self, name: str, words: list[tuple[str, int, int]]) -> tuple[int, int, int, int, int] | None:
        """Words of the template that lack, words between that are added, start, end, and words of the template."""
        want, have = self.words[name], [w for w, _, _ in words]
        same = [m for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        lacks = len(want) - sum(m.size for m in same)
        added = sum(b.b - a.b - a.size for a, b in zip(same, same[1:]))
        if 100 * (lacks + added) > max(MOST_DIFFERENT * len(want), 100 * (len(want) >= FEW_WORDS)):
            return None
        if lacks and name in self.named and not self.named[name] <= {w for m in same for w in want[m.a : m.a + m.size]}:
            return None
        return lacks, added, words[same[0].b][1], words[same[-1].b + same[-1].size - 1][2], len(want)

    def _hits(self, text: str, low: int, high: int, start: int, end: int) -> list[tuple]:
        """Template, n_lacking, n_added, start, end, n_words and saving of each template that confirms in text[low:high],
        where it meets text[start:end]."""
        block = text[low:high]
        words = _words(block)
        good = [(s, k) for s, k in self.rank(block) if s >= LEAST_SAVING]
        found = [(k, c[0], c[1], low + c[2], low + c[3], c[4], s) for s, k in good if (c := self.confirm(k, words))]
        return [h for h in found if h[3] < end and start < h[4]]

    def __call__(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """Template, start, end, saving, n_lacking and n_added of the best confirmed template of each part of a block."""
        text = text or ""
        found, work = [], self.blocks(text)
        while work:
            start, end = work.pop()
            if met := next((f for f in found if f[1] < end and start < f[2]), None):
                work += [(x + u, x + v) for x, y in ((start, met[1]), (met[2], end)) if x < y for u, v in self.blocks(text[x:y])]
                continue
            low = max([start - self.around, 0, *(f[2] for f in found if f[2] <= start)])
            high = min([end + self.around, len(text), *(f[1] for f in found if f[1] >= end)])
            hits = self._hits(text, start, end, start, end) + self._hits(text, low, high, start, end)
            if hits:
                # The most words that agree: a longer template wins over one that it contains.
                k, lacks, added, a, b, _, s = min(hits, key=lambda h: (h[1] + h[2] - h[5], h[1] + h[2], h[0]))
                found.append((k, a, b, round(s, 4), lacks, added))
                work.append((start, end))
        return sorted(found, key=lambda f: f[1:3])


_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()), ("n_lacking", pa.int64()), ("n_added", pa.int64()), ("exact", pa.bool_())])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each license notice of each document; the span counts code points."""

    def run(batches):
        scan = Scanner(templates)
        for batch in batches:
            rows = [(d, hit[0].partition(":")[0], *hit, hit[4] + hit[5] == 0) for d, text in zip(*(c.to_pylist() for c in batch.columns)) for hit in scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    ddl = "doc_id long, license string, template string, start long, end long, saving double, n_lacking long, n_added long, exact boolean"
    return mapped(docs.select("doc_id", "text"), run, ddl)
