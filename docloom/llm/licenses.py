"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Templates are cut into pieces of at most 32 words. Documents are read in overlapping windows
that are a little longer than a size class of pieces, so every piece-long passage lies whole
in some window. For each class the number of bands (of one row) is what makes a passage that
reaches the containment threshold collide with probability 1 - miss at least. A collision is
followed by the exact containment of the whole template's shingles at that place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, PrefixHash, give_back, mix, widened
from .decontaminate import fold_words


@dataclass(frozen=True)
class LicenseScan:
    shingle: int = 5
    containment: float = 0.8
    miss: float = 1e-4  # largest probability that the bands miss a passage at the threshold
    classes: tuple[int, ...] = (8, 16, 32)
    step_words: int = 500_000
    template_bytes: int = 16 << 20  # templates are broadcast: more than this in all is an error


#: Notices, as their licences word them (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole licences and further notices, as their owners word them (fixed values).
TEMPLATES += (
    ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_OPENING} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def bands_for(low: float, miss: float) -> int:
    """Bands of one row that miss a pair of similarity `low` with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - low)) if low < 1 else 1


class Templates:
    def __init__(self, templates, rule: LicenseScan) -> None:
        self.rule, self.hash = rule, PrefixHash(0xA24BAED4963EE407)
        self.names, self.sets, self.sizes = [], [], []
        self.known: dict[bytes, int] = {}
        pieces: dict[int, list] = {c: [] for c in rule.classes}
        for name, text in templates:
            words = fold_words(text.encode() if isinstance(text, str) else text)
            if len(words) < rule.shingle:
                raise ValueError(f"the template {name!r} has fewer than {rule.shingle} words")
            self.names.append(name)
            self.sizes.append(len(words))
            self.sets.append({tuple(words[i : i + rule.shingle]) for i in range(len(words) - rule.shingle + 1)})
            longest = rule.classes[-1]
            starts = list(range(0, max(1, len(words) - rule.shingle + 1), longest))
            for start in starts:
                start = min(start, max(0, len(words) - longest))
                part = words[start : start + longest]
                size = next(c for c in rule.classes if c >= len(part))
                pieces[size].append((len(self.names) - 1, start, part))
        self.classes = []
        smallest = dict(zip(rule.classes, (rule.shingle, *(c + 1 for c in rule.classes))))
        for size, parts in pieces.items():
            if not parts:
                continue
            stride = size // 4
            window = size + stride
            window += -(window - rule.shingle + 1) % stride
            held = smallest[size] - rule.shingle + 1
            shared = max(1, math.ceil(rule.containment * held))
            low = shared / (window - rule.shingle + 1 + held - shared)
            bands = bands_for(low, rule.miss)
            odd = mix(np.arange(1, bands + 1, dtype=U64) + U64(size << 20)) | U64(1)
            mins = []
            for _, _, part in parts:
                h = self.shingles(self.word_hashes(part))
                mins.append([(h * o).min() for o in odd])
            mins = np.array(mins, U64)
            self.classes.append((stride, (window - rule.shingle + 1) // stride, odd, mins, parts))

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, U64)

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.rule.shingle + 1
        if n <= 0:
            return np.zeros(0, U64)
        at = np.arange(n)
        sums = self.hash.sums(hashes)
        return mix(self.hash.spans(sums, at, at + self.rule.shingle))

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(template, first word) at which some band of some window collides."""
        found = set()
        shingles = self.shingles(hashes)
        for stride, blocks, odd, mins, parts in self.classes:
            n = -(-len(shingles) // stride)
            if not n:
                continue
            padded = np.full(n * stride, U64(0xFFFFFFFFFFFFFFFF))
            work = np.empty(len(shingles), U64)
            for band, o in enumerate(odd):
                np.multiply(shingles, o, out=work)
                padded[: len(work)] = work
                block = padded[0::stride].copy()
                for i in range(1, stride):
                    np.minimum(block, padded[i::stride], out=block)
                window = block
                for i in range(1, blocks):
                    window = np.minimum(window[:-1], block[i:]) if len(window) > 1 else window
                first = np.zeros(65536, bool)
                first[(mins[:, band] >> U64(48)).astype(np.int64)] = True
                for at in np.flatnonzero(first[(window >> U64(48)).astype(np.int64)]).tolist():
                    for number in np.flatnonzero(mins[:, band] == window[at]).tolist():
                        template, offset, _ = parts[number]
                        found.add((template, at * stride, offset))
        return found

    def verify(self, words: list[bytes], template: int, at: int, offset: int) -> tuple[float, int]:
        """Containment of the template about a place of one document, and the first word of what is shared."""
        slack = 2 * self.rule.classes[-1]
        low, high = max(0, at - offset - slack), min(len(words), at - offset + self.sizes[template] + slack)
        k, wanted = self.rule.shingle, self.sets[template]
        shared, first = set(), -1
        for i in range(low, high - k + 1):
            gram = tuple(words[i : i + k])
            if gram in wanted:
                shared.add(gram)
                first = i if first < 0 else first
        return len(shared) / len(wanted), first


def _scan_part(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Templates(*shared.value)
        for batch in batches:
            rows, words, hashes, starts = [], [], [], [0]

            def flush(first: int) -> None:
                best: dict = {}
                if words:
                    edges = np.array(starts)
                    for template, at, offset in model.candidates(np.concatenate(hashes)):
                        # a window may reach over an edge: its passage is in any of the texts it touches
                        span = 2 * model.rule.classes[-1]
                        low, high = np.searchsorted(edges, [at, at + span], side="right") - 1
                        for doc in range(int(low), min(int(high), len(starts) - 2) + 1):
                            own = words[starts[doc] : starts[doc + 1]]
                            score, where = model.verify(own, template, at - starts[doc], offset)
                            if score >= model.rule.containment:
                                key = (first + doc, model.names[template])
                                had = best.get(key)
                                best[key] = (max(score, had[0]), min(where, had[1])) if had else (score, where)
                rows.extend((doc, name, *v) for (doc, name), v in sorted(best.items()))

            done = 0
            for i, text in enumerate(batch.column("_text")):
                own = fold_words(text.as_py())
                words += own
                hashes.append(model.word_hashes(own))
                starts.append(len(words))
                if len(words) > model.rule.step_words or i == batch.num_rows - 1:
                    flush(done)
                    words, hashes, starts, done = [], [], [0], i + 1
            take = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(n).take(take) for n in names] + made, [*names, "license", "containment", "first_word"])
        give_back()

    return run


def _bounded(templates, rule: LicenseScan) -> tuple:
    """The templates as (name, text), once each, after a check of their size."""
    if isinstance(templates, DataFrame):
        rows = templates.select("name", "text").where("name is not null and text is not null").distinct()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    else:
        rows, size = None, sum(len(text.encode()) for _, text in templates)
    if size > rule.template_bytes:
        raise ValueError(f"templates of {size} bytes; {rule.template_bytes} may be broadcast")
    return tuple(templates) if rows is None else tuple(sorted((r["name"], r["text"]) for r in rows.collect()))


def scan(docs: DataFrame, *columns: str, templates=TEMPLATES, rule: LicenseScan = LicenseScan()) -> DataFrame:
    """The named columns, license, containment (the best) and first_word, for each document and licence found in it.

    `templates` is a list of (name, text), or a table of them (name, text) such as a collection of whole
    licences; it is broadcast, and more than `template_bytes` of texts, or one under five words, is an error. Null and empty texts have no licence; a text of any length is scanned whole; equal
    rows are reported alike; other columns do not matter, whatever their names.
    """
    source = docs.select(*columns, F.col("text").cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((_bounded(templates, rule), rule))
    return source.mapInArrow(_scan_part(shared, list(columns)), widened(source, list(columns), "license string, containment double, first_word long"))
