"""Licence scans: Dice coefficient over word bigrams against licence templates.

Text is lower-cased and cut into words of letters and digits. A unit is any run of consecutive words, wherever lines break;
its set is its distinct word bigrams. Dice = 2 |A & B| / (|A| + |B|) can reach the threshold t only if the template's size b
and the unit's size a satisfy b t / (2 - t) <= a <= b (2 - t) / t and at least b t / (2 - t) of the template's bigrams occur:
templates are pruned by that for the document first, units by size after. The best unit begins and ends with a bigram of the
template, and the shortest of equals holds its first bigram once, so only those are tried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernel as K
from .decontam import FILTER_BITS, SEPARATOR, spelled
from .license_texts import TEXTS

THRESHOLD = 0.9
_U = np.uint64
_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_ALONG = (
    " You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., "
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
)
#: Licence notices, as their licences word them or as they are usually declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": _NOTICE,
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "proprietary": "All rights reserved.",
    "AGPL-3.0-notice": _NOTICE.replace("GNU General", "GNU Affero General"),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "GPL-2.0-notice": _NOTICE.replace("software: you", "software; you").replace("version 3", "version 2") + _ALONG,
    "LGPL-2.1-notice": _NOTICE.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0-notice": _NOTICE.replace("GNU General", "GNU Lesser General"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    **TEXTS,
}

_GPL3 = TEXTS["GPL-3.0-text"]
#: How a licence is named after "under", with the article or without.
_NAMES = {
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0", "Apache License v2", "Apache Software License 2.0", "Apache Software License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "Simplified BSD License", "FreeBSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "ISC": ("ISC License",),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"),
    "MIT": ("MIT License", "MIT/X11 License", "Expat License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL v2.0"),
    "Unlicense": ("Unlicense",),
}
for _x, _versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))):
    for _v in _versions:
        _short = _v.removesuffix(".0")
        _NAMES[f"{_x}-{_v}"] = (
            *(f"{n}{how}{v}" for n in _NAMES[_x] for how in (", version ", " v", " ") for v in dict.fromkeys((_short, _v))),
            *(f"{_x}v{_short}", f"GNU {_x}v{_short}", f"{_NAMES[_x][0]} ({_x}) version {_short}", f"version {_short} of the {_NAMES[_x][0]}"),
        )
for _x, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    _long = f"Creative Commons {_long} 4.0"
    _NAMES[f"CC-{_x}-4.0"] = (f"CC {_x} 4.0", f"CC {_x} 4.0 License", f"{_long} International License", f"{_long} International", f"{_long} License", _long)
#: Further wordings, reported as the same licence: declarations, SPDX tags, both spellings, and texts without preamble or disclaimer's names.
VARIANTS = {
    k: tuple(
        dict.fromkeys(
            w
            for n in names
            for m in (n, n.replace("License", "Licence"))
            for way in ("under", "under the terms of")
            for w in [f"{way} {article}{m}" for article in ("the ", "", "an " if m[0] in "AEIM" else "a ")]
        )
    )
    + ((f"SPDX-License-Identifier: {k}",) if k[-1] != "L" else ())
    for k, names in _NAMES.items()
}
VARIANTS["GPL-3.0-text"] = (_GPL3[_GPL3.index("TERMS AND CONDITIONS") : _GPL3.index("END OF TERMS AND CONDITIONS")],)
VARIANTS["GPL-2.0-notice"] = (TEMPLATES["GPL-2.0-notice"].removesuffix(_ALONG),)
VARIANTS["proprietary"] = ("All rights are reserved.",)


class Templates:
    """Bigram sets of the templates and their variants: sorted distinct hashes, an incidence matrix, the templates of each hash and sizes."""

    def __init__(self, texts: dict[str, str], variants: dict[str, tuple[str, ...]] = {}):
        every = sorted([*texts.items(), *((n, t) for n, more in variants.items() for t in more)])
        self.names = [n for n, _ in every]
        text = pa.array([t.lower() for _, t in every], pa.large_string())
        data, offs = K.buffers(text)
        grams, first = K.Words(data, offs, SEPARATOR).grams(2)
        sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:])]
        self.hash = np.unique(np.concatenate(sets))
        self.has = np.stack([np.isin(self.hash, s) for s in sets], axis=1)
        self.size = self.has.sum(axis=0)
        self.holders = np.nonzero(self.has)[1]
        self.first = np.concatenate([[0], np.cumsum(self.has.sum(axis=1))])
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.hash >> _U(64 - FILTER_BITS)] = True


def scan_slice(table: Templates, data: np.ndarray, offs: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, template, dice, first line, lines): the runs of words that reach the threshold and share no word with a better one."""
    words = K.Words(data, offs, SEPARATOR)
    total = len(words.hash)
    if total < 2:
        return
    gram = K.mix(words.hash[:-1] * K.STEP[0] + words.hash[1:] * K.STEP[1])  # as grams(2), with those across texts
    owner = words.doc()
    at = np.flatnonzero(table.filter[gram >> _U(64 - FILTER_BITS)])
    at = at[owner[at] == owner[at + 1]]
    place = np.searchsorted(table.hash, gram[at])
    real = (place < len(table.hash)) & (table.hash[np.minimum(place, len(table.hash) - 1)] == gram[at])
    at, place = at[real], place[real]
    if not len(at):
        return
    pairs = np.unique(owner[at] * len(table.hash) + place)
    doc, which = pairs // len(table.hash), pairs % len(table.hash)
    n = (table.first[1:] - table.first[:-1])[which]
    entry = np.repeat(table.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
    both, found = np.unique(np.repeat(doc, n) * len(table.names) + table.holders[entry], return_counts=True)
    both = both[found >= table.size[both % len(table.names)] * threshold / (2 - threshold) - 1e-9]
    for d in np.unique(both // len(table.names)).tolist():
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
        line = None
        for k, dice, s, e in sorted(best_runs(table, both[both // len(table.names) == d] % len(table.names), gram[lo : hi - 1], at[a:b] - lo, place[a:b], threshold)):
            if line is None:
                line = np.searchsorted(np.flatnonzero(data[offs[d] : offs[d + 1]] == 10) + offs[d], words.start[lo:hi], side="left")
            yield d, k, dice, int(line[s]), int(line[e] - line[s] + 1)


class Taken:
    """Disjoint runs of words, from first to last, that licences hold already."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []

    def add(self, first: int, last: int) -> None:
        i = bisect_left(self.first, first)
        self.first.insert(i, first)
        self.last.insert(i, last)

    def room(self, word: int, words: int) -> int:
        """The last word that a run from ``word`` on may have; -1 if ``word`` is taken."""
        i = bisect_right(self.first, word)
        if i and self.last[i - 1] >= word:
            return -1
        return self.first[i] - 1 if i < len(self.first) else words - 1


class Runs:
    """The runs of one template in a document that reach the threshold, the best first: of equal Dice the shortest, then the first.

    ``spots`` are the places of the template's bigrams; ``before`` and ``after`` the places where each bigram was last and is next.
    A run is looked for from each spot up to where its first bigram recurs. It waits under the Dice of a run of all the template's bigrams
    up to there, and is measured only once no other start promises more: an exact copy is found by its first word alone.
    """

    def __init__(self, spots: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, threshold: float):
        self.before, self.after, self.size, self.threshold = before, after, size, threshold
        self.most = size * (2 - threshold) / threshold + 1e-9
        self.member = np.zeros(len(before), dtype=bool)
        self.member[spots] = True
        common = np.minimum(np.searchsorted(spots, after[spots]) - np.arange(len(spots)), size)
        enough = common >= size * threshold / (2 - threshold) - 1e-9
        common = common[enough]
        self.waiting = list(zip((-2 * common / (common + size)).tolist(), common.tolist(), spots[enough].tolist(), [-1] * len(common)))
        heapify(self.waiting)

    def best(self, taken: Taken) -> tuple[float, int, int] | None:
        """(dice, first word, last word) of the best run of words that are not ``taken``."""
        while self.waiting:
            dice, _, s, e = self.waiting[0]
            room = taken.room(s, len(self.before) + 1)
            if 0 <= e <= room:
                return -dice, s, e
            found = self.measured(s, min(int(self.after[s]), room))
            if found is None:
                heappop(self.waiting)
            else:
                heapreplace(self.waiting, found)
        return None

    def measured(self, s: int, limit: int) -> tuple[float, int, int, int] | None:
        """The best run of bigrams from ``s`` on and before ``limit``."""
        if limit <= s:
            return None
        width = int(2 * self.most) + 8
        while True:
            e = min(limit, s + width)
            fresh = self.before[s:e] < s
            distinct = np.cumsum(fresh)
            if e == limit or distinct[-1] > self.most:
                break
            width *= 4
        n = int(np.searchsorted(distinct, self.most, side="right"))
        dice = 2 * np.cumsum(fresh[:n] & self.member[s : s + n]) / (distinct[:n] + self.size)
        i = int(np.argmax(dice))
        return (-float(dice[i]), i + 1, s, s + i + 1) if dice[i] >= self.threshold - 1e-12 else None


def best_runs(table: Templates, candidates: np.ndarray, gram: np.ndarray, spots: np.ndarray, place: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(template, dice, first word, last word) of a document: every licence's runs that share no word with a better one."""
    order = np.argsort(gram, kind="stable")
    again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    before, after = np.full(len(gram), -1), np.full(len(gram), len(gram))
    before[order[again + 1]], after[order[again]] = order[again], order[again + 1]
    taken = Taken()
    runs = {int(k): Runs(spots[table.has[place, k]], before, after, int(table.size[k]), threshold) for k in candidates}
    open_: dict[int, tuple[int, float, int, int, int]] = {}

    def look(k: int) -> None:
        """Puts the best run that is left of template ``k`` into ``open_``."""
        open_.pop(k, None)
        if (run := runs[k].best(taken)) is not None:
            dice, s, e = run
            open_[k] = (weight(gram[s:e], dice, int(table.size[k])), dice, -k, s, e)

    for k in runs:
        look(k)
    out = []
    while open_:
        _, dice, k, s, e = max(open_.values())
        out.append((-k, dice, s, e))
        last = e - 1  # the words around that only repeat the run's bigrams belong to it
        after_room, end = taken.room(e, len(gram) + 1), e
        while end < after_room and before[end] >= s:
            end += 1
        start = s
        while start > 0 and after[start - 1] <= last and taken.room(start - 1, len(gram) + 1) >= 0:
            start -= 1
        taken.add(start, end)
        for o in [o for o, (_, _, _, first, final) in open_.items() if first <= end and start <= final]:
            look(o)
    return out


def weight(grams: np.ndarray, dice: float, size: int) -> int:
    """Agreeing bigrams of a run and a template of ``size`` less differing ones: of two that overlap, the greater is the better.

    An exact one-line notice inside an edited longer licence thus loses to it, and of licences of like length the closer one wins.
    """
    distinct = len(np.unique(grams))
    common = round(dice * (distinct + size) / 2)
    return 3 * common - distinct - size


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, dice, first_line, n_lines for every row of ``docs`` (doc_id, text) and every run of its words that is a licence.

    A licence that a text holds twice has two rows. A run of words never shares a word with a better run (see ``weight``), of its own template or another; the lines are those
    of its first and last word. Lines count from 0. Null, empty and one-word texts hold none. Of equally good runs the shortest is reported, then the first. Repeated rows report each; a null doc_id is carried; other columns are ignored; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(Templates(templates, VARIANTS if templates is TEMPLATES else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi, data, offs in K.slices(batch.column(1)):
                rows = list(scan_slice(table, data, offs, threshold))
                if rows:
                    d, k, dice, first, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).take(pa.array(d)), pa.array([table.names[i] for i in k]), pa.array(dice), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "license_id", "dice", "first_line", "n_lines"],
                    )

    text = spelled(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, license_id string, dice double, first_line long, n_lines long")
