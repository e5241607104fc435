"""License scans: exact containment join of license texts with blocks of documents.

A label may have several templates: the license text, the sentence that authors put in its place, and
its SPDX line.  A template's blocks are all runs of words of a text that are half as long again as the template (room
for names, bullets and comment signs), or the whole text where that is shorter.  A template with n
distinct words meets a block that holds at least ``threshold`` * n of them.  Its label is given if a
block holds as large a share of its telling words too, which stand in no template of another label: so
that a text alike in wording alone, or under another license's name, isn't taken for it.  What meets
the threshold without them is told in a column of its own, or labelled with ``telling=False``.

Words are ordered by how rare they are in the corpus.  A run can only meet the threshold if it holds
one of the n - ceil(threshold * n) + 1 rarest words of the template (prefix filter).  Around each of
these places as many distinct template words as needed must stand within a run's length (length
filter), and as many of them as are still needed must come behind the place's own word in the order,
since each block is looked at from its rarest word (positional filter).  What is left is verified by
sliding over every run, so the join is exact.

Base labels come from fixed phrases whose words must stand one after the other; they are found by
their rarest word and verified in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.textkit import ALNUM, Words, batch_of, map_batches, slices, texts_of

#: Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Published license texts, and the notices that the longer ones tell authors to use, as words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "cc-by-nc-4.0": "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
    "cc-by-sa-4.0": "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
    "cc0": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}
#: Sentences that name a license, and names of the SPDX list.  What stands behind ``#`` tells templates of one label apart.
NOTICES = {
    "apache-2.0#named": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0#named": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0#named": "licensed under cc by sa 4 0",
    "gpl-notice#named": "this work is licensed under the gnu general public license version 3",
    "mit#named": "released under the mit license",
    "mpl-2.0#named": "licensed under the mozilla public license version 2 0",
}
SPDX = {"apache-2.0": "apache 2 0", "bsd": "bsd 3 clause", "boost": "bsl 1 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc0": "cc0 1 0", "gpl-notice": "gpl 3 0", "isc": "isc", "mit": "mit", "mpl-2.0": "mpl 2 0", "unlicense": "unlicense", "zlib": "zlib"}
TEMPLATES |= NOTICES | {f"{label}#spdx": f"spdx license identifier {name}" for label, name in SPDX.items()}
THRESHOLD = 0.8
#: A block's words for each word of its template.
ROOM = 1.5


def needed(n: int, threshold: float) -> int:
    """Words that a block must hold of n."""
    return math.ceil(threshold * n - 1e-9)


def run_words(template: str) -> int:
    """Words of a template's blocks."""
    return math.ceil(ROOM * len(template.split()))


def telling_words(templates: dict[str, str]) -> dict[str, set[str]]:
    """The words of each template that stand in none of another label."""
    sets = {name: set(body.split()) for name, body in templates.items()}
    return {name: words - set().union(*(other for n, other in sets.items() if label_of(n) != label_of(name))) for name, words in sets.items()}


def label_of(name: str) -> str:
    """The label of a template's name."""
    return name.partition("#")[0]


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), ALNUM).hash[0])


class _Vocabulary:
    """The words of templates and phrases by hash, behind a bit table."""

    def __init__(self, templates: dict[str, str]):
        self.words = sorted({w for t in [*templates.values(), *PHRASES] for w in t.split()})
        hashes = np.array([_hash_of(w) for w in self.words], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.front = np.zeros(1 << 16, bool)
        self.front[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, word numbers) of the words that are known."""
        at = np.flatnonzero(self.front[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == hashes[at]
        return at[hit], self.number[slot[hit]]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    offsets, data = texts_of(batch)
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)


def word_frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """How often each template word stands in the whole corpus; a row for each word and task is shuffled."""
    vocabulary = _Vocabulary(templates)
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, _, words in _parts(batch):
                total += np.bincount(vocabulary.find(words.hash)[1], minlength=len(total))
        yield batch_of(schema, word=np.arange(len(total), dtype=np.int32), n=total)

    rows = map_batches(docs.select(F.col(text).cast("string").alias("text")), count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary.words)}


class _Template:
    """A template's words by rank: ``position`` of each rank in its own order (-1: not its word), the rarest first."""

    def __init__(self, label: str, body: str, telling: set[str], rank_of: dict[str, int], threshold: float):
        tokens = sorted({rank_of[w] for w in body.split()})
        self.label, self.size, self.need, self.run = label_of(label), len(tokens), needed(len(tokens), threshold), run_words(body)
        self.position = np.full(len(rank_of), -1)
        self.position[tokens] = np.arange(len(tokens))
        self.prefix = tokens[: self.size - self.need + 1]
        self.telling = np.zeros(len(tokens), bool)
        self.telling[self.position[[rank_of[w] for w in telling]] if telling else []] = True
        self.need_telling = needed(int(self.telling.sum()), threshold)

    def best(self, at: np.ndarray, position: np.ndarray) -> tuple[int, int]:
        """The most distinct words that any run holds, and any with its telling words; 0 under what is needed.  ``at``: places of its words in one text."""
        if len(np.unique(position)) < self.need:
            return 0, 0
        first = np.searchsorted(at, at - self.run, side="right")
        last = np.searchsorted(at, at + self.run)
        near = np.zeros(len(at), bool)
        for i in np.flatnonzero(position <= self.size - self.need).tolist():
            around = position[first[i] : last[i]]
            # of the blocks that have their rarest word here
            if len(np.unique(around[around >= position[i]])) >= self.need:
                near[first[i] : last[i]] = True
        held = np.zeros(self.size, np.int64)
        n = telling = start = best = told = 0
        for i, p in zip(np.flatnonzero(near).tolist(), position[near].tolist(), strict=True):
            held[p] += 1
            if held[p] == 1:
                n, telling = n + 1, telling + int(self.telling[p])
            while at[start] <= at[i] - self.run:
                if near[start]:
                    q = position[start]
                    held[q] -= 1
                    if not held[q]:
                        n, telling = n - 1, telling - int(self.telling[q])
                start += 1
            if n >= self.need:
                best = max(best, n)
                if telling >= self.need_telling:
                    told = max(told, n)
        return best, told


class Scanner:
    def __init__(self, frequencies: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, telling: bool = True):
        self.telling = telling
        self.vocabulary = _Vocabulary(templates)
        order = sorted(self.vocabulary.words, key=lambda w: (frequencies.get(w, 0), w))
        rank_of = {w: r for r, w in enumerate(order)}
        self.rank = np.array([rank_of[w] for w in self.vocabulary.words])
        words = telling_words(templates)
        self.templates = [_Template(label, body, words[label], rank_of, threshold) for label, body in sorted(templates.items())]
        self.wanted = np.zeros((len(self.templates), len(order)), bool)
        for t, template in enumerate(self.templates):
            self.wanted[t, template.prefix] = True
        self.any_wanted = self.wanted.any(0)
        self.phrases = []
        for body, label in PHRASES.items():
            tokens = body.split()
            key = min(range(len(tokens)), key=lambda i: rank_of[tokens[i]])
            self.phrases.append((rank_of[tokens[key]], key, len(tokens), body, label))

    def scan(self, words: Words) -> list[dict]:
        at, number = self.vocabulary.find(words.hash)
        ranks = self.rank[number]
        of = words.of
        doc = np.searchsorted(of, at, side="right") - 1
        out = [{"n_words": int(n), "n_base": 0, "first": None, "last": None, "base": set(), "labels": set(), "met": set(), "score": 0.0} for n in np.diff(of)]
        for key, shift, length, body, label in self.phrases:
            for i, d in zip((at[ranks == key] - shift).tolist(), doc[ranks == key].tolist(), strict=True):
                if i >= of[d] and i + length <= of[d + 1] and words.text(i, i + length) == body:
                    x, place = out[d], int(i - of[d])
                    x["n_base"] += 1
                    x["first"] = place if x["first"] is None else min(x["first"], place)
                    x["last"] = place if x["last"] is None else max(x["last"], place)
                    x["base"].add(label)
                    x["score"] = 1.0
        hits = np.flatnonzero(self.any_wanted[ranks])
        edges = np.searchsorted(doc, np.arange(len(out) + 1))
        for d in np.unique(doc[hits]).tolist():
            here, spots = ranks[edges[d] : edges[d + 1]], at[edges[d] : edges[d + 1]]
            # a text with fewer template words than the smallest need, or none of a template's rare ones, has nothing to verify
            present = np.zeros(len(self.any_wanted), bool)
            present[here] = True
            for t in np.flatnonzero((self.wanted & present).any(1)).tolist():
                template = self.templates[t]
                if int((present & (template.position >= 0)).sum()) < template.need:
                    continue
                position = template.position[here]
                mine = position >= 0
                best, told = template.best(spots[mine], position[mine])
                if best:
                    out[d]["met"].add(template.label)
                if best := told if self.telling else best:
                    out[d]["labels"].add(template.label)
                    out[d]["score"] = max(out[d]["score"], best / template.size)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text", telling: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, met_labels.

    ``met_labels`` has those of all templates that meet the threshold, whether their telling words are
    there or not; with ``telling=False`` they are labels too.  ``score`` is 1 with a base phrase, else the largest containment of a template found, else 0.
    Templates of any length are held against all runs of words.  Null and empty texts have no words and
    empty labels; repeated rows are looked at one by one; an empty table gives an empty result; other
    columns aren't read, so their names can't clash.
    """
    if not 0 < threshold <= 1 or not all(t.split() for t in templates.values()):
        raise ValueError("threshold must be over 0 and at most 1, and templates need words")
    scanner = Scanner(word_frequencies(docs, templates, text), templates, threshold, telling)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("met_labels", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _parts(batch):
                found = scanner.scan(words)
                yield batch_of(schema, doc_id=batch.column(0).slice(a, b - a), n_words=[x["n_words"] for x in found], n_base=[x["n_base"] for x in found], first_word=[x["first"] for x in found], last_word=[x["last"] for x in found], base_labels=[",".join(sorted(x["base"])) for x in found], labels=[",".join(sorted(x["base"] | x["labels"])) for x in found], score=[x["score"] for x in found], met_labels=[",".join(sorted(x["met"])) for x in found])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, met_labels string")
