"""License scans by a positional rare-token index.

The index holds, for the two highest-IDF words of each template's mandatory key phrases, their postings (template, phrase, position). A
template stands at no place without both, so a file's own licence words are looked up, and each occurrence with its phrase around it
tells places where the template may begin, up to SLACK words off (also before the text, where its first words are cut off); the places that both words tell (the postings met by relative
position) are left. There all key phrases are verified, and the share of the template's words that stand in their places is its score.
Base phrases are templates that must match whole and
everywhere: their rarest word is looked up alike, so no place is missed. The IDF of a licence word is taken over all documents.

Defined results: null text is an empty text (no words, score 0); other columns play no part; repeated rows and null ids
stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# Phrases and labels of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license notices and whole texts of short licenses, each with the phrases that must stand in it.
TEMPLATES = {
    "gpl-3.0": [("licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]), ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"])],
    "gpl-2.0": [("licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]), ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"])],
    "lgpl": [("licensed under the gnu lesser general public license", ["gnu lesser general public license"])],
    "agpl": [("licensed under the gnu affero general public license", ["gnu affero general public license"])],
    "apache-2.0": [("licensed under the apache license version 2 0", ["apache license", "version 2 0"]), ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license", "in compliance with the license"])],
    "mit": [("released under the mit license", ["mit license"]), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "without restriction"]), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["substantial portions", "dealings in the software"])],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "conditions are met"]), ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", ["copyright holders and contributors", "procurement of substitute goods"])],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ["for any purpose with or without fee", "tortious action"])],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"]), ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"])],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"]), ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"]), ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"])],
    "cc0": [("this work is dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"])],
    "cc-by-nd-4.0": [("licensed under cc by nd 4 0", ["cc by nd 4 0"]), ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"])],
    "bsd-3-clause": [("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["nor the names of its contributors", "specific prior written permission"])],
    "mit-notice": [("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included", "substantial portions"])],
    "zlib": [("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "authors be held liable"])],
    "bsl-1.0": [("distributed under the boost software license version 1 0", ["boost software license"]), ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["machine executable object code", "title and non infringement"])],
    "epl-2.0": [("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"])],
    "ofl-1.1": [("this font software is licensed under the sil open font license version 1 1", ["open font license"])],
    "artistic-2.0": [("licensed under the artistic license 2 0", ["artistic license 2 0"])],
    "postgresql": [("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["without a written agreement is hereby granted"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["unencumbered software"]), ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["unencumbered software", "relinquishment in perpetuity"])],
}

#: Words of each template whose postings must meet.
RARE_WORDS = 2
#: Words that a key phrase may be off, and share of a template's words that must be in place.
SLACK, SHARE = 2, 0.6

# Word characters are [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z; bytes from 0x80 on are parts of such characters.
_FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:long,share:double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Index:
    """The templates and the base phrases, by the rarest word that each must hold."""

    def __init__(self, base: dict[str, str], templates: dict[str, list]):
        self.templates = [(label, tuple(text.encode().split()), [_placed(text, key) for key in keys]) for label, texts in templates.items() for text, keys in texts]
        self.base = [(label, tuple(phrase.encode().split())) for phrase, label in base.items()]
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words) | {w for _, phrase in self.base for w in phrase}

    def weigh(self, idf: dict[bytes, float]) -> None:
        self.idf = idf
        self.anchors = {}  # rarest word of a base phrase: (phrase, its place in it)
        for b, (_, phrase) in enumerate(self.base):
            q = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
            self.anchors.setdefault(phrase[q], []).append((b, q))
        self.postings: dict[bytes, list[tuple[int, int, int]]] = {}  # rarest words of a template's key phrases: (template, phrase, place in it)
        self.needed: list[tuple[bytes, ...]] = []  # by template: those words
        for t, (_, _, keys) in enumerate(self.templates):
            ranked = sorted(((k, q) for k, (_, key) in enumerate(keys) for q in range(len(key))), key=lambda x: (-idf[keys[x[0]][1][x[1]]], x[0], x[1]))
            chosen: dict[bytes, tuple[int, int]] = {}
            for k, q in ranked:
                if len(chosen) < RARE_WORDS:
                    chosen.setdefault(keys[k][1][q], (k, q))
            self.needed.append(tuple(chosen))
            for w, (k, q) in chosen.items():
                self.postings.setdefault(w, []).append((t, k, q))
        self.rare = frozenset(self.anchors) | frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str], list[tuple[str, int, float]]]:
        """Places of base phrases, their labels, and (label, word, share) of the templates found."""
        look = self.rare.intersection(words)
        if not look:
            return [], [], []
        places, labels = [], set()
        starts: dict[tuple[int, bytes], set[int]] = {}
        for p, w in enumerate(words):
            if w in look:
                for b, q in self.anchors.get(w, ()):
                    label, phrase = self.base[b]
                    if p >= q and tuple(words[p - q : p - q + len(phrase)]) == phrase:
                        places.append(p - q)
                        labels.add(label)
                for t, k, q in self.postings.get(w, ()):
                    offset, key = self.templates[t][2][k]
                    if p >= q and tuple(words[p - q : p - q + len(key)]) == key:
                        starts.setdefault((t, w), set()).update(p - q - offset - d for d in range(-SLACK, SLACK + 1))
        met = {t: set.intersection(*(starts.get((t, w), set()) for w in self.needed[t])) for t, _ in starts}
        candidates = [(t, at) for t, found in met.items() for at in found]
        best: dict[str, tuple[float, int]] = {}
        for t, at in candidates:
            label, template, keys = self.templates[t]
            if all(any(at + q + d >= 0 and tuple(words[at + q + d : at + q + d + len(key)]) == key for d in range(-SLACK, SLACK + 1)) for q, key in keys):
                before = max(0, -at)  # words of the template that would stand before the text
                share = sum(a == b for a, b in zip(words[at + before : at + len(template)], template[before:], strict=False)) / len(template)
                if share >= SHARE:
                    best[label] = max(best.get(label, (0.0, 0)), (share, -at))
        return places, sorted(labels), [(label, max(0, -at), share) for label, (share, at) in sorted(best.items())]


def _placed(text: str, key: str) -> tuple[int, tuple[bytes, ...]]:
    words, phrase = text.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), tuple(key.encode().split())


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Over all documents: their number, and in how many each word of the vocabulary stands. A row for each such word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in text_bytes(batch):
                seen.update(vocabulary.intersection(words_of(text)))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word.encode(): r.n for r in counts.collect()}
    return found.pop(b"", 0), found


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list] = TEMPLATES) -> DataFrame:
    """documents (doc_id, text) to RESULT. matches: the templates found, each at its best place."""
    index = Index(base, templates)
    n, seen = document_frequencies(docs, index.vocabulary)
    index.weigh({w: math.log((1 + n) / (1 + seen.get(w, 0))) for w in index.vocabulary})
    names = [c.split()[0] for c in RESULT.split(", ")]
    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in text_bytes(batch):
                places, base_labels, found = index.scan(words := words_of(text))
                labels = sorted({*base_labels, *(x[0] for x in found)})
                score = 1.0 if base_labels else max((x[2] for x in found), default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(labels), score, [dict(zip(("label", "word", "share"), x, strict=True)) for x in found]))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
