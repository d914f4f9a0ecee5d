r"""Operator 10: license scans by an exact set-similarity join of text blocks with license templates.

Words are runs of digits, a-z and everything above \x7F after lower-casing A-Z. A block is any window of a text's words,
over line ends, that is as long as a template and a fourth of it more (one word more at least), so wrapped notices are
found and words scattered over a paragraph are not. A block matches a template when it contains at least THRESHOLD of the
template's distinct words (containment). The join:

1. count on how many lines each template word stands, over the whole corpus, and order words by that, rarest first;
2. prefix filter: of a template with t words that must share o = ceil(THRESHOLD * t), one of the t - o + 1 rarest
   stands in every matching block; only those are indexed;
3. length filter: a text with fewer than o template words has no matching block;
4. positional filter: from the positions of a shared prefix word in text and template, at most
   1 + min(words behind it in either) words can be shared, plus those already met before it;
5. verification: a window is slid over the template's words in the text, counting the distinct ones.

`blocks` has every match; of overlapping windows the fullest. Each adds its label, unless all its shared words are
shared by a better match over the same words (GPL-3's notice has 9 of AGPL-3's 10). The base labels are exact phrases,
searched in the whole text with all places counted. The templates, notices and grants of the licences, are a parameter
of fixed size; so is everything that is broadcast (their words and counts). The corpus is read twice and never
shuffled, apart from one row for each template word and task.

Cases: null text is empty; a document without words gets zeros and empty labels; repeated rows are scanned each; ties
in frequency are broken by the word, two templates of one label add it once; very long texts are scanned whole, in time
proportional to their length; an empty table gives no rows; columns besides text and `keep` are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import chunks, release, schema_of, table, texts_of

THRESHOLD = 0.9
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices and the opening grants of licence texts, as their authors publish them.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0",
    "apache-2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-2": "licensed under the gnu general public license version 2",
    "lgpl": "licensed under the gnu lesser general public license",
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl-2-notice": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}
#: Templates that word the same licence.
SAME_LABEL = {"mit-grant": "mit", "mit-notice": "mit", "apache-2-header": "apache-2", "bsd-grant": "bsd", "mpl-2-notice": "mpl-2"}

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c == 10 else 32
    for c in range(256)
)  # \n stays, so that blocks can be told apart


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    needed: int
    span: int  # the words of a block

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def build(templates: dict[str, str], counts: dict[bytes, int], threshold: float) -> tuple[list[Template], dict[bytes, int]]:
    """Templates in the global order of words, and each word's place in that order."""
    vocabulary = sorted({w for t in templates.values() for w in t.encode().split()}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    out = []
    for name, text in templates.items():
        n, words = len(text.split()), tuple(sorted(set(text.encode().split()), key=rank.__getitem__))
        out.append(Template(SAME_LABEL.get(name, name), words, max(1, math.ceil(threshold * len(words) - 1e-9)), n + max(1, n // 4)))
    return out, rank


class Matcher:
    """The join's index of templates; `match` gives (template, shared words) of every template that a block meets."""

    def __init__(self, templates: list[Template], rank: dict[bytes, int]):
        self.rank, self.templates = rank, templates
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for t, template in enumerate(templates):
            for place, w in enumerate(template.prefix):
                self.index.setdefault(w, []).append((t, place))
        self.sets = [frozenset(t.words) for t in templates]
        self.least = min((t.needed for t in templates), default=1)

    def match(self, words: Iterable[bytes]) -> list[int]:
        """The templates that a block of these words may meet: all those that the words as a whole meet."""
        known = sorted({w for w in words if w in self.rank}, key=self.rank.__getitem__)
        if len(known) < self.least:  # length filter
            return []
        tried, found, met = set(), [], frozenset(known)
        for at, w in enumerate(known):
            for t, place in self.index.get(w, ()):
                template = self.templates[t]
                if t in tried or len(known) < template.needed:
                    continue
                # no earlier shared prefix word, or t would have been tried: what is shared starts here
                if 1 + min(len(known) - at - 1, len(template.words) - place - 1) < template.needed:
                    continue
                tried.add(t)
                if len(met & self.sets[t]) >= template.needed:
                    found.append(t)
        return found

    def windows(self, words: list[bytes], t: int) -> list[tuple[int, int, frozenset[bytes]]]:
        """(first word, end, shared words) of the blocks that meet template t; of overlapping ones the fullest."""
        own, needed, span = self.sets[t], self.templates[t].needed, self.templates[t].span
        out: list[tuple[int, int, frozenset[bytes]]] = []
        inside: deque[int] = deque()  # places of the template's words in the block
        n: Counter[bytes] = Counter()
        for at, w in enumerate(words):
            if w not in own:
                continue
            inside.append(at)
            n[w] += 1
            while inside[0] <= at - span or n[words[inside[0]]] > 1:  # too far, or met again later
                n[words[inside[0]]] -= 1
                inside.popleft()
            if len(inside) < needed or len(shared := frozenset(words[i] for i in inside)) < needed:
                continue
            if not out or inside[0] >= out[-1][1]:
                out.append((inside[0], at + 1, shared))
            elif len(shared) > len(out[-1][2]):
                out[-1] = (inside[0], at + 1, shared)
        return out


@dataclass(frozen=True)
class Match:
    start: int  # its words in the text: [start, end)
    end: int
    line: int
    last_line: int
    template: int
    shared: frozenset[bytes]
    label: str
    containment: float


def matches(text: bytes, matcher: Matcher) -> list[Match]:
    """Every block of a translated text that meets a template, in order."""
    lines = [x.split() for x in text.split(b"\n")]
    words = [w for x in lines for w in x]
    if matcher.index.keys().isdisjoint(words):
        return []
    starts, found = [0], []
    for x in lines:
        starts.append(starts[-1] + len(x))
    for t in matcher.match(words):
        template = matcher.templates[t]
        for a, b, shared in matcher.windows(words, t):
            lines_at = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            found.append(Match(a, b, *lines_at, t, shared, template.label, len(shared) / len(template.words)))
    return sorted(found, key=lambda m: (m.start, m.end, m.template))


def labels_of(found: list[Match]) -> set[str]:
    """The labels of all matches but those whose shared words a better match over some of the same words shares too."""
    rows = sorted(found, key=lambda m: m.start)
    gone: set[int] = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b.start >= a.end:
                break
            if a.containment < b.containment and a.shared <= b.shared:
                gone.add(i)
            elif b.containment < a.containment and b.shared <= a.shared:
                gone.add(j)
    return {m.label for i, m in enumerate(rows) if i not in gone}


def word_counts(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """On how many lines of the whole corpus each template word stands: one row for each word at the driver."""
    vocabulary = frozenset(w for t in templates.values() for w in t.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in texts_of(b.column("text")):
                for block in text.translate(_WORDS).split(b"\n"):
                    for w in vocabulary.intersection(block.split()):
                        n[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in n], "n": list(n.values())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in rows.collect()}


def phrase_places(text: bytes, phrases: dict[bytes, str]) -> tuple[int, list[tuple[int, str]]]:
    """(words, [(start word, label)]) of a text already translated."""
    words = text.split()
    line, found = b" " + b" ".join(words) + b" ", []
    for p, label in phrases.items():
        at, before, n = line.find(p), 0, 0
        while at >= 0:
            n += line.count(b" ", before, at)
            found.append((n, label))
            before, at = at, line.find(p, at + 1)
    return len(words), found


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
SCHEMA = """n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
    blocks array<struct<line: int, last_line: int, label: string, containment: double>>"""


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns with the phrases' places, labels, best containment and the matching blocks (lines from 0)."""
    matcher = Matcher(*build(templates, word_counts(docs, templates), threshold))
    needles = {b" " + p.encode() + b" ": label for p, label in phrases.items()}
    block = pa.list_(pa.struct([("line", pa.int32()), ("last_line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "_text"):
                cols: list[list] = [[] for _ in types]
                for text in texts_of(b.column("_text")):
                    text = text.translate(_WORDS)
                    n, places = phrase_places(text, needles)
                    found = matches(text, matcher)
                    blocks = [{"line": m.line, "last_line": m.last_line, "label": m.label, "containment": m.containment} for m in found]
                    base = sorted({label for _, label in places})
                    every = sorted({*base, *labels_of(found)})
                    at = [p for p, _ in places]
                    score = 1.0 if base else max((m.containment for m in found), default=0.0)
                    for c, v in zip(cols, (n, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, blocks), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*keep, *COLUMNS])
        release()

    schema = schema_of(docs, keep, SCHEMA)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("blocks")
