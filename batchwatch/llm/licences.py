"""License scan by a positional index of rare template words.

Of each template the words with the highest IDF are looked up, as many as it may lack and ``AGREEING`` more, so
a notice that covers enough of it agrees on its offset whatever the frequencies are; their places in the file are
intersected by relative position.  A template and offset that enough of these words agree on is compared word by
word, and its mandatory phrase has to stand there.  IDF counts all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import utf8

# Phrases and their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Openings of public license notices and texts; label, mandatory phrase, words
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("mit", "mit license", "released under the mit license"),
    ("apache-2", "apache license version 2",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("gpl-3", "gnu general public license version 3",
     "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike",
     "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial",
     "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "dedicated the work to the public domain",
     "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his "
     "or her rights to the work worldwide under copyright law"),
    ("cc0", "waived all copyright and related",
     "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("agpl", "gnu affero general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
     "public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "free and unencumbered software released into the public domain",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software"),
    ("epl-2", "eclipse public license",
     "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
     "for any damages arising from the use of this software"),
    ("bsl-1", "boost software license version 1 0", "distributed under the boost software license version 1 0"),
    # how the full texts begin
    ("apache-2", "apache license version 2", "apache license version 2 0 january 2004 http www apache org licenses terms and "
     "conditions for use reproduction and distribution"),
    ("gpl-3", "gnu general public license version 3",
     "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc"),
    ("gpl-2", "gnu general public license version 2",
     "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc"),
    ("agpl", "gnu affero general public license version 3",
     "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc"),
    ("lgpl", "gnu lesser general public license version",
     "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license version 2 0 1 definitions 1 1 contributor means each "
     "individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("epl-2", "eclipse public license", "eclipse public license v 2 0 the accompanying program is provided under the terms of "
     "this eclipse public license"),
    ("cc-by", "creative commons attribution 4 0",
     "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: looked-up words that have to agree on an offset
AGREEING = 2
#: share of a template's words that has to stand at its place
COVERAGE = 0.8

#: bytes outside words become blanks, A-Z become a-z
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PHRASES = {re.compile(b"(?= %s )" % p.encode()): label for p, label in PHRASES.items()}
_KIND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "template string, start_word long")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return utf8(text).translate(_WORD_BYTES).split()


class Index:
    """Places of the templates' rarest words, by the words' IDF."""

    def __init__(self, frequency: dict[str, int], documents: int, templates=TEMPLATES):
        self.templates = [(label, key.encode().split(), body.encode().split()) for label, key, body in templates]
        vocabulary = {w for _, _, body in self.templates for w in body}
        self.idf = {w: math.log((documents + 1) / (frequency.get(w.decode(), 0) + 1)) for w in vocabulary}
        self.postings: list[list[tuple[bytes, int]]] = []
        for _, _, body in self.templates:
            lacking = max(n for n in range(len(body)) if (len(body) - n) / len(body) >= COVERAGE)
            rarest = sorted(range(len(body)), key=lambda k: (-self.idf[body[k]], body[k], k))
            self.postings.append([(body[k], k) for k in rarest[:lacking + AGREEING]])

    def best(self, found: list[bytes], present: set[bytes]) -> tuple[dict[str, float], tuple[float, str | None, int | None]]:
        """(coverage by label, best (coverage, template, start))."""
        labels: dict[str, float] = {}
        top: tuple[float, str | None, int | None] = (0.0, None, None)
        # a template whose mandatory phrase has a word the file lacks stands nowhere in it
        possible = [t for t, (_, key, _) in enumerate(self.templates) if present.issuperset(key)]
        place_of: dict[bytes, list[int]] = {w: [] for t in possible for w, _ in self.postings[t]}
        if not place_of:
            return labels, top
        for at, word in enumerate(found):
            if word in place_of:
                place_of[word].append(at)
        for t in possible:
            label, key, body = self.templates[t]
            votes = Counter(at - place for word, place in self.postings[t] for at in place_of[word])
            for start, n in votes.items():
                if n < AGREEING:
                    continue
                covered = sum(a == b for a, b in zip(found[max(0, start):start + len(body)], body[max(0, -start):]))
                share = covered / len(body)
                if share < COVERAGE or not self._holds(found, key, max(0, start), start + len(body)):
                    continue
                labels[label] = max(labels.get(label, 0.0), share)
                top = min(top, (share, label, max(0, start)), key=lambda x: (-x[0], x[2] if x[2] is not None else 0))
        return labels, top

    @staticmethod
    def _holds(found: list[bytes], key: list[bytes], start: int, end: int) -> bool:
        """Whether the phrase stands in found[start:end], two words more on either side allowed."""
        return any(found[k:k + len(key)] == key for k in range(max(0, start - 2), end + 3 - len(key)))

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        line = b" " + b" ".join(found) + b" "
        hits = [(line.count(b" ", 0, m.start()), label) for p, label in _PHRASES.items() for m in p.finditer(line)]
        base = {label for _, label in hits}
        labels, (share, template, start) = self.best(found, set(found))
        return (len(found), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None),
                ",".join(sorted(base)), ",".join(sorted(base | set(labels))), max([share, *([1.0] if hits else [])]),
                template, start)


def _frequencies(docs: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """Documents per template word, and documents; one count per word of the templates' vocabulary."""
    vocabulary = {w.encode() for _, _, body in TEMPLATES for w in body.split()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch["text"]:
                counts[""] += 1
                counts.update(w.decode() for w in vocabulary.intersection(words(body)))
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInPandas(run, "word string, n long")
    found = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan_licences(docs: DataFrame, text: str = "text", name: str = "licence") -> DataFrame:
    """``docs`` with a struct column ``name``.

    n_words, n_base (places of base phrases), first_word and last_word (their least and greatest start, else
    null), base_labels, labels (sorted, comma-joined), score (1 with a base phrase, else the coverage of the
    best template), template and start_word of that template.  Null and empty texts have no words and no
    labels; of templates with equal coverage the first in the text counts.
    """
    frequency, documents = _frequencies(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(Index(frequency, documents))

    @F.pandas_udf(_KIND)
    def run(texts: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame([shared.value.scan(t) for t in texts], columns=[c.split()[0] for c in _KIND.split(", ")])
        return frame.astype({"first_word": "Int64", "last_word": "Int64", "start_word": "Int64"})

    return docs.withColumn(name, run(F.col(text)))
