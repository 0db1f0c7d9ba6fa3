"""Row-wise operators: decontamination, line rules, license scan."""

import random
import re
from collections import Counter

import pytest

from batchwatch.llm import licences as L
from batchwatch.llm import line_rules as R
from batchwatch.llm import qgrams as Q

from .frames import PROSE, awkward, documents

ITEMS = [
    (1, "What is the tallest mountain on the continent of Africa, and in which country would a climber find it?"),
    (2, "Explain in your own words, step by step, how a bill becomes a law; mention both chambers, the committees "
        "that read it first, the votes that follow, and what the head of state may do with it in the end."),
    (3, "too short"), (4, None), (5, ""),
]


def edit_distance_inside(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "z"
        elif kind == 1:
            out.insert(at, "z")
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_segments_within_the_budget_are_found_and_others_are_not():
    rng = random.Random(7)
    bench = Q.Benchmark([(i, t) for i, t in ITEMS if t])
    for _ in range(120):
        s = rng.randrange(len(bench.text))
        inner = edited(bench.text[s].decode(), rng.randrange(14), rng)
        text = f"{PROSE[:rng.randrange(80)]} {inner} {PROSE[:rng.randrange(80)]}"
        found = {m[0]: m[3] for m in bench.matches(text)}
        for k, segment in enumerate(bench.text):
            best = edit_distance_inside(segment.decode(), Q.normalise(text).decode())
            if best <= bench.edits[k]:
                assert found[k] == best
            else:
                assert k not in found


def test_leaks_of_awkward_rows(spark):
    long = " ".join([PROSE] * 800)
    shouted = ITEMS[0][1].upper().replace(" ", "!!  ")
    rows = awkward() + [(20, ITEMS[0][1]), (21, f"{long} {ITEMS[1][1]} {long}"), (22, shouted), (22, shouted),
                        (23, "too short"), (24, ITEMS[0][1] + " " + ITEMS[1][1])]
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in Q.leaks(documents(spark, rows), bench).collect())
    assert got == [(20, 1), (21, 2), (22, 1), (22, 1), (23, 3), (24, 1), (24, 2)]
    kept = Q.uncontaminated(documents(spark, rows), bench)
    assert kept.columns == documents(spark, []).columns and kept.count() == len(rows) - 6
    none = spark.createDataFrame([], "item_id long, text string")
    assert Q.leaks(documents(spark, rows), none).count() == 0
    assert Q.uncontaminated(documents(spark, []), bench).count() == 0


def test_sentences_of_other_scripts_are_kept():
    for sentence in ("今天 天气 很好 我们 去 公园 散步 吧 明天 见。", "यह एक अच्छा वाक्य है और इसमें बहुत सारे शब्द हैं।",
                     "هل هذا سؤال جيد أم أنه سؤال لا يفيد أحدا اليوم؟", "Dit is een zin met meer dan tien woorden »zoals hier«"):
        judged = dict(zip(R._COLUMNS, R.judge(sentence)))
        assert judged["n_punctuation"] == judged["n_navigation"] == 0 and judged["kept"] == (judged["n_words"] >= 10)


def test_short_items_and_items_without_id(spark):
    items = [(1, "too short"), (2, "为什么天是蓝的"), (3, "42"), (None, ITEMS[0][1]), (None, "été"), (5, ITEMS[1][1]), (6, "?!")]
    rows = [(1, "this is Too  SHORT, indeed"), (2, "not too shorter, nor stoo short"), (3, "请问为什么天是蓝的呢"), (4, "in 1942"),
            (5, f"{ITEMS[1][1]} and {ITEMS[0][1]}"), (6, "l'été 42"), (7, "étés"), (8, "42"), (9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in Q.leaks(documents(spark, rows), bench).collect()), key=str)
    assert got == sorted([(1, 1), (3, 2), (5, None), (5, 5), (6, None), (6, 3), (8, 3)], key=str)
    kept = sorted(r.doc_id for r in Q.uncontaminated(documents(spark, rows), bench).collect())
    assert kept == [2, 4, 7, 9, 10]


def test_every_planted_item_of_the_tables_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: Q.normalise(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items()
            if len(t) >= Q.LEAST_ITEM and t in Q.normalise(r.text)}
    assert want and want == {(r.doc_id, r.item_id) for r in Q.leaks(docs, bench).collect()}


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_base_counts_equal_plain_counts(spark):
    texts = [t for _, t in awkward()] + ["a b c d e f a b c d e", "a a a a a a", "x # y | z <\n\nx\nx \nx", "  \x1c \x85 a"]
    got = R.clean_lines(documents(spark, [(k, t) for k, t in enumerate(texts)]).select("doc_id", "text")).collect()
    assert len(got) == len(texts)
    for r in got:
        x = r.rules
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)


@pytest.mark.parametrize("line,rule", [
    ("Home", "navigation"), ("Home | About | Contact us.", "navigation"), ("A line that just stops", "punctuation"),
    ("*** $$$ %%% now.", "punctuation"), ("Accept Cookies to go on reading.", "boilerplate"), ("A good line of text.", None),
    ("Yes.", None),
])
def test_line_rules(line, rule):
    assert R.line_verdict(line, len(line.split())) == rule


def test_documents_that_lose_too_much_are_rejected():
    good = "Here is a line with quite a few good words in it."
    assert R.judge(good + "\nmenu")[R._COLUMNS.index("kept")]
    assert R.judge(good + "\nmenu")[-1] == good
    assert not R.judge(good + "\n" + good[:-1].replace("e", "a"))[R._COLUMNS.index("kept")]


def plain_places(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [(k, label) for phrase, label in L.PHRASES.items() for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_license_scan(spark):
    texts = [t for _, t in awkward()] + [
        "Released under the MIT License.", "under the MIT license under the mit license", "CC-BY-NC, cc by nc",
        "Licensed under the Apache License, Version 2.0 (x)", PROSE + " This work is licensed under the GNU General "
        "Public License, version 3. " + PROSE, "gnu license general public version", "Ü under thé mit license"]
    docs = documents(spark, [(k, t) for k, t in enumerate(texts)])
    for r in L.scan_licences(docs.select("doc_id", "text")).collect():
        x, (n, places) = r.licence, plain_places(texts[r.doc_id])
        assert (x.n_words, x.n_base) == (n, len(places))
        assert (x.first_word, x.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert x.base_labels == ",".join(sorted({p[1] for p in places})) and 0 <= x.score <= 1
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
    assert L.scan_licences(documents(spark, []).select("doc_id", "text")).count() == 0


def test_positional_index_labels_notices_and_not_loose_words():
    index = L.Index({"the": 900, "of": 800, "is": 700}, 1000)
    notice = PROSE + " this work is licensed under the gnu general public license version 3 " + PROSE
    assert index.scan(notice)[5] == "gpl-3"
    assert index.scan(" ".join(reversed(notice.split())))[5] == ""
    damaged = notice.replace("this work is", "this thing is")
    assert index.scan(damaged)[5] == "gpl-3" and index.scan(damaged)[6] < 1
    assert index.scan(notice.replace("general public", "general private"))[5] == ""


NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the Software), to deal in the Software without restriction.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


@pytest.mark.parametrize("label", NOTICES)
def test_a_notice_of_many_documents_is_found_in_each(spark, label):
    notice = f"{PROSE} {NOTICES[label]} {PROSE}"
    start = len(L.words(PROSE))
    one = L.scan_licences(documents(spark, [(1, notice)]).select("doc_id", "text")).first().licence
    assert (one.labels, one.template, one.score, one.start_word) == (label, label, 1.0, start)
    docs = documents(spark, [(k, notice if k % 3 == 0 else f"{PROSE} {k}") for k in range(60)])
    for r in L.scan_licences(docs.select("doc_id", "text")).collect():
        want = (label, 1.0, start) if r.doc_id % 3 == 0 else ("", 0.0, None)
        assert (r.licence.labels, r.licence.score, r.licence.start_word) == want


def test_index_finds_what_a_comparison_at_every_word_finds():
    rng = random.Random(3)
    vocabulary = sorted({w for _, _, body in L.TEMPLATES for w in body.split()})
    found = Counter()
    for turn in range(400):
        index = L.Index({w: rng.randrange(101) for w in vocabulary}, 100)
        body = rng.choice(L.TEMPLATES)[2].split()
        for _ in range(rng.randrange(len(body) // 4 + 1)):
            body[rng.randrange(len(body))] = rng.choice([*vocabulary, "zebra"])
        body = body[rng.choice([0, 0, 0, 1]):len(body) - rng.choice([0, 0, 0, 1])]
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(9)) + body + rng.choices(vocabulary, k=rng.randrange(9)))
        words = L.words(text)
        want: dict[str, float] = {}
        for label, key, template in index.templates:
            for start in range(-len(template), len(words)):
                share = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template)) / len(template)
                near = words[max(0, max(0, start) - 2):start + len(template) + 2]
                if share >= L.COVERAGE and any(near[k:k + len(key)] == key for k in range(len(near))):
                    want[label] = max(want.get(label, 0.0), share)
        labels, top = index.best(words, set(words))
        assert labels == want and top[0] == max(want.values(), default=0.0)
        found.update(want)
    assert len(found) > 6
