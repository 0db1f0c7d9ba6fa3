import zlib

import numpy as np

from batchwatch.llm import cross_parsing as C

from .frames import PROSE, awkward, documents

GERMAN = ("der alte mann ging langsam durch den dunklen wald und dachte an die vergangenen jahre die er mit seiner "
          "familie in dem kleinen haus am fluss verbracht hatte")


def longest(text, at, training):
    n = 0
    while at + n < len(text) and text[at:at + n + 1] in training:
        n += 1
    return n


def phrases_by_search(text, training):
    """Greedy cross parsing by plain substring search."""
    count = at = 0
    while at < len(text):
        count += 1
        at += max(1, longest(text, at, training))
    return count


def coded(text):
    return "".join(chr(c) for c in C.symbols(text, C._letters()))


def test_phrases_equal_plain_search():
    model = C.Model({"en": [PROSE], "de": [GERMAN]})
    texts = ["watching old owls run so quietly", "der fuchs im wald", "zzz", "x", PROSE, "éé the", "a-b -- c"]
    counts, sizes = model.phrases(texts)
    for text, row, size in zip(texts, counts, sizes):
        assert size == len(coded(text))
        assert row.tolist() == [phrases_by_search(coded(text), coded(t)) for t in (GERMAN, PROSE)]


def test_long_texts_are_parsed_in_segments():
    model = C.Model({"en": [PROSE]})
    text = coded((PROSE + " ") * 40)
    parts = [text[k:k + C.SEGMENT] for k in range(0, len(text), C.SEGMENT)]
    counts, _ = model.phrases([text.replace("\x00", " ")])
    assert counts[0, 0] == sum(phrases_by_search(p, coded(PROSE)) for p in parts)


def test_every_sampled_text_has_a_share_and_large_alphabets_stay_small():
    rng = np.random.default_rng(3)
    long = [GERMAN * 400] + [f"wort{chr(97 + k)}{chr(97 + k)} haus" for k in range(26)]
    model = C.Model({"de": long})
    counts, _ = model.phrases(["wortzz", "wortqq"])
    assert counts[:, 0].tolist() == [1, 1]
    texts = {lang: ["".join(map(chr, rng.choice(np.arange(first, first + 3000), 200))) for _ in range(100)]
             for lang, first in (("x", 0x4E00), ("y", 0x6000))}
    model = C.Model(texts)
    edges = sum(1 for k in model.edges.keys if k >= 0)
    assert len(model.edges.keys) <= 8 * edges and model.width > 5000
    probe = [t[50:90] for t in texts["x"][:5]] + [t[50:90] for t in texts["y"][:5]]
    assert model.predict(probe)["language"].tolist() == ["x"] * 5 + ["y"] * 5
    counts, _ = model.phrases(probe)
    for text, row in zip(probe, counts):
        for k, lang in enumerate("xy"):
            training = coded(" ".join(C.share_of_text(t, 300, 0) for t in texts[lang]))
            assert row[k] == phrases_by_search(coded(text), training)


def test_awkward_texts(spark):
    docs = documents(spark, awkward() + [(12, GERMAN), (13, "Wald und Haus")])
    model = C.Model({"en": [PROSE], "de": [GERMAN]})
    got = {r.doc_id: r.language for r in C.with_language(docs.select("doc_id", "text"), model).collect()}
    assert [got[k].language for k in (3, 4, 5, 11)] == ["und"] * 4 and got[3].score == 0
    assert got[1].language == "en" and got[12].language == got[13].language == "de"
    assert all(0 <= g.score <= 1 for g in got.values())


def test_no_labels_and_empty_tables(spark):
    empty = documents(spark, [])
    assert C.known_language(empty).count() == 0
    docs = documents(spark, awkward())
    model = C.fit(docs.select("doc_id", "text"), docs.selectExpr("doc_id", "cast(NULL AS string) AS label"))
    assert {r.language.language for r in C.with_language(docs.select("doc_id", "text"), model).collect()} == {"und"}


def test_stage_keeps_texts_of_known_languages(spark):
    rows = [(k, PROSE[k:] + " " + PROSE[:k]) for k in range(20)] + [(30, None), (31, "42"), (32, "жжэюя фывапр цукен")]
    kept = C.known_language(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_learning_leaves_the_held_out_fold_alone(spark):
    docs = documents(spark, [(k, PROSE) for k in range(30)])
    learned = {r.doc_id for r in C.training_labels(docs).collect()}
    assert learned == {k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = C.fit(docs.select("doc_id", "text"), C.training_labels(docs))
    found = C.with_language(docs.select("doc_id", "text", "lang"), model).toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 3 == 1 for d in found["doc_id"]]]
    assert np.mean([a["language"] == b for a, b in zip(held["language"], held["lang"])]) > 0.97
