import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchwatch.llm import byte_cnn as B

from .frames import PROSE, awkward, documents

SF = "/root/testdata/sf0.01"


def plain_scores(net, text):
    """One text, window by window."""
    data = text.encode() if text else b""
    span = B.CHUNK * B.STRIDE
    chunks = -(-len(data) // span)
    data += bytes(chunks * span - len(data) + B.WIDTH)
    hidden = []
    for c in range(chunks):
        windows = [c * span + k * B.STRIDE for k in range(B.CHUNK)]
        hidden.append(np.max([[sum(net.filters[j, data[at + j], f] for j in range(B.WIDTH)) for f in range(4)]
                              for at in windows], axis=0))
    return np.array(hidden)


def test_pooled_values_equal_a_plain_loop():
    net = B.ByteNet(3)
    text = PROSE * 3
    data, starts, _, _ = B.chunked([text.encode()])
    np.testing.assert_allclose(net.pooled(data, starts)[:, :4], plain_scores(net, text), rtol=1e-4, atol=1e-4)


def test_gradients_equal_differences():
    net = B.ByteNet(5)
    net.bias += 0.1
    texts, truth, weight = [b"abc def", (PROSE + PROSE[::-1]).encode()], np.array([1, 0], np.float32), np.array([0.5, 0.5])

    def loss():
        scores = net.scores([t.decode() for t in texts])
        return -np.sum(weight * (truth * np.log(scores) + (1 - truth) * np.log(1 - scores)))

    filters, bias, last, offset = net.step(texts, truth, weight)
    for weights, gradient, at in ((net.bias, bias, 3), (net.last, last, 1), (net.last, last, -1), (net.offset, offset, 0),
                                  (net.filters, filters, np.unravel_index(np.abs(filters).argmax(), filters.shape))):
        before = weights[at]
        weights[at] = before + 1e-3
        up = loss()
        weights[at] = before - 1e-3
        down = loss()
        weights[at] = before
        assert gradient[at] == pytest.approx((up - down) / 2e-3, rel=0.1, abs=2e-3)


def test_a_text_scores_the_same_alone_and_in_any_batch():
    net = B.ByteNet(4)
    net.bias += 0.05
    texts = [PROSE[k:k + n] for k, n in ((0, 250), (3, 253), (5, 256), (9, 7), (1, 900), (0, 0), (2, 1))] + [PROSE * 9, None]
    texts += texts[:3]
    alone = [net.scores([t])[0] for t in texts]
    assert net.scores(texts).tolist() == alone
    assert net.scores(texts[::-1]).tolist() == alone[::-1]
    assert net.scores([texts[0], "\xff" * 50, texts[1]])[[0, 2]].tolist() == alone[:2]


def test_whole_texts_count():
    net = B.ByteNet(2)
    long = PROSE * 200
    assert net.scores([long])[0] != net.scores([long + " #### " * 50])[0]


def test_awkward_texts_and_missing_labels(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    net = B.fit(docs.select("doc_id", "text"), B.training_labels(labels))
    got = B.with_score(docs.select("doc_id", "text"), net).collect()
    assert len(got) == len(awkward()) and all(r.score == pytest.approx(0.5) for r in got)
    assert B.good_quality(documents(spark, []), labels).count() == 0
    one = spark.createDataFrame([(k, 1) for k in (1, 2, 4, 8)], "doc_id long, quality int")
    kept = B.good_quality(docs, one)
    assert kept.columns == docs.columns and kept.count() == len(awkward())


def test_labels_that_disagree_and_held_out_rows_are_not_learned_from(spark):
    rows = [(k, 1) for k in range(40)] + [(1, 0), (2, None), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int").withColumn("label", F.lit("clash"))
    got = {r.doc_id for r in B.training_labels(labels).collect()}
    assert got - {None} == {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 != 0 and k != 1}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = B.fit(docs, B.training_labels(labels))
    found = B.with_score(docs.join(labels, "doc_id"), net).toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 5 == 0 for d in found["doc_id"]]]
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.9
    assert (good >= B.THRESHOLD).mean() > 0.9
