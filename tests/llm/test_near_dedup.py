import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from batchwatch.llm import hyperminhash as H
from batchwatch.llm.words import shingle_set

from .frames import PROSE, awkward, documents


def brute_force(rows, width, percent):
    """component id by doc id, from all pairs."""
    sets = {d: set(shingle_set(t, width).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for group in range(25):
        base = rng.choices(words, k=rng.choice([3, 6, 12, 40, 150]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((k, " ".join(text)))
            base = text if rng.random() < 0.5 else base  # chains, whose ends are not similar
            k += 1
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_all_pairs(spark, width):
    rows = corpus()
    got = {r.doc_id: r.component_id for r in H.near_duplicates(documents(spark, rows), width=width).collect()}
    assert got == brute_force(rows, width, 80)


def test_awkward_rows(spark):
    found = H.near_duplicates(documents(spark, awkward())).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(awkward())
    assert by_id[1].component_id == by_id[2].component_id == by_id[None].component_id == 1
    assert [by_id[d].n_shingles for d in (3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1]
    assert all(by_id[d].component_id == d for d in (3, 4, 5, 6, 7, 10, 11))
    assert by_id[9].component_id == 8
    kept = H.one_of_each(documents(spark, awkward()), width=4)
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 10, 11]


def test_kept_row_may_be_repeated(spark):
    kept = H.one_of_each(documents(spark, [(1, PROSE), (1, PROSE), (2, PROSE), (3, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_a_column_called_like_the_key_stays(spark):
    rows = documents(spark, awkward()).withColumn("_key", F.lit("mine"))
    kept = H.one_of_each(rows, width=4)
    assert kept.columns == rows.columns and {r._key for r in kept.collect()} == {"mine"}


def test_empty_table(spark):
    assert H.near_duplicates(documents(spark, [])).count() == 0
    assert H.one_of_each(documents(spark, [])).count() == 0


def test_estimates_follow_the_true_similarity():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        errors = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
            common = int(len(pool) * share)
            half = (len(pool) - common) // 2
            a, b = np.sort(pool[:common + half]), np.sort(np.concatenate([pool[:common], pool[common + half:]]))
            errors.append(H.estimate(H.sketch(a), H.sketch(b), len(a), len(b)) - common / len(pool))
        assert abs(np.mean(errors)) < 0.03


def test_chance_collisions_are_those_of_unrelated_sets():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        agree.append((H.sketch(a) == H.sketch(b)).mean())
    assert np.mean(agree) == pytest.approx(H._collisions(48, 48), abs=2e-4)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in H.components(links).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and got[101] == 100
