from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import minhash_dedup as module
from ebbline.llm.minhash_dedup import BANDS, ROWS, bands, minhash_dedup, most_ones, odd_sketch, samples


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3)))


def brute(pairs):
    """Component of every id, by all pairs."""
    parent = {i: i for i, _ in pairs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t)) for i, t in pairs if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}


def families(seed, passage_words=30):
    """Near copies at all distances, copies, and many texts around one passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=passage_words))
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [f"{passage} " + " ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("comparisons", [64, 1])
def test_components_equal_those_of_all_pairs(spark, documents, monkeypatch, comparisons):
    """Also where nearly all buckets are split by further bands."""
    monkeypatch.setattr(module, "COMPARISONS", comparisons)
    pairs = families(1) + [(i + 1000, t) for i, t in families(2, 60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup(documents(pairs)).collect()}
    wanted = brute(pairs)
    assert got == {i: (len(sets_of(t)), wanted[i], wanted[i] == i) for i, t in pairs}


def test_edges_of_the_input(spark, documents, empty):
    long_ = " ".join(f"t{k}" for k in range(20_000))
    pairs = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "two one"), (7, long_), (8, long_ + " end"),
        (9, "a b c d"), (9, "a b c d"), (10, "a b c d"), (None, "a b c d"), (None, None),
        # one id with two texts joins the copies of both
        (20, "p q r s t"), (21, "p q r s t"), (21, "k l m n o"), (22, "k l m n o"), (19, "k l m n o"), (20, None),
        (30, "x y z u v"), (30, "q w e r t"), (30, "q w e r t"),
    ]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup(documents(pairs)).collect()}
    component = brute(pairs)
    # a row without shingles is alone, whatever the other rows of its id are
    wanted = {(i, len(sets_of(t)), c, c == i) for i, t in pairs if i is not None for c in [component[i] if sets_of(t) else i]}
    assert got == wanted | {(None, 1, None, None), (None, 0, None, None)}
    assert minhash_dedup(documents(pairs)).count() == len(pairs)
    assert minhash_dedup(empty("doc_id long, text string")).collect() == []


def drawn_pair(rng, size, share):
    """Two sets of about so many tokens with a similarity of ``share`` and more, the second at times smaller."""
    common = rng.integers(0, 2**63, round(size * 2 * share / (1 + share)) + 1).astype(np.uint64)
    own = int(len(common) * (1 - share) / share)
    left = int(rng.integers(0, own + 1))
    return [np.unique(np.concatenate([common, rng.integers(0, 2**63, n).astype(np.uint64)])) for n in (left, own - left)]


@pytest.mark.parametrize("size", [5, 40, 300, 1500, 2500, 30_000])
def test_similar_sets_are_let_through_and_others_mostly_not(spark, size):
    rng, unlike = np.random.default_rng(size), 0.5 if size <= module.SAMPLES else 0.25  # sketches of samples tell less
    rows = []
    for share in (0.8, unlike):
        for k in range(150):
            a, b = drawn_pair(rng, size, share)
            ones = int(np.bitwise_count(odd_sketch(a) ^ odd_sketch(b)).sum())
            if max(len(a), len(b)) <= module.SAMPLES:
                assert ones <= len(np.setxor1d(a, b))
            rows.append((share, ones, *sorted((len(a), len(b)))))
    df = spark.createDataFrame(rows, "share double, ones int, small long, large long")
    df = df.where("small * 5 >= large * 4")  # sizes are compared first
    assert df.where("share = 0.8").count() == 150
    got = {r["share"]: r["n"] for r in df.where(F.col("ones") <= most_ones(F.col("small"), F.col("large"), 4, 5)).groupBy("share").agg(F.count("*").alias("n")).collect()}
    assert got[0.8] == 150 and got.get(unlike, 0) <= 20


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    for share in (0.8, 0.3):
        found, shared = [], 0
        for _ in range(150):
            a, b = (samples(s) for s in drawn_pair(rng, 400, share))
            found.append((a == b).mean())
            shared += (bands(a) == bands(b)).any()
        assert abs(np.mean(found) - share) < 0.02 and (shared == 150 or share < 0.5)
        assert len(a) == BANDS * ROWS
