from __future__ import annotations

import random
from collections import defaultdict

import pytest

from ebbline.llm.components import connected_components
from ebbline.llm.ngram_join import ngram_join


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(pairs):
    """Component of every id, by all pairs."""
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t)) for i, t in pairs]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}


def corpus(seed):
    """Families of near copies at all distances, copies, shared passages and lone texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + (f" {passage}" if rng.random() < 0.3 else ""))
    texts += [rng.choice(texts) for _ in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_those_of_all_pairs(spark, documents, seed):
    pairs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(documents(pairs)).collect()}
    wanted = brute(pairs)
    assert got == {i: (len(sets_of(t)), wanted[i]) for i, t in pairs}


def test_edges_of_the_input(spark, documents, empty):
    long_ = " ".join(f"t{k}" for k in range(20_000))
    pairs = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "two one"), (7, long_), (8, long_ + " end"),
        (9, "a b c d e"), (9, "a b c d e"), (10, "a b c d e"), (None, "a b c d e"),
        # one id with two texts joins the copies of both
        (20, "p q r s t u"), (21, "p q r s t u"), (21, "k l m n o p"), (22, "k l m n o p"), (19, "k l m n o p"),
    ]
    rows = ngram_join(documents(pairs)).collect()
    assert len(rows) == len(pairs)
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)}
    assert got[4] == {(1, 4)} and got[5] == {(1, 4)} and got[6] == {(1, 6)}
    assert got[7] == {(19_996, 7)} and got[8] == {(19_997, 7)}
    assert got[9] == {(1, 9)} and got[10] == {(1, 9)} and got[None] == {(1, None)}
    assert {c for i in (19, 20, 21, 22) for _, c in got[i]} == {19}
    assert ngram_join(empty("doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(1000, k) for k in range(1001, 1030)]
    rows = connected_components(spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "u long, v long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got) and set(got.values()) == {0, 1000}
    assert {n for n, c in got.items() if c == 0} == set(range(41))
