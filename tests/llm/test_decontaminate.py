from __future__ import annotations

import random
import time

import numpy as np
import pytest

from ebbline.llm import decontaminate
from ebbline.llm.decontaminate import Items, edits, find_benchmark, nearest, word_hashes

ITEM = "item_id long, text string, matches int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if not row else row
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j - 1] + (x != y), previous[j] + 1, row[-1] + 1))
    return row[-1]


def brute(words, item):
    """The least edits between an item and any passage."""
    return min(distance(item, words[i:j]) for i in range(len(words) + 1) for j in range(i, min(len(words), i + 2 * len(item)) + 1))


def changed(rng, words, count):
    words = list(words)
    for _ in range(count):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 2 else [f"z{rng.randrange(10**6)}"]
    return words


def test_nearest_passage_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        words, item = rng.choices(range(6), k=14), rng.choices(range(6), k=5)
        near, start = nearest(np.array(item), np.array(words))
        assert near == brute(words, item)
        assert near == min(distance(item, words[start:j]) for j in range(start, len(words) + 1))


def test_finds_every_planted_passage_and_nothing_else(spark, documents):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(120)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([5, 9, 15, 30, 50]))) for _ in range(30)]
    texts, planted = [], {}
    for i in range(120):
        text = rng.choices(vocabulary, k=rng.choice([0, 10, 80]))
        if i % 2:
            k = rng.randrange(len(items))
            size = len(items[k].split())
            text[len(text) // 2 : len(text) // 2] = changed(rng, items[k].split(), rng.randint(0, max(0, edits(size) - 1)))
            planted[i] = k
        texts.append(" ".join(text))
    table = spark.createDataFrame([(k, t.upper(), 1) for k, t in enumerate(items)], ITEM)
    rows = {r["doc_id"]: {m["item_id"]: m for m in r["matches"]} for r in find_benchmark(documents(texts), table).collect()}
    found = sum(planted[i] in rows[i] for i in planted)
    assert found >= 0.95 * len(planted)
    for i, matches in rows.items():  # the edit distance is exact and within the bound
        words = texts[i].split()
        for k, m in matches.items():
            item = items[k].split()
            assert m["edits"] <= edits(len(item)) and m["edits"] >= brute(words, item)
        exact = {k for k, t in enumerate(items) if f" {t} " in f" {texts[i]} "}
        assert exact <= set(matches)


@pytest.mark.parametrize("size", [6, 15, 60, 150, 400, 1000])
def test_recall_at_the_bound(size):
    """At the most edits allowed, whatever the size of an item and that of the others."""
    rng = random.Random(size)
    sizes = [size] * 60 + [rng.choice([5, 9, 25, 40]) for _ in range(40)]
    items = Items(list(range(100)), [" ".join(f"a{rng.randrange(10**6)}" for _ in range(n)) for n in sizes])
    found = 0
    for k in range(60):
        words = [str(w) for w in items.words[k].tolist()]
        new = np.array([int(w) if w.isdigit() else rng.randrange(1 << 62) for w in changed(rng, words, edits(len(words)))], np.uint64)
        around = np.array([rng.randrange(1 << 62) for _ in range(40)], np.uint64)
        found += any(i == k for i, _, _ in items.find(np.concatenate([around[:20], new, around[20:]])))
    assert found >= 57


def test_starts_of_windows():
    rng = random.Random(3)
    for _ in range(200):
        hit = np.array(sorted(rng.sample(range(60), rng.randint(1, 20))))
        span, most = rng.randint(1, 12), rng.randint(0, 3)
        wanted = [a for a in range(60) if sum(a <= h < a + span for h in hit) >= max(1, span - 3 * most)]
        assert decontaminate._starts(hit, span, most).tolist() == wanted


def test_a_long_text_that_repeats_an_item_takes_no_longer_than_others():
    words = [f"a{k}" for k in range(40)]
    items, text = Items([1], [" ".join(words)]), word_hashes(" ".join(words * 500))
    began = time.perf_counter()
    assert items.find(text) == [(0, 0, 0)]
    assert time.perf_counter() - began < 5


def test_edges_of_the_input(spark, documents, empty, monkeypatch):
    passage = "one two three four five six seven"
    long_ = "w " * 30_000 + passage
    docs = documents([(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (4, long_), (5, "one two three"), (6, "ONE, two; three-four five/six (seven)")])
    table = spark.createDataFrame([(1, passage, 0), (1, "eight nine ten eleven twelve", 0), (2, "one two", 0), (3, None, 0), (None, passage, 0), (4, passage, 0), (4, passage, 0)], ITEM)
    wanted = {1: [], 2: [], 3: [1, 4], None: [1, 4], 4: [1, 4], 5: [], 6: [1, 4]}
    for size in (8 << 20, 20):  # one block of items, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = find_benchmark(docs, table).collect()
        assert len(rows) == 8 and all([m["item_id"] for m in r["matches"]] == wanted[r["doc_id"]] for r in rows)
    assert [r["matches"] for r in find_benchmark(docs, empty(ITEM)).collect()] == [[]] * 8
    assert find_benchmark(empty("doc_id long, text string"), table).collect() == []
    assert len(word_hashes("a-B ä_c")) == 4


@pytest.mark.parametrize("size", range(5, 80))
def test_bound_leaves_an_unspoiled_run(size):
    assert size - 2 - 3 * edits(size) >= 1
