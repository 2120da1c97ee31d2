from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ebbline.llm.prefix_trie import placed_turns, prefix_trie, share_heads, subtree_totals

TURN = "conv_id long, turn long, role string, text string, place string, depth int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0, "x") for r in rows], TURN)


def dialogues(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in found.items()}


def shared(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)

    def words(text):
        return len(text.encode().split())

    rows = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in members)]
        saved = sum((len(members[k]) - 1) * words(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(key))
        rows.append((
            own[0], len(key), members[key[:-1]][0] if key else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def dialogue_rows(seed, count, most):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b b", "é c\x0bd  e", ""])) for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = dialogue_rows(seed, 60, 7)
    # ties, repeated rows, nulls, an empty founder's family, rows without an id
    rows += [(70, 1, "b", "x"), (70, 1, "a", "x"), (70, 1, "a", "x"), (70, None, None, None), (81, 0, "u", "lone"), (None, 0, "u", "no id"), (None, 1, "u", "no id")]
    rows += [(85, None, "u", "only"), (100, 0, "u", "short founder")] + [(100 + k, t, "u", f"t{t}") for k in range(1, 6) for t in range(5)]
    placed, sizes = placed_turns(frame(spark, rows).repartition(5))
    assert result(prefix_trie(placed, sizes)) == brute(dialogues(rows))
    assert result(prefix_trie(share_heads(placed, sizes), sizes)) == brute(shared(dialogues(rows)))


def test_a_dialogue_may_lose_all_its_turns(spark):
    lone = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(lone, 0, "u", "gone")]
    placed, sizes = placed_turns(frame(spark, rows))
    assert result(prefix_trie(share_heads(placed, sizes), sizes)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_one_long_dialogue_and_many_copies(spark):
    rows = [(1, t, "u", f"turn {t}") for t in range(120)] + [(c, t, "u", f"turn {t}") for c in range(2, 40) for t in range(3)]
    placed, sizes = placed_turns(frame(spark, rows).repartition(7))
    assert result(prefix_trie(placed, sizes)) == brute(dialogues(rows))


def tree_sums(parents, values):
    totals = dict(values)
    for node in values:
        up = parents[node]
        while up is not None:
            totals[up] += values[node]
            up = parents[up]
    return totals


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom", "forest"])
def test_contraction_of_any_tree(spark, shape):
    rng = random.Random(5)
    n = 120
    above = {
        "chain": lambda k: k - 1, "star": lambda k: 0, "random": lambda k: rng.randrange(k),
        "broom": lambda k: k - 1 if k < 60 else 59, "forest": lambda k: None if k % 17 == 0 else k - 1,
    }[shape]
    parents = {0: None} | {k: above(k) for k in range(1, n)}
    values = {k: rng.randint(-5, 50) for k in range(n)}
    tree = spark.createDataFrame([(k, parents[k], values[k], 1) for k in range(n)], "id long, parent long, v long, one long")
    got = {r["id"]: (r["v"], r["one"]) for r in subtree_totals(tree, ["v", "one"]).collect()}
    sizes = tree_sums(parents, dict.fromkeys(values, 1))
    assert got == {k: (t, sizes[k]) for k, t in tree_sums(parents, values).items()}


def test_empty_table(empty):
    placed, sizes = placed_turns(empty(TURN))
    assert prefix_trie(share_heads(placed, sizes), sizes).collect() == []
