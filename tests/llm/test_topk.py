from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ebbline.llm import topk
from ebbline.llm.topk import top_k

EMBEDDING = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k, every):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, a in {(i, tuple(v)) for i, v in sound if i % every == 0}:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in sound if i != q and len(b) == len(a))
        found |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], EMBEDDING)


def grid(rng, size):
    """Components that are whole 256ths, so floats and doubles agree."""
    return [rng.randint(-256, 256) / 256 for _ in range(size)]


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "BINS", 4)
    rng = random.Random(1)
    rows = [(i, grid(rng, 8)) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # ties
    got = top_k(frame(spark, rows).repartition(5), F.col("vec_id") % 25 == 0, 5)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 25)


@pytest.mark.parametrize("bins", [512, 4])
def test_large_components(spark, monkeypatch, bins):
    """Beyond what doubles hold exactly, beyond what products of longs hold, and scores that no long holds."""
    monkeypatch.setattr(topk, "BINS", bins)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-9, 9) * 2 ** rng.choice([0, 10, 18])) + rng.randint(0, 3) / 256 for _ in range(4)]) for i in range(60)]
    rows += [(60 + i, [float(rng.choice([-1, 1]) * 2 ** rng.choice([0, 23, 57])), float(rng.randint(-5, 5)), 0.5, 2.0 ** rng.choice([-8, 22])]) for i in range(30)]
    rows += [(100, [1e17, 0.0, 0.0, 0.0]), (101, [3e38, -3e38, 0.0, 1.0]), (102, [0.0, 1.0, 0.0, 0.0]), (125, [0.0, 0.0, 0.0, 1.0])]
    rows = [(i, struct.unpack(f"{len(v)}f", struct.pack(f"{len(v)}f", *v))) for i, v in rows]  # as the table holds them
    got = top_k(frame(spark, rows).repartition(3), F.col("vec_id") % 25 == 0, 5)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 25)


def test_all_scores_equal(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)]
    got = {tuple(r) for r in top_k(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(rows, 5, 10)


def test_edges_of_the_input(spark, empty):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, None]), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, None), (5, []), (None, [1.0, 1.0]),
        (6, [0.5, 0.25]), (7, [1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (100, [0.0]), (0, [1.0, 0.0]),
    ]
    got = sorted(tuple(r) for r in top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 6, 256 * 128), (50, 1, 7, 3 * 65536)]
    assert top_k(empty(EMBEDDING), F.col("vec_id") % 50 == 0).collect() == []
