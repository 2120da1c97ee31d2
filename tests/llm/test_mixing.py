from __future__ import annotations

import numpy as np
import pytest
import xxhash

from ebbline.llm.corpus import TARGETS as PRODUCTION
from ebbline.llm.mixing import Targets, fit_weights, mix_sources, probabilities

TARGETS = Targets(source={"a": 0.3, "b": 0.3}, lang={"en": 0.5, "de": 0.3}, topic={f"topic{k}": 1 / 6 for k in range(6)}, keep=0.4)


def test_fitting_meets_the_marginals_and_keeps_ratios():
    rng = np.random.default_rng(1)
    cells = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    goals = [rng.dirichlet(np.ones(n)) for n in cells.shape]
    wanted = fit_weights(cells, goals)
    for axis, goal in enumerate(goals):
        assert wanted.sum(axis=tuple(a for a in range(3) if a != axis)) == pytest.approx(goal, abs=1e-8)
    share = wanted / cells  # a product of one factor for each dimension: odds ratios stay
    assert share[0, 0, 0] * share[1, 1, 0] == pytest.approx(share[0, 1, 0] * share[1, 0, 0])
    weight, chance = probabilities(cells, wanted, 0.3)
    assert (cells * chance).sum() == pytest.approx(0.3 * cells.sum()) and chance.max() <= 1
    free = chance < 1
    assert np.ptp(chance[free] / weight[free]) < 1e-9


def test_a_target_without_tokens_goes_to_the_rest():
    cells = np.array([[10.0, 0.0], [30.0, 0.0]])
    wanted = fit_weights(cells, [np.array([0.5, 0.5]), np.array([0.5, 0.5])])
    assert wanted == pytest.approx(np.array([[0.5, 0.0], [0.5, 0.0]]))


def corpus(spark, count=4000):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 997:04d}" for k in range(5 + i % 40)), ["en", "en", "en", "de", None][i % 5], ["a", "a", "a", "b", "c"][(i // 5) % 5], 0) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_sample_meets_the_targets(spark):
    docs = corpus(spark)
    rows = mix_sources(docs, TARGETS).collect()
    tokens = sum(r["n_tokens"] for r in rows)
    kept = [r for r in rows if r["kept"]]
    assert sum(r["n_tokens"] for r in kept) == pytest.approx(0.4 * tokens, rel=0.05)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.4 * tokens, rel=1e-6)
    # token weights, before probabilities meet 1, reproduce the shares
    for name, key, share in (("source", "a", 0.3), ("source", "b", 0.3), ("source", "c", 0.4), ("lang", "en", 0.5), ("lang", "de", 0.3)):
        weighted = sum(r["n_tokens"] * r["weight"] for r in rows if r[name] == key)
        assert weighted == pytest.approx(share * tokens, rel=1e-4)
    again = mix_sources(docs.repartition(7), TARGETS).collect()
    assert sorted(r["doc_id"] for r in again if r["kept"]) == sorted(r["doc_id"] for r in kept)


def plain_mix(rows, targets, rounds=200):
    """Raking, probabilities and draws in plain loops, from (doc_id, lang, source, tokens, topic, text)."""
    names = {1: targets.lang, 2: targets.source, 4: targets.topic}

    def cell(row):
        return tuple(row[k] if row[k] in named else "other" for k, named in names.items())

    tokens = {}
    for row in rows:
        tokens[cell(row)] = tokens.get(cell(row), 0) + row[3]
    tokens = {c: n for c, n in tokens.items() if n}
    total = sum(tokens.values())
    wanted = {c: n / total for c, n in tokens.items()}
    for _ in range(rounds):
        for axis, named in enumerate(names.values()):
            now = {}
            for c, w in wanted.items():
                now[c[axis]] = now.get(c[axis], 0) + w
            left = 1 - sum(named.values())
            if named and left < 1e-9:  # nothing is left for other values: they keep what they have
                has = sum(n for c, n in tokens.items() if c[axis] == "other") / total
                goal = {k: v / sum(named.values()) * (1 - has) for k, v in named.items()} | {"other": has}
            else:
                goal = dict(named) | {"other": left}
            there = sum(goal[k] for k in now)
            wanted = {c: w * goal[c[axis]] / there / now[c[axis]] for c, w in wanted.items()}
    weight = {c: w / (tokens[c] / total) for c, w in wanted.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        kept = sum(n / total * min(1, middle * weight[c]) for c, n in tokens.items())
        low, high = (middle, high) if kept < targets.keep else (low, middle)
    found = []
    for row in rows:
        seed = 42 if row[0] is None else xxhash.xxh64_intdigest((row[0] % 2**64).to_bytes(8, "little"), 42)
        seed = seed if row[5] is None else xxhash.xxh64_intdigest(row[5].encode(), seed)
        draw = xxhash.xxh64_intdigest((44).to_bytes(4, "little"), xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42)) % 2**52 / 2**52
        w, p = weight.get(cell(row), 1.0), min(1, high * weight[cell(row)]) if cell(row) in weight else targets.keep
        found.append((row[0], row[5], w, p, draw < p))
    return found


@pytest.mark.parametrize("targets", [TARGETS, PRODUCTION])
def test_equals_plain_loops(spark, targets):
    docs = corpus(spark, 600).unionByName(spark.createDataFrame([(None, "no id, word after word", "fr", "src3", 0), (7, None, None, None, 0), (-3, "", "de", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = mix_sources(docs, targets).collect()
    wanted = plain_mix([(r["doc_id"], r["lang"], r["source"], len((r["text"] or "").split()), r["topic"], r["text"]) for r in got], targets)
    for r, (doc_id, text, weight, chance, kept) in zip(got, wanted, strict=True):
        assert (r["doc_id"], r["text"]) == (doc_id, text) and r["weight"] == pytest.approx(weight, rel=1e-6) and r["probability"] == pytest.approx(chance, rel=1e-6)
        assert r["kept"] == kept
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_rows_without_an_id_have_draws_of_their_own(spark, documents):
    rows = mix_sources(documents([(None, f"some words number {k}") for k in range(200)] + [(7, f"text {k}") for k in range(200)]), Targets(keep=0.5)).collect()
    assert 60 < sum(r["kept"] for r in rows if r["doc_id"] is None) < 140 and 60 < sum(r["kept"] for r in rows if r["doc_id"] == 7) < 140


def test_clashing_columns_are_replaced_and_others_stay(spark):
    docs = corpus(spark, 50).selectExpr("*", "'x' AS topic", "'x' AS n_tokens", "1 AS weight", "'x' AS kept", "'x' AS probability", "'y' AS _source", "'y' AS __lang")
    rows = mix_sources(docs, TARGETS).collect()
    assert len(rows) == 50 and all(r["_source"] == r["__lang"] == "y" and r["topic"] != "x" and isinstance(r["kept"], bool) for r in rows)
    assert rows[0].asDict().keys() >= {"topic", "n_tokens", "weight", "kept", "probability"} and len(rows[0]) == len(docs.columns)


def test_edges_of_the_input(spark, documents, empty):
    assert mix_sources(empty("doc_id long, text string, lang string, source string, n_chars long"), TARGETS).collect() == []
    rows = mix_sources(documents([(1, None), (2, ""), (None, "x"), (3, "word " * 20_000), (3, "word " * 20_000)]), TARGETS).collect()
    assert len(rows) == 5 and all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["doc_id"]: (r["n_tokens"], r["topic"]) for r in rows if r["doc_id"] in (1, 2)} == {1: (0, "other"), 2: (0, "other")}
    assert len({r["kept"] for r in rows if r["doc_id"] == 3}) == 1
    only = mix_sources(documents(["", None]), TARGETS).collect()  # no tokens at all
    assert [r["probability"] for r in only] == [0.4, 0.4]
    everything = mix_sources(documents(["some words here"] * 3), Targets(keep=1.0)).collect()
    assert all(r["kept"] for r in everything)


def test_values_that_no_target_names_can_be_kept(spark):
    """The named shares of the production targets leave nothing, but null, unlisted and short-word rows are no less clean."""
    words = [f"word{k:04d}" for k in range(997)]
    rows = [(i, " ".join(words[(i * 7 + k) % 997] for k in range(5 + i % 40)), ["en", "de", "fr", "es"][i // 20 % 4], f"src{i % 20}", 0) for i in range(2000)]
    text = " ".join(words[:20])
    rest = [("en", None, text), ("en", "src20", text), (None, "src1", text), ("it", "src1", text), ("en", "src2", "a few of the like"), ("it", None, "so on"), ("en", "src2", "")]
    rows += [(2000 + i, text, lang, source, 0) for i, (lang, source, text) in enumerate(rest * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mix_sources(docs, PRODUCTION).collect()
    assert min(r["probability"] for r in got) > 0.01
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(0.6 * sum(r["n_tokens"] for r in got), rel=1e-6)
    assert {(r["lang"], r["source"], r["text"]) for r in got if r["kept"] and r["doc_id"] >= 2000} == set(rest)
