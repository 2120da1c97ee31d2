from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from ebbline.llm.toxicity import SEEDS, Lexicon, _logistic, drop_toxic, fit, fold, match, score_toxicity, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_folding_undoes_disguise():
    assert fold("You 1D10T!") == " you idiot "
    assert fold("іdіоt") == " idiot "  # Cyrillic letters
    assert fold("ｉｄｉｏｔ i​diot l0$er") == " idiot idiot loser "
    assert fold("room 101, 4785 $$$") == " room 101 4785 "


def test_folding_undoes_marks_forms_and_spelling():
    assert fold("ídíot ÏDÏÖT i̶d̶i̶o̶t̶") == " idiot idiot idiot "
    bold = "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    circled = "".join(chr(0x24D0 + ord(c) - 97) for c in "idiot")
    assert fold(f"{bold} {circled} IDIOT") == " idiot idiot idiot "
    assert fold("you i.d.i.o.t, a b c and i d i o t!") == " you idiot a b c and idiot "
    assert fold("été 漢字 naïve") == " ete 漢字 naive "


def plain_match(folded, weights, exceptions):
    """Every entry tried at every place."""
    best, spared = {}, []
    for at in range(len(folded)):
        for term, weight in weights.items():
            if folded.startswith(f" {term}", at):
                best[at] = max(weight, best.get(at, 0.0))
        for phrase in exceptions:
            if folded.startswith(f" {phrase} ", at):
                spared.append((at, at + len(phrase)))
    kept = [w for at, w in best.items() if not any(a <= at < b for a, b in spared)]
    return sum(kept), len(kept), len(folded.split())


def test_matches_equal_those_of_a_plain_scan():
    rng = random.Random(9)
    terms = ["ab", "abc", "b", "bca", "ca", "cab c", "a"]
    for _ in range(500):
        lexicon = Lexicon(weights={t: rng.choice([0.5, 1.5, 3.0]) for t in rng.sample(terms, 4)}, exceptions=tuple(rng.sample(["ab c", "b", "ca ab", "abc bca"], 2)))
        folded = fold(" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12))))
        assert match(folded, lexicon.automaton()) == plain_match(folded, lexicon.weights, lexicon.exceptions)


def test_calibration_is_the_penalised_optimum():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(400), rng.random((400, 2)) * 3])
    y = (rng.random(400) < 1 / (1 + np.exp(3 - 2 * x[:, 1]))).astype(float)
    w = _logistic(x, y)

    def loss(v):
        z = x @ v
        return (np.log1p(np.exp(z)) - y * z).sum() + 0.025 * (v @ v)

    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(w) < loss(w + step)


def test_learned_weights_equal_plain_counts(spark, documents):
    """Every beginning of a word counted in plain loops, over the documents that teach."""
    docs, labels = labelled(spark, documents, 400)
    lexicon = fit(docs, labels)
    taught = {r["doc_id"] for r in labels.where("pmod(xxhash64(doc_id, 19), 5) >= 2").collect()}
    texts = [(r["text"], int(r["doc_id"] % 7 == 0)) for r in docs.collect() if r["doc_id"] in taught]
    sizes = [sum(y == k for _, y in texts) for k in (0, 1)]
    seen = {}
    for text, y in texts:
        for term in {w[:k] for w in text.split() for k in range(3, min(len(w), 9) + 1)}:
            seen.setdefault(term, [0, 0])[y] += 1
    bounds = {}
    for term, (clean, toxic) in seen.items():
        t, c = toxic + 0.5, clean + 0.5
        bound = math.log(t / (sizes[1] + 1)) - math.log(c / (sizes[0] + 1)) - 1.64 * math.sqrt(1 / t + 1 / c)
        if toxic >= max(3, sizes[1] // 250) and bound >= 1.5:
            bounds[term] = bound
    weights = {}
    for term in sorted(bounds, key=lambda t: (len(t), t)):
        if max((weights.get(term[:k], 0.0) for k in range(3, len(term))), default=0.0) < bounds[term] - 0.5:
            weights[term] = bounds[term]
    learned = {t: w for t, w in lexicon.weights.items() if t not in SEEDS}
    assert learned and learned == pytest.approx(weights)


def test_matches_begin_words_and_spare_exceptions():
    lexicon = Lexicon(weights={"idiot": 3.0, "idiotic": 5.0, "trash": 2.0})
    found = lexicon.automaton()
    assert match(fold("idiots, idiotic; patriot unidiot"), found) == (8.0, 2, 4)
    assert match(fold("The trash can. Trash!"), found) == (2.0, 1, 4)
    assert match(fold(""), found) == (0, 0, 0)


def test_weight_is_normalised_by_length(spark, documents):
    lexicon = Lexicon(weights={"idiot": 3.0})
    rows = {r["doc_id"]: r for r in score_toxicity(documents(["idiot", "idiot " + "fine " * 5000, None, "", "fine"]), lexicon).collect()}
    assert rows[0]["score"] > rows[1]["score"] > rows[2]["score"] == rows[3]["score"] == rows[4]["score"] > 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def labelled(spark, documents, count=600):
    """Texts of made-up words; toxic ones hold words with one beginning, which no seed names."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "mo") for b in ("lin", "ras", "tup") for c in ("do", "fe", "gi")]
    docs, labels = [], []
    for i in range(count):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 7 == 0
        if toxic:
            text[rng.randrange(len(text))] = f"zarq{rng.choice('aeiou')}n"
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return documents(docs), spark.createDataFrame(labels, LABELS)


def test_learns_beginnings_from_labels_that_are_not_held_out(spark, documents):
    docs, labels = labelled(spark, documents)
    rows = toxicity(docs, labels).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(600)}
    assert all(r["predicted"] == int(r["doc_id"] % 7 == 0) == int(r["score"] >= 0.3) for r in rows)
    # turning the held-out labels over changes nothing
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted((r["doc_id"], r["score"]) for r in toxicity(docs, turned).collect()) == sorted((r["doc_id"], r["score"]) for r in rows)


def test_held_out_accuracy(spark):
    """Few clean documents are rejected, and few toxic ones missed."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean, toxic = ([r["predicted"] for r in rows if r["toxic"] == label] for label in (0, 1))
    assert sum(clean) <= 0.02 * len(clean) and len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic)


def test_edges_of_the_input(spark, documents, empty):
    none = empty(LABELS)
    rows = toxicity(documents([(1, "idiot"), (1, "idiot"), (None, None), (2, "fine " * 40)]), none).collect()
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert toxicity(empty("doc_id long, text string"), none).collect() == []
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (5, 1, 1), (5, 1, 0)], LABELS)
    docs = documents([(1, "idiot"), (2, "fine " * 40)])
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
