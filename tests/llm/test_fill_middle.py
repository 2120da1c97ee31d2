from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm.fill_middle import SLICE, Boundaries, classes, fill_in_middle, restored
from ebbline.llm.wavelet import WaveletMatrix


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    prefix, middle, suffix = ("".join(tokens[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 1000])
def test_ranks_equal_counts(size):
    rng = np.random.default_rng(size)
    symbols = rng.integers(0, 4, size).astype(np.uint8)
    matrix = WaveletMatrix(symbols, 2)
    places = np.arange(size + 1)
    for symbol in range(4):
        assert matrix.rank(symbol, places).tolist() == [int((symbols[:p] == symbol).sum()) for p in places]


def test_every_cut_of_neighbouring_texts():
    texts = ["", "ab", "cd", "a b", "", "ab1cd é", "zz"]  # letters that touch across two texts are different tokens
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    stops = np.cumsum([len(c) for c in codes])
    starts = stops - [len(c) for c in codes]
    found = Boundaries(classes(np.concatenate(codes), starts))
    tokens = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert (found.before(stops) - found.before(starts)).tolist() == [len(t) for t in tokens]
    for k in range(8):
        wanted = np.minimum(k, [len(t) for t in tokens])
        assert (found.cut(starts, stops, wanted) - starts).tolist() == [len("".join(t[:n])) for t, n in zip(tokens, wanted)]


def test_samples_equal_brute_force(spark, documents):
    rng = random.Random(3)
    marks = ["a", "Z", "bc", " ", "\n", "1", "é", "😀", "ſ", "K", "<", "<S", "P>", "[", "`", "@", "\x00"]
    texts = ["".join(rng.choices(marks, k=rng.choice([1, 2, 5, 40, 300]))) for _ in range(400)]
    texts += ["", None, "a<P>b", "<M>", "word " * 3, "x" * (SLICE + 10) + " y", "é" * 5]
    pairs = [*enumerate(texts), (3, "again"), (3, "again"), (None, "no id here"), (-7, "minus id")]
    got = fill_in_middle(documents(pairs)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=repr) == sorted(
        ((i is None, i, *brute(i, t), t or "") for i, t in pairs), key=repr
    )
    forms = [r["form"] for r in got]
    assert {"plain", "psm", "spm"} == set(forms) and forms.count("psm") > forms.count("spm") > 0


def test_empty_table(empty):
    assert fill_in_middle(empty("doc_id long, text string, n string")).collect() == []
