from __future__ import annotations

import html
import math
import random
import time

import numpy as np
import pytest

from ebbline.llm import html_extract
from ebbline.llm.html_blocks import blocks_of
from ebbline.llm.html_extract import Labeller, _padded, draw_page, extract, fit, named_labels, vectors
from tests.conftest import SMALL

PAGE = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def labeller(spark):
    return fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize(("page", "texts"), [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("<p>a <b>b</b>\n\t c<br>d</p>", ["a b c d"]),
    ("<p>1 &lt; 2 &amp; &copy;&nbsp;x &am", ["1 < 2 & © x &am"]), ("<script>var t='</p>';</script><style>p{}</style><p>x</p>", ["x"]),
    ("<!-- <p>no</p> --><p title='a>b'>x</p><!DOCTYPE html>", ["x"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>x</p><div class", ["x"]), ("<p>x<!-- open", ["x"]),
    ("<title>t</title><p>x<textarea>no</textarea>y</p>", ["xy"]), ("a < b <p>c", ["a < b", "c"]), ("<p>" + "w " * 50_000, [("w " * 50_000).strip()]),
    ("<div>a<table><tr><td>b<td>c</table>d</div>", ["a", "b", "c", "d"]), ("</p></div>x</p>", ["x"]), ('<p class="a>x</p><p>y</p>', ["x", "y"]),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


def test_paths_and_links():
    found = blocks_of('<body><div class="side bar" id=x><a href=q>go</a> on</div><article><h1>T</h1><p>U</article><p>V')
    assert [b.path for b in found] == [("body", "div", ".side", ".bar", ".x"), ("body", "article", "h1"), ("body", "article", "p"), ("body", "p")]
    assert [b.linked for b in found] == [2, 0, 0, 0]


@pytest.mark.parametrize(("page", "texts"), [
    ("<html><head><title>x</title><body><article><p>a</article>", ["a"]), ("<head><meta name=x><title>x</title><style>s</style><p>a", ["a"]),
    ("<head><title>x</title><script>s</script></head><p>a", ["a"]), ("<head><title>x</title>a<p>b", ["a", "b"]),
    ("<p>a<button>x<p>b</p>c", ["a", "b", "c"]), ("<div><button>x</div>a<p>b</p><button>y</button>c", ["a", "b", "c"]),
    ("<p><button>x<button>y</button>a</p>b", ["a", "b"]), ("<button><div>x</div>y</button><p>a", ["a"]),
    ("<select><option>x<option>y</select>a", ["a"]), ("<select><option>x<option>y<p>a", ["a"]), ("<div><select><option>x</div>a", ["a"]),
    ("<object>x<object>y</object>z</object>a", ["a"]), ("<object data=q>x<p>a</p>b", ["a", "b"]), ("<div><object>x</div>y</object>a</div>", ["a"]),
    ("<svg><title>x<path></svg>a", ["a"]), ("<svg><title>x<p>a", ["a"]), ("<p>a<svg><path></p>b<svg></svg>c", ["a", "bc"]),
    ("<noscript>x<p>a", ["a"]), ("<noscript><p>x</p></noscript>a", ["a"]), ("<iframe src=q>x<p>a", ["a"]), ("<svg/><p>a", ["a"]),
    ("<p>a<script>x<p>y", ["a"]), ("<p>a<title>x<p>y", ["a"]), ("<p>a<textarea>x<p>y", ["a"]), ("<canvas>x<template>y<p>a", ["a"]),
    ("<p>w <object>" * 20_000, ["w"] * 20_000), ("<noscript>x<p>a" * 20_000, ["a"] * 20_000),
])
def test_unclosed_silent_elements(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


SPACE = "\t\n\f\r "


def tag_end(page, at):
    """Behind the tag that begins at ``at``, one character after the other: in names, and in values behind an equals sign."""
    at += 1 + (page[at + 1] == "/")
    while at < len(page) and page[at] not in SPACE + "/>":
        at += 1
    while at < len(page):
        while at < len(page) and page[at] in SPACE + "/":
            at += 1
        if at == len(page):
            break
        if page[at] == ">":
            return at + 1
        at += 1  # the first character of a name may be an equals sign
        while at < len(page) and page[at] not in SPACE + "/>=":
            at += 1
        value = at
        while value < len(page) and page[value] in SPACE:
            value += 1
        if value == len(page) or page[value] != "=":
            continue
        value += 1
        while value < len(page) and page[value] in SPACE:
            value += 1
        at = value
        if value < len(page) and page[value] in "\"'":
            close = page.find(page[value], value + 1)
            at = close + 1 if close >= 0 else value
            continue
        while at < len(page) and page[at] not in SPACE + ">":
            at += 1
    return at


def plain_blocks(page):
    """The texts between block tags, by a machine that reads one character after the other."""
    found, now, at, run = [], [], 0, ""

    def flush():
        text = " ".join("".join(now).split())
        if text:
            found.append(text)
        now.clear()

    while at <= len(page):
        name = page[at + 1 : at + 3].lstrip("/")[:1] if at < len(page) and page[at] == "<" and page[at + 1 : at + 3] != "//" else ""
        is_tag = bool(name) and name.isascii() and name.isalpha()
        if at == len(page) or is_tag:
            now.append(html.unescape(run))
            run = ""
        if at == len(page):
            break
        if not is_tag:
            run += page[at]
            at += 1
            continue
        word = page[at + 1 + (page[at + 1] == "/") :]
        word = word[: next((i for i, c in enumerate(word) if c in SPACE + "/>"), len(word))].lower()
        at = tag_end(page, at)
        if word in ("p", "div", "li"):
            flush()
        elif word == "br":
            now.append(" ")
    flush()
    return found


def test_blocks_of_random_markup():
    rng = random.Random(11)
    marks = ["<p", "<div ", "<b>", "</b>", "</p>", "<br/>", "<li a=", " title=", " x", "=", "'", '"', ">", "/", " ", "\n", "O'Neil", "don't", "&am", "p;", "&lt;", "&copy;", "word", "é", "< ", "<i y='", "b\"c"]
    for _ in range(6000):
        page = "".join(rng.choices(marks, k=rng.randint(1, 14)))
        assert [b.text for b in blocks_of(page)] == plain_blocks(page), page


def test_names_with_apostrophes_keep_the_article():
    page = "<article><h1>Title</h1><p data-author=O'Neil>It's one.</p><p>Two.</p><p>Don't stop.</p></article>"
    assert [b.text for b in blocks_of(page)] == ["Title", "It's one.", "Two.", "Don't stop."]
    assert [b.text for b in blocks_of("<p title=it's>Hello don't worry</p><p>rest</p>")] == ["Hello don't worry", "rest"]
    assert [b.text for b in blocks_of("AT&am<b>p;</b>x")] == ["AT&amp;x"]


@pytest.mark.parametrize("page", ["<div class=a>" * 20_000 + "x" + "</div>" * 20_000, "<div class=a>x" * 20_000, "<div><i></div>" * 20_000])
def test_deep_pages_take_no_longer_than_long_ones(page):
    began = time.perf_counter()
    vectors(blocks_of(page))
    assert time.perf_counter() - began < 4


def plain_forward(model, x):
    """The labeller on one page, a number at a time."""
    def sigma(v):
        return 1 / (1 + math.exp(-v))

    size, scores = html_extract.HIDDEN, [float(model.p["bias"][0])] * len(x)
    for way in "fb":
        wx, wh, bias, out = (model.p[f"{k}{way}"].tolist() for k in "xhow")
        h, c = [0.0] * size, [0.0] * size
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = [bias[j] + sum(v * wx[i][j] for i, v in enumerate(x[t]) if v) + sum(h[i] * wh[i][j] for i in range(size)) for j in range(4 * size)]
            c = [sigma(z[size + j]) * c[j] + sigma(z[j]) * math.tanh(z[3 * size + j]) for j in range(size)]
            h = [sigma(z[2 * size + j]) * math.tanh(c[j]) for j in range(size)]
            scores[t] += sum(a * b for a, b in zip(h, out, strict=True))
    return [sigma(s) for s in scores]


def test_labels_equal_those_of_plain_loops(labeller):
    rng = random.Random(4)
    pages = [vectors(blocks_of(draw_page(rng, ["alpha", "beta", "gamma"]))) for _ in range(12)]
    for rows, labels in zip(pages, labeller.label(pages), strict=True):
        wanted = plain_forward(labeller, rows.astype(float).tolist())
        assert all(abs(w - 0.5) < 1e-6 or (w >= 0.5) == got for w, got in zip(wanted, labels, strict=True))
        chance, _ = labeller.forward(*_padded([(rows, np.zeros(len(rows)))])[:2])
        assert np.allclose(chance[:, 0], wanted, atol=1e-6)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, there, y = _padded([(rng.random((n, html_extract.WIDTH)), rng.integers(0, 2, n)) for n in (6, 3)])
    model = Labeller(2)

    def loss():
        p, _ = model.forward(x, there)
        return -np.where(there, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / there.sum()

    for name, g in model.gradients(x, there, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, step = model.p[name][at], 1e-5
        model.p[name][at] = kept + step
        high = loss()
        model.p[name][at] = kept - step
        low = loss()
        model.p[name][at] = kept
        assert g[at] == pytest.approx((high - low) / (2 * step), rel=1e-4)


def test_pages_of_one_batch_do_not_touch(labeller):
    rng = random.Random(2)
    pages = [vectors(blocks_of(draw_page(rng, ["alpha", "beta", "gamma"]))) for _ in range(30)]
    together = labeller.label(pages)
    assert all(np.array_equal(a, labeller.label([p])[0]) for a, p in zip(together, pages, strict=True))


def test_held_out_layouts(labeller):
    """Layouts drawn anew, many without a tag that names the main part."""
    rng, wrong, total = random.Random(99), 0, 0
    for _ in range(200):
        blocks = blocks_of(draw_page(rng, ["lorem", "ipsum", "dolor", "sit", "amet"]))
        truth = np.array([b.text.startswith(html_extract._MARK) for b in blocks])
        for b in blocks:
            b.text = b.text.removeprefix(html_extract._MARK) or "x"
        wrong += (labeller.label([vectors(blocks)])[0] != truth).sum()
        total += len(blocks)
    assert wrong <= 0.02 * total


def test_pages_of_the_corpus(spark, labeller):
    """Pages that were not trained on give exactly the blocks of their article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in extract(pages, labeller).join(pages.select("page_id", "html"), "page_id").collect():
        blocks = blocks_of(row["html"])
        wanted = "\n".join(b.text for b, y in zip(blocks, named_labels(blocks), strict=True) if y)
        assert row["text"] == wanted and row["n_chars"] == len(wanted)


def test_edges_of_the_input(spark, labeller, empty):
    long_ = "<article>" + "<p>some words of text here</p>" * 3000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<script>x</script>"), (4, "u", "<nav><a>x</a></nav>"), (5, "u", long_), (5, "u", long_), (None, None, "<article><p>A 😀 b.</p></article>")]
    got = [tuple(r)[:4] for r in extract(spark.createDataFrame([(*r, "x", "x") for r in rows], PAGE), labeller).collect()]
    assert got[:4] == [(1, None, "", 0), (2, "u", "", 0), (3, "u", "", 0), (4, "u", "", 0)]
    assert got[4] == got[5] and got[4][2].count("\n") == 2999 and got[6] == (None, None, "A 😀 b.", 6)
    assert extract(empty("page_id long, url string, html string"), labeller).collect() == []
