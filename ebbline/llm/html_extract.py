"""Main text of web pages by a recurrent labeller of blocks.

A numpy bidirectional LSTM reads the leaf blocks of a page in order, each as a hashed
tag path, hashed words and a few measures, and decides for every block, from the whole page,
whether it is main text.  It is trained on pages that name their parts themselves
(``article``, ``nav``, ``footer`` ...) and on pages drawn from layouts with known answers.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ebbline.llm.common import arrow_map, smallest, texts_of
from ebbline.llm.html_blocks import PATH_SLOTS, Block, blocks_of

#: Pages of the corpus that are trained on at most, those of smallest hash, and drawn pages beside them.
TRAIN_PAGES, DRAWN_PAGES = 300, 500
#: Blocks of a page that are trained on at most, in one window; extraction reads whole pages.
TRAIN_BLOCKS = 120
WORD_SLOTS, MEASURES, HIDDEN = 32, 7, 20
EPOCHS, BATCH, RATE = 10, 32, 0.01
WIDTH = PATH_SLOTS + WORD_SLOTS + MEASURES

MAIN = ("article", "main")
#: Tags and class words of what is not main text.
ASIDE = frozenset(
    "nav footer aside form dialog menu .ad .ads .advert .advertisement .banner .promo .sponsor .sponsored .sidebar .menu .nav .navbar .navigation .footer "
    ".cookie .cookies .consent .notice .popup .modal .newsletter .subscribe .comment .comments .commentlist .reply .replies .respond .share .social .related "
    ".breadcrumb .breadcrumbs .widget .login .search .copyright .masthead .toolbar".split()
)


@lru_cache(maxsize=20_000)
def _path(slots: int, tag: str) -> np.ndarray:
    row = np.array([slots >> k & 1 for k in range(PATH_SLOTS)], float)
    row[zlib.crc32(f"leaf {tag}".encode("utf-8", "surrogatepass")) % PATH_SLOTS] += 0.5
    return row


#: A word's hash is the sum of a value for each of its bytes.
_BYTES = np.random.default_rng(3).integers(0, 1 << 20, 256)
_BYTES[[10, 32]] = 0


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block: its tag path and words, hashed, and measures of size, links, place and signs."""
    rows, count = np.zeros((len(blocks), WIDTH), np.float32), len(blocks)
    if not blocks:
        return rows
    data = np.frombuffer("\n".join(b.text for b in blocks).encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero((data == 32) | (data == 10)) + 1])
    owner = np.concatenate([[0], np.cumsum(data == 10)])[starts]
    slots = np.add.reduceat(np.append(_BYTES[data], 0), starts) % WORD_SLOTS
    words = np.bincount(owner, minlength=count)
    rows[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.bincount(owner * WORD_SLOTS + slots, minlength=count * WORD_SLOTS).reshape(count, -1) / words[:, None]
    for i, b in enumerate(blocks):
        size = len(b.text)
        rows[i, :PATH_SLOTS] = _path(b.slots, b.tag)
        rows[i, -MEASURES:] = (
            np.log1p(size) / 5, np.log1p(words[i]) / 4, b.linked / size, (i + 1) / count, 1 / (i + 1), b.text[-1] in ".!?…", "©" in b.text,
        )
    return rows


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output for each block."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN))
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"o{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
            self.p[f"w{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        self.p["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, there: np.ndarray, way: str) -> dict[str, np.ndarray]:
        """States of one direction; ``x`` is (block, page, feature), ``there`` marks real blocks."""
        steps, pages, _ = x.shape
        drive = x @ self.p[f"x{way}"] + self.p[f"o{way}"]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        kept = {n: np.zeros((steps, pages, k * HIDDEN)) for n, k in (("gates", 4), ("c", 1), ("h", 1), ("c0", 1), ("h0", 1))}
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            kept["h0"][t], kept["c0"][t] = h, c
            z = drive[t] + h @ self.p[f"h{way}"]
            z[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = np.split(z, 4, axis=1)
            m = there[t][:, None]
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            kept["gates"][t], kept["c"][t], kept["h"][t] = z, c, h
        return kept

    def forward(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, dict]:
        states = {way: self._run(x, there, way) for way in "fb"}
        score = sum(states[way]["h"] @ self.p[f"w{way}"] for way in "fb") + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30))), states

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the real blocks."""
        chance, states = self.forward(x, there)
        error = np.where(there, chance - y, 0.0) / max(there.sum(), 1)
        grads = {"bias": np.array([error.sum()])}
        for way in "fb":
            s, steps = states[way], len(x)
            grads[f"w{way}"] = np.einsum("tp,tph->h", error, s["h"])
            dz_all = np.zeros_like(s["gates"])
            dh = dc = np.zeros(s["h"].shape[1:])
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                i, f, o, g = np.split(s["gates"][t], 4, axis=1)
                m, squashed = there[t][:, None], np.tanh(s["c"][t])
                dh = dh + error[t][:, None] * self.p[f"w{way}"]
                inner = np.where(m, dc + dh * o * (1 - squashed**2), 0.0)
                z = np.concatenate([inner * g * i * (1 - i), inner * s["c0"][t] * f * (1 - f), np.where(m, dh * squashed, 0.0) * o * (1 - o), inner * i * (1 - g**2)], axis=1)
                dz_all[t] = z
                dc = np.where(m, inner * f, dc)
                dh = np.where(m, z @ self.p[f"h{way}"].T, dh)
            grads[f"x{way}"] = np.einsum("tpd,tpk->dk", x, dz_all, optimize=True)
            grads[f"h{way}"] = np.einsum("tph,tpk->hk", s["h0"], dz_all, optimize=True)
            grads[f"o{way}"] = dz_all.sum(axis=(0, 1))
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> None:
        """Adam over shuffled batches; half of the paths' features are dropped at random, so that no single tag decides."""
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 10
            for at in range(0, len(order), BATCH):
                x, there, y = _padded([pages[i] for i in order[at : at + BATCH]])
                x[:, :, :PATH_SLOTS] *= rng.random((1, x.shape[1], PATH_SLOTS)) > 0.15
                step += 1
                for name, g in self.gradients(x, there, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    self.p[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length go together, and every block of a page counts."""
        answers: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[0]])
            group = order[: max(1, min(64, 20_000 // max(longest, 1)))]
            order = order[len(group) :]
            x, there, _ = _padded([(pages[i], np.zeros(len(pages[i]))) for i in group])
            chance, _ = self.forward(x, there)
            for k, i in enumerate(group):
                answers[i] = chance[: len(pages[i]), k] >= 0.5
        return answers


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, y, there = np.zeros((steps, len(pages), WIDTH)), np.zeros((steps, len(pages))), np.zeros((steps, len(pages)), bool)
    for k, (rows, labels) in enumerate(pages):
        x[: len(rows), k], y[: len(rows), k], there[: len(rows), k] = rows, labels, True
    return x, there, y


def named_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that names its parts; None for one without ``article`` or ``main``."""
    if not any(t in b.path for b in blocks for t in MAIN):
        return None
    return np.array([any(t in b.path for t in MAIN) and not ASIDE & set(b.path) for b in blocks], float)


#: Begins the main blocks of a drawn page; a private character that is taken off again.
_MARK = "\ue000"


def draw_page(rng: random.Random, words: list[str]) -> str:
    """A page of a random layout whose main blocks begin with a mark."""

    def say(least: int, most: int) -> str:
        text = " ".join(rng.choice(words) for _ in range(rng.randint(least, most))).strip(",.")
        return text.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{rng.choice(words)}">{say(1, 4)}</a></li>' for _ in range(count))

    def title() -> str:
        return f'{rng.choice(["", "site-", "page-", "main-"])}'

    asides = {
        "header": lambda: f'<header class="{title()}header"><div class="logo">{say(1, 3)}</div><p>{say(2, 8)}</p></header>',
        "top": lambda: f'<div id="{title()}header" class="masthead"><h1>{say(1, 4)}</h1><span>{say(2, 6)}</span></div>',
        "nav": lambda: f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>",
        "menu": lambda: f'<div class="{title()}{rng.choice(["menu", "nav", "navbar", "navigation"])}"><ul>{links(rng.randint(2, 9))}</ul></div>',
        "crumbs": lambda: f'<div class="breadcrumbs"><a href="/">{say(1, 1)}</a> &gt; <a href="/x">{say(1, 2)}</a></div>',
        "ad": lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"])}">{say(3, 25)}</div>',
        "notice": lambda: f'<div class="{rng.choice(["cookie-notice", "cookie-banner", "consent", "notice", "popup", "modal", "alert notice"])}"><p>{say(5, 30)}</p></div>',
        "sidebar": lambda: f'<{(t := rng.choice(["aside", "div"]))} class="sidebar"><h3>{say(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{say(5, 40)}</p></{t}>',
        "plain": lambda: f"<aside><p>{say(5, 40)}</p></aside>",
        "form": lambda: f'<form action="/s"><label>{say(1, 4)}</label><input name="q"><p>{say(3, 15)}</p><button>{say(1, 2)}</button></form>',
        "newsletter": lambda: f'<div class="{rng.choice(["newsletter", "subscribe", "login", "search", "share social"])}"><p>{say(3, 15)}</p></div>',
        "related": lambda: f'<div class="{rng.choice(["related", "widget", "related-posts"])}"><h3>{say(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul></div>',
        "comments": lambda: f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["id", "class"])}="comments"><h3>{say(1, 3)}</h3>' + "".join(
            f'<div class="comment"><p>{say(4, 50)}</p></div>' for _ in range(rng.randint(1, 5))) + f"</{t}>",
        "replies": lambda: '<ol class="commentlist">' + "".join(f"<li><b>{say(1, 2)}</b><p>{say(4, 40)}</p></li>" for _ in range(rng.randint(1, 5))) + "</ol>",
        "footer": lambda: f"<footer>&copy; {say(1, 3)} &middot; {say(3, 20)}</footer>",
        "bottom": lambda: f'<div class="{title()}footer"><p>{say(3, 20)}</p><p class="copyright">&copy; {say(1, 5)}</p></div>',
    }

    def main() -> str:
        parts = [f"<h1>{_MARK}{say(3, 12)}</h1>"]
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f"<p>{_MARK}{rng.choice(['', '', '<b>'])}{say(1, 90)}" + rng.choice(["</p>", "</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                parts.append(f"<h2>{_MARK}{say(2, 8)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{say(2, 20)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote><p>{_MARK}{say(5, 40)}</p></blockquote>")
            elif kind < 0.94:
                parts.append(f"<table><tr><td>{_MARK}{say(1, 4)}</td><td>{_MARK}{say(1, 4)}</td></tr></table>")
            else:
                parts.append(asides[rng.choice(["ad", "plain", "newsletter", "related"])]())
        if rng.random() < 0.15:
            parts.append(asides[rng.choice(["comments", "replies"])]())
        body = "".join(parts)
        style = rng.choice(["article", "article", "main", "post", "nested", "bare"])
        if style in ("article", "main"):
            return f"<{style}>{body}</{style}>"
        if style == "post":
            return f'<div class="{rng.choice(["content", "post", "entry-content", "article-body", "story", "text"])}">{body}</div>'
        return f'<main id="content"><article class="post"><section>{body}</section></article></main>' if style == "nested" else f"<div>{body}</div>"

    before = rng.sample(["header", "top", "nav", "menu", "crumbs", "ad", "notice", "form", "sidebar"], rng.randint(0, 4))
    after = rng.sample(["sidebar", "plain", "ad", "newsletter", "related", "comments", "replies", "form", "notice", "footer", "bottom"], rng.randint(0, 4))
    body = "".join(asides[a]() for a in before) + main() + "".join(asides[a]() for a in after)
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def fit(pages: DataFrame) -> Labeller:
    """Train on at most TRAIN_PAGES pages that name their parts, and DRAWN_PAGES drawn ones with words of those."""
    rows = smallest(pages.select("page_id", "html").where("html IS NOT NULL"), "page_id", 6, TRAIN_PAGES).collect()
    examples, words = [], set()
    for row in rows:
        blocks = blocks_of(row["html"])[:TRAIN_BLOCKS]
        words.update(w for b in blocks for w in b.text.split(" ")[:40])
        labels = named_labels(blocks) if blocks else None
        if labels is not None:
            examples.append((vectors(blocks), labels))
    rng, listed = random.Random(6), sorted(words)[:20_000] or ["word"]
    for _ in range(DRAWN_PAGES):
        blocks = blocks_of(draw_page(rng, listed))[:TRAIN_BLOCKS]
        labels = np.array([b.text.startswith(_MARK) for b in blocks], float)
        for b in blocks:
            b.text = b.text.removeprefix(_MARK).strip() or "x"
        examples.append((vectors(blocks), labels))
    labeller = Labeller()
    labeller.train(examples)
    return labeller


def main_text(blocks: list[Block], labels: np.ndarray) -> str:
    return "\n".join(b.text for b, main in zip(blocks, labels, strict=True) if main)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row: the main blocks in page order, one a line.

    Whole pages are read.  A null or empty page, or one without main text, gives an empty text.  Repeated rows
    give repeated results, an empty table none (the labeller is then trained on drawn pages); other columns are ignored.
    """
    labeller = labeller or fit(pages)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, held = [], [], []

        def finish() -> None:
            labels = labeller.label([vectors(blocks) for blocks in held])
            texts.extend(main_text(blocks, own) for blocks, own in zip(held, labels, strict=True))
            counts.extend(len(blocks) for blocks in held)
            held.clear()

        for page in texts_of(batch.column("html")):
            held.append(blocks_of(page))
            if sum(map(len, held)) > 5_000:  # bounds the vectors held at once
                finish()
        finish()
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes, pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"]
        )

    return arrow_map(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long, n_blocks long")
