"""Finding benchmark passages in documents under edits, by embedded windows and bit sampling.

A window of as many words as an item is embedded by a random walk (CGK): at each of
twice as many steps it writes the word under its pointer, and a random bit of step and word
tells whether the pointer moves on.  Texts at a small edit distance walk alike again soon after
each edit, so their embeddings differ in few places.  Each of several repeats has a walk
of its own and keys a window by a few sampled places; windows that share a key with an
item of their size are candidates, and the exact edit distance in words decides.

Windows that cannot match any item are skipped first: k edits spoil at most
GRAM * k of the word runs of length GRAM, so a match holds enough unspoiled ones.  The longer
an item, the longer a walk strays after its edits; sizes for which MOST_REPEATS walks do not
reach the wished recall take the windows that hold enough unspoiled runs of an item as its
candidates, which loses none.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import arrow_map, mix, stage, texts_of

#: Edits allowed for each word of an item, and words an item needs to be looked for.
EDIT_SHARE, LEAST_WORDS = 0.2, 5
#: Words of a run that the skip test counts, sampled places of a key, wished recall and most repeats to reach it.
GRAM, PLACES, RECALL, MOST_REPEATS = 3, 2, 0.99, 48
#: Pairs of an item and its most edited form on which the recall of a size is measured.
TRIALS = 200
#: Items that go to the tasks at once, in UTF-8 bytes.
BLOCK_BYTES = 8 << 20
#: Bits of the table that tells quickly whether a run occurs in an item.
TABLE_BITS = 20

_SPACE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word: ASCII letters in lower case, ASCII digits, and all other letters as they are."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACE).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def edits(size: int) -> int:
    """Edits allowed for an item of so many words; so few that at least one run stays whole."""
    return max(0, min(int(EDIT_SHARE * size), (size - GRAM) // GRAM))


def runs(words: np.ndarray) -> np.ndarray:
    if len(words) < GRAM:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        total = (total + words[k : len(words) - GRAM + 1 + k]) * _STEP
    return total


def sample_places(size: int, repeats: int) -> np.ndarray:
    """(repeat, step): whether the walk's step is sampled.  A walk leaves a text after about two steps a word."""
    rng, chosen = np.random.default_rng([size, 11]), np.zeros((MOST_REPEATS, 2 * size), bool)
    for row in chosen:
        row[rng.choice(2 * size, min(PLACES, 2 * size), replace=False)] = True
    return chosen[:repeats]


def embed(windows: np.ndarray, repeats: int) -> np.ndarray:
    """(window, repeat): hash of the symbols that each repeat's walk writes at its sampled places.

    ``windows`` has a row for each window and one word hash a column; behind its end a walk writes 0.
    """
    rows, size = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    sampled, at = sample_places(size, repeats), np.arange(rows)[:, None]
    pointer = np.zeros((rows, repeats), np.int64)
    key = np.broadcast_to(np.arange(repeats, dtype=np.uint64), (rows, repeats)).copy()
    walks = mix(np.arange(repeats), 77)
    for step in range(sampled.shape[1]):
        symbol = padded[at, pointer]
        if (now := sampled[:, step]).any():
            key[:, now] = mix(key[:, now] * _STEP + symbol[:, now])
        moves = mix(symbol + walks, 1 + step) >> np.uint64(63)
        pointer = np.minimum(pointer + moves.astype(np.int64), size)
    return key


def nearest(item: np.ndarray, segment: np.ndarray) -> tuple[int, int]:
    """(edits, start) of the passage of ``segment`` nearest to ``item`` by edit distance, the first of several."""
    one = 1 << 32  # a cell holds edits * one + start, so that the smaller start wins ties
    steps = np.arange(len(segment) + 1, dtype=np.int64) * one
    row = np.arange(len(segment) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        now = row + one
        now[0] = i * one
        np.minimum(now[1:], row[:-1] + np.where(segment == word, 0, one), out=now[1:])
        row = np.minimum.accumulate(now - steps) + steps  # words of the segment that the item lacks
    near, start = divmod(int(row.min()), one)
    return near, start


def _grid(size: int) -> int:
    """The size at which the recall of items of ``size`` words is measured: the next of some that grow by a fifth."""
    at = LEAST_WORDS
    while at < size:
        at = max(at + 1, at * 6 // 5)
    return at


@cache
def repeats_for(size: int) -> int:
    """The repeats that find RECALL of the items of so many words after the most edits allowed; 0 if MOST_REPEATS do not.

    Measured on drawn items and edits, on the window that begins where the item does.
    """
    rng, pairs = np.random.default_rng([size, 5]), []
    for _ in range(TRIALS):
        words = rng.integers(1 << 62, size=size)
        changed = words.tolist()
        for _ in range(edits(size)):
            at, kind = int(rng.integers(len(changed))), int(rng.integers(3))
            if kind == 0:
                changed[at] = int(rng.integers(1 << 62))
            elif kind == 1:
                changed.insert(at, int(rng.integers(1 << 62)))
            elif len(changed) > 1:
                del changed[at]
        window = (changed + rng.integers(1 << 62, size=size).tolist())[:size]
        pairs += [words, np.array(window)]
    keys = embed(np.stack(pairs).astype(np.uint64), MOST_REPEATS)
    found = np.logical_or.accumulate(keys[::2] == keys[1::2], axis=1).mean(axis=0)
    return int(np.argmax(found >= RECALL)) + 1 if found[-1] >= RECALL else 0


def _starts(hit: np.ndarray, span: int, most: int) -> np.ndarray:
    """Where windows begin that hold enough of the runs at ``hit``; one may reach over the end of a text that lacks words of the item."""
    first = np.clip(hit - span + 1, 0, None)
    fresh = np.maximum(first, np.concatenate([[0], hit[:-1] + 1]))  # each start once, however many runs its window holds
    sizes = hit + 1 - fresh
    starts = np.arange(sizes.sum()) + np.repeat(fresh - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    held = np.searchsorted(hit, starts + span) - np.searchsorted(hit, starts)
    return starts[held >= max(1, span - GRAM * most)]


class Items:
    """The items of one block: their words, sizes, runs and, for each size and repeat, the table of their keys.

    A size for which no number of repeats is enough has a table from each run to its items instead.
    """

    def __init__(self, ids: list, texts: list[str]):
        words = [word_hashes(t or "") for t in texts]
        kept = [i for i, w in enumerate(words) if len(w) >= LEAST_WORDS]
        self.ids = [ids[i] for i in kept]
        self.words = [words[i] for i in kept]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.sizes = [int(s) for s in np.unique(sizes)]
        self.runs: dict[int, np.ndarray] = {}
        self.keys: dict[int, list[dict[int, list[int]]]] = {}
        self.holders: dict[int, dict[int, list[int]]] = {}
        self.table = np.zeros(1 << TABLE_BITS, bool)
        for size in self.sizes:
            members = np.flatnonzero(sizes == size)
            block = np.stack([self.words[m] for m in members])
            self.runs[size] = np.unique(np.concatenate([runs(w) for w in block]))
            self.table[(self.runs[size] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            repeats = repeats_for(_grid(size))
            if not repeats:
                holders: dict[int, list[int]] = {}
                for member, words in zip(members.tolist(), block, strict=True):
                    for run in np.unique(runs(words)).tolist():
                        holders.setdefault(run, []).append(member)
                self.holders[size] = holders
                continue
            tables: list[dict[int, list[int]]] = [{} for _ in range(repeats)]
            for member, keys in zip(members.tolist(), embed(block, repeats).tolist(), strict=True):
                for table, key in zip(tables, keys, strict=True):
                    table.setdefault(key, []).append(member)
            self.keys[size] = tables
        self.every = np.unique(np.concatenate([*self.runs.values(), np.empty(0, np.uint64)]))

    def find(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, edits) of every item in a document: its nearest window, the first of several."""
        grams = runs(words)
        known = np.flatnonzero(self.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if len(known):
            known = known[self.every[np.minimum(np.searchsorted(self.every, grams[known]), len(self.every) - 1)] == grams[known]]
        best: dict[int, tuple[int, int]] = {}
        found: dict[int, list[int]] = {}
        for size in self.sizes if len(known) else []:
            own = self.runs[size]
            hit = known[own[np.minimum(np.searchsorted(own, grams[known]), len(own) - 1)] == grams[known]]
            if not len(hit):
                continue
            span, most = size - GRAM + 1, edits(size)
            if size in self.holders:
                places: dict[int, list[int]] = {}
                for at, run in zip(hit.tolist(), grams[hit].tolist(), strict=True):
                    for item in self.holders[size][run]:
                        places.setdefault(item, []).append(at)
                for item, own_places in places.items():
                    starts = _starts(np.array(own_places), span, most)
                    if len(starts):
                        found[item] = starts.tolist()
                continue
            starts = _starts(hit, span, most)
            for at in range(0, len(starts), 1024):  # bounds memory on long texts
                part = starts[at : at + 1024]
                places = part[:, None] + np.arange(size)[None, :]
                windows = np.where(places < len(words), words[np.minimum(places, len(words) - 1)], np.uint64(1))
                tables = self.keys[size]
                keys = embed(windows, len(tables)).tolist()
                pairs = {(row, item) for row, own_ in enumerate(keys) for table, key in zip(tables, own_, strict=True) if key in table for item in table[key]}
                for row, item in sorted(pairs):
                    found.setdefault(item, []).append(int(part[row]))
        for item, firsts in found.items():
            own, most = self.words[item], edits(len(self.words[item]))
            ends = [i for i in range(1, len(firsts)) if firsts[i] - firsts[i - 1] > len(own)]
            for run in np.split(np.array(firsts), ends):  # windows that overlap are one stretch of text
                begin = max(0, int(run[0]) - most)
                near, start = nearest(own, words[begin : int(run[-1]) + len(own) + most])
                if near <= most:
                    best[item] = min(best.get(item, (most + 1, 0)), (near, begin + start))
        return [(item, first, near) for item, (near, first) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> list[Items]:
    """The items in blocks of about BLOCK_BYTES; an item of any size is in exactly one."""
    benchmark = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    for block in range(count):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).distinct().orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if items.ids or block == count - 1:  # the last one counts the words if there are no items
            yield items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (``columns``, by default doc_id) with ``n_words`` and ``matches``.

    ``matches`` lists (item_id, first_word, edits) of every item that some passage
    of the document equals up to the edits that ``edits`` allows for its size (none for 5 words, 1 from 6, then one for each
    five words), sorted; whole texts are read.  At the most edits, 0.99 of the passages and more are found, at fewer
    edits nearly all, and copies all.  Null
    or empty texts match nothing, and so do items of fewer than LEAST_WORDS words, null items and null texts.
    Items that share an id are looked for each.  Repeated rows give repeated results, an empty table none;
    without items no row has a match.  Benchmarks of any size go through in blocks, one after the other, one pass over the documents each.
    """
    columns = columns or ["doc_id"]
    kinds = dict(docs.dtypes)
    result = docs.select(*columns, "text")
    names = [*columns, "text"]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in columns) + (", `text` string" if "text" not in columns else "")
    names = list(dict.fromkeys(names))
    result = docs.select(*names).withColumn("n_words", F.lit(0).cast("long")).withColumn("matches", F.array().cast("array<struct<item_id:long,first_word:long,edits:long>>"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int64())]))
    schema += ", n_words long, matches array<struct<item_id:long,first_word:long,edits:long>>"
    several = False
    for items in _blocks(benchmark):
        if several:  # only one block is held at a time
            result = stage(result, "benchmark-block")
        several = True

        def work(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            sizes, found = [], []
            for text, before in zip(texts_of(batch.column("text")), batch.column("matches"), strict=True):
                words = word_hashes(text)
                sizes.append(len(words))
                now = [{"item_id": items.ids[i], "first_word": first, "edits": near} for i, first, near in items.find(words)]
                found.append(sorted(before.as_py() + now, key=lambda m: (m["item_id"], m["first_word"], m["edits"])))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sizes, pa.int64()), pa.array(found, kind)], [*names, "n_words", "matches"]
            )

        result = arrow_map(result, work, schema)
    return result
