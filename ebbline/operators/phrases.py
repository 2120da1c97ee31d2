"""Scoring texts by a table of phrases that is too large to go to every task.

Texts are packed into blocks.  A block asks for each of its phrases once, by 32 bits of a hash; what may be meant comes back as
text and is compared word by word, so equal hashes change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.session import staged

# The functions below are sent to the workers with their code, which therefore need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a block, but for longer texts; bytes of the table and of what is asked that one task looks through.
BLOCK_WORDS, TABLE_BYTES, ASKED_BYTES = 1 << 20, 8 << 20, 32 << 20
#: Rows that a worker gets at once, for some texts are very long.
BATCH_ROWS = 500
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def stage(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``, in small batches, and what was shuffled for it is deleted; afterwards the session is as it was."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        conf.set(k, v)
    try:
        return staged(df, name, compression="zstd")
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


# ── hashes ──────────────────────────────────────────────────────────────────


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class _Runs:
    """Hashes of runs of numbers, each from sums of its beginning and its end."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(values))

    def hashes(self, begins: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        h = (self.sums[begins + sizes] - self.sums[begins]) * self.back[begins]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """``words`` are not empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = pa.concat_arrays([words.cast(pa.large_string())])
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)
    return _Runs(data).hashes(offsets[:-1] - offsets[0], np.diff(offsets))


def _split(entries: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the entries, where each entry begins and how many it has."""
    lists = pc.split_pattern(entries.cast(pa.large_string()), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(sizes) - sizes, sizes


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _raw(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _joined(texts: pa.Array) -> bytes:
    return _pressed("\n".join(texts.to_pylist()).encode())


def _texts(data: bytes) -> pa.Array:
    return pc.split_pattern(pa.scalar(_raw(data), pa.large_binary()).cast(pa.large_string()), "\n").values


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_raw(data), kind)


# ── blocks of texts ─────────────────────────────────────────────────────────


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(rows, their sizes, all their words) of about ``most`` words at most, but for longer texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            sizes = pc.fill_null(pc.list_value_length(part.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                lists = part.column("words").slice(begin, end - begin)
                if sizes[begin:end].any():
                    yield part.column("_row").to_numpy()[begin:end], sizes[begin:end], lists.flatten().dictionary_encode()


def in_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, pa.DictionaryArray]]:
    """Batches (_row, words) by blocks of texts with words: rows, how many words each has, and all their words."""

    def whole(held: list) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        words = pa.chunked_array([w for _, _, w in held]).unify_dictionaries().combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        return *(np.concatenate([x[k] for x in held]) for k in (0, 1)), words

    held, size = [], 0
    for piece in _pieces(batches, most):
        if held and size + len(piece[2]) > most:
            yield whole(held)
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield whole(held)


def _blocks(words: DataFrame) -> DataFrame:
    """Texts by blocks: rows, how many words each has, the different words, and of all words which of them."""
    most = BLOCK_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for block, (rows, sizes, words) in enumerate(in_blocks(batches, most), first):
            columns = {"rows": rows.astype(np.int64), "sizes": sizes, "codes": words.indices.to_numpy().astype(np.int32)}
            columns = {k: _pressed(v.tobytes()) for k, v in columns.items()} | {"words": _joined(words.dictionary)}
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), **{k: pa.array([columns[k]], pa.binary()) for k in ("rows", "sizes", "words", "codes")},
                "n": pa.array([len(words)], pa.int64()),
            })

    return words.mapInArrow(work, "block long, rows binary, sizes binary, words binary, codes binary, n long")


class _Block:
    """One block unpacked: ``codes`` of all words, and of each the place where its text begins and ends."""

    def __init__(self, rows: bytes, sizes: bytes, words: bytes, codes: bytes):
        self.rows, self.words, self.codes = _numbers(rows, np.int64), _texts(words), _numbers(codes, np.int32)
        sizes = _numbers(sizes, np.int64)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.cumsum(sizes)[self.text]
        self.begin = self.end - sizes[self.text]
        self.places = np.arange(len(self.codes))
        self.hashed = _word_hashes(self.words)
        self.runs = _Runs(self.hashed[self.codes])

    def hashes(self, n: int) -> np.ndarray:
        """Of all phrases of ``n`` words; of single words each once."""
        return _Runs(self.hashed).hashes(np.arange(len(self.hashed)), 1) if n == 1 else self.phrases(n)[1]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of ``n`` words begin, and their hashes."""
        begins = np.flatnonzero(self.places + n <= self.end)
        return begins, self.runs.hashes(begins, n)


def _unpacked(batch: pa.RecordBatch | pa.Table, i: int) -> _Block:
    return _Block(*(batch.column(k)[i].as_py() for k in ("rows", "sizes", "words", "codes")))


# ── asking and answering ────────────────────────────────────────────────────


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 32 bits of each hash as one number."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _runs_of(dealt: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of numbers that ascend."""
    buckets, begins = np.unique(dealt >> np.uint64(32), return_index=True)
    yield from zip(buckets.tolist(), begins.tolist(), [*begins[1:].tolist(), len(dealt)], strict=True)


def _asked(blocks: DataFrame, lengths: list[int], buckets: int) -> DataFrame:
    """(bucket, block, prints): the phrases of each block once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _unpacked(batch, i)
                asked = np.unique(_dealt(np.concatenate([block.hashes(n) for n in lengths]), buckets))
                prints, runs = asked.astype(np.uint32), list(_runs_of(asked))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _, _ in runs], pa.int64()), "block": pa.array([batch.column("block")[i].as_py()] * len(runs), pa.int64()),
                    "prints": pa.array([prints[a:b].tobytes() for _, a, b in runs], pa.binary()),
                })

    return blocks.mapInArrow(work, "bucket long, block long, prints binary")


def _listed(entries: DataFrame, buckets: int) -> DataFrame:
    """(bucket, prints, weights, entries): the table, many entries to a row."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts, weights = pa.concat_arrays(table.column("entry").chunks), table.column("weight").to_numpy()
        words, begins, sizes = _split(texts)
        dealt = _dealt(_Runs(_word_hashes(words)).hashes(begins, sizes), buckets)
        order = np.argsort(dealt)
        dealt, texts, weights = dealt[order], texts.take(pa.array(order)), weights[order]
        prints, runs = dealt.astype(np.uint32), list(_runs_of(dealt))
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([k for k, _, _ in runs], pa.int64()), "prints": pa.array([prints[a:b].tobytes() for _, a, b in runs], pa.binary()),
            "weights": pa.array([_pressed(weights[a:b].tobytes()) for _, a, b in runs], pa.binary()),
            "entries": pa.array([_joined(texts.slice(a, b - a)) for _, a, b in runs], pa.binary()),
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > TABLE_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return entries.select("entry", "weight").mapInArrow(work, "bucket long, prints binary, weights binary, entries binary")


def _answered(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """(block, entries, weights): the entries whose bits a block asked for."""

    def work(asked: pa.Table, listed: pa.Table) -> pa.Table:
        answers: dict[str, list] = {"block": [], "entries": [], "weights": []}
        if asked.num_rows and listed.num_rows:
            prints, weights = (np.concatenate([np.frombuffer(x, k) for x in parts]) for parts, k in (
                (listed.column("prints").to_pylist(), np.uint32), (map(_raw, listed.column("weights").to_pylist()), np.float64)))
            texts = pa.concat_arrays([_texts(x.as_py()) for x in listed.column("entries")])
            order = np.argsort(prints, kind="stable")
            prints = prints[order]
            for block, wanted in zip(asked.column("block").to_pylist(), asked.column("prints"), strict=True):
                wanted = np.frombuffer(wanted.as_py(), np.uint32)
                first = np.searchsorted(prints, wanted)
                there = prints[np.minimum(first, len(prints) - 1)] == wanted
                first = first[there]
                many = np.searchsorted(prints, wanted[there], "right") - first
                if len(first):
                    found = order[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    answers["block"].append(block)
                    answers["entries"].append(_joined(texts.take(pa.array(found))))
                    answers["weights"].append(_pressed(weights[found].tobytes()))
        return pa.Table.from_pydict(answers, schema=pa.schema([("block", pa.int64()), ("entries", pa.binary()), ("weights", pa.binary())]))

    return asked.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInArrow(work, "block long, entries binary, weights binary")


# ── scores ──────────────────────────────────────────────────────────────────


def _hits(block: _Block, entries: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where entries begin and end in the block, and their weights; an entry inside a longer one is left out."""
    words, begins, sizes = _split(entries)
    codes = pc.fill_null(pc.index_in(words, value_set=block.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = _Runs(_word_hashes(words))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        if n == 1:
            of = of[codes[begins[of]] >= 0]
            entry = np.full(len(block.words), -1)
            entry[codes[begins[of]]] = of
            entry = entry[block.codes]
            at = np.flatnonzero(entry >= 0)
            found.append((at, at + 1, weights[entry[at]]))
            continue
        hashes = runs.hashes(begins[of], n)
        order = np.argsort(hashes)
        of, hashes = of[order], hashes[order]
        at, wanted = block.phrases(n)
        first = np.searchsorted(hashes, wanted)
        while len(at):  # once for each entry of the same hash
            near = first < len(hashes)
            near[near] = hashes[first[near]] == wanted[near]
            at, wanted, first = at[near], wanted[near], first[near]
            entry = of[first]
            same = np.ones(len(at), bool)
            for k in range(n):
                same &= block.codes[at + k] == codes[begins[entry] + k]
            found.append((at[same], at[same] + n, weights[entry[same]]))
            at, wanted, first = at[~same], wanted[~same], first[~same] + 1
    begin, end, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-end, begin))
    begin, end, weight = begin[order], end[order], weight[order]
    covered = np.concatenate([np.full(1, -1), np.maximum.accumulate(end)[:-1]]) if len(end) else end
    outer = covered < end
    return begin[outer], end[outer], weight[outer]


def _means(block: _Block, entries: pa.Array, weights: np.ndarray, intensifiers: Mapping[str, float], negators: Sequence[str], negation: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, mean) of the texts in which entries were found."""
    begin, _, weight = _hits(block, entries, weights)
    words = pa.concat_arrays([block.words, pa.array([""], block.words.type)])  # the last stands for no word
    strong = pc.fill_null(pc.index_in(words, value_set=pa.array(list(intensifiers), words.type)), -1).to_numpy(zero_copy_only=False)
    factors = np.array([*map(float, intensifiers.values()), 1.0])[strong]
    negates = pc.is_in(words, value_set=pa.array(list(negators), words.type)).to_numpy(zero_copy_only=False)
    before, second = (np.where(begin - k >= block.begin[begin], block.codes[np.maximum(begin - k, 0)], len(words) - 1) for k in (1, 2))
    turned = negates[before] | ((strong[before] >= 0) & negates[second])
    with np.errstate(invalid="ignore"):
        score = weight * (factors[before] * np.where(turned, negation, 1.0))
    score = np.where(np.isnan(score), 1.0, np.clip(score, -1.0, 1.0))  # Spark takes NaN for greater than any number
    text = block.text[begin]
    number = np.bincount(text, minlength=len(block.rows))
    with np.errstate(invalid="ignore"):
        mean = np.bincount(text, score, len(block.rows)) / number
    return block.rows[number > 0], mean[number > 0]


def means_by_table(words: DataFrame, entries: DataFrame, size: int, lengths: list[int], intensifiers: Mapping[str, float], negators: Sequence[str], negation: float) -> DataFrame:
    """(_row, _mean) of ``words`` (_row, words) in which entries (entry, weight) are found, for a table of ``size`` bytes whose entries have ``lengths`` words.

    What is shuffled is packed, and deleted as soon as its result is staged.
    """
    blocks = stage(_blocks(words), "text-blocks")
    asked = 4 * len(lengths) * (blocks.agg(F.sum("n")).first()[0] or 0)
    buckets = max(1, size // TABLE_BYTES, asked // ASKED_BYTES)
    answers = stage(_answered(_asked(blocks, lengths, buckets), _listed(entries, buckets)), "text-answers")

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not (rows.num_rows and found.num_rows):
            row, mean = np.empty(0, np.int64), np.empty(0)
        else:
            texts = pa.concat_arrays([_texts(x.as_py()) for x in found.column("entries")])
            weights = np.concatenate([_numbers(x.as_py(), np.float64) for x in found.column("weights")])
            row, mean = _means(_unpacked(rows, 0), texts, weights, intensifiers, negators, negation)
        return pa.Table.from_pydict({"_row": pa.array(row, pa.int64()), "_mean": pa.array(mean, pa.float64())})

    return stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, "_row long, _mean double"), "text-means")
