"""Fill-in-the-middle samples: texts cut in three at token boundaries and put together in another order.

A wavelet matrix over character classes answers how many tokens begin before any
character; bisection on these counts finds the characters at which the two cuts fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import map_batches
from ebbline.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 draws so many stay plain, and of those cut so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Classes of characters: a token begins at every character but a letter that follows a letter.
INNER, FIRST, SPACE, OTHER = range(4)
#: Code points that share one wavelet matrix, unless a single text is longer.
SLICE = 1 << 20


def classes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every code point of texts that lie behind one another from ``starts`` on."""
    letter = ((codes | 32) >= ord("a")) & ((codes | 32) <= ord("z")) & (codes < 128)
    follows = np.zeros(len(codes), bool)
    follows[1:] = letter[:-1]
    follows[starts[starts < len(codes)]] = False
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.where(letter, np.where(follows, INNER, FIRST), np.where(space, SPACE, OTHER)).astype(np.uint8)


class Boundaries:
    """Counts and places of token beginnings in a sequence of classes."""

    def __init__(self, kinds: np.ndarray):
        self.matrix = WaveletMatrix(kinds, 2)

    def before(self, places: np.ndarray) -> np.ndarray:
        """The tokens that begin before each place."""
        return sum(self.matrix.rank(kind, places) for kind in (FIRST, SPACE, OTHER))

    def cut(self, starts: np.ndarray, stops: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Where each text has ``tokens`` tokens behind it: the beginning of the next one, or the end.

        That is the last place before which no more than ``tokens`` begin, found by halving the text.
        """
        wanted = self.before(starts) + tokens
        low, high = starts.copy(), stops.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.before(middle) <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _cuts(texts: list[str], draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of tokens, and the code points before the earlier and the later cut."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    stops = np.cumsum([len(c) for c in codes], dtype=np.int64)
    starts = stops - np.array([len(c) for c in codes], np.int64)
    found = Boundaries(classes(np.concatenate(codes), starts))
    n = found.before(stops) - found.before(starts)
    one, two = (d % (n + 1) for d in draws)
    return n, *(found.cut(starts, stops, tokens) - starts for tokens in (np.minimum(one, two), np.maximum(one, two)))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows, each of at most SLICE characters or of one row, with the place of their first."""
    first, texts, size = 0, [], 0
    for at, value in enumerate(batch.column("text")):
        text = value.as_py() or ""
        if texts and size + len(text) > SLICE:
            yield first, texts
            first, texts, size = at, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
        for first, texts in _slices(batch):
            rows = slice(first, first + len(texts))
            n, low, high = _cuts(texts, [h[0][rows], h[1][rows]])
            forms, prefixes, middles, outputs = [], [], [], []
            for text, a, b, chance, order in zip(texts, low.tolist(), high.tolist(), h[2][rows] % 100, h[3][rows] % 100):
                if not text or chance >= 100 - PLAIN or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                first_suffix = order < SUFFIX_FIRST
                forms.append("spm" if first_suffix else "psm")
                prefixes.append(a)
                middles.append(b - a)
                head = f"{SUFFIX}{suffix}{PREFIX}{prefix}" if first_suffix else f"{PREFIX}{prefix}{SUFFIX}{suffix}"
                outputs.append(f"{head}{MIDDLE}{middle}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    ``n`` counts the tokens, runs of the letters A-Z and a-z or single other
    characters, of the whole text.  Two draws from the SHA-256 of ``seed:doc_id`` cut it at token
    boundaries into prefix, middle and suffix; two more choose the form.  ``plain`` leaves the
    text as it is, with null lengths: an empty text, one that holds a mark already, and one in ten others.
    ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle, each behind its mark; lengths are code points.

    A null text is empty; a null doc_id draws as an empty one.  Rows that repeat a doc_id share their
    draws and all stay.  Other columns are ignored, an empty table gives no rows.  Texts of any length
    are cut whole, in slices of bounded size.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(1, 5)]
    return map_batches(
        docs.select("doc_id", "text", *draws), _assemble,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that a sample was made from, from the sample and its form alone.

    A text that is cut holds no mark, and none can arise where a part meets a mark, for marks
    begin with the only ``<`` they have; so the marks split the sample into its parts.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = (F.when(form == "psm", parts[at]).otherwise(parts[3 - at]) for at in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
