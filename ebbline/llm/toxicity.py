"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

The lexicon holds beginnings of words with a weight each: a few stated ones, and those that
the labelled documents teach.  Matches inside an exception phrase do not count.
The weight found, normalised by the length of the text, becomes a probability by a
logistic calibration on labelled documents that the lexicon was not learned from.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import map_batches, smallest, stage, texts_of

#: Labelled documents that teach the lexicon and the calibration: at most so many, those of smallest hash.
TRAIN_DOCS = 20_000
#: The lengths of the word beginnings that can become an entry.
SHORTEST, LONGEST = 3, 9
#: An entry needs this lower bound of its log-odds.
LEAST_WEIGHT = 1.5
#: Score from which a document counts as toxic.
CUT = 0.3

#: Stated entries and their weight; labels overrule them.
SEED_WEIGHT = 3.0
SEEDS = (
    "idiot", "moron", "imbecile", "stupid", "dumbass", "loser", "scum", "pathetic", "worthless", "disgusting",
    "trash", "clown", "bastard", "asshole", "bitch", "cunt", "faggot", "retard", "slut", "whore", "wanker", "subhuman",
)
#: Phrases whose words do not count.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum",
    "sore loser", "stupid question", "disgusting taste",
)
#: Letters of other scripts that look like these.
LOOKALIKES = {
    "a": "аαɑ", "b": "ьв", "c": "сϲ", "d": "ԁ", "e": "еε℮", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏⅼ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
#: Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_FOLDS = {ord(c): letter for letter, others in LOOKALIKES.items() for c in others} | dict.fromkeys(
    [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]  # invisible signs go
)
_MARKS = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_DIGIT = re.compile(r"(?<=[^\W\d_])[0134578]|[0134578](?=[^\W\d_])|(?<=[^\W_])[@$](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")
#: Four and more single letters with the same sign between them.
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([\W_])(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])")


def fold(text: str) -> str:
    """Lower-case words between single spaces, with disguises undone.

    Compatible forms (bold, circled, full-width letters) become plain letters, accents and other marks go, lookalikes of
    other scripts, digits and signs inside of words become the letters they stand for, and letters that are spelled out one by one a word.
    """
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_FOLDS)
    text = _DIGIT.sub(lambda m: DIGITS[m[0]], text.lower())
    text = _SPELLED.sub(lambda m: m[0].replace(m[1], ""), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Weights of word beginnings, and the coefficients of the calibration."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    coefficients: tuple[float, ...] = (-3.0, 2.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase), None))
        found.make_automaton()
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.coefficients), -30, 30)))


def match(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """(sum of weights, words matched, words) of a folded text; of entries that begin at one place the heaviest counts."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        if weight is None:
            spared.append((end - length - 1, end - 1))
        else:
            start = end - length
            best[start] = max(weight, best.get(start, 0.0))
    if spared and best:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
    return sum(best.values()), len(best), folded.count(" ") - 1 if len(folded) > 2 else 0


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Constant, weight of the text, weight per hundred words; both damped."""
    return np.column_stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (words + 20))])


def _matches(docs: DataFrame, lexicon: Lexicon, names: list[str]) -> DataFrame:
    """The named columns as c0, c1, ... (their names may be those of the scores) with weight, hits, n_words and score."""
    kinds = dict(docs.dtypes)
    columns = list(dict.fromkeys([*names, "text"]))
    schema = "".join(f"c{i} {kinds[n]}, " for i, n in enumerate(names)) + "weight double, hits long, n_words long, score double"

    def work(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [match(fold(t), automaton) for t in texts_of(batch.column("text"))]
            weight, hits, words = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0),) * 3
            score = lexicon.score(features(weight, words)) if rows else weight
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(weight, pa.float64()), pa.array(hits.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(score, pa.float64())],
                [*(f"c{i}" for i in range(len(names))), "weight", "hits", "n_words", "score"],
            )

    return map_batches(docs.select(*columns), work, schema)


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents with a word that begins so, by label."""

    def flush(counts: dict[int, Counter]) -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_pydict({
            "term": pa.array(terms, pa.string()), "toxic": pa.array([counts[1][t] for t in terms], pa.int64()), "clean": pa.array([counts[0][t] for t in terms], pa.int64()),
        })
        for counter in counts.values():
            counter.clear()
        return batch

    def work(batches):
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = set(fold(text).split())
                counts[toxic].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield flush(counts)
        yield flush(counts)

    rows = map_batches(docs.select("text", "toxic"), work, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn weights and calibration from ``labels`` (doc_id, toxic 0 or 1).

    At most TRAIN_DOCS labelled documents are read, those of smallest hash.  Three fifths of
    them teach the lexicon, the rest the calibration.  Rows without an id or a
    label are left out; of several labels of one document the highest counts.  Words are learned by their first
    LONGEST letters; every beginning with evidence becomes an entry.
    Without documents of both labels the stated entries and coefficients stay.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = smallest(known, "doc_id", 9, TRAIN_DOCS).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(5)) < 2)
    sample = stage(sample, "toxicity-sample")
    taught = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxicity-texts")  # at most TRAIN_DOCS ids
    sizes = {(r["toxic"], r["calibrates"]): r["count"] for r in taught.groupBy("toxic", "calibrates").count().collect()}
    toxic, clean = sizes.get((1, False), 0), sizes.get((0, False), 0)
    lexicon = Lexicon()
    if not toxic or not clean:
        return lexicon
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / (toxic + 1.0)) - F.log(c / (clean + 1.0))
    bound = weight - 1.64 * F.sqrt(1 / t + 1 / c)
    terms = _term_counts(taught.where("NOT calibrates")).withColumn("bound", bound)
    seeds = [s[:LONGEST] for s in SEEDS]
    wanted = (F.col("toxic") >= max(3, toxic // 250)) & (F.col("bound") >= LEAST_WEIGHT)
    rows = terms.where(wanted).collect()  # bounded by the words of TRAIN_DOCS documents, of which few mark toxic ones
    doubtful = terms.where(F.col("term").isin(seeds) & (F.col("toxic") + F.col("clean") >= 20)).collect()
    for row in doubtful:  # a stated entry with evidence takes the learned weight, or goes
        for seed in [s for s in lexicon.weights if s[:LONGEST] == row["term"]]:
            del lexicon.weights[seed]
    for row in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        shorter = max((lexicon.weights.get(row["term"][:k], 0.0) for k in range(SHORTEST, len(row["term"]))), default=0.0)
        if shorter < row["bound"] - 0.5:  # else a beginning of it says as much
            lexicon.weights[row["term"]] = float(row["bound"])
    if sizes.get((1, True)) and sizes.get((0, True)):
        seen = _matches(taught.where("calibrates"), lexicon, ["toxic"]).toArrow()  # at most TRAIN_DOCS rows
        weight, words, label = (seen.column(n).to_numpy().astype(float) for n in ("weight", "n_words", "c0"))
        lexicon.coefficients = tuple(_logistic(features(weight, words), label))
    return lexicon


def held_out():
    """Documents whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, weight, hits, n_words) for every row.

    A null or empty text has no weight and gets the score of that.  Texts are
    read whole.  Repeated rows are scored alike, an empty table gives no rows, other columns are ignored.
    """
    scored = _matches(docs, lexicon, ["doc_id"])
    return scored.select(F.col("c0").alias("doc_id"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "weight", "hits", "n_words")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that are not held out, then score all documents."""
    lexicon = fit(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))
    return score_toxicity(docs, lexicon).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not judged toxic, with all their columns."""
    lexicon = fit(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))
    scored = stage(_matches(docs, lexicon, docs.columns).where(F.col("score") < CUT), "toxicity-kept")  # whole texts, in small batches
    return scored.drop("weight", "hits", "n_words", "score").toDF(*docs.columns)
