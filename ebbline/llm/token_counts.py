"""Greedy longest-match token counts by a linear automaton, without building the tokens.

A trie of the vocabulary gets failure links and, with each link, the number of tokens that
following it completes.  Reading a word moves through the trie once; where no longer
match exists, the failure link pops whole tokens by adding their number.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ebbline.llm.common import map_batches, texts_of

#: Where the vocabulary lies on the driver, which sends it to the workers; a parameter, never copied.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256  # the symbol after the last byte of a word
#: Words: contractions, letters, single digits, and runs of other signs.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Distinct words whose length is remembered at once.
REMEMBERED = 500_000


def _byte_of() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    return entries_of(Path(path).read_text(encoding="utf-8"))


def entries_of(vocabulary: str) -> list[tuple[int, ...]]:
    """Every entry as bytes, with END after an entry that closes a word; special entries are left out."""
    bytes_, found = _byte_of(), []
    for name in json.loads(vocabulary)["model"]["vocab"]:
        closes = name.endswith("</w>")
        body = name.removesuffix("</w>") if closes else name
        if body and all(c in bytes_ for c in body) and not (body.startswith("<|") and body.endswith("|>")):
            found.append((*(bytes_[c] for c in body), *((END,) if closes else ())))
    return found


class Automaton:
    """Trie with failure links; ``count`` gives the number of greedy longest-match tokens, or None."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for entry in entries:
            node = 0
            for symbol in entry:
                step = self.next[node].get(symbol)
                if step is None:
                    step = len(self.next)
                    self.next[node][symbol] = step
                    self.next.append({})
                    whole.append(False)
                node = step
            whole[node] = True
        size = len(self.next)
        self.fail, self.pops, self.whole = [-1] * size, [0] * size, whole
        queue = [0]
        for node in queue:  # breadth first: links of shorter strings come first
            for symbol, child in self.next[node].items():
                queue.append(child)
                if whole[child]:
                    self.fail[child], self.pops[child] = 0, 1  # the string is a token: pop it
                elif node:
                    # the greedy tokens of the string's beginning, then on from what remains of it
                    state, popped = self.fail[node], self.pops[node]
                    while state >= 0 and symbol not in self.next[state]:
                        popped += self.pops[state]
                        state = self.fail[state]
                    if state >= 0:
                        self.fail[child], self.pops[child] = self.next[state][symbol], popped

    def count(self, symbols) -> int | None:
        """None where greedy matching gets stuck: a symbol that no token starts with."""
        state, tokens, next_, fail, pops = 0, 0, self.next, self.fail, self.pops
        for symbol in symbols:
            while (step := next_[state].get(symbol)) is None:
                tokens += pops[state]
                state = fail[state]
                if state < 0:
                    return None
                if not state and symbol not in next_[0]:
                    return None
            state = step
        while state:
            tokens += pops[state]
            state = fail[state]
            if state < 0:
                return None
        return tokens


@lru_cache(maxsize=2)
def automaton_of(vocabulary: str) -> Automaton:
    """Built once in each Python worker, which serves many tasks."""
    return Automaton(entries_of(vocabulary))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row.

    A word is lower-cased and cut into the longest vocabulary entries from its start; its last entry must close it.
    A word that cannot be cut counts as one unknown token.  Null and empty texts have no words.
    Whole texts are read; repeated rows are counted each, an empty table gives no rows, other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))  # a few MB, whatever the documents

    def work(batches):
        automaton, known = automaton_of(shared.value), {}
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("text")):
                tokens = unknown = total = 0
                for word, times in Counter(words_of(text)).items():
                    size = known.get(word, 0)
                    if not size:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = automaton.count((*word.encode("utf-8", "surrogatepass"), END))
                        size = known[word] = -1 if found is None else found
                    total += times
                    tokens += times * max(size, 1)
                    unknown += times * (size < 0)
                rows.append((total, tokens, unknown))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_words long, n_tokens long, n_unknown long")
