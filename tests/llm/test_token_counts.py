from __future__ import annotations

import random

from ebbline.llm.token_counts import END, Automaton, count_tokens, read_vocabulary, words_of


def greedy(symbols, entries):
    """Longest match from the left, by trying every length."""
    tokens, at = 0, 0
    while at < len(symbols):
        for end in range(len(symbols), at, -1):
            if tuple(symbols[at:end]) in entries:
                break
        else:
            return None
        tokens, at = tokens + 1, end
    return tokens


def test_automaton_equals_greedy_matching_on_small_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        entries = {tuple(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = Automaton(sorted(entries))
        for _ in range(30):
            word = rng.choices("abc", k=rng.randint(0, 12))
            assert automaton.count(word) == greedy(word, entries), (entries, word)


def test_automaton_equals_greedy_matching_on_the_vocabulary():
    listed = read_vocabulary()
    entries, automaton = set(listed), Automaton(listed)
    rng = random.Random(6)
    assert len(entries) > 49_000 and all((b,) in entries for b in range(256))
    for _ in range(400):
        parts = [bytes(s for s in rng.choice(listed) if s != END) for _ in range(rng.randint(1, 4))]
        word = [*b"".join(parts), END]
        assert automaton.count(word) == greedy(word, entries)


def test_counts_of_whole_texts(spark, documents, empty):
    listed = read_vocabulary()
    entries = set(listed)
    texts = ["The cat's hat, 42!", None, "", " \n\t", "Ünïcode ÄÖ 漢字 naïve", "x" * 5000, "hello " * 3000, "the the"]
    rows = {r["doc_id"]: r for r in count_tokens(documents([*enumerate(texts), (7, "the the"), (None, "a")])).collect()}
    for i, text in enumerate(texts):
        counts = [greedy([*w.encode(), END], entries) if len(w) < 100 else None for w in words_of(text or "")]
        assert rows[i]["n_words"] == len(counts)
        if None not in counts:
            assert rows[i]["n_tokens"] == sum(counts) and rows[i]["n_unknown"] == 0
    assert words_of("The cat's 42!") == ["the", "cat", "'s", "4", "2", "!"]
    assert rows[None]["n_tokens"] == 1
    assert count_tokens(empty("doc_id long, text string")).collect() == []
