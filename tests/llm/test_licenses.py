from __future__ import annotations

import itertools
import re

import pytest

from ebbline.llm.licenses import BASE, HINT, NAMED, STRONG, Rule, _spaced, build_rules, gate, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, rules):
    """What the scan returns, by plain loops over words."""
    words = words_of(text)
    spaced = "".join(f" {w} " for w in words)
    found = []
    for number, r in enumerate(rules):
        if " " + _spaced(r.keyword) in spaced:
            for m in re.finditer(" (?:" + _spaced(r.pattern) + ") ", spaced):
                first = spaced[: m.start()].count(" ") // 2
                found.append((first, first + m[0].count(" ") // 2 - 1, r.priority, number, r.label, r.base))
    kept = [
        d for d in found
        if not any(
            e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3]) for e in found
        )
    ]
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    return (
        len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), max(({3: 1.0, 2: 0.8, 1: 0.5}[d[2]] for d in kept), default=0.0),
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.  ALL RIGHTS RESERVED",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc by cc-by",
    "SPDX-License-Identifier: BSD-3-Clause", "mit der Lizenz", "Copyright (c) 2020 by A. All rights reserved. MIT License", None, "", "...", "ÄÖ cc by ß",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "GPLv2 gpl v3 gpl version 2", "general\x00public\x7flicense", "the lesser general public licence 2.1 applies",
    "x " * 3000 + "all rights reserved " * 400 + "Apache License 2.0",
]


def test_scan_equals_plain_loops(spark, documents):
    rules = build_rules()
    got = {r["doc_id"]: tuple(r)[1:8] for r in scan_licenses(documents(TEXTS)).collect()}
    assert got == {i: brute(t, rules) for i, t in enumerate(TEXTS)}


def test_labels_and_spans(spark, documents):
    rows = {r["doc_id"]: r for r in scan_licenses(documents(TEXTS)).collect()}
    assert rows[0]["labels"] == "apache-2.0" and rows[0]["score"] == 1.0
    assert rows[1]["labels"] == "mit" and rows[6]["labels"] == "bsd-3-clause"
    assert rows[3]["labels"] == "gpl,gpl-3.0" and rows[3]["base_labels"] == "gpl"
    assert rows[4]["labels"] == "cc-by,cc-by-nc-4.0" and rows[5]["n_base"] == 3 and rows[7]["labels"] == ""
    assert [(d["first"], d["last"], d["label"]) for d in rows[0]["detections"]] == [(0, 7, "apache-2.0")]


def test_priority_and_containment(spark, documents):
    rules = [Rule("wide", "a", "a b c d", HINT), Rule("strong", "a", "a b", STRONG), Rule("named", "b", "b c", NAMED), Rule("inner", "c", "c", HINT), Rule("twin", "a", "a b", STRONG)]
    (row,) = scan_licenses(documents(["a b c d"]), rules).collect()
    assert [d["label"] for d in row["detections"]] == ["wide", "strong", "named"]  # the inner hint lies in a wider one, the twin comes later


def test_rules_and_edges(spark, documents, empty):
    rules = build_rules()
    assert len(rules) >= 300 and len(set(rules)) == len(rules)
    for r in rules:  # every match of a name holds its keyword, and no rule matches nothing
        assert not re.fullmatch(_spaced(r.pattern), "")
    assert scan_licenses(empty("doc_id long, text string")).collect() == []
    rows = scan_licenses(documents([(1, "mit license"), (1, "mit license"), (None, "mit license")])).collect()
    assert [r["labels"] for r in rows] == ["mit"] * 3


@pytest.mark.parametrize("rule", [r for r in build_rules() if r.priority == STRONG][::7], ids=lambda r: r.pattern[-40:])
def test_keyword_is_part_of_the_simplest_match(rule):
    """Keep the first choice of each group and drop the optional ones: the shortest text of the rule."""
    text = rule.pattern
    while (shorter := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?|\{0,\d\})?", lambda m: "" if m[2] else m[1], text)) != text:
        text = shorter
    text = re.sub(r"\[(.)[^\]]*\](?:\{\d\}|\*|\+)?", r"\1", text).replace(" ?", " ").strip()
    assert re.search(" " + _spaced(rule.keyword), "".join(f" {w} " for w in text.split())), text


def expansions(items):
    """Every text of a parsed pattern: all alternatives, with and without what is optional; any other word is x."""
    texts = [""]
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = ["x"] if str(value[0][0]) == "NEGATE" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "SUBPATTERN":
            more = expansions(value[3])
        elif name == "BRANCH":
            more = [t for branch in value[1] for t in expansions(branch)]
        else:
            assert name == "MAX_REPEAT", name
            low, high, inner = value
            more = ["".join(p) for n in {low, min(high, low + 1)} for p in itertools.product(expansions(inner), repeat=n)]
        texts = [a + b for a in texts for b in more]
    return texts


def test_every_alternative_passes_its_gates():
    rules = build_rules()
    literals = gate(rules)
    for rule in rules:
        pattern = " (?:" + _spaced(rule.pattern) + ") "
        for text in set(expansions(re._parser.parse(pattern))):
            assert re.fullmatch(pattern, text)
            assert " " + _spaced(rule.keyword) in text, (rule, text)
            assert any(literal in text for literal in literals), (rule, text)


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("the FreeBSD license", "bsd-2-clause", 0.8), ("licensed under the FreeBSD License", "bsd-2-clause", 1.0), ("for noncommercial use only", "non-commercial", 1.0),
    ("for non-commercial use only", "non-commercial", 1.0), ("All rights are reserved.", "reserved", 0.8), ("some rights reserved", "reserved", 0.8),
])
def test_phrases_without_the_usual_keyword(spark, documents, text, labels, score):
    (row,) = scan_licenses(documents([text])).collect()
    assert (row["labels"], row["score"]) == (labels, score)
