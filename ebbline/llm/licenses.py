"""License detection by ordered signature rules over normalised words, in DataFrame functions only.

A text becomes its lower-case words, each between two spaces of its own, so
that a rule is a regular expression over whole words and neighbouring matches
share nothing.  Rules run only on texts that contain their keyword.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import LOWER, UPPER

#: Everything in ASCII that is neither digit nor (lower-case) letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks of the first and the last word of a match; no word contains them.
OPEN, CLOSE = "\x01", "\x02"
STRONG, NAMED, HINT = 3, 2, 1
CONFIDENCE = {STRONG: 1.0, NAMED: 0.8, HINT: 0.5}

#: The phrases every caller gets: (phrase, label).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, keyword, name, identifier): keyword begins a word in every text that the name matches, whichever alternative it takes; identifier is that of a license tag.
_V = "(?:version |v ?)?"
FAMILIES = (
    ("apache-1.0", "apache", "apache (?:software )?licen[sc]e " + _V + "1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e " + _V + "1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e " + _V + "2(?: 0)?", "apache 2 0"),
    ("mit", "mit lic", "mit licen[sc]e", "mit"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("expat", "expat", "expat licen[sc]e", "expat"),
    ("isc", "isc lic", "isc licen[sc]e", "isc"),
    ("0bsd", "zero", "(?:bsd )?zero clause(?: bsd)? licen[sc]e", "0bsd"),
    ("bsd-2-clause", "licen", "(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) licen[sc]e", "bsd 4 clause"),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", "bsd"),
    ("gpl-1.0", "general public lic", "(?:gnu )?general public licen[sc]e " + _V + "1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public lic", "(?:gnu )?general public licen[sc]e " + _V + "2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public lic", "(?:gnu )?general public licen[sc]e " + _V + "3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general public lic", "(?:gnu )?general public licen[sc]e", "gpl"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: )?" + _V + "2(?: 0)?", "gplv2"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: )?" + _V + "3(?: 0)?", "gplv3"),
    ("lgpl-2.0", "lesser general", "(?:gnu )?lesser general public licen[sc]e " + _V + "2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[sc]e " + _V + "2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public licen[sc]e " + _V + "3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "lgpl"),
    ("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", "lgplv2"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[sc]e(?: " + _V + "3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-1.0", "affero", "affero general public licen[sc]e " + _V + "1(?: 0)?", "agpl 1 0"),
    ("gfdl-1.1", "free documentation", "(?:gnu )?free documentation licen[sc]e " + _V + "1 1", "gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "free documentation", "(?:gnu )?free documentation licen[sc]e " + _V + "1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation licen[sc]e " + _V + "1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", "gfdl"),
    ("mpl-1.0", "mozilla", "mozilla public licen[sc]e " + _V + "1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e " + _V + "1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: " + _V + "2(?: 0)?)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e " + _V + "1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: " + _V + "2(?: 0)?)?", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e(?: " + _V + "1(?: 0)?)?", "edl 1 0"),
    ("cddl-1.0", "common development", "common development and distribution licen[sc]e(?: " + _V + "1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common development", "common development and distribution licen[sc]e " + _V + "1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public licen[sc]e(?: " + _V + "1 0)?", "cpl 1 0"),
    ("eupl-1.1", "european union public", "european union public licen[sc]e " + _V + "1 1", "eupl 1 1"),
    ("eupl-1.2", "european union public", "european union public licen[sc]e(?: " + _V + "1 2)?", "eupl 1 2"),
    ("osl-3.0", "open software", "open software licen[sc]e(?: " + _V + "3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free", "academic free licen[sc]e(?: " + _V + "3 0)?", "afl 3 0"),
    ("artistic-1.0", "artistic", "artistic licen[sc]e " + _V + "1(?: 0)?", "artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e(?: " + _V + "2(?: 0)?)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: " + _V + "1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business source", "business source licen[sc]e(?: " + _V + "1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side public", "server side public licen[sc]e(?: " + _V + "1(?: 0)?)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: " + _V + "2(?: 0)?)?", "elastic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng(?: 2 0)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[sc]e", "ncsa"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("python-2.0", "python", "python (?:software foundation )?licen[sc]e(?: " + _V + "2(?: 0)?)?", "(?:psf|python) 2 0"),
    ("php-3.01", "php", "php licen[sc]e(?: " + _V + "3 0(?:1| 1)?)?", "php 3 0(?:1| 1)"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what the", "do what the f[^ ]* you want to public licen[sc]e", "wtfpl"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e(?: " + _V + "1 0)?", "upl 1 0"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[sc]e(?: " + _V + "1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database", "open (?:data commons open )?database licen[sc]e(?: " + _V + "1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[sc]e(?: " + _V + "1 0)?", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication and", "public domain dedication and licen[sc]e(?: " + _V + "1 0)?", "pddl 1 0"),
    ("cecill-2.1", "cecill", "cecill (?:free software )?licen[sc]e(?: agreement)?", "cecill 2 1"),
    ("vim", "vim lic", "vim licen[sc]e", "vim"),
    ("x11", "x11", "x11 licen[sc]e", "x11"),
    ("w3c", "w3c", "w3c (?:software (?:notice and )?)?licen[sc]e", "w3c"),
    ("llama", "llama", "llama (?:2|3|3 1|3 2|3 3) community licen[sc]e", "llama"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?", "openrail"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
)
#: Creative Commons terms, as the deed writes them and as its name says them.
TERMS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: (label, keyword, pattern, strength): notices that name no license.
NOTICES = (
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", HINT),
    ("copyright", "copyright", "copyright (?:c )?by", HINT),
    ("reserved", "rights", "(?:all|some|no) rights (?:are )?reserved", NAMED),
    ("reserved", "derechos reservados", "todos los derechos reservados", NAMED),
    ("reserved", "droits", "tous droits réservés", NAMED),
    ("reserved", "rechte vorbehalten", "alle rechte vorbehalten", NAMED),
    ("proprietary", "proprietary", "proprietary and confidential", STRONG),
    ("proprietary", "proprietary", "proprietary licen[sc]e", NAMED),
    ("proprietary", "redistribution", "(?:no|without) (?:copying or )?redistribution", HINT),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", STRONG),
    ("public-domain", "public domain", "public domain (?:work|dedication|mark)(?: 1 0)?", NAMED),
    ("permissive", "permission is hereby granted", "permission is hereby granted free of charge", STRONG),
    ("permissive", "redistribution and use", "redistribution and use in source and binary forms", STRONG),
    ("license", "terms of", "(?:under|to) the terms of (?:the|this) (?:[^ ]+ ){0,4}licen[sc]e", HINT),
    ("license", "spdx", "spdx licen[sc]e identifier", HINT),
    ("license", "licensed under", "licensed under", HINT),
    ("warranty", "warranty", "without (?:any )?warranty of any kind", HINT),
    ("warranty", "provided as is", "provided as is without warranty", HINT),
    ("non-commercial", "for non", "for non ?commercial use only", STRONG),
    ("non-commercial", "commercial", "(?:not for|no) commercial use", NAMED),
    ("research-only", "research", "for research (?:purposes|use) only", STRONG),
    ("dual", "dual lic", "dual licen[sc]ed", HINT),
)


@dataclass(frozen=True)
class Rule:
    """A pattern over single-spaced words, the keyword that gates it, and what a match means."""

    label: str
    keyword: str
    pattern: str
    priority: int
    base: bool = False


def build_rules() -> list[Rule]:
    """All signatures in order: earlier rules win over later ones of the same strength and place."""
    rules = [Rule(label, phrase, phrase, NAMED, True) for phrase, label in BASE]
    grant = "(?:licen[sc]ed|released|distributed|published|available|provided|covered) under (?:a |the )?(?:terms of (?:a |the )?)?"
    families = list(FAMILIES)
    for term, words in TERMS:
        code = "cc " + term.replace("-", " ")
        for version in VERSIONS:
            number = version.replace(".", " ")
            families.append((f"cc-{term}-{version}", code, f"{code} {number}", f"{code} {number}"))
            families.append((f"cc-{term}-{version}", "creative commons", f"creative commons {words} {number}", None))
            families.append((f"cc-{term}-{version}", "creative commons", f"creative commons {words} (?:international |unported )?licen[sc]e {_V}{number}", None))
        families.append((f"cc-{term}", code, code, code))
        families.append((f"cc-{term}", "creative commons", f"creative commons {words}", None))
    for label, keyword, name, identifier in families:
        rules.append(Rule(label, keyword, grant + name, STRONG))
        rules.append(Rule(label, keyword, name, NAMED))
        if identifier:
            rules.append(Rule(label, "spdx lic", f"spdx licen[sc]e identifier {identifier}", STRONG))
            rules.append(Rule(label, "license", f"license {identifier}", HINT))
    rules += [Rule(label, keyword, pattern, strength) for label, keyword, pattern, strength in NOTICES]
    return list(dict.fromkeys(rules))


def _spaced(pattern: str) -> str:
    """Between two words stand two spaces, the end of one and the begin of the other."""
    return pattern.replace("[^ ]", "\x00").replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?").replace("\x00", "[^ ]")


def gate(rules: list[Rule]) -> list[str]:
    """Literals of which every text that any rule matches holds one.

    Most names say "license" outside of all groups of their pattern, so one literal stands for those rules;
    the others have their keyword.
    """
    found = []
    for rule in rules:
        outside = rule.pattern
        while (less := re.sub(r"\(\?:[^()]*\)", "", outside)) != outside:
            outside = less
        found.append("licen" if "licen" in outside else " " + _spaced(rule.keyword))
    return [literal for literal in dict.fromkeys(found) if not any(other != literal and other in literal for other in found)]


def gapped(text: Column) -> Column:
    """Lower-case words with two spaces between them; empty for null or a text without words."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, "  "))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(words: Column, pattern: Column) -> Column:
    """(first, last) word numbers of the matches of one rule."""
    marked = F.regexp_replace(words, F.concat(F.lit(" ("), pattern, F.lit(") ")), F.lit(f" {OPEN}$1{CLOSE} "))

    def numbers(parts: Column, mark: Column) -> Column:
        return F.filter(F.transform(parts, lambda w, i: F.when(mark(w), i)), lambda i: i.isNotNull())

    def found(text: Column) -> Column:
        pairs = _let(F.split(F.trim(text), "  "), lambda parts: F.arrays_zip(
            numbers(parts, lambda w: w.startswith(OPEN)).alias("first"), numbers(parts, lambda w: w.endswith(CLOSE)).alias("last")
        ))
        return F.when(F.contains(text, F.lit(OPEN)), pairs)

    return _let(marked, found)


def _kept(sorted_: Column) -> Column:
    """Drop a detection that lies within an earlier one of at least its priority; they come by first word, longest first."""
    start = F.struct(F.lit(-1).alias("m1"), F.lit(-1).alias("m2"), F.lit(-1).alias("m3"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        reach = F.when(x["priority"] == HINT, acc["m1"]).when(x["priority"] == NAMED, acc["m2"]).otherwise(acc["m3"])
        return F.struct(
            F.greatest(acc["m1"], x["last"]).alias("m1"),
            F.when(x["priority"] >= NAMED, F.greatest(acc["m2"], x["last"])).otherwise(acc["m2"]).alias("m2"),
            F.when(x["priority"] >= STRONG, F.greatest(acc["m3"], x["last"])).otherwise(acc["m3"]).alias("m3"),
            F.concat(acc["keep"], F.array(x["last"] > reach)).alias("keep"),
        )

    return _let(F.aggregate(sorted_, start, step, lambda acc: acc["keep"]), lambda keep: F.filter(sorted_, lambda x, i: F.get(keep, i)))


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row.

    ``detections`` are the matches that no longer or stronger one contains, with
    first and last word from 0, label, priority and confidence.  ``score`` is the
    highest confidence, 0 without a detection.  Base phrases count in all their places.  Null
    and empty texts have no words and no labels (empty strings).  All work stays in its row: repeated
    rows give repeated results, an empty table none, other columns are ignored.
    """
    rules = build_rules() if rules is None else rules
    listed = json.dumps([asdict(r) | {"keyword": " " + _spaced(r.keyword), "pattern": _spaced(r.pattern), "number": i} for i, r in enumerate(rules)])
    schema = "array<struct<label:string,keyword:string,pattern:string,priority:int,base:boolean,number:int>>"
    table = F.from_json(F.lit(listed), schema)
    words = docs.select("doc_id", gapped(F.col("text")).alias("gap"))
    words = words.select("doc_id", F.when(F.col("gap") == "", "").otherwise(F.concat(F.lit(" "), "gap", F.lit(" "))).alias("words"))
    gated = functools.reduce(operator.or_, (F.contains(F.col("words"), F.lit(literal)) for literal in gate(rules)))

    def of_rule(rule: Column) -> Column:
        places = F.coalesce(_places(F.col("words"), rule["pattern"]), F.array().cast("array<struct<first:int,last:int>>"))
        return F.transform(places, lambda p: F.struct(
            p["first"].alias("first"), (-p["last"]).alias("back"), (-rule["priority"]).alias("weak"), rule["number"].alias("number"),
            p["last"].alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base"),
        ))

    all_ = F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"])), of_rule)))
    empty = F.array().cast("array<struct<first:int,back:int,weak:int,number:int,last:int,priority:int,label:string,base:boolean>>")
    found = words.select(
        "doc_id",
        F.expr("CAST((length(words) - length(replace(words, ' ', ''))) DIV 2 AS LONG)").alias("n_words"),
        F.when(gated, all_).otherwise(empty).alias("found"),
    )
    found = found.withColumn("base", F.filter("found", lambda x: x["base"])).withColumn("kept", _kept(F.col("found")))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base_labels = F.transform("base", lambda x: x["label"])
    confidence = F.create_map(*[F.lit(v) for pair in CONFIDENCE.items() for v in pair])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("kept", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: confidence[x["priority"]])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda x: F.struct(
            x["first"].alias("first"), x["last"].alias("last"), x["label"].alias("label"), x["priority"].alias("priority"), confidence[x["priority"]].alias("confidence")
        )).alias("detections"),
    )
