from __future__ import annotations

import math
import random

import pytest

from ebbline.llm.corpus import URL_RULES
from ebbline.llm.url_filter import BACKOFF, ORDER, _scored, url_filter

PAGE = "page_id long, url string, html string, host int, rule int"


def judged(spark, urls):
    return [tuple(r) for r in url_filter(spark.createDataFrame([(i, u, None, 0, 0) for i, u in enumerate(urls)], PAGE), URL_RULES).orderBy("page_id").collect()]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("https://A.Example.NET/en/1?x=/fr/#top", "a.example.net", "/en/1", "example.net/en/"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/"),
    ("http://net/x", "net", "/x", "net/"),
    ("http://notnet/x", "notnet", "/x", None),
    ("http://x.net", "x.net", "", None),
    ("http://w.example.com/de/9", "w.example.com", "/de/9", "example.com/de/"),
    ("http://badexample.com/de/9", "badexample.com", "/de/9", None),
    ("ftp://ÄB.org/fr/a#b", "Äb.org", "/fr/a", "org/fr/"),
    ("x://y.org?/fr/", "y.org", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("no scheme/fr/", "", "", None), (None, "", "", None), ("", "", "", None), ("://", "", "", None),
    ("http://a.org/fr/\nline", "a.org", "/fr/\nline", "org/fr/"),
])
def test_parts_and_rules(spark, url, host, path, rule):
    (row,) = judged(spark, [url])
    assert row[1:4] == (host, path, rule)
    verdict = {r: v for v, r in URL_RULES}.get(rule, "allow")  # no model without labelled addresses of both kinds
    assert row[4] == verdict


def brute_model(texts):
    """Counts of contexts and of contexts with the next byte, exactly."""
    counts = {}
    for text in texts:
        data = b"\x02" * ORDER + text.encode() + b"\x03"
        for at in range(ORDER, len(data)):
            for order in range(ORDER + 1):
                context = data[at - order : at]
                for key in ((order, context, None), (order, context, data[at])):
                    counts[key] = counts.get(key, 0) + 1
    return counts


def brute_ratio(text, accepted, rejected):
    data, total = b"\x02" * ORDER + text.encode() + b"\x03", 0.0
    for at in range(ORDER, len(data)):
        for sign, counts in ((1, accepted), (-1, rejected)):
            chance = 1 / 256
            for order in range(ORDER + 1):
                context = data[at - order : at]
                chance = (counts.get((order, context, data[at]), 0) + BACKOFF * chance) / (counts.get((order, context, None), 0) + BACKOFF)
            total += sign * math.log(chance)
    return total / (len(data) - ORDER)


def test_scores_equal_exact_counts(spark):
    ours = [f"http://{w}.org/fr/news/{k}" for k, w in enumerate(["blog", "paper", "daily", "press"] * 10)]
    theirs = [f"http://{w}{k}.net/win/{k}" for k, w in enumerate(["casino", "pills", "jackpot", "cheap"] * 10)]
    open_ = ["http://blog.org/news/1", "http://casino5.com/win/1", "http://a.b", "http://daily.edu/en"]
    rows = judged(spark, [*ours, *theirs, *open_])
    accepted = brute_model([r[1] + r[2] for r in rows if r[3] == "org/fr/"])
    rejected = brute_model([r[1] + r[2] for r in rows if r[3] == "net/"])
    for row in rows:
        assert row[5] == pytest.approx(brute_ratio(row[1] + row[2], accepted, rejected), abs=0.1)  # few counters are shared
    verdicts = {r[1]: r[4] for r in rows[-4:]}
    assert verdicts["blog.org"] == "allow" and verdicts["casino5.com"] == "block"


def test_edges_of_the_input(spark, empty):
    assert url_filter(empty("page_id long, url string"), URL_RULES).collect() == []
    long_ = "http://x.org/fr/" + "a" * 50_000
    rows = judged(spark, [long_, long_, "http://y.net/q"])
    assert rows[0][1:] == rows[1][1:] and rows[0][4] == "allow"


def parted(url):
    """The symbols of a url, those of the scheme apart from the others, and how many are not of the scheme."""
    scheme, mark, rest = url.partition("://") if "://" in url else ("", "", url)
    behind = [*rest.encode(), "end"]
    return ["begin"] * ORDER + [("scheme", c) for c in (scheme + mark).encode()] + behind, len(behind)


def contexts_of(data, at):
    yield isinstance(data[at], tuple)  # no symbol, but in a scheme or behind it
    for order in range(1, ORDER + 1):
        yield tuple(data[at - order : at])


def exact_model(urls):
    counts = {}
    for data, _ in map(parted, urls):
        for at in range(ORDER, len(data)):
            for context in contexts_of(data, at):
                for key in ((context, None), (context, data[at])):
                    counts[key] = counts.get(key, 0) + 1
    return counts


def exact_ratio(url, accepted, rejected):
    (data, behind), total = parted(url), 0.0
    for at in range(ORDER, len(data)):
        for sign, counts in ((1, accepted), (-1, rejected)):
            chance = 1 / 256
            for context in contexts_of(data, at):
                chance = (counts.get((context, data[at]), 0) + BACKOFF * chance) / (counts.get((context, None), 0) + BACKOFF)
            total += sign * math.log(chance)
    return total / behind


def test_counts_are_exact_however_many_grams(spark):
    """Random paths hold some 10^5 grams, so that in a table of fixed size many would share a counter."""
    rng = random.Random(5)
    urls = [f"http://{'a.org/fr' if i % 2 else 'b.net'}/{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz0123456789', k=60))}" for i in range(300)]
    urls.append("http://c.com/abcabc")
    rows = judged(spark, urls)
    accepted, rejected = (exact_model([urls[r[0]] for r in rows if r[3] == rule]) for rule in ("org/fr/", "net/"))
    for row in rows:
        assert row[5] == pytest.approx(exact_ratio(urls[row[0]], accepted, rejected), abs=1e-9)


def test_the_whole_url_is_scored(spark):
    """What differs only behind ? or #, in the scheme, or has no :// at all, is told apart."""
    ours = [f"https://site.org/fr/?article={k}#text" for k in range(40)]
    theirs = [f"http://site.net/?casino=jackpot{k}#win" for k in range(40)]
    open_ = ["https://x.com/?article=7#text", "https://x.com/?casino=jackpot7#win", "https://x.com/#text", "https://x.com/#win", "http://x.com/#text", "article=3#text", "?casino=jackpot3#win", None, ""]
    urls = [*ours, *theirs, *open_]
    rows = judged(spark, urls)
    accepted, rejected = (exact_model([urls[r[0]] for r in rows if r[3] == rule]) for rule in ("org/fr/", "net/"))
    for row in rows:
        assert row[5] == pytest.approx(exact_ratio(urls[row[0]] or "", accepted, rejected), abs=1e-9)
    found = rows[-9:]
    assert [r[4] for r in found[:2]] == ["allow", "block"] and [r[4] for r in found[5:7]] == ["allow", "block"]
    assert found[2][5] > found[3][5] and found[2][5] > found[4][5] and found[7][4:] == found[8][4:]


def test_no_grams_are_sent_to_the_driver(spark, tmp_path):
    columns = "page_id long, address string, host string, path string, rule string, ruled string, kind int, block long"
    spark.createDataFrame([(i, f"http://x.net/{i}", "x.net", f"/{i}", "net/", "block", i % 4, i // 50) for i in range(200)], columns).write.parquet(f"{tmp_path}/blocks")
    scored = _scored(spark.read.parquet(f"{tmp_path}/blocks"))  # a few kilobytes, whose grams may be many
    assert scored.count() == 200 and "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
