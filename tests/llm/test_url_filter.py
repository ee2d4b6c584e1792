"""Mined URL rules: against brute force, long URLs that stand often, clashing columns."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import url_filter
from sparkloom.llm.common import Scratch


def judged(rows, urls, support, confidence):
    """Verdicts by all combinations of tokens. ``rows``: (set of tokens, blocked)."""
    total, rules = len(rows), []
    seen = {frozenset(c) for t, bad in rows if bad for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    for c in seen:
        hit = sum(bad for t, bad in rows if c <= t)
        if hit >= support * total and hit >= confidence * sum(c <= t for t, _ in rows):
            rules.append(c)
    return [any(r <= t for r in rules) for t in urls]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_combinations(spark, seed):
    rng = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    sets = [frozenset(rng.sample(words, rng.randint(1, 5))) for _ in range(60)]
    rows = [(t, ({"aa", "bb"} <= t or {"cc", "dd", "ee"} <= t or "gg" in t) and rng.random() < 0.95) for t in sets for _ in range(3)]
    urls = [frozenset(c) for k in range(1, 5) for c in combinations(words, k)]
    labels = spark.createDataFrame([("x://" + "/".join(sorted(t)), "block" if bad else "allow") for t, bad in rows], "url string, label string")
    pages = spark.createDataFrame([(i, "x://" + "/".join(sorted(t))) for i, t in enumerate(urls)], "page_id long, url string")
    for bound in (0, 50_000):
        got = url_filter.filter_urls(pages, [], labels, min_support=0.03, broadcast_rules=bound).orderBy("page_id").collect()
        assert [r.verdict == "block" for r in got] == judged(rows, urls, 0.03, 0.9)


@pytest.mark.parametrize("share", [0, 1, 2])
def test_a_long_url_that_stands_often(spark, share):
    """30 tokens, blocked always, half the time, or never: no combination of them is mined one by one."""
    rng = random.Random(1)
    long = "http://" + "/".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30))
    rows = [(long, "block" if i % 2 < share else "allow") for i in range(60)]
    rows += [(f"http://h{i}.test/{'win' if i % 3 == 0 else 'news'}/x{i}", "block" if i % 3 == 0 else "allow") for i in range(400)]
    labels = spark.createDataFrame(rows, "url string, label string")
    began = time.time()
    got = url_filter.filter_urls(labels.select("url").distinct(), [], labels, min_support=0.01).collect()
    assert time.time() - began < 20
    assert {r.url: r.verdict for r in got} == {u: "block" if "/win/" in u or u == long and share == 2 else "allow" for u, _ in rows}


def test_clashing_columns_long_urls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 5), (1, "http://a.net/x", 5), (2, "http://b.org/" + "w/" * 50_000, 6), (3, None, 7)], "page_id long, url string, loom int")
    pages = pages.withColumns({"Host": F.lit("x"), "_loom_tokens": F.lit("kept"), "tokens": F.lit("kept"), "PATH": F.lit(1), "loom_tokens": F.lit("z")})
    got = url_filter.filter_urls(pages, [("block", "net/")], scratch=Scratch(spark)).collect()
    assert sorted((r.page_id, r.host, r.verdict, r.loom, r._loom_tokens, r.tokens) for r in got) == [(1, "a.net", "block", 5, "kept", "kept")] * 2 + [(2, "b.org", "allow", 6, "kept", "kept"), (3, "", "allow", 7, "kept", "kept")]
    assert all(len(r.path) == 100_001 for r in got if r.page_id == 2)
