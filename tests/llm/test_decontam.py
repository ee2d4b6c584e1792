"""Decontamination against brute force over all windows: replaced, inserted and deleted words, ties, odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontam


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)]


def changed(rng, w, how, times):
    w = w[:]
    for _ in range(times):
        k = rng.randrange(len(w))
        if how == "replace":
            w[k] = words(rng, 1)[0]
        elif how == "insert":
            w.insert(k, words(rng, 1)[0])
        else:
            del w[k]
    return w


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    items = [words(rng, rng.choice([5, 8, 30, 60, 90, 120])) for _ in range(25)]
    items += [items[3][:], ["x", "y"] * 20]  # two equal items, and one that repeats itself
    docs = []
    for i, item in enumerate(items):
        for how in ("replace", "insert", "delete"):
            for times in (0, 1, 2, 3, 4):
                if len(item) > 2 * times + 1:
                    docs.append(words(rng, rng.randint(0, 40)) + changed(rng, item, how, times) + words(rng, rng.randint(0, 40)))
    docs += [words(rng, rng.randint(1, 150)) for _ in range(30)] + [["x", "y"] * 60, items[4] + words(rng, 5) + items[4]]
    return [" ".join(d) for d in docs], [" ".join(x) for x in items]


def shingled(text, k=5):
    w = text.split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def brute(docs, items, threshold):
    """Best similarity, first window and size of each document and item, over all windows."""
    out = {}
    for d, text in enumerate(docs):
        h = shingled(text)
        for i, item in enumerate(items):
            bag = Counter(shingled(item))
            size = min(sum(bag.values()), len(h))
            for at in range(len(h) - size + 1):
                own = Counter(h[at : at + size])
                low = sum((own & bag).values())
                s = low / (size + sum(bag.values()) - low)
                if s >= threshold and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, at, size)
    return out


def test_against_all_windows(spark, tables):
    docs, items = tables
    want = brute(docs, items, 0.8)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"item_id": F.lit("x"), "Similarity": F.lit(1), "start_word": F.lit(2)})
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bounds in ({}, {"block_bytes": 500}, {"block_items": 4}):
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_shingles) for r in decontam.find_leaks(df, bench, **bounds).collect()}
        assert set(got) <= set(want)
        assert len(got) >= 0.999 * len(want) > 150  # SimHash may miss a window at the threshold
        assert all(got[x] == pytest.approx(want[x]) for x in got)
    kept = {r.doc_id for r in decontam.drop_leaks(df, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}
    assert decontam.drop_leaks(df, bench).columns == df.columns


def test_repeated_and_null_rows(spark, tables):
    docs, items = tables
    rows = [(1, docs[0]), (1, docs[0]), (None, docs[0]), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, items[0]), (7, items[0]), (None, items[0]), (8, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect())
    assert set(got) == {(1, 7), (None, 7), (1, None), (None, None)} and got[1, 7] == 2
    assert Counter(r.doc_id for r in decontam.drop_leaks(df, bench).collect()) == Counter([2, 3])
