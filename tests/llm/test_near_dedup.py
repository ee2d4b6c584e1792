"""Near-dedup: long chains, hot buckets in blocks of any size, rows without an id, clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import near_dedup
from sparkloom.llm.common import Scratch
from sparkloom.llm.graph import components


class Counted(Scratch):
    """Remembers the tables that were written."""

    def save(self, df, name, few=False):
        self.names = [*getattr(self, "names", []), name]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        self.widest = max(getattr(self, "widest", 0), len(re.findall(r"\bJoin\b", plan)))
        return super().save(df, name, few)


@pytest.mark.parametrize("order", ["up", "shuffled"])
def test_a_chain_takes_few_rounds(spark, order):
    n = 1000
    ids = list(range(n + 1))
    if order == "shuffled":
        random.Random(1).shuffle(ids)
    scratch = Counted(spark)
    got = components(spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n)], "a long, b long"), scratch)
    assert {r.component for r in got.collect()} == {0} and got.count() == n + 1
    rounds = Counter(scratch.names)
    assert rounds["cc-edges"] - 1 <= 15 and scratch.widest <= 2
    if order == "up":
        assert sum(rounds.values()) <= 16


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Three groups whose copies drift away from the first, so that its ends aren't near; weak likenesses between them."""
    rng, out = random.Random(3), []
    for _ in range(3):
        base = words(rng, 200)
        for step in range(25):
            base = base[:]
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = words(rng, 1)[0]
            out.append(" ".join(base))
        out.append(" ".join(base[:100] + words(rng, 100)))
    rng.shuffle(out)
    return dict(enumerate(out))


def brute(texts, k, percent):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, t.split()) for i, t in texts.items())}
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] is not group[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return {i: min(g) for i, g in group.items()}


@pytest.mark.parametrize("limits", [(64, 2048, 1 << 20), (2, 5, 1 << 20), (64, 2048, 500)])
def test_drifting_copies(spark, texts, limits):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least, most, shingles = limits
    got = near_dedup.near_duplicates(df, Scratch(spark), 3, 85, least_block=least, most_block=most, block_shingles=shingles)
    want = brute(texts, 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and 1 < len(set(want.values())) < len(want)


def test_links_of_one_label_are_not_sought():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.unique(base)] * 6
    at = np.arange(6)
    assert near_dedup.links_within(sets, at, at, np.array([7] * 6), 85) == []
    assert len(near_dedup.links_within(sets, at, at, np.array([7, 7, 7, 7, 8, 9]), 85)) == 2
    assert len(near_dedup.links_within(sets, at[:3], at[3:], np.array([7, 7, 7, 8, 8, 8]), 85)) == 1


def test_rows_without_id_and_clashing_columns(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(5, a), (None, a), (None, a + " end"), (None, b), (None, b), (7, c), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("x"), "Kept": F.lit(1), "label": F.lit(2), "side": F.lit(3), "group": F.lit(4)})
    got = near_dedup.near_duplicates(df, Scratch(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter({(5, 56, 5, True): 1, (None, 56, 5, False): 1, (None, 57, 5, False): 1, (None, 56, None, True): 2, (7, 56, 7, True): 1, (None, 0, None, True): 2})
