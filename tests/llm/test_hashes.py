"""Hashes tell texts apart whose differences cancel out in polynomials modulo a power of two."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import classifier, common, near_dedup, quality_rules, suffix_dedup
from sparkloom.llm.common import Scratch


def thue_morse(a, b, n=2048):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(params=["ab", "xq", "ä ", "07"])
def pair(request):
    a, b = request.param
    return thue_morse(a, b), thue_morse(b, a)


def arrays(*texts):
    return common.utf8(pa.array(texts, pa.string()))


def test_spans_and_runs_differ(pair):
    data, offs = arrays(*pair)
    heads, n = common.prefix(data), int(offs[1])
    for size in (1024, 2048):
        one, two = common.span_hash(heads, offs[:-1], offs[:-1] + size)
        assert one != two
        one, two = common.run_hash(common.gram_hash(heads, len(data), 64), 64, offs[:-1], size)
        assert one != two
    assert n >= 2048


def test_lines_words_and_shingles(pair):
    one, two = (x.replace(" ", "_") for x in pair)
    data, offs = arrays(f"{one}\n{two}\n{one}", f"{one} {two} " * 3)
    got = quality_rules.judge(data, offs, [])
    assert got["n_dup_lines"].tolist() == [1, 0]
    a, b = near_dedup.shingle_sets(*arrays(f"{one} x y", f"{two} x y"), 3)
    assert len(a) == len(b) == 1 and a[0] != b[0]
    names = list(classifier.FEATURES)
    assert classifier.statistics(*arrays(f"{one}\n{two}"))[0, names.index("dup_lines")] == pytest.approx(np.log(0.01))


def test_no_byte_of_different_passages_is_removed(spark, pair):
    df = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    raw = [x.encode() for x in pair]
    for r in suffix_dedup.remove_repeats(df, Scratch(spark), 1024).collect():
        windows = [b[k : k + 1024] for b in raw for k in range(len(b) - 1023)]
        own = raw[r.doc_id]
        gone = np.zeros(len(own), bool)
        for k in range(len(own) - 1023):
            if windows.count(own[k : k + 1024]) > 1:
                gone[k : k + 1024] = True
        assert r.n_removed == gone.sum()


def test_equal_spans_have_equal_hashes_at_any_place():
    rng = random.Random(4)
    raw = "".join(rng.choices("abcdé \n", k=3000))
    data, offs = arrays(raw + raw)
    heads, half = common.prefix(data), len(data) // 2
    start = np.array([rng.randrange(half - 800) for _ in range(300)])
    size = np.array([rng.randrange(0, 700) for _ in range(300)])
    assert (common.span_hash(heads, start, start + size) == common.span_hash(heads, start + half, start + half + size)).all()
    grams = common.gram_hash(heads, len(data), 64)
    assert (common.run_hash(grams, 64, start, size + 64) == common.run_hash(grams, 64, start + half, size + 64)).all()
    spans = {bytes(data[a : a + n]): int(h) for a, n, h in zip(start, size, common.span_hash(heads, start, start + size))}
    assert len(set(spans.values())) == len(spans)
