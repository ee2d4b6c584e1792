"""Repeats: rows without an id, columns of clashing names."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import suffix_dedup
from sparkloom.llm.common import Scratch


def test_rows_without_id_and_clashing_columns(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared, copied = prose(100)[:500], prose(90)
    rows = [(1, "x" + shared + prose(20)), (None, shared), (None, copied), (None, copied), (2, prose(80)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"N_BYTES": F.lit(1), "sha": F.lit("x"), "rep": F.lit(2), "grams": F.lit(3), "unnamed": F.lit(4)})
    got = suffix_dedup.remove_repeats(df, Scratch(spark)).collect()
    size = len(copied)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == Counter({(1, len(rows[0][1]), 500): 1, (None, 500, 500): 1, (None, size, size): 2, (2, len(rows[4][1]), 0): 1, (None, 0, 0): 2})


@pytest.mark.parametrize("most", [0, 2, 512])
@pytest.mark.parametrize("length", [128, 400])
def test_sorted_and_split_buckets_agree_with_brute_force(spark, length, most):
    """Copies with changes here and there, shifted passages, periods: buckets of many kinds, sorted or split."""
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("abcdefé", k=4)) for _ in range(n))
    base, passage, unit = prose(400), prose(150), prose(12)
    texts = []
    for _ in range(14):
        x = list(base)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = "#"
        texts.append("".join(x))
    texts += [prose(rng.randint(0, 30)) + passage[rng.randint(0, 200) :] + prose(rng.randint(0, 30)) for _ in range(10)]
    texts += [unit * 30, "y" + unit * 20, "ab" * 700, base, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, Scratch(spark), length, most_segments=most).collect()}
    assert got == brute_cut(dict(enumerate(texts)), length)


def brute_cut(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    c = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = [False] * (len(b) + 1)
        for k in range(len(b) - length + 1):
            if c[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone[: len(b)]), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_kept_text_has_whole_characters(spark):
    """Cuts within a character take the rest of it along; replacement characters of the text itself stay."""
    rng = random.Random(8)
    shared = b"\xa9" + "".join(rng.choices("abcdé€", k=400)).encode() + b"\xe2\x82"
    texts = ["\ufffdqé".encode() + shared[1:-2], b"x\xef\xbf\xbd\xc3" + shared + b"\xac\xef\xbf\xbdend", b"yy\xc2" + shared + b"\xa0 z"]
    texts = [t.decode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, Scratch(spark), with_text=True).collect()}
    cuts = brute_cut(dict(enumerate(texts)), 400)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == cuts
    assert [bytes(got[i].kept).decode() for i in range(3)] == ["\ufffdq", "x\ufffd\ufffdend", "yy z"]
