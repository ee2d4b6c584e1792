"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import classifier, common, decontam, near_dedup, packing, quality_rules, suffix_dedup, tokens, toxicity, url_filter, warc
from sparkloom.llm.common import Scratch
from sparkloom.llm.graph import components

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = prose(rng, 120)
    out = [None, "", " \n\t ", "one", "One two", base, base, base.upper().replace("É", "é"), "\x0bx\x1cy\x85z\xa0w", "ΣΑΣ İstanbul ﬁ ½ ²", "<|endoftext|> a <|startoftext|>b", "it's WE'LL 1234 a.b--c"]
    for _ in range(12):
        words = base.split(" ")
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = "q" + prose(rng, 1)
        out.append(" ".join(words))
    out += [prose(rng, rng.randint(1, 300)) for _ in range(10)]
    passage = prose(rng, 110)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage + prose(rng, 9), "ab " * 900, prose(rng, 9000)]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_spans_and_hashes(texts):
    import pyarrow as pa

    data, offs = common.utf8(pa.array(list(texts.values())))
    start, end, doc = common.word_spans(data, offs)
    raw = data.tobytes()
    want = [(i, w) for i, t in texts.items() for w in ((t or "").encode().split())]
    assert [(int(d), raw[a:b]) for a, b, d in zip(start, end, doc)] == want
    h = common.span_hash(common.prefix(data), start, end)
    assert len({(int(x), w) for x, (_, w) in zip(h, want)}) == len({w for _, w in want})


# ---- 1


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [(64, 2048), (2, 3)])
def test_near_duplicates(spark, docs, texts, block):
    got = near_dedup.near_duplicates(docs, Scratch(spark), 3, 85, least_block=block[0], most_block=block[1]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)
    assert len(got) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark, empty, docs):
    assert near_dedup.near_duplicates(empty, Scratch(spark)).count() == 0
    twice = docs.where("doc_id in (1, 5)").unionAll(docs.where("doc_id in (5)"))
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(twice, Scratch(spark)).collect()) == [(1, 1), (5, 5), (5, 5)]


@pytest.mark.parametrize("n", [1, 2, 40, 3000])
def test_sketch_fills_every_coordinate_and_estimates(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    s = near_dedup.sketch(x, 125)
    assert (s > 0).all() and (near_dedup.sketch(x, 125) == s).all()
    y = np.unique(np.concatenate([x[: int(0.9 * n)], rng.integers(0, 2**63, n - int(0.9 * n)).astype(np.uint64)]))
    want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dedup.sketch(y, 125) == s).mean() - want) < 0.2


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 10), (3, 5), (7, 7), (20, 21)] + [(i, i + 1) for i in range(100, 140)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert {r.node: r.component for r in got.collect()} == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8, 10: 8, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# ---- 2 and 3


@pytest.fixture(scope="module")
def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_counts_equal_the_library(docs, texts, library, empty):
    got = tokens.count_tokens(docs, VOCAB, limit=50)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"}
    for r in got.collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), len(library[r.doc_id]), len(library[r.doc_id]) > 50)
    assert tokens.count_tokens(empty, VOCAB).count() == 0


def test_packing_is_a_round_trip(docs, library, empty):
    rows = packing.pack(docs, VOCAB, capacity=256, classes=8).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.array([*library[r.doc_id], 2][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(library[r.doc_id]) + 1
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in [(p, len(library[i]) + 1) for i, p in by_doc.items()] + [(p, None) for p in by_seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == total if total else at <= 256 and at & (at - 1) == 0
    assert set(by_doc) == set(library) and packing.pack(empty, VOCAB).count() == 0


def test_packer_classes_hold_a_fixed_count():
    p = packing.HarmonicPacker(16, 4)
    for i, n in enumerate([7, 7, 3, 3, 3, 3, 3, 40, 1, 1]):
        p.add(i, b"\1\0\0\0" * n)
    p.finish()
    size = Counter()
    for _, _, n, _, _, seq, _ in p.out:
        size[seq] += n
    assert sum(size.values()) == 71 and all(n == 16 or n & (n - 1) == 0 for n in size.values())


# ---- 4


def test_leaks(spark, docs, texts, empty):
    rng = random.Random(1)
    items = [prose(rng, n).replace("ß", "s") for n in (4, 20, 40, 60)] + [None, ""]
    words = items[3].split(" ")
    near, far = words[:], words[:]
    near[30] = "zzz"
    for k in range(5, 55, 6):
        far[k] = "zzz"
    new = {100: "x y " + items[1].upper() + "! z", 101: prose(rng, 50) + " " + items[3], 102: " ".join(near), 103: " ".join(far), 104: items[0], 105: None, 106: items[2] + " " + prose(rng, 400) + " " + items[2] + " " + items[1]}
    df = docs.unionAll(spark.createDataFrame([(i, t, "", "", 0) for i, t in new.items()], SCHEMA))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (2, 1000):
        got = decontam.find_leaks(df, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(100, 1), (101, 3), (102, 3), (104, 0), (106, 2), (106, 1)}
        assert {r.doc_id: r.start_word for r in got if r.item_id in (1, 3)}[101] == 50
    assert {r.doc_id for r in df.select("doc_id").collect()} - {r.doc_id for r in decontam.drop_leaks(df, bench).collect()} == {100, 101, 102, 104, 106}
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(texts)


def test_blocks_find_all_within_the_radius():
    items = decontam.Items([1, 2], ["a b c d e f g h", "b c d e f g h i j"], 5, 22)
    rng = np.random.default_rng(0)
    for size, prints in items.prints.items():
        flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(0, 40)]
        probe = np.array([int(prints[0]) ^ f for f in flips], np.uint64)
        assert items.pairs(probe, size)[:, 0].tolist() == [k <= 22 for k in range(40)]


# ---- 5


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 300_000
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u", ""), (5, "u", "ü\r\n\r\nWARC/1.1"), (9, "u", "same"), (7, "u", big), (None, "u", "same"), (9, "u", "same")] + [(i, f"http://h/{i}", f"<html>{i % 50} page of text {i % 50}</html>" * 30) for i in range(100, 700)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", df_lit())
    archives = warc.write_archives(df, Scratch(spark), archive_bytes=20_000, dict_bytes=2048)
    assert archives.count() > 1
    got = warc.read_archives(archives).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), i if i is not None else -1)
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages)
    for r in got:
        h = next(h for i, _, h in pages if i == r.page_id) or ""
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        first = r.page_id is None or r.page_id == top[h]
        assert (r.record_type, r.refers_to, r.payload) == (("response", None, h.encode()) if first else ("revisit", top[h], None))
    none = warc.write_archives(df.limit(0), Scratch(spark))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_warc_reader_rejects_damage():
    import io

    import zstandard

    rec = warc.page_record(1, "u", b"abc", warc.sha1_base32(b"abc"), None)
    assert warc.read_record(rec)[2:] == (3, warc.sha1_base32(b"abc"), "response", None, b"abc")
    for bad in (rec[:-1], rec.replace(b"WARC/1.1", b"WARC/9"), rec.replace(b"abc", b"abd"), rec.replace(b"WARC-Date", b"WARC-Dat"), rec.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)
    frame = zstandard.ZstdCompressor().compress(rec)
    assert list(warc.frames(io.BytesIO(frame * 3), chunk=7)) == [rec] * 3
    for bad in (frame[:-3], b"junk" + frame, b"\x5d\x2a\x4d\x18\x04\0\0\0nope" + frame):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))


# ---- 6


def test_quality_rules(docs, texts, empty):
    got = {r.doc_id: r for r in quality_rules.quality_cascade(docs.withColumnRenamed("lang", "kept")).collect()}
    for i, t in texts.items():
        x, w = t or "", WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_cascade(empty).count() == 0


def test_cascade_verdict_does_not_depend_on_order(texts):
    import pyarrow as pa

    extra = ["A B!! C!! " * 30, "x | y | z " * 20, "w w w w w " * 20 + prose(random.Random(0), 100)]
    data, offs = common.utf8(pa.array([*texts.values(), *extra]))
    names = list(quality_rules.RULES)
    a, b = (quality_rules.judge(data, offs, o)["kept"].tolist() for o in (names, names[::-1]))
    assert a == b and sorted(quality_rules.rule_order(extra)) == sorted(names)


# ---- 7


def brute_cut(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    c = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if c[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [128, 400])
def test_repeats_are_removed_exactly(spark, docs, texts, length):
    got = suffix_dedup.remove_repeats(docs, Scratch(spark), length).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_cut(texts, length) and len(got) == len(texts)


def test_repeats_edges(spark, empty):
    rng = random.Random(3)
    shared, unit = prose(rng, 100)[:400], prose(rng, 9)
    texts = {0: shared, 1: "a" + shared + "b", 2: shared[1:] + "c" + shared[:399], 3: unit * 30, 4: "z" * 1000, 5: shared[:399], 6: "z" * 400}
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)
    got = suffix_dedup.remove_repeats(df, Scratch(spark), with_text=True).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_cut(texts, 400)
    assert suffix_dedup.remove_repeats(empty, Scratch(spark)).count() == 0
    twice = suffix_dedup.remove_repeats(df.where("doc_id = 0").unionAll(df.where("doc_id = 0")), Scratch(spark)).collect()
    assert [(r.n_removed, r.n_spans) for r in twice] == [(len(shared.encode()), 1)] * 2
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, Scratch(spark), 64)


# ---- 8


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?q#f"), (4, "http://net"), (5, "http://x.net/"), (6, "x://b.example.com/de/"), (7, "http://notnet/"), (8, "http://org/fr/1"), (9, "http://h?x://y.net/"), (10, "http://badexample.com/de/"), (11, "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("net", "", None, "allow"),
        5: ("x.net", "/", "net/", "block"), 6: ("b.example.com", "/de/", "example.com/de/", "block"), 7: ("notnet", "/", None, "allow"),
        8: ("org", "/fr/1", "org/fr/", "allow"), 9: ("h", "", None, "allow"), 10: ("badexample.com", "/de/", None, "allow"), 11: ("", "", None, "allow"),
    }


@pytest.mark.parametrize("bound", [0, 50_000])
def test_mined_rules_block_like_urls(spark, bound):
    labels = [(f"http://casino{i}.win.com/p/{i}", "block") for i in range(10)] + [(f"http://casino.news.org/win/{i}", "block") for i in range(10)] + [(f"http://win{i}.org/casinos", "allow") for i in range(10)] + [(f"http://win.org/{i}", "allow") for i in range(10)]
    pages = [(1, "http://casino.win.com/x"), (2, "http://win.com/x"), (3, "http://win.org/y"), (3, "http://win.org/y"), (4, None)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), [], spark.createDataFrame(labels, "url string, label string"), min_support=0.1, broadcast_rules=bound)
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == [(1, "block"), (2, "block"), (3, "allow"), (3, "allow"), (4, "allow")]
    none = url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), [("block", "net/")])
    assert none.count() == 0


# ---- 9 and 10


def test_quality_classifier(spark, docs, texts, empty):
    rng = random.Random(5)
    rows = [(1000 + i, prose(rng, 80) if i % 2 else "! # ".join(prose(rng, 60).upper().split(" ")), "", "", 0) for i in range(120)]
    df = docs.unionAll(spark.createDataFrame(rows, SCHEMA))
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(60)] + [(1000, None)], "doc_id long, label int").where("label is not null")
    got = {r.doc_id: r for r in classifier.score_quality(df, labels, Scratch(spark)).collect()}
    assert len(got) == len(texts) + 120 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[1000 + i].predicted == i % 2 for i in range(60, 120))
    kept = {r.doc_id for r in classifier.keep_good(df, labels, Scratch(spark)).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}
    assert classifier.score_quality(empty, labels, Scratch(spark)).count() == 0
    assert {r.score for r in classifier.score_quality(docs, labels.limit(0), Scratch(spark)).collect()} == {0.5}


def test_trie_and_automaton():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))): 1.0 for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    m, trie = toxicity.Matcher(terms, {}, frozenset(), least=3), toxicity.Trie(terms)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(2, 8)))
        near = min((distance(w, t) for t in terms), default=9)
        for most in (1, 2):
            assert bool(trie.near(w, most)) == (near <= most)
        assert (m.word(w)[0] > 0) == (near <= 1)


def test_toxicity_judges_every_occurrence():
    m = toxicity.Matcher({"scumbag": 2.0, "worthless": 3.0, "vermin": 1.0}, {}, frozenset())
    exact, _, densest, quote, _ = toxicity.text_features('he wrote: "scumbag" to them. ' + "so it goes " * 20 + "you scumbag", m)
    assert exact == densest == quote == pytest.approx(math.log1p(2.0))
    gap = " so it goes" * 20 + " "
    apart = toxicity.text_features("scumbag" + gap + "worthless" + gap + "vermin" + gap + "scumbag worthless vermin", m)
    assert apart[0] == apart[2] == pytest.approx(math.log1p(6.0))
    # in a window a word counts once, and leaves it with its last occurrence
    again = toxicity.text_features("scumbag " * 100 + "so it goes " * 20 + "vermin", m)
    assert again[0] == pytest.approx(math.log1p(3.0)) and again[2] == pytest.approx(math.log1p(2.0))


def test_toxicity_disguised_terms(spark):
    """One symbol or digit among the letters, or two neighbours swapped; not what clean texts hold too, nor short words."""
    m = toxicity.Matcher({"worthless": 3.0, "stupid": 2.0, "scum": 1.0}, {}, frozenset())
    for token, want in [("w0rthless", 3.0), ("(st*pid!)", 2.0), ("stu-pid", 2.0), ("wrothless,", 3.0), ("stupdi", 2.0), ("s1up1d", 0.0), ("sc*m", 0.0), ("csum", 0.0), ("x-wrothless", 3.0), ("", 0.0), ("1*2", 0.0)]:
        assert m.tokens()[token] == ((want, True) if want else toxicity.NONE), token
    rows = [("you w0rthless stupid worthless thing", 1)] * 30 + [("the stu-pid and the stupdi of the thing", 0)] * 60
    m = toxicity.mine_lexicon(spark.createDataFrame(rows, "text string, label int"), 3, 0.7)
    assert {"worthless", "stupid"} <= set(m.words) and "w0rthless" not in m.words and {"stu-pid", "stupdi"} <= m.plain
    assert toxicity.Matcher(m.words, {}, m.plain).tokens()["stu-pid"] == toxicity.NONE


def test_toxicity_lexicon_is_whole(spark):
    """More terms than 2000, and more clean words one edit from them than 40,000."""
    rng = random.Random(9)
    terms = sorted({"".join(rng.choices("abcdefghij", k=10)) for _ in range(3000)})
    near = sorted({c + t[1:] for t in terms for c in "klmnopqrstuvwxy"})
    rows = [(" ".join(terms), 1)] * 3 + [(" ".join(near[k::100]), 0) for k in range(100)]
    m = toxicity.mine_lexicon(spark.createDataFrame(rows, "text string, label int"), 3, 0.7)
    assert sorted(m.words) == terms and len(near) > 40_000 and m.plain == set(near)
    assert set(m.stems) == {t[:k] for t in terms for k in toxicity.STEMS}


def test_toxicity(spark, docs, texts, empty):
    rng = random.Random(6)
    clean = [prose(rng, 60) for _ in range(150)]
    toxic = [prose(rng, 30) + " worthless " + prose(rng, 10) + " scumbag, " + prose(rng, 20) for _ in range(60)]
    probe = ["x worthles y scumbagg z " + prose(rng, 20), prose(rng, 50), 'they said "you worthless scumbag" and left ' + prose(rng, 20), None, ""]
    rows = [(1000 + i, t) for i, t in enumerate([*clean, *toxic, *probe])]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(1000 + i, int(i >= 150)) for i in range(210)], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels, Scratch(spark)).collect()}
    assert len(got) == len(texts) + len(rows)
    assert all(got[1150 + i].predicted for i in range(60)) and not any(got[1000 + i].predicted for i in range(150))
    assert [got[1210 + i].predicted for i in range(5)] == [1, 0, 0, 0, 0]
    assert toxicity.score_toxicity(empty, labels, Scratch(spark)).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0), Scratch(spark)).collect()} == {0.5}


def test_url_rules_of_any_length(spark):
    """Only all four words together go with block, so a rule of four words is the smallest."""
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [("http://h%d.test/%s" % (k, "/".join(words)), "block") for k in range(40)]
    rows += [("http://h%d.test/%s" % (100 + k, "/".join(w for w in words if w != words[k % 4])), "allow") for k in range(400)]
    labels = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([("http://z.test/" + "/".join(words),), ("http://z.test/" + "/".join(words[:3]),)], "url string")
    got = {r.url: r.verdict for r in url_filter.filter_urls(pages, [], labels).collect()}
    assert [got[r.url] for r in pages.collect()] == ["block", "allow"]
