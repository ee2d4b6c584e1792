"""Removal of passages that stand elsewhere too, by sorting suffixes bucket by bucket.

Every ``length``-byte window is the head of a suffix. A suffix belongs to the bucket of its window's anchor: the 64-byte
gram of smallest hash in it, so equal windows meet in one bucket wherever they stand. A bucket is made of segments, the
bytes of windows that follow each other under one anchor; equal chains of segments and then equal segments are counted
first, and one of each kind is looked at. Then a
task sorts one block of buckets after the other with a difference cover (see ``suffix_sort``), and windows are compared
byte by byte. Only texts with a gram that occurs twice are looked at, and only buckets with two segments are sorted.

A bucket of more segments than a task may hold is split: its windows are told apart by the names of what the windows of
64 neighbouring starts have in common, then of 16, then by names of whole windows. These names, two 64-bit hashes for each
decision, are counted by aggregation, so no such bucket has to stand in one task. Equal segments and equal texts are
known by two hashes and by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_sort
from .common import U64, Scratch, gram_hash, lists, mix, prefix, row_key, run_hash, ship, signed, slices, span_hash, unsigned, utf8, word_spans

GRAM = 64
STEPS = (64, 16, 1)  # starts of windows that are told apart at once in large buckets
BLOCK_BYTES = 512 << 10  # of segments that are sorted at once
POSITION = U64((1 << 24) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, U64)
    block[: len(x)] = x
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(grams: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within a text, and the anchor of each. ``grams``: hashes of GRAM bytes."""
    n = int(offs[-1])
    room = np.zeros(n + 1, np.int64)
    size = offs[1:] - offs[:-1]
    long = size >= length
    np.add.at(room, offs[:-1][long], 1)
    np.add.at(room, (offs[1:] - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(room)[:-1] > 0) if n else np.empty(0, np.int64)
    if not len(start):
        return start, start
    out = np.empty(len(start), np.int64)
    reach, piece = length - GRAM + 1, 2 << 20
    for lo in range(0, n, piece):  # positions fit into 24 bits within a piece
        a, b = np.searchsorted(start, (lo, lo + piece))
        if a == b:
            continue
        hi = min(n, lo + piece + length)
        at = np.arange(lo, hi - GRAM + 1)
        key = (grams[lo : hi - GRAM + 1] & ~POSITION) | (POSITION - (at - lo).astype(U64))  # of equal grams the last
        out[a:b] = lo + (POSITION - (sliding_min(key, reach)[start[a:b] - lo] & POSITION)).astype(np.int64)
    return start, out


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, unnamed, n_bytes, sha, and the grams of the anchors of each text, with how often each occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                grams = gram_hash(prefix(d), len(d), GRAM)
                _, at = anchors(grams, o, length)
                at = np.unique(at)
                doc = np.searchsorted(o, at, side="right") - 1
                gram = grams[at]
                order = np.lexsort((gram, doc))  # a text that repeats itself has one gram at many places
                gram, doc = gram[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])) if len(gram) else order
                times = np.diff(np.append(first, len(gram)))
                count = np.bincount(doc[first], minlength=j - i)
                cols = [b.column(0).slice(i, j - i), b.column(3).slice(i, j - i), pa.array(np.diff(o), pa.int64()), b.column(2).slice(i, j - i), lists(signed(gram[first]), count, pa.int64()), lists(times, count, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "unnamed", "n_bytes", "sha", "gram", "times"])

    src = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "unnamed")
    return src.mapInArrow(run, "doc_id long, unnamed boolean, n_bytes long, sha string, gram array<long>, times array<long>")


def brief(docs: DataFrame, words: int, length: int) -> DataFrame:
    """doc_id, name, times, start, end: runs of ``words`` words under ``length`` bytes, a row for each text and name.

    ``start`` and ``end`` are lists of the spans that the runs of the name cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                heads = prefix(d)
                a, z, doc = word_spans(d, o)
                n = max(0, len(a) - words + 1)
                pick = np.flatnonzero((doc[:n] == doc[words - 1 :][:n]) & (z[words - 1 :][:n] - a[:n] < length))
                a, z, doc = a[pick], z[pick + words - 1], doc[pick]
                name = span_hash(heads, a, z)
                order = np.lexsort((a, name, doc))
                a, z, doc, name = a[order], z[order], doc[order], name[order]
                new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.empty(0, bool)
                first = np.flatnonzero(new)
                apart = new.copy()  # runs of one name are of one size, so those that touch follow each other
                apart[1:] |= a[1:] > z[:-1]
                span = np.flatnonzero(apart)
                last = np.append(span[1:], len(a)) - 1 if len(span) else span
                count = np.diff(np.append(np.searchsorted(span, first), len(span)))
                own = o[doc[span]]
                ids = b.column(0).slice(i, j - i).take(pa.array(doc[first]))
                cols = [ids, pa.array(signed(name[first])), pa.array(np.diff(np.append(first, len(a)))), lists(a[span] - own, count, pa.int64()), lists(z[last] - own, count, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "times", "start", "end"])

    return docs.mapInArrow(run, "doc_id long, name long, times long, start array<long>, end array<long>")


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a list column without nulls."""
    offs = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], np.diff(offs)


def chunks(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, start, end, k1, k2, segments: chains of segments whose anchors' grams are among ``grams``.

    ``texts``: doc_id, text, grams. A segment (gram, h1, h2, start, n, top) is the n windows from ``start`` on whose
    anchor is at ``top``; two hashes stand for the bytes of all these windows and the anchor's place there. A chain ends
    at a gap, and before a gram whose hash is smaller than both its neighbours', about every third; so any passage of
    some segments has chains of its own. k1 and k2 stand for all bytes of a chain.
    """
    kinds = [("gram", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("top", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            given, counts = column(b.column(2))
            ends = np.concatenate([[0], np.cumsum(counts)])
            for i, j, d, o in slices(data, offs):
                heads = prefix(d)
                grams = gram_hash(heads, len(d), GRAM)
                start, at = anchors(grams, o, length)
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])) if len(at) else at
                a, lo, n = at[new], start[new], np.diff(np.append(new, len(at)))
                doc = np.searchsorted(o, lo, side="right") - 1
                known = unsigned(given[ends[i] : ends[j]]) ^ mix(np.repeat(np.arange(j - i), counts[i:j]).astype(U64))
                pick = np.isin(grams[a] ^ mix(doc.astype(U64)), known)
                a, lo, n, doc = a[pick], lo[pick], n[pick], doc[pick]
                place, size = mix((a - lo).astype(U64)), n - 1 + length
                h1 = run_hash(grams, GRAM, lo, size) ^ place
                h2 = span_hash(heads, lo, lo + size) + place
                mark = np.append(mix(grams[a]), np.iinfo(np.uint64).max)
                cut = (lo[1:] != lo[:-1] + n[:-1]) | (doc[1:] != doc[:-1]) | ((mark[1:-1] < mark[:-2]) & (mark[1:-1] < mark[2:]))
                first = np.flatnonzero(np.concatenate([[True], cut])) if len(a) else a
                last = np.append(first[1:], len(a)) - 1 if len(a) else a
                head, end, own = lo[first], lo[last] + size[last], o[doc[first]]
                values = (signed(grams[a]), signed(h1), signed(h2), lo - o[doc], n, a - o[doc])
                inner = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)], names=[x for x, _ in kinds])
                cols = [
                    b.column(0).slice(i, j - i).take(pa.array(doc[first])),
                    pa.array(head - own),
                    pa.array(end - own),
                    pa.array(signed(run_hash(grams, GRAM, head, end - head))),
                    pa.array(signed(span_hash(heads, head, end))),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), inner),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "k1", "k2", "segments"])

    return texts.mapInArrow(run, "doc_id long, start long, end long, k1 long, k2 long, segments array<struct<" + ",".join(f"{x}:bigint" for x, _ in kinds) + ">>")


def pieces(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, gram, start, n and the bytes of segments. ``texts``: doc_id, text, parts (start, n, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            col = b.column(2)
            counts = np.diff(col.offsets.to_numpy())
            flat = col.flatten()
            start, n, gram = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(len(counts)), counts)
            lo, size = offs[row] + start, n - 1 + length
            for i in range(0, len(row), 4096):
                part = slice(i, i + 4096)
                raw = pa.array([data[x : x + m].tobytes() for x, m in zip(lo[part].tolist(), size[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[part])), pa.array(gram[part]), pa.array(start[part]), pa.array(n[part]), raw], ["doc_id", "gram", "start", "n", "piece"])

    return texts.mapInArrow(run, "doc_id long, gram long, start long, n long, piece binary")


def sorted_blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id, start, end: spans of windows that stand in another segment of their bucket too. ``rows``: see ``pieces``."""

    def find(ids: list, grams: list, starts: list, counts: list, raw: list) -> pa.RecordBatch:
        size, n = np.array([len(x) for x in raw], np.int64), np.array(counts, np.int64)
        at = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, bucket = np.unique(np.array(grams, np.int64), return_inverse=True)
        hit = suffix_sort.repeated(np.frombuffer(b"".join(raw), np.uint8), at[row] + step, bucket[row], length)
        row, step = row[hit], step[hit]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])) if len(row) else row
        last = np.append(first[1:], len(row)) - 1 if len(row) else row
        base, ids_ = np.array(starts, np.int64), np.array(ids, np.int64)
        cols = [ids_[row[first]], base[row[first]] + step[first], base[row[first]] + step[last] + length]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        size, last = 0, None
        for b in batches:
            for one in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if one[1] != last and size >= BLOCK_BYTES:
                    yield find(*held)
                    held, size = [[] for _ in range(5)], 0
                last = one[1]
                size += len(one[4])
                for x, v in zip(held, one, strict=True):
                    x.append(v)
        if size:
            yield find(*held)

    dealt = rows.repartition(parts, "gram").sortWithinPartitions("gram")
    return dealt.select("doc_id", "gram", "start", "n", "piece").mapInArrow(run, "doc_id long, start long, end long")


def cells(texts: DataFrame, length: int, step: int) -> DataFrame:
    """doc_id, start, n, top, core, around: windows cut into runs of ``step`` starts, counted back from a common place.

    ``texts``: doc_id, text, parts (start, n, top, key): n windows from ``start`` on, in which ``top`` stands where it
    stands in all that are equal. ``core`` names the bytes that all windows of a run have in common (for single windows
    the key), ``around`` the bytes of all its windows in this text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            col = b.column(2)
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            flat = col.flatten()
            start, n, top, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for i, j, d, o in slices(data, offs):
                grams = gram_hash(prefix(d), len(d), GRAM)
                part = slice(ends[i], ends[j])
                doc = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                lo, hi, up = start[part] + o[doc], start[part] + n[part] - 1 + o[doc], top[part] + o[doc]
                g0, g1 = (up - hi) // step, (up - lo) // step
                m = g1 - g0 + 1
                of = np.repeat(np.arange(len(m)), m)
                g = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + g0[of]
                up = up[of] - g * step
                p, q, doc = np.maximum(lo[of], up - step + 1), np.minimum(hi[of], up), doc[of]
                core = unsigned(key[part][of])
                if step > 1:
                    core = mix(core + g.astype(U64)) ^ run_hash(grams, GRAM, up, length - step + 1)
                around = run_hash(grams, GRAM, p, q - p + length) ^ mix((up - p).astype(U64))
                ids = b.column(0).slice(i, j - i).take(pa.array(doc))
                cols = [ids, *[pa.array(x) for x in (p - o[doc], q - p + 1, up - o[doc], signed(core), signed(around))]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n", "top", "core", "around"])

    return texts.mapInArrow(run, "doc_id long, start long, n long, top long, core long, around long")


def whole_characters(text: np.ndarray, gone: np.ndarray) -> bytes:
    """The bytes of the characters none of whose bytes is ``gone``."""
    char = np.cumsum((text & 0xC0) != 0x80)
    broken = np.zeros(len(text) + 1, bool)
    broken[char[gone]] = True
    return text[~broken[char]].tobytes()


def cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256 and perhaps kept. ``texts``: doc_id, text, spans (start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            size = 0
            col = b.column(2)
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            flat = col.flatten()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            data, offs = utf8(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = data[offs[i] : offs[i + 1]]
                marks = np.zeros(len(text) + 1, np.int64)
                np.add.at(marks, start[ends[i] : ends[i + 1]], 1)
                np.add.at(marks, end[ends[i] : ends[i + 1]], -1)
                gone = np.cumsum(marks)[:-1] > 0
                digest = hashlib.sha256(text[~gone].tobytes()).hexdigest()
                kept = whole_characters(text, gone) if with_text else None
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                for c, v in zip(out, (doc, int(gone.sum()), spans, digest, kept), strict=True):
                    c.append(v)
                size += len(kept) if kept else 0
                if size > 8 << 20:
                    yield batch(out)
                    out, size = [[] for _ in range(5)], 0
            yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def split_buckets(texts: DataFrame, parts: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """doc_id, start, end: spans of windows that stand elsewhere in their bucket, by counting names, coarse to fine.

    ``parts``: doc_id, start, n, top, key. Runs of windows whose core no other run has are done with; runs equal in all
    their bytes stand elsewhere as wholes; of each kind of the others one is cut into shorter runs.
    """
    spans = None
    for step in STEPS:
        own = parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "top", "key")).alias("parts"))
        runs = scratch.save(cells(texts.select("doc_id", "text").join(own.hint("merge"), "doc_id"), length, step), "runs")
        names = runs.groupBy("core", "around").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "n", "top")).alias("one"))
        names = scratch.save(names, "names")
        twice = scratch.save(names.where("c > 1").select("core", "around"), "twice", few=True)
        whole = runs.join(twice, ["core", "around"]).select("doc_id", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))
        spans = whole if spans is None else spans.unionAll(whole)
        if step > 1:
            tied = scratch.save(names.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"), "ties", few=True)
            parts = scratch.save(names.join(tied, "core").select("one.*", F.col("core").alias("key")), "parts")
    return spans


def remove_repeats(df: DataFrame, scratch: Scratch, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, words: int = 0, most_segments: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and kept) for each row of ``df`` (rows of equal id are equal).

    Each byte is removed that a ``length``-byte string covers which also starts at another place of any text; the same
    text counts, overlaps count, and strings are judged on the input. Texts are UTF-8 bytes; with ``with_text``, kept holds
    the remaining bytes but for characters that are cut in two, and is null for a text that stays whole. Of equal texts one stands for all: the others and itself, of ``length`` bytes or
    more, are covered by each other throughout, as are repeated rows. A text's own repeats are found like those of others. Rows without an
    id are judged like others and get a null id. Null and empty texts lose nothing; an empty table gives an empty result;
    other columns of ``df``, whatever their names, aren't read. ``length`` must be 128 at least. With ``words``, strings
    of so many words go too where they are shorter. A bucket of up to ``most_segments`` different segments is sorted in
    one task, a larger one is split; the result is the same.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = df.sparkSession
    ship(spark)
    own_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = df.select(row_key(own_id, text).alias("doc_id"), text.alias("text"), own_id.isNull().alias("unnamed"))
    base = scratch.save(anchored(docs, length), "anchors")
    docs = docs.drop("unnamed")
    copies = base.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = scratch.save(copies, "copies", few=True)
    members = scratch.save(base.select("doc_id", "sha", "n_bytes").join(copies, ["sha", "n_bytes"]).select("doc_id", "rep").distinct(), "members")
    alone = base.join(members.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    at = alone.where(F.size("gram") > 0).select("doc_id", F.explode(F.arrays_zip("gram", "times")).alias("x")).select("doc_id", "x.gram", "x.times")
    at = scratch.save(at, "grams")
    # tables of their own here and below, so that the rows of a hot key can be split in the join that follows
    often = scratch.save(at.groupBy("gram").agg(F.sum("times").alias("c")).where("c > 1").select("gram"), "often", few=True)
    known = at.join(often, "gram").select("doc_id", "gram")
    if words:
        runs = scratch.save(brief(docs, words, length), "short")
        shared = scratch.save(runs.groupBy("name").agg(F.sum("times").alias("c")).where("c > 1").select("name"), "shared")
        runs = scratch.save(runs.join(shared, "name").select("doc_id", F.explode(F.arrays_zip("start", "end")).alias("x")).select("doc_id", "x.*"), "brief")
        scratch.drop("short")
        known = known.unionAll(runs.select("doc_id", F.lit(None).cast("long")))  # their texts are needed, no gram is
    grams = known.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    # joins of texts are merge joins at every size: one plan to know
    texts = scratch.save(docs.join(grams.hint("merge"), "doc_id"), "texts")
    scratch.drop("grams")
    # chains that stand twice: all their windows do; of each kind of chain one is looked at closer
    chains = scratch.save(chunks(texts, length), "chains")
    one = chains.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "segments")).alias("one"))
    one = scratch.save(one, "chain-kinds")
    twice = scratch.save(one.where("c > 1").select("k1", "k2"), "chains-twice", few=True)
    spans = chains.join(twice, ["k1", "k2"]).select("doc_id", "start", "end")
    segs = one.select("one.doc_id", F.explode("one.segments").alias("x")).select("doc_id", "x.*")
    segs = scratch.save(segs, "segments")
    kinds = segs.groupBy("gram", "h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start", "n", "top")).alias("one"))
    kinds = scratch.save(kinds, "kinds")
    # segments that stand twice: all their windows do
    again = scratch.save(kinds.where("c > 1").select("gram", "h1", "h2"), "segments-twice", few=True)
    whole = segs.join(again, ["gram", "h1", "h2"]).select("doc_id", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))
    # buckets of several kinds: one segment of each
    buckets = scratch.save(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets", few=True)
    open_ = scratch.save(kinds.join(buckets, "gram").select("one.*", "gram", "kinds"), "open")
    small = open_.where(F.col("kinds") <= most_segments).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "gram")).alias("parts"))
    rows = pieces(texts.select("doc_id", "text").join(small.hint("merge"), "doc_id").select("doc_id", "text", "parts"), length)
    some = scratch.save(sorted_blocks(rows, length, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sorted")
    large = scratch.save(open_.where(F.col("kinds") > most_segments).select("doc_id", "start", "n", "top", F.col("gram").alias("key")), "large", few=True)
    if not large.isEmpty():
        some = some.unionAll(split_buckets(texts, large, scratch, length))
    spans = spans.unionAll(whole).unionAll(some)
    if words:
        spans = spans.unionAll(runs.select("doc_id", "start", "end"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = scratch.save(cut(texts.select("doc_id", "text").join(spans.hint("merge"), "doc_id"), with_text).dropDuplicates(["doc_id"]), "cut")
    scratch.drop("chains", "chain-kinds", "chains-twice", "segments", "segments-twice", "kinds", "buckets", "open", "sorted", "large", "runs", "parts", "names", "twice", "ties", "often", "copies", "texts")
    out = base.select("doc_id", "unnamed", "n_bytes", "sha").join(done, "doc_id", "left").join(members, "doc_id", "left")
    gone = F.col("rep").isNotNull() & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    cols = [
        F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"),
        F.col("n_bytes"),
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)
