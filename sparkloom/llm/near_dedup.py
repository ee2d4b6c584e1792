"""MinHash near-dedup: fast similarity sketches, banding, and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, UNNAMED, Scratch, lists, mix, prefix, row_key, ship, shingles, signed, slices, span_hash, utf8, word_spans
from .graph import components

STEP = U64(0x9E3779B97F4A7C15)


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of t coordinates of a set of distinct hashes.

    In each round every element falls into a bin with a value, and an empty bin takes the smallest value that falls
    into it. In rounds t to 2t-1 all elements fall into bin round-t, so every coordinate is filled in the end.
    """
    out, full, i = np.zeros(t, U64), np.zeros(t, bool), 0
    low = U64((1 << 40) - 1)
    if len(x) * t <= 20_000:  # few elements take many rounds: some at once
        step = max(1, min(t, 20_000 // max(1, len(x) * 4)))
    else:
        step = 1
    while i < t and not full.all():
        rounds = np.arange(i, min(t, i + step), dtype=U64)
        h = mix(x[None, :] + (rounds[:, None] + U64(1)) * STEP)
        bins = ((h >> U64(40)) * U64(t)) >> U64(24)
        for r in range(len(rounds)):
            s = np.sort((bins[r] << U64(40)) | (h[r] & low))
            b = (s >> U64(40)).astype(np.int64)
            first = np.concatenate([[True], b[1:] != b[:-1]])
            at, v = b[first], s[first] & low
            new = ~full[at]
            out[at[new]] = v[new] + (rounds[r] << U64(40))
            full[at] = True
            if full.all():
                break
        i += step
    for b in np.flatnonzero(~full):
        shift = U64((t + int(b) + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
        out[b] = (mix(x + shift) & low).min() + (U64(t + int(b)) << U64(40))
    return out


def band_keys(s: np.ndarray, bands: int) -> np.ndarray:
    rows = s.reshape(bands, -1)
    acc = np.arange(1, bands + 1, dtype=U64)
    for j in range(rows.shape[1]):
        acc = mix(acc * STEP + mix(rows[:, j]))
    return acc


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The set of distinct k-word shingles of each text (A-Z in lower case), sorted."""
    start, end, doc = word_spans(data, offs)
    n = len(offs) - 1
    h, d, _ = shingles(span_hash(prefix(data, LOWER), start, end), doc, n, k)
    cut = np.searchsorted(d, np.arange(n + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def sketches(df: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, unnamed, n_shingles, h1 and h2 (which stand for the set) and the band keys; no keys for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                sets = shingle_sets(d, o, k)
                size = np.array([len(x) for x in sets])
                h1 = np.array([mix(x + U64(5)).sum(dtype=U64) for x in sets], U64)
                h2 = np.array([mix(x ^ U64(0x5BD1E9955BD1E995)).sum(dtype=U64) for x in sets], U64)
                keys = [band_keys(sketch(x, bands * rows), bands) for x in sets if len(x)]
                flat = np.concatenate(keys) if keys else np.empty(0, U64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)), lists(signed(flat), np.where(size > 0, bands, 0), pa.int64())],
                    ["doc_id", "unnamed", "n_shingles", "h1", "h2", "bands"],
                )

    return df.mapInArrow(run, "doc_id long, unnamed boolean, n_shingles long, h1 long, h2 long, bands array<long>")


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and of ``right`` (positions in ``sets``), as a forest that connects alike.

    Members of one label are known to be connected already and aren't compared. So of two that are compared, one at
    least isn't of the commonest label, and only those are gone through. Intersections are exact: the set is marked in
    the universe of shared shingles and counted over all sets of the other side at once.
    """
    same = left is right
    members = left if same else np.concatenate([left, right])
    kinds, count = np.unique(labels[members], return_counts=True)
    rare = members[labels[members] != kinds[np.argmax(count)]]
    if not len(rare):
        return []
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[ids] > 1
    owner = np.repeat(np.arange(len(sets)), size)[shared]
    ids = ids[shared]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    sides = []
    for side in (left, right):
        inside = np.zeros(len(sets), bool)
        inside[side] = True
        pick = inside[owner]
        sides.append((inside, ids[pick], owner[pick]))
    _, first, alike = np.unique(labels, return_index=True, return_inverse=True)
    up = first[alike]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    out, mark = [], np.zeros(len(count), bool)
    for u in rare:
        inside, other_ids, other_owner = sides[1] if same or sides[0][0][u] else sides[0]
        mark[ids[cut[u] : cut[u + 1]]] = True
        inter = np.bincount(other_owner[mark[other_ids]], minlength=len(sets))
        mark[ids[cut[u] : cut[u + 1]]] = False
        near = (100 * inter >= percent * (size + size[u] - inter)) & inside & (inter > 0) & (labels != labels[u])
        for v in np.flatnonzero(near):
            a, b = root(int(u)), root(int(v))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(u), int(v)))
    return out


def verify(rows: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Links (a, b). ``rows``: group, side (0, 1, or 2 for both), doc_id, label, text.

    A group is a pair of blocks, or a whole small class, or some texts and the one that they may be near to; it stands
    in one task, which holds its shingle sets alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, labels, sets = None, [], [], [], []

        def close() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            side = np.array(sides)
            both = np.flatnonzero(side == 2)
            left, right = (both, both) if len(both) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(left) or not len(right):
                return []
            return [(ids[a], ids[b]) for a, b in links_within(sets, left, right, np.array(labels), percent)]

        def links(got: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            got: list[tuple[int, int]] = []
            groups, side, docs, label = (batch.column(i).to_pylist() for i in range(4))
            data, offs = utf8(batch.column(4))
            for i, _, d, o in slices(data, offs):
                for n, s in enumerate(shingle_sets(d, o, k), i):
                    if groups[n] != key:
                        got += close()
                        key, ids, sides, labels, sets = groups[n], [], [], [], []
                    ids.append(docs[n])
                    sides.append(side[n])
                    labels.append(label[n])
                    sets.append(s)
            yield links(got)
        yield links(close())

    dealt = rows.repartition(parts, "group").sortWithinPartitions("group")
    return dealt.select("group", "side", "doc_id", "label", "text").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", least_block: int = 64, most_block: int = 2048, block_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df`` (rows of equal id are equal).

    Two documents are linked when 100 * shared shingles >= ``percent`` * shingles of both together; component_id is
    the smallest id reachable over links, and the document of that id is kept. Texts with equal sets are one vertex.
    Documents that share a band key (any of ``bands``; at the threshold a pair shares none with probability
    (1 - s**rows)**bands) are candidates, and all of them are compared on full sets:

    1. Each document is compared with the smallest one of each of its buckets. What is linked is merged.
    2. A bucket whose documents aren't all merged by then is open. Documents of open buckets that hang together form a
       class, and in it all pairs not merged yet are compared: small classes in one task, larger ones as pairs of blocks.

    A task holds the sets of two blocks, of at most ``most_block`` documents and about ``block_shingles`` shingles each
    (a larger single text is a block of its own). No pair is ever a row but those of step 1, at most ``bands`` for each
    document; of links there are no more than connect a group. No candidate is dropped.

    Null and empty texts have no shingles and are linked with nothing; a text of fewer than k words has its whole
    sequence as one shingle; repeated rows get the same answer. Rows without an id are judged like others and come
    after all ids: component_id is null in a group that has no id, and one of its texts is kept. An empty table gives
    an empty result; other columns of ``df``, whatever their names, aren't read.
    """
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = df.select(row_key(own_id, text).alias("doc_id"), text.alias("text"), own_id.isNull().alias("unnamed"))
    sk = scratch.save(sketches(docs, k, bands, rows), "sketch")
    docs = docs.drop("unnamed")
    full = sk.where("n_shingles > 0")
    copies = full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = scratch.save(copies, "copies", few=True)  # a table of its own, so that a hot set's rows can be split in the join
    members = scratch.save(full.select("doc_id", "h1", "h2", "n_shingles").join(copies, ["h1", "h2", "n_shingles"]).select("doc_id", "rep").distinct(), "members")
    doubles = members.where("doc_id <> rep").select("doc_id")
    keys = scratch.save(full.select("doc_id", "n_shingles", F.explode("bands").alias("key")).join(doubles, "doc_id", "left_anti"), "keys")
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    hubs = scratch.save(hubs, "hubs", few=True)
    blocks = lambda docs, shingles, most: F.greatest(F.ceil(docs / most), F.ceil(shingles / block_shingles), F.lit(1)).cast("int")
    total = [F.count("*").alias("g"), F.sum("n_shingles").alias("s")]

    # 1: each document and the smallest of its bucket
    near = keys.join(hubs, "key").where("doc_id <> a").select("a", "doc_id", "n_shingles").distinct()
    near = scratch.save(near, "near")
    # the texts of all candidates, once; merge joins at every size: one plan to know
    candidates = near.select("doc_id").unionAll(near.select(F.col("a").alias("doc_id"))).distinct()
    pool = scratch.save(docs.join(candidates.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "candidate-texts")
    fan = scratch.save(near.groupBy("a").agg(*total).select("a", blocks(F.col("g"), F.col("s"), -(-most_block // 8)).alias("n")), "fan", few=True)
    spokes = near.join(fan, "a").select("doc_id", F.concat_ws(":", "a", F.pmod(F.xxhash64("doc_id"), F.col("n"))).alias("group"), F.lit(1).alias("side"))
    centres = fan.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("doc_id", F.concat_ws(":", "a", "i").alias("group"), F.lit(0).alias("side"))
    texts = pool.join(scratch.save(spokes.unionAll(centres), "spokes").hint("merge"), "doc_id").withColumn("label", F.col("side").cast("long"))
    merged = scratch.save(verify(texts, k, percent, parts), "links")
    scratch.drop("near", "fan", "spokes")
    first = components(merged, scratch, "stars").select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    # 2: buckets that still hold several groups
    keys = scratch.save(keys.join(first, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    scratch.drop("keys", "hubs")
    still = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "a")
    still = scratch.save(still, "open", few=True)
    inside = scratch.save(keys.join(still, "key").select("a", "doc_id", "n_shingles", "label").distinct(), "inside")
    scratch.drop("labelled", "open")
    classes = components(inside.select("a", F.col("doc_id").alias("b")), scratch, "candidates").select(F.col("node").alias("doc_id"), "component")
    classes = scratch.save(inside.select("doc_id", "n_shingles", "label").distinct().join(classes, "doc_id"), "placed")
    # a class is dealt into blocks; each document goes to the pairs that its block is part of
    block = F.least(F.lit(most_block), F.greatest(F.lit(least_block), F.ceil(F.col("g") / 16)))
    size = scratch.save(classes.groupBy("component").agg(*total).select("component", blocks(F.col("g"), F.col("s"), block).alias("n")), "sizes", few=True)
    placed = scratch.save(classes.join(size, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")), "blocks")
    dealt = pool.join(placed.hint("merge"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    group = F.concat_ws(":", "component", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    more = scratch.save(verify(dealt.select(group.alias("group"), side.alias("side"), "doc_id", "label", "text"), k, percent, parts), "links")
    found = components(merged.unionAll(more), scratch, "classes")
    scratch.drop("candidate-texts", "inside", "placed", "blocks")
    out = sk.select("doc_id", "unnamed", "n_shingles").join(members, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(
        F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        F.when(~F.col("unnamed") | (component < UNNAMED), component).alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )
