"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, prefix, ship, shingles, slices, span_hash, utf8, word_spans

#: White space and ASCII punctuation part words; case is folded before.
PARTS = np.zeros(256, bool)
PARTS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
BITMAP = 22


def text_shingles(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts i..j: hashes, first words and the cut of each text's k-word shingles."""
    data, offs = utf8(pc.utf8_lower(col))
    for i, j, d, o in slices(data, offs):
        start, end, doc = word_spans(d, o, PARTS)
        h, owner, at = shingles(span_hash(prefix(d), start, end), doc, j - i, k)
        first = np.searchsorted(doc, owner)
        yield i, j, h, at - first, np.searchsorted(owner, np.arange(j - i + 1))


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums over shingles of +1 or -1 for each of 64 bits."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    bits = (sums[start + size] - sums[start] > 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(U64).ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared weight by total weight of two bags of shingles; a shingle weighs as often as it stands there."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low)


class Items:
    """Benchmark items by their number of shingles, with the block index of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int, radius: int):
        self.radius, self.k = radius, k
        edges = np.linspace(0, 64, radius + 2).round().astype(int)  # radius+1 blocks: one of them is equal within radius
        self.masks = [U64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, _, h, _, cut in text_shingles(pa.array(texts, pa.string()), k):
            for n, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    by.setdefault(int(b - a), []).append((ids[i + n], h[a:b]))
        self.by = {s: ([x[0] for x in v], [x[1] for x in v]) for s, v in by.items()}
        self.prints = {s: np.array([fingerprints(bit_sums(h), np.zeros(1, int), s)[0] for h in v[1]], U64) for s, v in self.by.items()}
        every = [h for _, v in self.by.values() for h in v]
        self.known = np.unique(np.concatenate(every)) if every else np.empty(0, U64)
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[self.known >> U64(64 - BITMAP)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Which shingles stand in an item."""
        out = self.bitmap[h >> U64(64 - BITMAP)]
        at = np.flatnonzero(out)
        where = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = self.known[where] == h[at]
        return out

    def pairs(self, prints: np.ndarray, size: int) -> np.ndarray:
        """Mask of windows and items that share a block and lie within the radius.

        At 22 of 64 bits the blocks are 2 or 3 bits wide and nearly all pairs share one, so it is the count of known
        shingles, taken before, that leaves few windows, and the distance that leaves few items.
        """
        own = self.prints[size]
        shared = np.zeros((len(prints), len(own)), bool)
        for mask in self.masks:
            shared |= (prints & mask)[:, None] == (own & mask)[None, :]
        w, i = np.nonzero(shared)
        far = np.bitwise_count(prints[w] ^ own[i]) > self.radius
        shared[w[far], i[far]] = False
        return shared

    def find(self, h: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item -> best similarity, first shingle and number of shingles of the window, over the windows of one text.

        A window as similar as ``threshold`` holds at least that share of shingles known from items, so others
        aren't looked at.
        """
        out: dict[int, tuple[float, int, int]] = {}
        marks = np.concatenate([[0], np.cumsum(self.hits(h))])
        if marks[-1] == 0:
            return out
        sums = None
        for size, (ids, bags) in self.by.items():
            m = min(size, len(h))
            need = int(np.ceil(threshold * size - 1e-9))
            start = np.flatnonzero(marks[m:] - marks[:-m] >= max(1, need))
            if not len(start):
                continue
            sums = bit_sums(h) if sums is None else sums
            for c in range(0, len(start), 512):
                part = start[c : c + 512]
                for w, i in zip(*np.nonzero(self.pairs(fingerprints(sums, part, m), size)), strict=True):
                    at = int(part[w])
                    s = weighted_similarity(h[at : at + m], bags[i])
                    if s >= threshold and s > out.get(ids[i], (0.0,))[0]:
                        out[ids[i]] = (s, at, m)
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 22, block_items: int = 20_000, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_shingles: the best window of each document for each item it holds.

    Every window of as many k-word shingles as an item has is compared by SimHash (64 bits, within ``radius``) and
    then exactly, by bags of shingles. The items are a stated query set: they are read in blocks of ``block_items`` items
    or ``block_bytes`` bytes of text, which bounds what is broadcast (a single longer item is a block of its own), and
    each block meets all documents in one pass without a shuffle. Columns of ``docs`` but the two named aren't read. Null and empty texts hold nothing and match nothing;
    a text of fewer than k words is one shingle; repeated rows give repeated results, rows and items without an id have null there, items of one id count as one, of equal windows the first
    counts; without documents or items the result is empty.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, similarity double, start_word long, n_shingles long"
    names = [x.split()[0] for x in schema.split(", ")]

    def finder(items: Items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                rows: list[tuple] = []
                ids = b.column(0)
                for i, j, h, at, cut in text_shingles(b.column(1), k):
                    if not len(own.known):
                        continue
                    total = np.concatenate([[0], np.cumsum(own.hits(h))])
                    for n in np.flatnonzero(total[cut[1:]] > total[cut[:-1]]):
                        a, e = cut[n], cut[n + 1]
                        for item, (s, w, m) in sorted(own.find(h[a:e], threshold).items(), key=lambda x: (x[0] is None, x[0])):
                            rows.append((ids[i + int(n)].as_py(), item, s, int(at[a + w]), m))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

        return src.mapInArrow(run, schema)

    found = [finder(items) for items in item_blocks(benchmark, k, radius, block_items, block_bytes, item_col, item_text)]
    return reduce(DataFrame.unionAll, found)


def item_blocks(benchmark: DataFrame, k: int, radius: int, block_items: int, block_bytes: int, item_col: str, item_text: str) -> Iterator[Items]:
    """The items, at most ``block_items`` of them and about ``block_bytes`` bytes of text at a time; one empty block where there are none."""
    ids, texts, any_, size = [], [], False, 0
    for item, text in benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text}`")).toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text.encode()) if text else 0
        if len(ids) == block_items or size >= block_bytes:
            yield Items(ids, texts, k, radius)
            ids, texts, any_, size = [], [], True, 0
    if ids or not any_:
        yield Items(ids, texts, k, radius)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 22, block_items: int = 20_000, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``find_leaks``. Nothing is shuffled."""
    ship(docs.sparkSession)

    def without(df: DataFrame, items: Items) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                if len(own.known):
                    for i, _, h, _, cut in text_shingles(b.column(b.schema.get_field_index(text_col)), k):
                        total = np.concatenate([[0], np.cumsum(own.hits(h))])
                        for n in np.flatnonzero(total[cut[1:]] > total[cut[:-1]]):
                            clean[i + n] = not own.find(h[cut[n] : cut[n + 1]], threshold)
                yield b.filter(pa.array(clean))

        return df.mapInArrow(run, df.schema)

    return reduce(without, item_blocks(benchmark, k, radius, block_items, block_bytes, item_col, item_text), docs)
