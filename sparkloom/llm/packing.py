"""Packing: harmonic bins of a fixed number of documents, each worker for itself."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship
from .tokens import encoder

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


class HarmonicPacker:
    """Packs documents of one worker into sequences of ``capacity`` tokens.

    Whole sequences are cut off a document first. What is left, of r tokens, belongs to the class k of reciprocal
    capacity, capacity/(k+1) < r <= capacity/k, and a bin of class k takes exactly k documents. The gap of a full bin
    is filled with the head of the next document. At the end, what stands in open bins is run together; of the last,
    shorter run each sequence has a power of two tokens, so nothing is padded.
    """

    def __init__(self, capacity: int = 4096, classes: int = 64, first_id: int = 0):
        self.capacity, self.classes, self.next_id = capacity, classes, first_id
        self.open: dict[int, list] = {}
        self.gap: list | None = None  # pieces of the bin whose gap is being filled
        self.room = 0
        self.out: list[tuple[int, ...]] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, pos, cap = len(ids) // 4, 0, self.capacity
        if self.gap is not None and total:
            pos = min(self.room, total)
            self.gap.append((doc, 0, ids[: 4 * pos], total))
            self.room -= pos
            if not self.room:
                self.emit(self.gap)
                self.gap = None
        while total - pos >= cap:
            self.emit([(doc, pos, ids[4 * pos : 4 * (pos + cap)], total)])
            pos += cap
        if rest := total - pos:
            k = min(cap // rest, self.classes)
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, pos, ids[4 * pos :], total))
            if len(bin_) == k:
                del self.open[k]
                self.room = cap - sum(len(p[2]) // 4 for p in bin_)
                if self.room:
                    self.gap = bin_
                else:
                    self.emit(bin_)

    def finish(self) -> None:
        left = [*(self.gap or []), *(p for k in sorted(self.open) for p in self.open[k])]
        self.gap, self.open = None, {}
        tokens = sum(len(p[2]) // 4 for p in left)
        while tokens:
            size = self.capacity if tokens >= self.capacity else 1 << (tokens.bit_length() - 1)
            tokens -= size
            taken: list[tuple] = []
            while size:
                doc, start, ids, total = left.pop(0)
                n = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], total))
                size -= n
                if 4 * n < len(ids):
                    left.insert(0, (doc, start + n, ids[4 * n :], total))
            self.emit(taken)


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there, and its sequence and offset.

    ``capacity`` must be a power of two. Each document is its token ids and then ``end_id``; a null or empty text is
    ``end_id`` alone. Each id stands in exactly one piece. Workers need nothing of each other: a sequence id has the
    partition's number above its low 40 bits. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    ship(df.sparkSession)
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "bytes")
        packer = HarmonicPacker(capacity, classes, TaskContext.get().partitionId() << 40)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True)) or [[]] * len(COLUMNS)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(COLUMNS))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, enc(text) + tail)
                if len(packer.out) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
