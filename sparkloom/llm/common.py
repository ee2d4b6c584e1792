"""Shared helpers: scratch tables in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where all run on one machine, one is set when it is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one run, written to the shared folder so that lineage ends there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/loom/{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """With ``few``, by two tasks for each core at most: small tables aren't spread over a file for each partition."""
        path = self.path(name)
        df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism) if few else df
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables whose name has one of these endings."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(base):
            for status in fs.listStatus(base):
                if any(status.getPath().getName().endswith(f"-{n}") for n in names):
                    fs.delete(status.getPath(), True)


#: Where the keys of rows without an id begin; ids are below.
UNNAMED = 1 << 62


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or for a row without one a hash of its text above all ids, so that it is judged like other rows."""
    own = F.xxhash64(text).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    return F.coalesce(doc_id.cast("long"), own)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds Arrow batches by bytes.

    A batch stands in a worker several times over (JVM buffer, socket, arrays), so one of 64 MB, the usual bound, is
    too much for two workers beside an executor's heap. A bound that the user has set is kept.
    """
    app = spark.sparkContext.applicationId
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64MB", str(64 << 20)):
        spark.conf.set(key, str(BATCH_BYTES))
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.basename(root)
    out = os.path.join(tempfile.mkdtemp(prefix="loom-"), "loom_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(top, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


# ---------------------------------------------------------------- bytes of Arrow columns


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if buffers[2] is None or buffers[2].size == 0:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes (one longer text is a run of its own)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # masks of the first k bytes of eight
SIZE = U64(0xA24BAED4963EE407)


def prefix(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros past the end), each byte put through ``table`` first."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if table is None else table[data]
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,)).copy()


def span_hash(heads: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end, alike wherever they stand. ``heads``: see ``prefix``.

    Eight bytes at a time are mixed with their number, so no pattern of the text (repeats, Thue-Morse words) cancels out
    as it does in polynomials modulo a power of two.
    """
    size = end - start
    out = mix((heads[start] & FIRST[np.minimum(size, 8)]) ^ SIZE)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3  # further runs of eight
        first = np.cumsum(n) - n
        k = np.arange(1, int(n.sum()) + 1) - np.repeat(first, n)
        at = np.repeat(start[long], n) + 8 * k
        left = np.minimum(np.repeat(end[long], n) - at, 8)
        v = mix((heads[at] & FIRST[left]) ^ mix(k.astype(U64) * U64(BASE)))
        out[long] += np.add.reduceat(v, first)
    return mix(out + size.astype(U64) * SIZE)


def gram_hash(heads: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (8 times a power of two) from each place on, of the n bytes that ``heads`` is of."""
    out, have = mix(heads[: max(0, n - 7)] ^ SIZE), 8
    while have < size and len(out):
        out = mix(out[:-have] * U64(BASE) + out[have:]) if len(out) > have else out[:0]
        have *= 2
    return out


def run_hash(grams: np.ndarray, size: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of ``length`` bytes from ``start`` on, ``size`` of them at least, out of the hashes of all grams of that size."""
    length = np.broadcast_to(np.asarray(length, np.int64), start.shape)
    out = length.astype(U64) * SIZE
    last = start + length - size
    for k in range(0, int(length.max(initial=0)), size):
        on = k < length
        out = np.where(on, mix(out * U64(BASE) + grams[np.where(on, np.minimum(start + k, last), 0)]), out)
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: the runs of bytes that are no separators."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    sp = space[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = sp[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = sp[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = True
    start = np.flatnonzero(~sp & before)
    end = np.flatnonzero(~sp & after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive hashes."""
    n = len(hashes) - k + 1
    acc = np.full(max(n, 0), k, U64)
    for j in range(k):
        acc = mix(acc * U64(BASE) + hashes[j : j + n])
    return acc


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of each k-word shingle.

    A text of fewer words gives its whole sequence as one shingle, a text without words none.
    """
    if not len(hashes):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    parts = []
    if len(hashes) >= k:
        at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        parts.append((fold(hashes, k)[at], doc[at], at))
    for c in range(1, k):
        at = first[count == c]
        if len(at):
            acc = np.full(len(at), c, U64)
            for j in range(c):
                acc = mix(acc * U64(BASE) + hashes[at + j])
            parts.append((acc, doc[at], at))
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(out[2], kind="stable")
    return out[0][order], out[1][order], out[2][order]


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise mask over each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column with counts[i] values in row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U64)
