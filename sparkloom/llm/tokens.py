"""Token counts: a broadcast table of frequent words and worker caches before the tokenizer itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# The split pattern of the vocabulary file, for the characters of SAFE alone.
LETTERS = "a-zªµºß-öø-ſ"
DIGITS = "0-9²³¹¼½¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
#: What isn't in this class (or may start a special string) goes through the library as a whole text:
#: within the class NFC changes nothing and lower case, letters, digits and spaces are beyond doubt.
UNSAFE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|")
CACHE, LONGEST = 200_000, 64  # entries of a worker's table, and characters of one


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: kept if printable, else from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)}


class Pieces(dict):
    """Pre-token -> what ``make`` gives for its ids; full caches answer without keeping."""

    def __init__(self, model, make: Callable[[list[int]], object]):
        super().__init__()
        self.model, self.make, self.chars = model, make, byte_chars()

    def __missing__(self, piece: str):
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))]
        out = self.make(ids)
        if len(self) < CACHE and len(piece) <= LONGEST:
            self[piece] = out
        return out


class Words(dict):
    """White-space word (lower case) -> the joined results of its pre-tokens."""

    def __init__(self, pieces: Pieces, join: Callable):
        super().__init__()
        self.pieces, self.join = pieces, join

    def __missing__(self, word: str):
        out = self.join(map(self.pieces.__getitem__, PIECES.findall(word)))
        if len(self) < CACHE and len(word) <= LONGEST:
            self[word] = out
        return out


class Encoder:
    """``tokenizers`` for one vocabulary file, without begin, end or added special tokens."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        make, self.join = {"count": (len, sum), "bytes": (to_bytes, b"".join)}[kind]
        self.make = make
        self.words = Words(Pieces(self.lib.model, make), self.join)

    def __call__(self, text: str | None):
        if not text:
            return self.join(())
        if UNSAFE.search(text):
            return self.make(self.lib.encode(text, add_special_tokens=False).ids)
        return self.join(map(self.words.__getitem__, text.lower().split()))


def to_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def frequent_words(df: DataFrame, text_col: str, path: str, sample_docs: int, size: int) -> dict[str, int]:
    """Token counts of the most frequent words of a few documents, at most ``size`` entries.

    The table only saves work: a word that isn't in it is encoded where it is met, so the sample changes no result.
    It is taken from the first partitions, of texts short enough that the driver holds little.
    """
    seen: Counter = Counter()
    for (text,) in df.select(text_col).where(F.length(text_col) <= 20_000).take(sample_docs):
        if not UNSAFE.search(text):
            seen.update(text.lower().split())
    enc = encoder(path, "count")
    return {w: enc.words[w] for w, _ in seen.most_common(size)}


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 2048, sample_docs: int = 400, table_size: int = 20_000) -> DataFrame:
    """The columns of ``df`` but the text, then n_bytes, n_tokens and over_limit of each row.

    Columns of the names added, in upper or lower case, are replaced.
    A word is looked up in a broadcast table of frequent words (at most ``table_size`` entries, from ``sample_docs``
    documents), then in the worker's cache, then encoded; no word is ever shuffled. Null and empty texts have 0 bytes
    and 0 tokens; repeated rows are counted each for itself; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_words(df, text_col, tokenizer, sample_docs, table_size))
    keep = [c for c in df.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    src = df.select(*[F.col(f"`{c}`") for c in keep])
    carried = [c for c in keep if c != text_col]
    schema = src.select(*[F.col(f"`{c}`") for c in carried], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "count")
        if not enc.words:
            enc.words.update(table.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            n = pa.array([enc(t) for t in texts], pa.int64())
            cols = [b.column(b.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*cols, size, n], [*carried, "n_bytes", "n_tokens"])

    return src.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
