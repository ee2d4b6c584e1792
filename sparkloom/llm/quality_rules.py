"""Quality rules: statistics of every text, then a cascade of rules ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, fold, mix, per_text, prefix, ship, slices, span_hash, utf8, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
TAIL = (np.arange(256) & 0xC0) == 0x80  # bytes within a code point
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs, and whether the same value stands at an earlier place."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    count = np.empty(len(key), np.int64)
    count[order] = np.bincount(group)[group] if len(k) else 0
    later = np.empty(len(key), bool)
    later[order] = ~new
    return count, later


@dataclass
class Texts:
    """A run of whole texts and what the rules share of them."""

    data: np.ndarray
    offs: np.ndarray
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        self.n = len(self.offs) - 1
        self.start, self.end, self.doc = word_spans(self.data, self.offs)
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.heads = prefix(self.data)
        self.hash = span_hash(self.heads, self.start, self.end)

    def word_chars(self) -> np.ndarray:
        return per_text(~SPACE[self.data] & ~TAIL[self.data], self.offs)

    def symbols(self) -> np.ndarray:
        return per_text(SYMBOLS[self.data], self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and how many of them equal an earlier line, of each text."""
        brk = np.zeros(256, bool)
        brk[10] = True
        cut = np.flatnonzero(brk[self.data])
        start = np.concatenate([self.offs[:-1], cut + 1])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.offs, cut, side="right") - 1])
        order = np.lexsort((owner, start))
        start, owner = start[order], owner[order]
        # a text's last line ends with the text, the others before their break
        end = np.empty(len(start), np.int64)
        last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.empty(0, bool)
        end[last] = self.offs[1:][owner[last]]
        end[~last] = start[np.flatnonzero(~last) + 1] - 1
        solid = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~SPACE[self.data], out=solid[1:])
        full = solid[end] > solid[start]
        start, end, owner = start[full], end[full], owner[full]
        _, later = repeats(span_hash(self.heads, start, end) ^ mix(owner.astype(U64)))
        return np.bincount(owner, minlength=self.n), np.bincount(owner[later], minlength=self.n)

    def repeat_words(self, window: int = 8) -> np.ndarray:
        m = len(self.hash) - window + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[window - 1 :])
        count, _ = repeats(fold(self.hash, window)[at] ^ mix(self.doc[at].astype(U64)))
        marks = np.zeros(len(self.hash) + 1, np.int64)
        hit = at[count > 1]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + window, -1)
        covered = np.cumsum(marks)[:-1] > 0
        return np.bincount(self.doc[covered], minlength=self.n)

    def only(self, keep: np.ndarray) -> Texts:
        """The kept texts alone."""
        size = (self.offs[1:] - self.offs[:-1])[keep]
        mask = np.repeat(keep, self.offs[1:] - self.offs[:-1])
        return Texts(self.data[mask], np.concatenate([[0], np.cumsum(size)]))


# Rules: True for the texts that a rule rejects. A text without words never comes here.


def many_symbols(t: Texts) -> np.ndarray:
    return 10 * t.symbols() > t.n_words


def odd_word_length(t: Texts) -> np.ndarray:
    chars = t.word_chars()
    return (chars < 2 * t.n_words) | (chars > 15 * t.n_words)


def mostly_upper(t: Texts) -> np.ndarray:
    return 2 * per_text(UPPER[t.data], t.offs) > per_text(LETTER[t.data], t.offs)


def many_marks(t: Texts) -> np.ndarray:
    marked = t.data[t.end - 1] == ord("!")
    return 10 * np.bincount(t.doc[marked], minlength=t.n) > 3 * t.n_words


def duplicate_lines(t: Texts) -> np.ndarray:
    lines, dup = t.lines()
    return 10 * dup > 3 * lines


def stuttering(t: Texts) -> np.ndarray:
    same = (t.hash[1:] == t.hash[:-1]) & (t.doc[1:] == t.doc[:-1])
    return 10 * np.bincount(t.doc[1:][same], minlength=t.n) > 2 * t.n_words


def few_distinct_words(t: Texts, run: int = 2000) -> np.ndarray:
    """Distinct words are counted anew in each ``run`` words, so that prose of any length passes and repetition doesn't."""
    first = np.cumsum(t.n_words) - t.n_words
    part = (np.arange(len(t.doc)) - first[t.doc]) // run
    _, later = repeats(t.hash ^ mix(t.doc.astype(U64) + (part.astype(U64) << U64(40))))
    distinct = np.bincount(t.doc[~later], minlength=t.n)
    return (t.n_words >= 50) & (10 * distinct < t.n_words)


RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    f.__name__: f for f in (many_symbols, odd_word_length, mostly_upper, many_marks, duplicate_lines, stuttering, few_distinct_words)
}


def rule_order(texts: list[str | None], rules: dict[str, Callable] = RULES) -> list[str]:
    """Names of the rules by share rejected per second on a sample, best first.

    A greedy cascade: the next rule is the one that rejects most, per cost, of what the rules before it keep.
    """
    t = Texts(*utf8(pa.array(texts, pa.string())))
    t = t.only(t.n_words > 0)
    cost, rejects = {}, {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejects[name] = rule(t)
        cost[name] = time.perf_counter() - began + 1e-6
    left, order = np.ones(t.n, bool), []
    while len(order) < len(rules):
        best = max((n for n in rules if n not in order), key=lambda n: ((rejects[n] & left).sum() / cost[n], -cost[n]))
        order.append(best)
        left &= ~rejects[best]
    return order


def judge(data: np.ndarray, offs: np.ndarray, order: list[str], min_words: int = 20, repeat_percent: int = 30) -> dict[str, np.ndarray]:
    """Statistics and verdicts of a run of texts."""
    t = Texts(data, offs)
    _, dup = t.lines()
    out = {"n_words": t.n_words, "word_chars": t.word_chars(), "n_symbols": t.symbols(), "n_dup_lines": dup, "n_repeat_words": t.repeat_words()}
    out["base_failed"] = failed = (t.n_words < min_words) | (100 * out["n_repeat_words"] > repeat_percent * t.n_words)
    by = np.full(t.n, None, object)
    by[failed] = "base"
    alive = np.flatnonzero(~failed)
    rest = t.only(~failed)
    for name in order:
        if not len(alive):
            break
        bad = RULES[name](rest)
        by[alive[bad]] = name
        if bad.any():
            rest, alive = rest.only(~bad), alive[~bad]
    out["kept"] = np.array([x is None for x in by], bool)
    out["rejected_by"] = by
    return out


def quality_cascade(df: DataFrame, text_col: str = "text", sample_rows: int = 400, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """The columns of ``df`` but the text, then statistics, base_failed, kept and rejected_by of each row.

    Columns of the names added, in upper or lower case, are replaced. Cost and selectivity of the rules are estimated on
    at most ``sample_rows`` rows (with texts that the driver can hold); they only set the order in which
    the rules run, and a text that a rule rejects isn't shown to later ones. ``kept`` doesn't depend on the order.
    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table gives an empty result.
    """
    ship(df.sparkSession)

    order = rule_order([r[0] for r in df.select(text_col).where(F.length(text_col) <= 20_000).take(sample_rows)])
    keep = [c for c in df.columns if c.lower() not in NAMES]
    carried = [c for c in keep if c != text_col]
    src = df.select(*[F.col(f"`{c}`") for c in keep])
    kinds = [x.split() for x in OUT.split(", ")]
    schema = src.select(*[F.col(f"`{c}`") for c in carried], *[F.lit(None).cast(k).alias(n) for n, k in kinds]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(b.schema.get_field_index(text_col)))
            for i, j, d, o in slices(data, offs):
                got = judge(d, o, order, min_words, repeat_percent)
                cols = [b.column(b.schema.get_field_index(c)).slice(i, j - i) for c in carried]
                made = [pa.array(got[n], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[k]) for n, k in kinds]
                yield pa.RecordBatch.from_arrays([*cols, *made], [*carried, *NAMES])

    return src.mapInArrow(run, schema)
