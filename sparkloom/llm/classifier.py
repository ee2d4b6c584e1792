"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, mix, per_text, ship, slices, utf8
from .quality_rules import LETTER, UPPER, Texts, repeats

FEATURES = ("words", "word_length", "upper", "symbols", "marks", "stops", "digits", "stutter", "repeated", "new_words", "lines", "dup_lines")
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text: shares and rates, on a log scale."""
    t = Texts(data, offs)
    words = np.maximum(t.n_words, 1)
    letters = np.maximum(per_text(LETTER[data], offs), 1)
    last = data[t.end - 1] if len(t.end) else np.empty(0, np.uint8)
    marks = np.bincount(t.doc[last == ord("!")], minlength=t.n)
    stops = np.bincount(t.doc[(last == ord(".")) | (last == ord(","))], minlength=t.n)
    same = (t.hash[1:] == t.hash[:-1]) & (t.doc[1:] == t.doc[:-1])
    stutter = np.bincount(t.doc[1:][same], minlength=t.n)
    _, later = repeats(t.hash ^ mix(t.doc.astype(U64)))
    fresh = np.bincount(t.doc[~later], minlength=t.n)
    lines, dup = t.lines()
    share = lambda x, n: np.log(0.01 + x / n)
    return np.column_stack(
        [
            np.log1p(t.n_words),
            np.log1p(t.word_chars() / words),
            share(per_text(UPPER[data], offs), letters),
            share(t.symbols(), words),
            share(marks, words),
            share(stops, words),
            share(per_text(DIGIT[data], offs), words),
            share(stutter, words),
            share(t.repeat_words(), words),
            np.log(np.maximum(fresh, 1)) / np.log(words + 1.0),
            share(lines, words),
            share(dup, np.maximum(lines, 1)),
        ]
    ).astype(np.float64)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array x of FEATURES for each row; null texts count as empty."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                x = statistics(d, o)
                at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], ["doc_id", "x"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Quadratic:
    """Class means, cached Cholesky factors of the shrunken covariances, and log priors."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_prior: list[float]

    def log_density(self, x: np.ndarray, c: int) -> np.ndarray:
        """Log density but for a constant: the Mahalanobis distance by forward substitution in the Cholesky factor."""
        low, z = self.factors[c], (x - self.means[c]).T.copy()
        for i in range(len(low)):
            z[i] = (z[i] - low[i, :i] @ z[:i]) / low[i, i]
        return self.log_prior[c] - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; without labels of both classes, the share of class 1."""
        if not self.means:
            return np.full(len(x), self.log_prior[0])
        gap = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -700, 700)
        return 1 / (1 + np.exp(-gap))


#: About where the statistics lie; moments are taken from there, so that nearly constant ones don't cancel out.
CENTRE = np.array([5.0, 1.6, -3.0, -4.0, -4.0, -2.0, -4.0, -4.0, -4.0, 0.9, -2.0, -4.0])


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of x - CENTRE in each class, added up on the executors. ``rows``: x, label."""
    p = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, p) - CENTRE
            x = np.column_stack([np.ones(len(x)), x])
            y = b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] = total.get(c, 0) + x[y == c].T @ x[y == c]
        k = (p + 1) ** 2
        cols = [np.repeat([*total], k), np.tile(np.arange(k), len(total)), np.concatenate([m.ravel() for m in total.values()]) if total else []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["c", "i", "v"])

    out = {c: np.zeros((p + 1) ** 2) for c in (0, 1)}
    for r in rows.select("x", F.col("label").cast("int")).mapInArrow(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        out[r.c][r.i] = r.v
    return {c: (m[0], m.reshape(p + 1, p + 1)[0, 1:], m.reshape(p + 1, p + 1)[1:, 1:]) for c, m in out.items()}


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float | None = None, floor: float = 0.02) -> Quadratic:
    """Fits on all rows of ``stats`` (doc_id, x) that ``labels`` (doc_id, label 0 or 1) covers; repeated rows count each.

    A class's covariance is shrunk towards its diagonal, by the oracle-approximating amount unless ``shrinkage`` is
    given, and ``floor`` is added to each variance.
    """
    got = moments(stats.join(labels, "doc_id"))
    n = {c: m[0] for c, m in got.items()}
    if min(n.values()) < 2:
        return Quadratic([], [], [n[1] / max(1.0, n[0] + n[1]) if sum(n.values()) else 0.5])
    means, factors, prior = [], [], []
    for c in (0, 1):
        count, s, ss = got[c]
        mean = s / count
        cov = ss / count - np.outer(mean, mean)
        p, tr, tr2 = len(mean), np.trace(cov), (cov**2).sum()
        rho = shrinkage
        if rho is None:
            spread = (count + 1 - 2 / p) * (tr2 - tr**2 / p)
            rho = 1.0 if spread <= 0 else min(1.0, ((1 - 2 / p) * tr2 + tr**2) / spread)
            rho = max(rho, 0.05)
        cov = (1 - rho) * cov + rho * np.diag(np.diag(cov)) + floor * np.eye(p)
        means.append(mean + CENTRE)
        factors.append(np.linalg.cholesky(cov))
        prior.append(float(np.log(count / (n[0] + n[1]))))
    return Quadratic(means, factors, prior)


def training_rows(labels: DataFrame, column: str, folds: int, test: int) -> DataFrame:
    """doc_id and label of the rows whose crc32(doc_id as text) mod ``folds`` isn't ``test``; null labels are left out."""
    return labels.where(F.col(column).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != test)).select("doc_id", F.col(column).alias("label"))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fitted(docs: DataFrame, train: DataFrame, scratch: Scratch, most_labelled: int, id_col: str = "doc_id", text_col: str = "text") -> Quadratic:
    """Fits on the documents of at most ``most_labelled`` rows of ``train``, chosen by a hash of the id.

    That bound is what makes the ids small enough to broadcast; texts are read where they stand, and only statistics of
    labelled ones are computed. Equal rows of ``train`` count once.
    """
    some = train.select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_labelled)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    stats = scratch.save(document_statistics(texts), "statistics")
    return fit(stats, some)


def score_quality(docs: DataFrame, train: DataFrame, scratch: Scratch, threshold: float = 0.3, most_labelled: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``; its other columns, whatever their names, aren't read.

    The model is fitted on at most ``most_labelled`` rows of ``train`` (doc_id, label), see ``fitted``; then every text is
    scored where it stands, without a shuffle. A null or empty text has statistics like any other. Repeated rows are
    scored each for itself; without labels of both classes every score is the share of label 1; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    model = fitted(docs, train, scratch, most_labelled, id_col, text_col)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                s = model.score(statistics(d, o))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, train: DataFrame, scratch: Scratch, threshold: float = 0.3, text_col: str = "text", most_labelled: int = 50_000, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with a score of ``threshold`` or more, with all their columns.

    Texts are judged where they stand: nothing but statistics and labels of the rows that the model is fitted on (see
    ``fitted``) is shuffled.
    """
    ship(docs.sparkSession)
    model = fitted(docs, train, scratch, most_labelled, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(b.schema.get_field_index(text_col)))
            for i, j, d, o in slices(data, offs):
                yield b.slice(i, j - i).filter(pa.array(model.score(statistics(d, o)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
