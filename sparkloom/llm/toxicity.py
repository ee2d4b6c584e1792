"""Toxicity: a mined lexicon in a trie, met by Levenshtein automata, and scores of the context of each hit."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[\W\d_]*([^\W\d_]+[\W\d_][^\W\d_]+)[\W\d_]*")  # letters with one other character among them
STEMS = (4, 5, 6, 7)
FEATURES = ("exact", "misspelled", "densest", "quoted", "rate")
OPEN, CLOSE = "\"“«„‘'", "\"”»“’'"
# Words that announce someone else's words.
CUES = frozenset("said says wrote writes called quote quoted quotes dit écrit cite sagte schrieb zitat dijo escribió cita".split())
CACHE, LONGEST = 400_000, 64  # entries of a worker's table, and characters of one


class Trie:
    """Lexicon as a trie; ``near`` walks it together with a Levenshtein automaton.

    A state is a node of the trie, how much of the word is read, and the edits so far; a state whose edits are used up
    has one way on at most, so few states are ever met.
    """

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = weight

    def near(self, word: str, most: int) -> list[tuple[int, float]]:
        """Edits and weight of the terms within ``most`` edits (insert, delete, replace); a term may come up again."""
        out: list[tuple[int, float]] = []
        stack, n = [(self.root, 0, 0)], len(word)
        while stack:
            node, i, e = stack.pop()
            if i == n:
                if "" in node:
                    out.append((e, node[""]))
            elif (below := node.get(word[i])) is not None:
                stack.append((below, i + 1, e))
            if e < most:
                if i < n:
                    stack.append((node, i + 1, e + 1))
                for ch, below in node.items():
                    if ch:
                        stack.append((below, i, e + 1))
                        if i < n and ch != word[i]:
                            stack.append((below, i + 1, e + 1))
        return out


class Tokens(dict):
    """Token -> weight and whether it is misspelled; a full table answers without keeping."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, token: str) -> tuple[float, bool]:
        v, words, close = NONE, WORD.findall(token), []
        for w in words:
            x = self.matcher.word(w)
            if x[0] > v[0]:
                v = x
            elif x[1]:
                close.append(w)
        if not v[0] and (close or len(words) == 2):
            v = self.matcher.disguised(token, close)
        if len(self) < CACHE and len(token) <= LONGEST:
            self[token] = v
        return v


NONE = (0.0, False)
_tokens: dict[str, Tokens] = {}


class Matcher:
    """Weights of words: of a term, of a stem, or of a term that the word misspells (``misspelled`` tells which).

    A word misspells a term of ``least`` letters or more when it is one edit away; nearly every short word is one edit
    from some shorter term, so those are met exactly or by their stem only. ``disguised`` is for tokens none of whose
    words is met: two neighbouring letters may be swapped, and the one edit may be a digit or symbol among the letters.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], plain: frozenset[str], least: int = 5):
        self.words, self.stems, self.plain, self.least = words, stems, plain, least
        self.trie = Trie({w: v for w, v in words.items() if len(w) >= least})
        # texts one edit apart become equal by deleting at most one character of each
        self.deleted = {x for w in words if len(w) >= least for x in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}
        self.lengths = range(min(map(len, self.deleted), default=0), max(map(len, self.deleted), default=-1) + 2)
        self.key = uuid.uuid4().hex

    def word(self, w: str) -> tuple[float, bool]:
        if (v := self.words.get(w)) is not None:
            return v, False
        for k in reversed(STEMS):
            if (v := self.stems.get(w[:k])) is not None and len(w) >= k:
                return v, False
        return self.misspelled(w)

    def misspelled(self, w: str) -> tuple[float, bool]:
        if len(w) not in self.lengths or w in self.plain:
            return NONE
        if w in self.deleted or any(w[:i] + w[i + 1 :] in self.deleted for i in range(len(w))):
            return max((v for _, v in self.trie.near(w, 1)), default=0.0), True
        return NONE

    def disguised(self, token: str, close: list[str]) -> tuple[float, bool]:
        """``close``: words of the token that are a term but for one letter of each (all swapped ones are)."""
        core = MIXED.fullmatch(token)
        most = self.misspelled(core[1])[0] if core else 0.0
        for w in close:
            if len(w) >= self.least:
                most = max(most, *(self.words.get(w[:i] + w[i + 1] + w[i] + w[i + 2 :], 0.0) for i in range(len(w) - 1)))
        return (most, True) if most else NONE

    def tokens(self) -> Tokens:
        """The table of tokens met so far, kept from task to task in a worker; that of one matcher at a time."""
        if self.key not in _tokens:
            _tokens.clear()
            _tokens[self.key] = Tokens(self)
        return _tokens[self.key]


def quoted(tokens: list[str], i: int, span: int = 12) -> bool:
    """Whether token i stands between quotation marks, or shortly after a word that announces a quotation."""
    before, after = tokens[max(0, i - span) : i + 1], tokens[i : i + span + 1]
    opened = max((k for k, t in enumerate(before) if t[0] in OPEN), default=-1)
    closed = max((k for k, t in enumerate(before[:-1]) if t.rstrip(".,;:!?")[-1:] in CLOSE and t.rstrip(".,;:!?")), default=-1)
    if opened >= 0 and opened > closed and any(t.rstrip(".,;:!?")[-1:] in CLOSE and t.rstrip(".,;:!?") for t in after):
        return True
    return any(t.strip(".,;:!?\"'“”«»") in CUES for t in before[-4:-1])


def text_features(text: str | None, m: Matcher, window: int = 40) -> list[float]:
    tokens = text.lower().split() if text else []
    values = [*map(m.tokens().__getitem__, tokens)]
    if values.count(NONE) == len(values):
        return [0.0] * len(FEATURES)
    got = [(i, *v) for i, v in enumerate(values) if v[0]]
    if not got:
        return [0.0] * len(FEATURES)
    exact = fuzzy = quote = densest = run = 0.0
    own: list[tuple[int, float]] = []
    met: tuple[set[str], set[str]] = (set(), set())  # every occurrence is judged; a word counts once as own, once as quoted
    within: dict[str, int] = {}  # and once in a window
    left = 0
    for i, v, miss in got:
        word, cited = tokens[i], quoted(tokens, i)
        if word not in met[cited]:
            met[cited].add(word)
            if cited:
                quote += v
            elif miss:
                fuzzy += v
            else:
                exact += v
        if cited:
            continue
        own.append((i, v))
        within[word] = within.get(word, 0) + 1
        run += v if within[word] == 1 else 0.0
        while own[left][0] <= i - window:
            old, x = own[left]
            within[tokens[old]] -= 1
            run -= x if not within[tokens[old]] else 0.0
            left += 1
        densest = max(densest, run)
    return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(densest)), float(np.log1p(quote)), float(np.log1p(100 * (exact + fuzzy) / len(tokens)))]


def labelled_texts(docs: DataFrame, train: DataFrame, most: int) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled rows, chosen by a hash. The bound keeps the broadcast small."""
    some = train.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")


def mine_lexicon(texts: DataFrame, least_docs: int, least_weight: float) -> Matcher:
    """Words and stems that toxic texts hold much more often than others, by log-odds of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["entry", "clean", "toxic"])
            seen.clear()
            return out

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = text.lower() if text else ""
                words = set(WORD.findall(low))
                mixed = {"=" + m[1] for t in set(low.split()) if not t.isalpha() and (m := MIXED.fullmatch(t))}
                for e in [*words, *mixed, *{w[:k] + "*" for w in words for k in STEMS if len(w) >= k}]:
                    if (v := seen.get(e)) is None:
                        v = seen[e] = [0, 0]
                    v[label] += 1
                if len(seen) > 300_000:
                    yield flush()
            yield flush()

    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not toxic or not clean:
        return Matcher({}, {}, frozenset())
    df = texts.select("text", F.col("label").cast("int")).mapInArrow(count, "entry string, clean long, toxic long")
    df = df.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    # a low estimate: chance finds of few documents weigh little
    weight = weight - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    rows = df.where((F.col("toxic") >= least_docs) & ~F.col("entry").startswith("=")).withColumn("w", weight).where(F.col("w") >= least_weight)
    rows = rows.collect()  # the labelled sample bounds them
    words = {r.entry: min(r.w, 6.0) for r in rows if not r.entry.endswith("*")}
    stems = {r.entry[:-1]: min(r.w, 6.0) for r in rows if r.entry.endswith("*")}
    first = Matcher(words, stems, frozenset())

    def benign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for e in b.column(0).to_pylist():
                v = first.misspelled(e[1:]) if e[0] == "=" else first.word(e)
                if v[1] and (v[0] or first.disguised("", [e])[0]):
                    near.append(e.removeprefix("="))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["entry"])

    # words of clean texts that happen to be one edit (or swap) from a term aren't misspellings
    near = df.where("clean > 0 and entry not like '%*'").select("entry").mapInArrow(benign, "entry string").collect()
    return Matcher(words, stems, frozenset(r.entry for r in near))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the constant last, pulled towards ``prior``; Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.copy()
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - pull * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        d = np.linalg.solve(h, g)
        size = np.abs(d).max()
        w = w + d * min(1.0, 2.0 / size if size else 1.0)
        if size < 1e-8:
            break
    return w


#: Where the labels say little of a feature: misspelled terms count like others, quoted ones hardly.
PRIOR = np.array([1.0, 1.0, 0.5, -0.2, 0.5, -5.0])


def featured(texts: DataFrame, m: Matcher, extra: str) -> DataFrame:
    """doc_id, ``extra`` and the array x of FEATURES. ``texts``: doc_id, text and perhaps a column more."""
    cols = [c.split()[0] for c in extra.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t, m) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(x, pa.list_(pa.float64()))], ["doc_id", *cols, "x"])

    return texts.mapInArrow(run, "doc_id long, " + "".join(f"{c}, " for c in extra.split(", ") if c) + "x array<double>")


def score_toxicity(docs: DataFrame, train: DataFrame, scratch: Scratch, threshold: float = 0.7, most_labelled: int = 20_000, least_docs: int = 3, least_weight: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``.

    Lexicon and weights are fitted on at most ``most_labelled`` rows of ``train`` (doc_id, label), chosen by a hash of
    the id; the lexicon holds every entry that passes the thresholds there, and every whole text is scored. Null and empty texts hold no term and get the lowest score; repeated rows are
    scored each for itself; without labels of both classes all score the share of label 1; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = scratch.save(labelled_texts(docs, train, most_labelled), "labelled")
    m = mine_lexicon(texts, least_docs, least_weight)
    rows = featured(texts.select("doc_id", "text", F.col("label").cast("int").alias("label")), m, "label int").collect()
    y = np.array([r.label for r in rows], float)
    if 0 < y.sum() < len(y):
        w = logistic(np.array([r.x for r in rows]), y, PRIOR)
    else:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        w = np.append(np.zeros(len(FEATURES)), np.log(share / (1 - share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t, m) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
