"""Text search: analyzers, a tokenizer, and predicates over tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import truth

# Letters with accents and what they are without, up to Latin Extended-A: derived, not listed.
ACCENTED = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
PLAIN = [unicodedata.normalize("NFD", c)[0] for c in ACCENTED]
SPLIT = r"[^\p{L}\p{N}]+"


def norm(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), "".join(x.lower() for x in ACCENTED), "".join(x.lower() for x in PLAIN))


def norm_text(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(x))


def tokens(c: Column) -> Column:
    """Words of a text, normalized; no stemming. A null text has none."""
    return F.coalesce(F.filter(F.split(norm(c), SPLIT), lambda t: t != ""), F.array().cast("array<string>"))


def query_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", norm_text(text)) if t]


class Tokenizer:
    """How a language's texts become tokens; replace both functions alike for stemming."""

    def __init__(self, column: Callable[[Column], Column] = tokens, text: Callable[[str], list[str]] = query_tokens):
        self.column, self.text = column, text


DEFAULT = Tokenizer()


def any_word(toks: Column, words: list[str]) -> Column:
    return truth(F.arrays_overlap(toks, F.array(*map(F.lit, words)))) if words else F.lit(False)


def all_words(toks: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, words)), toks)) == 0 if words else F.lit(False)


def has_prefix(toks: Column, word: str) -> Column:
    return truth(F.exists(toks, lambda t: t.startswith(F.lit(word))))


def any_prefix(toks: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | has_prefix(toks, w)
    return out


def all_prefixes(toks: Column, words: list[str]) -> Column:
    out = F.lit(bool(words))
    for w in words:
        out = out & has_prefix(toks, w)
    return out


def phrase(toks: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(False)
    return truth(F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(f" {' '.join(words)} ")))


WORD_OPS = {"contains_any_word": any_word, "contains_all_words": all_words, "contains_any_prefix": any_prefix, "contains_all_prefixes": all_prefixes, "contains_phrase": phrase}
