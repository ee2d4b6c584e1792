"""Full-text and value search over root entities: compiled to predicates over analyzed columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import search as words
from ..functions import semantics
from ..functions.semantics import safe_list, truth
from ..model import Field, Type
from .compiler import Compiler, QueryError, Scope

# Search operators of String and ID fields.
TEXT_OPS = ("", "not", "lt", "lte", "gt", "gte", "in", "not_in", "starts_with", "not_starts_with")
ID_OPS = ("", "not", "in", "not_in")


class Search:
    def __init__(self, compiler: Compiler, options: Any):
        self.c, self.options = compiler, options

    def scope(self, t: Type, args: dict[str, Any]) -> Scope:
        """The scan with search filter, expression and post filter applied; with a limit set, guarded against too large results."""
        if not t.search:
            raise QueryError("NOT_SUPPORTED", f"{t.name} isn't searchable")
        s = self.c.scan(t)
        self.apply(s, args.get("flexSearchFilter") or {}, args.get("flexSearchExpression"))
        post = args.get("postFilter") or args.get("filter")
        primary = [f"{n}_{d}" for n, d in t.search_order]
        order = args.get("orderBy")
        order = order if isinstance(order, list) else [order] if order else []
        most = self.options.search_limit
        if most is not None and (post or (order and order != primary[: len(order)])):
            if s.frame.df.limit(most + 1).count() > most:
                raise QueryError("FLEX_SEARCH_TOO_MANY_OBJECTS", f"more than {most} objects match; a filter after the search or another order needs fewer")
        self.c.where(s, post)
        return s

    def apply(self, s: Scope, flt: dict[str, Any], expression: str | None) -> None:
        s.frame.df = s.frame.df.where(self.predicate(s, flt) & self.expression(s, expression))

    def predicate(self, s: Scope, flt: dict[str, Any]) -> Column:
        out = F.lit(True)
        for key, v in (flt or {}).items():
            if key == "AND":
                for x in v or []:
                    out = out & self.predicate(s, x)
            elif key == "OR":
                if v is not None:
                    any_ = F.lit(False)
                    for x in v:
                        any_ = any_ | self.predicate(s, x)
                    out = out & any_
            else:
                out = out & self.condition(s, key, v)
        return out

    def condition(self, s: Scope, key: str, v: Any) -> Column:
        if key.endswith("Aggregation") and key[:-11] in s.type.fields:
            f = s.type.fields[key[:-11]]
            t = self.c.model.types[f.type_name]
            return truth(F.exists(safe_list(s.node.getField(f.name)), lambda x: self.predicate(s.inner(f.name, x, t), v)))
        f, op = self.c.split(s.type, key)
        t = self.c.model.types[f.type_name]
        value = s.node.getField(f.name)
        value = value.cast("string") if t.name == "ID" and not f.is_list else value
        if op == "exists":
            there = value.isNotNull() & (F.size(value) > 0 if f.is_list else F.lit(True))
            return truth(there) == F.lit(bool(v))
        if f.is_list:
            if op == "":
                op = "some"
            some, _, rest = op.partition("_")
            if some != "some":
                rest = op
            if t.is_object:
                return truth(F.exists(safe_list(value), lambda x: self.predicate(s.inner(f.name, x, t), v)))
            if isinstance(v, dict):
                return truth(F.exists(safe_list(value), lambda x: self.all_of(f, t, x, v)))
            return truth(F.exists(safe_list(value), lambda x: self.test(f, t, x, rest, v)))
        if t.name == "I18nString" and op.endswith("localized"):
            return F.lit(True) if v is None else self.all_of(f, self.c.model.types["String"], F.try_element_at(value, F.lit(v.get("language", "en"))), {k: w for k, w in v.items() if k != "language"})
        if t.is_object:
            if f.kind in ("relation", "reference", "collect"):
                raise QueryError("BAD_INPUT", f"{f.name} isn't searchable")
            if v is None:
                return value.isNull() if t.kind != "extension" else F.lit(True)
            return self.predicate(s.inner(f.name, value, t, s.frame), v)
        return self.test(f, t, value, op, v)

    def all_of(self, f: Field, t: Type, x: Column, tests: dict[str, Any]) -> Column:
        out = F.lit(True)
        for op, v in tests.items():
            out = out & self.test(f, t, x, "" if op == "equal" else op, v)
        return out

    def test(self, f: Field, t: Type, x: Column, op: str, v: Any) -> Column:
        """One operator. Case-insensitive fields compare normalized values; word operators look at tokens."""
        negated = op.startswith("not_") and op[4:] in words.WORD_OPS
        if op in words.WORD_OPS or negated:
            if v is None:
                return F.lit(True)
            got = words.WORD_OPS[op.removeprefix("not_")](self.c.tokenizer.column(x), self.c.tokenizer.text(v))
            return ~got if negated else got
        if t.name not in ("String", "ID") or t.kind == "enum":
            return semantics.test(x, "String" if t.kind == "enum" else t.name, op, v)
        if op not in (ID_OPS if t.name == "ID" else TEXT_OPS):
            raise QueryError("BAD_INPUT", f"{f.name} has no search operator {op}")
        if op.endswith("starts_with"):
            if v is None:
                return F.lit(True)
            if v == "":  # every text begins with nothing
                return x.isNull() if op.startswith("not") else x.isNotNull()
        if f.case_sensitive:
            return semantics.test(x, "String", op, v)
        fold = lambda w: words.norm_text(w) if isinstance(w, str) else w
        return semantics.test(words.norm(x), "String", op, [fold(w) for w in v] if isinstance(v, list) else fold(v))

    def expression(self, s: Scope, text: str | None) -> Column:
        """Any field included in search that begins with the text or, for full text, holds all its words as prefixes."""
        if not text:
            return F.lit(True)
        found = [*self.included(s, s.type, s.node, self.options.search_depth)]
        if not found:
            raise QueryError("BAD_INPUT", f"no field of {s.type.name} is included in search")
        out = F.lit(False)
        for f, x in found:
            fits = []
            if f.search:
                fits.append(self.starting(f, text))
            if f.fulltext:
                fits.append(lambda y: words.all_prefixes(self.c.tokenizer.column(y), self.c.tokenizer.text(text)))
            for fit in fits:
                out = out | (truth(F.exists(safe_list(x), fit)) if f.is_list else fit(x))
        return out

    def starting(self, f: Field, text: str):
        return lambda y: self.test(f, self.c.model.types["String"], y, "starts_with", text)

    def included(self, s: Scope, t: Type, node: Column, depth: int, seen: tuple[str, ...] = ()):
        for f in t.fields.values():
            inner = self.c.model.types[f.type_name]
            if f.kind != "plain":
                continue
            if inner.is_object and seen.count(inner.name) < depth and not f.is_list:
                yield from self.included(s, inner, node.getField(f.name), depth, (*seen, inner.name))
            elif f.in_search and inner.name == "String":
                yield f, node.getField(f.name)
