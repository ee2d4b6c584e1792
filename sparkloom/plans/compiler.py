"""Nested selections as DataFrame plans.

Every list is a frame of its own, keyed by its parent's keys, and is joined back as one array column. Lists within a
document stay array expressions as long as nothing in them needs a join.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, search, semantics
from ..functions.semantics import comparable, greater, literal, safe_list, truth
from ..model import NULL_KEEPING, Field, Step, Type
from ..sdl import Field as Sel
from ..sources.binding import Binding
from . import auth

_count = itertools.count()
DOWN = "_down"  # field of a text by which rows go down


def fresh(stem: str) -> str:
    return f"_{stem}{next(_count)}"


def getter(name: str):
    """A one-argument function for array functions."""
    return lambda x: x.getField(name)


def revision(node: Column) -> Column:
    """Changes whenever a document does."""
    return F.md5(F.to_json(node, {"ignoreNullFields": "false"}).cast("binary"))


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Problem:
    """An error in one place of the output; the rest of the result stands."""

    path: tuple[str, ...]
    code: str
    message: str


@dataclass
class Frame:
    """Rows with unique ``keys``; joins add columns to ``df``."""

    df: DataFrame
    keys: list[str]
    attached: dict[tuple[str, str], tuple[Column, Type]] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)

    def add(self, value: Column, stem: str = "c") -> str:
        name = fresh(stem)
        self.df = self.df.withColumn(name, value)
        return name


@dataclass
class Scope:
    """An object to take fields from. Without a frame (within an array function) no joins are possible."""

    frame: Frame | None
    node: Column
    type: Type
    path: str = ""
    root: tuple[Column, Type] | None = None
    parent: tuple[Column, Type] | None = None

    def inner(self, name: str, node: Column, t: Type, frame: Frame | None = None) -> Scope:
        """Scope of an object within this one."""
        entity = self.type.kind in ("root", "child")
        root = (self.node, self.type) if self.type.kind == "root" else self.root
        return Scope(frame, node, t, f"{self.path}.{name}", root, (self.node, self.type) if entity else self.parent)


@dataclass
class Order:
    """One sort criterion: the path's name, its column, and its scalar type."""

    name: str
    column: Column
    kind: str
    down: bool

    def sort(self) -> Column:
        return self.column.desc_nulls_last() if self.down else self.column.asc_nulls_first()

    def ascending(self) -> list[Column]:
        """Columns that give the same order when they go up, null first; texts that go down are marked by DOWN."""
        if not self.down:
            return [self.column]
        c = self.column
        if self.kind in ("Int", "Int53") or self.kind.startswith("Decimal"):
            return [c.isNull(), -c]
        if self.kind == "Float":
            return [c.isNull(), ~F.isnan(c), -c]
        if self.kind == "DateTime":
            return [c.isNull(), -F.unix_micros(c)]
        return [c.isNull(), F.struct(c.alias(DOWN))]


def precedence(pairs: list[tuple[Column, Column, bool]]) -> Column:
    """-1, 0 or 1 for the first pair that differs, null first; a pair marked by ``down`` counts the other way round."""
    out = F.lit(0)
    for x, y, down in reversed(pairs):
        less, more = (1, -1) if down else (-1, 1)
        out = F.when(greater(y, x), less).when(greater(x, y), more).otherwise(out)
    return out


class Compiler:
    def __init__(self, binding: Binding, user: auth.User | None = None, max_depth_order: int | None = None, tokenizer: search.Tokenizer = search.DEFAULT):
        self.binding, self.model, self.user = binding, binding.model, user
        self.problems: list[Problem] = []
        self.max_depth_order = max_depth_order
        self.tokenizer = tokenizer

    # ---------------------------------------------------------------- scans

    def rows(self, t: Type) -> DataFrame:
        """All rows of a root entity that the user may read."""
        df = self.binding.table(t)
        g = auth.grant(self.model, t, self.user, "read")
        if g.never:
            raise QueryError("PERMISSION_DENIED", f"Not authorized to read {t.name} objects")
        return df if g.always else df.where(g.column(F.struct(*[F.col(f"`{c}`") for c in df.columns])))

    def scan(self, t: Type, df: DataFrame | None = None) -> Scope:
        df = self.rows(t) if df is None else df
        node, key = fresh("n"), fresh("k")
        df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(node), F.col("id").alias(key))
        return Scope(Frame(df, [key]), F.col(node), t)

    def as_node(self, t: Type, node: str) -> DataFrame:
        df = self.rows(t)
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(node))

    def edges(self, t: Type, f: Field) -> DataFrame:
        """_from, _to in the field's direction."""
        relation, forward = self.model.relation(t, f)
        e = self.binding.edges(relation)
        return e if forward else e.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))

    def id_test(self, s: Scope, value: Column, op: str, v: Any) -> Column:
        """A filter on an object's own id. Where ids are stored as numbers, the literals become numbers, not the column."""
        if self.binding.id_type(s.type.name) == "string":
            return semantics.test(value, "ID", op, v)
        if op in ("", "not", "in", "not_in") and v is not None and not (isinstance(v, list) and None in v):
            texts = [semantics.parse_scalar("ID", x) for x in (v if isinstance(v, list) else [v])]
            numbers = [n for x in texts if (n := semantics.whole_number(x)) is not None]
            # never null, and in a form that reaches the scan
            hit = F.lit(False) if not numbers else value.eqNullSafe(F.lit(numbers[0]).cast("bigint")) if len(numbers) == 1 else value.isNotNull() & value.isin(numbers)
            return ~hit if op.startswith("not") else hit
        return semantics.test(value.cast("string"), "ID", op, v)

    # ---------------------------------------------------------------- to-1 joins

    def target(self, s: Scope, f: Field) -> tuple[Column, Type]:
        """The object of a to-1 relation or reference, joined to the frame once; null where there is none."""
        t = self.model.types[f.type_name]
        if s.frame is None:
            raise QueryError("NOT_SUPPORTED", f"{s.type.name}.{f.name} can't be followed within this list")
        at = (s.path, f.name)
        if at not in s.frame.attached:
            node, key = fresh("n"), fresh("j")
            right = self.as_node(t, node)
            if f.kind == "reference":
                # both sides as they are stored if the model has one type for them
                alike = not f.key_field or semantics.SPARK_TYPES.get(s.type.fields[f.key_field].type_name) == semantics.SPARK_TYPES.get(t.key.type_name)
                plain = (lambda c: c) if alike else (lambda c: c.cast("string"))
                left = s.frame.add(plain(s.node.getField(f.key_field or f.name)), "f")
                right = right.select(node, plain(F.col(node).getField(t.key.name)).alias(key)).where(F.col(key).isNotNull())
                s.frame.df = s.frame.df.join(right, F.col(left) == F.col(key), "left").drop(key, left)
            else:
                left, to = s.frame.add(s.node.getField("id"), "f"), fresh("t")
                e = self.edges(s.type, f)
                if self.binding.single(*self.model.relation(s.type, f)):
                    e = e.select(F.col("_from").alias(key), F.col("_to").alias(to))
                else:
                    e = e.groupBy(F.col("_from").alias(key)).agg(F.min("_to").alias(to))
                other = fresh("j")
                right = right.select(node, F.col(node).getField("id").alias(other))
                s.frame.df = s.frame.df.join(e, F.col(left) == F.col(key), "left").join(right, F.col(to) == F.col(other), "left").drop(key, to, other, left)
            s.frame.attached[at] = (F.col(node), t)
        return s.frame.attached[at]

    # ---------------------------------------------------------------- filters

    def split(self, t: Type, key: str) -> tuple[Field, str]:
        """Field and operator of a filter name."""
        if key in t.fields:
            return t.fields[key], ""
        for name in sorted(t.fields, key=len, reverse=True):
            if key.startswith(name + "_"):
                return t.fields[name], key[len(name) + 1 :]
        raise QueryError("BAD_INPUT", f"{t.name} has no filter {key}")

    def where(self, s: Scope, flt: dict[str, Any] | None) -> Scope:
        """The scope's frame with a filter applied; conjuncts on relation lists become semi or anti joins."""
        if flt:
            p = self.predicate(s, flt, top=True)
            s.frame.df = s.frame.df.where(p)
        return s

    def predicate(self, s: Scope, flt: dict[str, Any], top: bool = False) -> Column:
        out = F.lit(True)
        for key, v in flt.items():
            if key == "AND":
                for x in v or []:
                    out = out & self.predicate(s, x or {}, top)
            elif key == "OR":
                if v is not None:
                    any_ = F.lit(False)
                    for x in v:
                        any_ = any_ | self.predicate(s, x or {})
                    out = out & any_
            else:
                f, op = self.split(s.type, key)
                out = out & self.condition(s, f, op, v, top)
        return out

    def condition(self, s: Scope, f: Field, op: str, v: Any, top: bool) -> Column:
        t = self.model.types[f.type_name]
        if not auth.field_allowed(f, self.user, "read"):
            raise QueryError("PERMISSION_DENIED", f"Not authorized to read {s.type.name}.{f.name}")
        if f.kind in ("collect", "root", "parent"):
            raise QueryError("BAD_INPUT", f"{s.type.name}.{f.name} can't be filtered")
        if f.is_list:
            if f.kind == "relation":
                return self.relation_quantifier(s, f, op, v, top)
            return self.quantifier(s, safe_list(s.node.getField(f.name)), t, op, v, f.name)
        if f.kind == "relation" or (f.kind == "reference" and (isinstance(v, dict) or (f.key_field and not op))):
            if op:
                raise QueryError("BAD_INPUT", f"{f.name} has no filter {op}")
            node, t = self.target(s, f)
            return self.nested(Scope(s.frame, node, t, f"{s.path}.{f.name}"), v)
        value = s.node.getField(f.name)
        if f.kind == "reference":
            if v is None and not op:
                return self.target(s, f)[0].getField("id").isNull()
            return semantics.test(value, t.key.type_name, op, v)
        if t.is_object:
            inner = s.inner(f.name, value, t, s.frame)
            return F.lit(True) if t.kind == "extension" and v is None else self.nested(inner, v)
        if f.type_name in ("StringMap", "I18nString"):
            return self.map_quantifier(value, op, v)
        if op not in semantics.operators(t.name, t.kind == "enum"):
            raise QueryError("BAD_INPUT", f"{f.name} has no filter {op}")
        if f.name == "id" and s.type.kind == "root":
            return self.id_test(s, value, op, v)
        return semantics.test(value, "String" if t.kind == "enum" else t.name, op, v)

    def nested(self, s: Scope, v: Any) -> Column:
        if v is None:
            return s.node.isNull()
        return truth(self.predicate(s, v))

    def quantifier(self, s: Scope, items: Column, t: Type, op: str, v: Any, name: str) -> Column:
        if op == "empty":
            return F.lit(True) if v is None else (F.size(items) == 0) == F.lit(bool(v))
        if op not in ("some", "every", "none"):
            raise QueryError("BAD_INPUT", f"{name} has no filter {op}")
        if v is None:
            return F.lit(True)

        def item(x: Column) -> Column:
            if t.is_object:
                return truth(self.predicate(s.inner(name, x, t), v))
            out = F.lit(True)
            for k, w in v.items():
                kind = "String" if t.kind == "enum" else t.name
                if k in ("in", "not_in") and w is None:
                    out = out & F.lit(k == "not_in")
                else:
                    out = out & semantics.test(x, kind, k, w)
            return out

        if op == "some":
            return F.exists(items, item)
        return ~F.exists(items, item if op == "none" else lambda x: ~item(x))

    def map_quantifier(self, value: Column, op: str, v: Any) -> Column:
        entries = semantics.map_entries(value)
        if op == "empty":
            return (F.size(entries) == 0) == F.lit(bool(v))

        def item(x: Column) -> Column:
            out = F.lit(True)
            for k, w in (v or {}).items():
                stem, _, rest = k.partition("_")
                if stem not in ("key", "language", "value"):
                    raise QueryError("BAD_INPUT", f"no filter {k}")
                out = out & semantics.test(x.getField("value" if stem == "value" else "key"), "String", rest, w)
            return out

        if op == "some":
            return F.exists(entries, item)
        if op in ("none", "every"):
            return ~F.exists(entries, item if op == "none" else lambda x: ~item(x))
        raise QueryError("BAD_INPUT", f"no filter {op}")

    def relation_quantifier(self, s: Scope, f: Field, op: str, v: Any, top: bool) -> Column:
        t = self.model.types[f.type_name]
        if s.frame is None:
            raise QueryError("NOT_SUPPORTED", f"{f.name} can't be filtered within this list")
        if op == "empty":
            if v is None:
                return F.lit(True)
            op, v = ("none" if v else "some"), {}
        elif op not in ("some", "every", "none"):
            raise QueryError("BAD_INPUT", f"{f.name} has no filter {op}")
        child = self.scan(t)
        p = self.predicate(child, v or {})
        ids = child.frame.df.where(~truth(p) if op == "every" else p).select(F.col(child.frame.keys[0]).alias("_to"))
        hit, own = fresh("h"), s.frame.add(s.node.getField("id"), "f")
        found = self.edges(s.type, f).join(ids, "_to", "left_semi").select(F.col("_from").alias(hit))
        if top:
            s.frame.df = s.frame.df.join(found, F.col(own) == F.col(hit), "left_semi" if op == "some" else "left_anti").drop(own)
            return F.lit(True)
        s.frame.df = s.frame.df.join(found.distinct(), F.col(own) == F.col(hit), "left").drop(own)
        return F.col(hit).isNotNull() if op == "some" else F.col(hit).isNull()

    # ---------------------------------------------------------------- order and pages

    def order_path(self, t: Type, name: str) -> list[Field]:
        """Fields of an order name, where underscores stand between them."""
        for own in sorted(t.fields, key=len, reverse=True):
            f = t.fields[own]
            if f.is_list or f.kind in ("collect", "root", "parent"):
                continue
            if name == own:
                return [f]
            if name.startswith(own + "_") and (self.model.types[f.type_name].is_object):
                return [f, *self.order_path(self.model.types[f.type_name], name[len(own) + 1 :])]
        raise QueryError("BAD_INPUT", f"{t.name} can't be ordered by {name}")

    def orders(self, s: Scope, clauses: Any) -> list[Order]:
        out = []
        for clause in clauses if isinstance(clauses, list) else [clauses] if clauses else []:
            name, _, way = clause.rpartition("_")
            if way not in ("ASC", "DESC"):
                raise QueryError("BAD_INPUT", f"bad order {clause}")
            at, kind = s, ""
            path = self.order_path(s.type, name)
            if self.max_depth_order is not None and sum(f.kind in ("relation", "reference") for f in path) > self.max_depth_order:
                raise QueryError("BAD_INPUT", f"{clause} crosses more than {self.max_depth_order} relations")
            for f in path:
                t = self.model.types[f.type_name]
                if f.kind in ("relation", "reference"):
                    node, t = self.target(at, f)
                    at = Scope(s.frame, node, t, f"{at.path}.{f.name}")
                else:
                    at = at.inner(f.name, at.node.getField(f.name), t, s.frame)
                kind = "String" if t.kind == "enum" else t.name
            out.append(Order(name, at.node.cast("string") if kind == "ID" else comparable(kind, at.node), semantics.plain_kind(kind), way == "DESC"))
        return out

    def absolute(self, s: Scope, orders: list[Order]) -> list[Order]:
        if any(o.name == "id" for o in orders) or "id" not in s.type.fields:
            return orders
        return [*orders, Order("id", s.node.getField("id").cast("string"), "ID", bool(orders) and all(o.down for o in orders))]

    @staticmethod
    def cursor(orders: list[Order]) -> Column:
        by_name = sorted(orders, key=lambda o: f"{o.name}_{'DESC' if o.down else 'ASC'}")
        return F.to_json(F.struct(*[o.column.alias(o.name) for o in by_name]), {"ignoreNullFields": "false"})

    @staticmethod
    def after(orders: list[Order], text: str) -> Column:
        """Rows after a cursor: the first criterion that differs decides."""
        try:
            at = json.loads(text)
        except ValueError as e:
            raise QueryError("INVALID_CURSOR", "the cursor is no JSON") from e
        if not isinstance(at, dict) or any(o.name not in at for o in orders):
            raise QueryError("INVALID_CURSOR", "the cursor doesn't have the order's properties")
        out = F.lit(False)
        for o in reversed(orders):
            v = literal(o.kind, at[o.name])
            beyond = semantics.less(o.column, v) if o.down else greater(o.column, v)
            out = beyond | (semantics.equal(o.column, v) & out)
        return out

    def page(self, s: Scope, args: dict[str, Any], wants_cursor: bool, within: list[str] | None = None) -> list[Order]:
        """Sorts and cuts the frame, as a whole or for each parent (``within``); returns the criteria as columns."""
        first, skip, after = args.get("first"), args.get("skip"), args.get("after")
        for n, v in (("first", first), ("skip", skip)):
            if v is not None and v < 0:
                raise QueryError("ARGUMENT_OUT_OF_RANGE", f"{n} must not be negative")
        orders = self.orders(s, args.get("orderBy"))
        if wants_cursor or after or first is not None or skip:
            orders = self.absolute(s, orders)
        orders = [Order(o.name, F.col(s.frame.add(o.column, "o")), o.kind, o.down) for o in orders]
        if after:
            s.frame.df = s.frame.df.where(self.after(orders, after))
        if first is None and not skip:
            return orders
        if within is None:
            df = s.frame.df.orderBy(*[o.sort() for o in orders])
            df = df.offset(skip) if skip else df
            s.frame.df = df if first is None else df.limit(first)
        else:
            rank = fresh("r")
            w = Window.partitionBy(*within).orderBy(*[o.sort() for o in orders])
            df = s.frame.df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) > (skip or 0))
            s.frame.df = df if first is None else df.where(F.col(rank) <= (skip or 0) + first)
            s.frame.meta["rank"] = rank
        return orders

    # ---------------------------------------------------------------- projection

    def project(self, s: Scope, sels: list[Sel], orders: list[Order] | None = None, at: tuple[str, ...] = ()) -> Column:
        """The selected fields as a struct; joins what is needed to the scope's frame."""
        cols = []
        for sel in sels:
            path = (*at, sel.alias)
            try:
                c = self.output(s, sel, orders, path)
            except QueryError as e:
                self.problems.append(Problem(path, e.code, str(e)))
                c = F.lit(None).cast("string")
            cols.append(c.alias(sel.alias))
        return F.struct(*cols) if cols else F.struct(F.lit(True).alias("_"))

    def output(self, s: Scope, sel: Sel, orders: list[Order] | None, path: tuple[str, ...]) -> Column:
        name = sel.name
        if name == "__typename":
            return F.lit(s.type.name)
        if name == "_cursor":
            return self.cursor(orders or [])
        if name == "_revision":
            return revision(s.node)
        if name.startswith("_") and name.endswith("Meta") and name[1:-4] in s.type.fields:
            f = s.type.fields[name[1:-4]]
            self.check(s.type, f)
            n = self.list_of(s, f, Sel(f.name, f.name, sel.args, []), path, count=True)
            return F.struct(*[n.alias(c.alias) for c in sel.children])
        f = s.type.fields.get(name)
        if f is None:
            raise QueryError("BAD_INPUT", f"{s.type.name} has no field {name}")
        self.check(s.type, f)
        t = self.model.types[f.type_name]
        if f.kind in ("root", "parent"):
            found = s.root if f.kind == "root" else s.parent
            if found is None or found[1].name != t.name:
                raise QueryError("NOT_SUPPORTED", f"{s.type.name}.{f.name} isn't known here")
            return self.project(Scope(s.frame, found[0], t, f"{s.path}.{name}", found if t.kind == "root" else s.root), sel.children, at=path)
        if f.is_list or f.kind == "collect":
            return self.list_of(s, f, sel, path)
        if f.kind in ("relation", "reference"):
            if f.kind == "reference" and not sel.children:
                return s.node.getField(f.name)
            node, t = self.target(s, f)
            inner = self.project(Scope(s.frame, node, t, f"{s.path}.{name}"), sel.children, at=path)
            return F.when(node.getField("id").isNotNull() | node.isNotNull(), inner)
        value = s.node.getField(name)
        if not t.is_object:
            return value.cast("string") if f.type_name == "ID" else value
        inner = self.project(s.inner(name, value, t, s.frame), sel.children, at=path)
        return inner if t.kind == "extension" else F.when(value.isNotNull(), inner)

    def check(self, t: Type, f: Field) -> None:
        if not auth.field_allowed(f, self.user, "read"):
            raise QueryError("PERMISSION_DENIED", f"Not authorized to read {t.name}.{f.name}")

    def needs_join(self, t: Type, sels: list[Sel], args: dict[str, Any]) -> bool:
        for sel in sels:
            f = t.fields.get(sel.name.removeprefix("_").removesuffix("Meta") if sel.name.startswith("_") else sel.name)
            if f is None:
                continue
            if f.kind == "relation" or (f.kind == "reference" and sel.children) or (f.kind == "collect" and any(x.field.kind == "relation" for x in f.steps)):
                return True
            inner = self.model.types[f.type_name]
            if f.kind in ("root", "parent") and self.needs_join(inner, sel.children, {}):
                return True
            if f.kind in ("plain", "collect") and inner.is_object and self.needs_join(inner, sel.children, sel.args):
                return True

        def joins(t: Type, flt: Any) -> bool:
            if isinstance(flt, list):
                return any(joins(t, x) for x in flt)
            for k, v in (flt or {}).items():
                if k in ("AND", "OR"):
                    if joins(t, v):
                        return True
                    continue
                f, _ = self.split(t, k)
                inner = self.model.types[f.type_name]
                if f.kind == "relation" or (f.kind == "reference" and (v is None or isinstance(v, dict))) or (inner.is_object and isinstance(v, dict) and f.kind == "plain" and joins(inner, v)):
                    return True
            return False

        return joins(t, args.get("filter"))

    # ---------------------------------------------------------------- lists

    def list_of(self, s: Scope, f: Field, sel: Sel, path: tuple[str, ...], count: bool = False) -> Column:
        t = self.model.types[f.type_name]
        steps = f.steps if f.kind == "collect" else None
        if steps is not None:
            t = self.model.types[steps[-1].field.type_name]
            if f.aggregate and not (f.aggregate == "DISTINCT" and t.is_object):
                return self.aggregate(s, f, t)
        if f.kind == "relation" or (steps and any(x.field.kind == "relation" for x in steps)):
            child = self.follow(s, f, t, distinct=f.aggregate == "DISTINCT")
            return self.joined(s, child, sel, path, count)
        items = safe_list(s.node.getField(f.name)) if steps is None else self.walk(s.node, [x.field for x in steps], f.aggregate == "DISTINCT")
        if f.aggregate == "DISTINCT":
            items = F.array_distinct(items)
        if not t.is_object:
            return F.size(items) if count else items
        if self.needs_join(t, sel.children, sel.args):
            return self.joined(s, self.exploded(s, f, items, t), sel, path, count)
        return self.embedded(s, f.name, items, t, sel, path, count)

    def walk(self, node: Column, fields: list[Field], drop_null: bool) -> Column:
        """Array of all values on a path of embedded fields."""
        at, many = node, False
        for f in fields:
            if not many:
                at = at.getField(f.name)
                if f.is_list:
                    at, many = safe_list(at), True
            elif f.is_list:
                at = F.flatten(F.filter(F.transform(at, getter(f.name)), lambda x: x.isNotNull()))
            else:
                at = F.transform(at, getter(f.name))
        return F.filter(at, lambda x: x.isNotNull()) if drop_null else at

    def embedded(self, s: Scope, name: str, items: Column, t: Type, sel: Sel, path: tuple[str, ...], count: bool) -> Column:
        """Filter, sort, cut and map of an array, without a join."""
        args = sel.args
        if args.get("filter"):
            items = F.filter(items, lambda x: truth(self.predicate(s.inner(name, x, t), args["filter"])))
        if count:
            return F.size(items)
        wants = any(c.name == "_cursor" for c in sel.children)
        probe = lambda x: self.orders(s.inner(name, x, t), args.get("orderBy"))
        full = (lambda x: self.absolute(s.inner(name, x, t), probe(x))) if wants or args.get("after") else probe
        if args.get("after"):
            items = F.filter(items, lambda x: self.after(full(x), args["after"]))
        if args.get("orderBy") or wants or args.get("after"):

            items = F.array_sort(items, lambda a, b: precedence([(x.column, y.column, x.down) for x, y in zip(full(a), full(b), strict=True)]))
        skip, first = args.get("skip") or 0, args.get("first")
        if first is not None:
            items = F.slice(items, skip + 1, first)
        elif skip:
            items = F.slice(items, skip + 1, F.greatest(F.size(items), F.lit(1)))
        return F.transform(items, lambda x: self.project(s.inner(name, x, t), sel.children, full(x) if wants else None, path))

    def exploded(self, s: Scope, f: Field, items: Column, t: Type) -> Scope:
        """The items of an embedded list as rows, keyed by parent and position."""
        pos, node = fresh("p"), fresh("n")
        root, parent = s.inner(f.name, s.node, t).root, s.inner(f.name, s.node, t).parent
        up = {}
        cols = [F.col(k) for k in s.frame.keys]
        for what, have in (("root", root), ("parent", parent)):
            if have is not None:
                up[what] = (fresh("u"), have[1])
                cols.append(have[0].alias(up[what][0]))
        df = s.frame.df.select(*cols, F.posexplode(items).alias(pos, node))
        here = {k: (F.col(c), kind) for k, (c, kind) in up.items()}
        child = Scope(Frame(df, [*s.frame.keys, pos]), F.col(node), t, "", here.get("root"), here.get("parent"))
        child.frame.meta["order"] = [pos]
        return child

    def hop(self, df: DataFrame, at: str, step: Any, t: Type, keep_null: bool, last: bool) -> tuple[DataFrame, str]:
        """One relation step from the ids in column ``at``; depths are a union of that many joins."""
        e = self.edges(t, step.field)
        if not last or step.most > 1 or keep_null:  # else the join with the target's rows does the same
            there = self.rows(self.model.types[step.field.type_name]).select(F.col("id").alias("_to"))
            e = e.join(there, "_to", "left_semi")  # dangling edges and hidden vertices end a path
        out, levels = fresh("i"), []
        level = df.withColumn(out, F.col(at))
        if step.least == 0:
            levels.append(level)
        for depth in range(1, step.most + 1):
            frm, to = fresh("a"), fresh("b")
            right = e.select(F.col("_from").alias(frm), F.col("_to").alias(to))
            level = level.join(right, F.col(out) == F.col(frm), "left" if keep_null and not step.field.is_list else "inner").drop(frm, out).withColumnRenamed(to, out)
            if depth >= step.least:
                levels.append(level)
        res = levels[0]
        for x in levels[1:]:
            res = res.unionByName(x)
        return res, out

    def follow(self, s: Scope, f: Field, t: Type, distinct: bool = False, keep_null: bool = False) -> Scope:
        """The end of a relation or of a collect path as rows, keyed by the parent's keys and what leads there."""
        if s.frame is None:
            raise QueryError("NOT_SUPPORTED", f"{s.type.name}.{f.name} can't be followed within this list")
        steps = f.steps if f.kind == "collect" else [Step(f)]
        at = fresh("i")
        df = s.frame.df.select(*[F.col(k) for k in s.frame.keys], s.node.getField("id").alias(at))
        here = s.type
        relations = [x for x in steps if x.field.kind == "relation"]
        for n, step in enumerate(relations):
            df, to = self.hop(df, at, step, here, keep_null and not any(x.field.is_list or x.most > 1 for x in steps[n + 1 :]), n == len(relations) - 1)
            df, at = df.drop(at), to
            here = self.model.types[step.field.type_name]
        keys = [*s.frame.keys, at]
        if distinct and here is t:
            df = df.dropDuplicates(keys)
        node, key = fresh("n"), fresh("j")
        right = self.as_node(here, node).select(node, F.col(node).getField("id").alias(key))
        df = df.join(right, F.col(at) == F.col(key), "left" if keep_null else "inner").drop(key)
        root = parent = None
        value, order = F.col(node), [at]
        rest = [x.field for x in steps if x.field.kind != "relation"]
        for k, g in enumerate(rest):
            inner = self.model.types[g.type_name]
            if here.kind in ("root", "child"):
                parent = (value, here)
            if here.kind == "root":
                root = (value, here)
            value = value.getField(g.name)
            if g.is_list:
                pos, item = fresh("p"), fresh("n")
                kept = {c: fresh("u") for c in ("root", "parent") if (root if c == "root" else parent) is not None}
                ups = [(root if c == "root" else parent)[0].alias(kept[c]) for c in kept]
                df = df.select(*[F.col(c) for c in keys], *ups, F.posexplode(value).alias(pos, item))
                if root is not None:
                    root = (F.col(kept["root"]), root[1])
                if parent is not None:
                    parent = (F.col(kept["parent"]), parent[1])
                keys, value, order = [*keys, pos], F.col(item), [*order, pos]
            here = inner
        child = Scope(Frame(df, keys), value, t, "", root, parent)
        child.frame.meta["order"] = order
        if distinct and rest and t.is_object:
            name = child.frame.add(value, "v")
            child.frame.df = child.frame.df.where(F.col(name).isNotNull()).dropDuplicates([*s.frame.keys, name])
        return child

    def joined(self, s: Scope, child: Scope, sel: Sel, path: tuple[str, ...], count: bool = False) -> Column:
        """Filter, page and project the child rows, gather them by parent and join them back."""
        self.where(child, sel.args.get("filter"))
        keys = s.frame.keys
        if count:
            out = fresh("c")
            got = child.frame.df.groupBy(*keys).agg(F.count("*").alias(out))
            s.frame.df = s.frame.df.join(got, keys, "left")
            return F.coalesce(F.col(out), F.lit(0)).cast("int")
        wants = any(c.name == "_cursor" for c in sel.children)
        orders = self.page(child, sel.args, wants, keys)
        item = self.project(child, sel.children, orders, path)
        one, out = fresh("x"), fresh("l")
        if "rank" in child.frame.meta:
            lead, names = [F.col(child.frame.meta["rank"]).alias("r")], ["r"]
        else:
            # no window: the rows of a parent are sorted once, as an array, by what leads its items
            order = [Order(c, F.col(c), "", False) for c in child.frame.meta.get("order", [])]
            lead = [c for o in [*orders, *order] for c in o.ascending()]
            lead, names = [c.alias(f"o{i}") for i, c in enumerate(lead)], [f"o{i}" for i in range(len(lead))]
        rows = child.frame.df.select(*[F.col(k) for k in keys], F.struct(*lead, item.alias("item")).alias(one))
        items, kind = F.collect_list(one), rows.schema[one].dataType.simpleString()
        if "map<" in kind or DOWN in kind:  # these can't be compared as wholes, or the wrong way round
            def pick(x: Column, n: str) -> Column:
                return x.getField(n).getField(DOWN) if n in texts else x.getField(n)

            texts = {f.name for f in rows.schema[one].dataType.fields if DOWN in f.dataType.simpleString()[:40] and f.name != "item"}
            items = F.array_sort(items, lambda a, b: precedence([(pick(a, n), pick(b, n), n in texts) for n in names]))
        else:
            items = F.sort_array(items)
        got = rows.groupBy(*keys).agg(F.transform(items, lambda x: x.getField("item")).alias(out))
        s.frame.df = s.frame.df.join(got, keys, "left")
        return safe_list(F.col(out))

    def aggregate(self, s: Scope, f: Field, t: Type) -> Column:
        """An aggregated collect field: over arrays as long as the path is embedded, else over joined rows."""
        kind = t.name if t.kind == "scalar" else t.kind
        keep = f.aggregate in NULL_KEEPING
        if not any(x.field.kind == "relation" for x in f.steps):
            items = self.walk(s.node, [x.field for x in f.steps], not keep)
            if kind == "OffsetDateTime":
                items = F.transform(items, lambda x: x.getField("timestamp"))
            return aggregates.of_array(f.aggregate, items, kind)
        child = self.follow(s, f, t, keep_null=keep)
        value = child.node.cast("string") if kind == "ID" else comparable(kind, child.node)
        v, out = fresh("v"), fresh("g")
        if t.kind in ("root", "child"):
            value = value.getField("id")
        rows = child.frame.df.select(*[F.col(k) for k in s.frame.keys], value.alias(v))
        if not keep:
            rows = rows.where(F.col(v).isNotNull())
        got = rows.groupBy(*s.frame.keys).agg(aggregates.of_rows(f.aggregate, F.col(v), kind).alias(out))
        s.frame.df = s.frame.df.join(got, s.frame.keys, "left")
        return aggregates.or_empty(f.aggregate, F.col(out))
