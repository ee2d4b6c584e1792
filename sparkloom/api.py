"""Engine: a model bound to tables, asked by operations or by DataFrame methods."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import sdl
from .functions import search
from .model import Model, Type
from .plans import auth
from .plans.compiler import Compiler, Problem, QueryError, Scope
from .plans.search import Search
from .sdl import Field as Sel
from .sources.binding import Binding


@dataclass
class Options:
    """Limits and hooks of an execution."""

    implicit_limit: int | None = None
    max_limit: int | None = None
    search_limit: int | None = None
    search_depth: int = 1
    max_order_depth: int | None = None
    tokenizer: search.Tokenizer = field(default_factory=lambda: search.DEFAULT)


@dataclass
class Part:
    """One root field: a frame of ``out`` structs, or of a single one."""

    df: DataFrame | None
    kind: str  # list, one, count, plain
    limit: int | None = None
    value: Any = None

    def rows(self) -> DataFrame:
        """The selected fields as columns."""
        return self.df.select("out.*")


@dataclass
class Result:
    parts: dict[str, Part]
    problems: list[Problem]

    def frame(self, alias: str) -> DataFrame:
        return self.parts[alias].rows()

    def explain(self, mode: str = "formatted") -> None:
        for p in self.parts.values():
            if p.df is not None:
                p.df.explain(mode)

    def data(self) -> dict[str, Any]:
        """The whole result as JSON-like values; small results only, as it comes to the driver."""
        out: dict[str, Any] = {}
        for alias, p in self.parts.items():
            at, names = out, alias.split("/")
            for n in names[:-1]:
                at = at.setdefault(n, {})
            if p.df is None:
                at[names[-1]] = p.value
                continue
            rows = [to_json(r["out"]) for r in p.df.collect()]
            if p.limit is not None and len(rows) > p.limit:
                self.problems.append(Problem((alias,), "TOO_MANY_OBJECTS", f"more than {p.limit} objects; say how many with first"))
                rows = rows[: p.limit]
            at[names[-1]] = rows if p.kind == "list" else rows[0] if rows else None
        return out


def to_json(v: Any) -> Any:
    if isinstance(v, Row):
        names = [n for n in v.__fields__ if n != "_"]
        if names == ["timestamp", "offset"]:
            return offset_text(v["timestamp"], v["offset"])
        return {n: to_json(v[n]) for n in names}
    if isinstance(v, list):
        return [to_json(x) for x in v]
    if isinstance(v, dict):
        return {k: to_json(x) for k, x in v.items()}
    if isinstance(v, dt.datetime):
        return instant_text(v) + "Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def instant_text(v: dt.datetime) -> str:
    """Seconds always, fractions in groups of three digits."""
    text = v.strftime("%Y-%m-%dT%H:%M:%S")
    if v.microsecond:
        text += f".{v.microsecond:06d}" if v.microsecond % 1000 else f".{v.microsecond // 1000:03d}"
    return text


def offset_text(at: dt.datetime | None, offset: str | None) -> str | None:
    if at is None:
        return None
    sign, rest = (offset or "+00:00")[0], (offset or "+00:00")[1:]
    h, m = map(int, rest.split(":"))
    shift = dt.timedelta(hours=h, minutes=m) * (-1 if sign == "-" else 1)
    return instant_text(at + shift) + ("Z" if not shift else offset)


class Engine:
    """Queries over a binding. Session time zone must be UTC."""

    def __init__(self, binding: Binding, options: Options | None = None):
        self.binding, self.model, self.spark = binding, binding.model, binding.spark
        self.options = options or Options()
        if self.spark.conf.get("spark.sql.session.timeZone") != "UTC":
            self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    # ---- operations

    def query(self, text: str, variables: dict[str, Any] | None = None, user: auth.User | None = None, name: str | None = None) -> Result:
        kind, fields = sdl.operation(text, variables, name)
        if kind != "query":
            raise QueryError("NOT_SUPPORTED", "this is no query; see sparkloom.operators.mutations")
        compiler = Compiler(self.binding, user, self.options.max_order_depth, self.options.tokenizer)
        parts: dict[str, Part] = {}
        self.resolve(compiler, fields, (), (), parts)
        return Result(parts, compiler.problems)

    def resolve(self, c: Compiler, fields: list[Sel], namespace: tuple[str, ...], at: tuple[str, ...], parts: dict[str, Part]) -> None:
        spaces = {t.namespace[: len(namespace) + 1] for t in self.model.roots() if len(t.namespace) > len(namespace) and t.namespace[: len(namespace)] == namespace}
        for f in fields:
            path = (*at, f.alias)
            if (*namespace, f.name) in spaces:
                self.resolve(c, f.children, (*namespace, f.name), path, parts)
                continue
            try:
                parts["/".join(path)] = self.part(c, f, namespace, path)
            except QueryError as e:
                c.problems.append(Problem(path, e.code, str(e)))
                parts["/".join(path)] = Part(None, "plain")

    def part(self, c: Compiler, f: Sel, namespace: tuple[str, ...], path: tuple[str, ...]) -> Part:
        if f.name == "__typename":
            return Part(None, "plain", value="Query")
        for t in self.model.roots():
            if t.namespace != namespace:
                continue
            if f.name == t.name:
                return self.one(c, t, f, path)
            if f.name == f"all{t.plural}":
                return self.many(c, c.scan(t), f, path)
            if f.name == f"_all{t.plural}Meta":
                return self.count(c, c.scan(t), f)
            if t.search and f.name == f"flexSearch{t.plural}":
                s = Search(c, self.options).scope(t, f.args)
                return self.many(c, s, f, path, {**f.args, "filter": None})
            if t.search and f.name == f"_flexSearch{t.plural}Meta":
                s = Search(c, self.options).scope(t, f.args)
                return self.count(c, s, Sel(f.name, f.alias, {}, f.children))
        raise QueryError("BAD_INPUT", f"no field {f.name}")

    def one(self, c: Compiler, t: Type, f: Sel, path: tuple[str, ...]) -> Part:
        given = {k: v for k, v in f.args.items() if v is not None}
        names = {"id"} | ({t.key.name} if t.key else set())
        if len(given) != 1 or not set(given) <= names:
            raise QueryError("BAD_INPUT", f"give exactly one of {', '.join(sorted(names))}")
        s = c.where(c.scan(t), given)
        s.frame.df = s.frame.df.limit(1)
        return Part(self.shaped(c, s, f.children, None, path), "one")

    def many(self, c: Compiler, s: Scope, f: Sel, path: tuple[str, ...], args: dict[str, Any] | None = None) -> Part:
        args = dict(f.args if args is None else args)
        o, limit = self.options, None
        if args.get("first") is not None and o.max_limit is not None and args["first"] > o.max_limit:
            raise QueryError("ARGUMENT_OUT_OF_RANGE", f"first must not be more than {o.max_limit}")
        c.where(s, args.get("filter"))
        if args.get("first") is None:
            limits = [x for x in (o.implicit_limit, o.max_limit) if x is not None]
            limit = min(limits, default=None)
            if limit is not None:
                args["first"] = limit + 1
        orders = c.page(s, args, any(x.name == "_cursor" for x in f.children))
        return Part(self.shaped(c, s, f.children, orders, path), "list", limit)

    def shaped(self, c: Compiler, s: Scope, children: list[Sel], orders: list | None, path: tuple[str, ...]) -> DataFrame:
        out = c.project(s, children, orders, path)
        df = s.frame.df
        if orders:
            df = df.orderBy(*[o.sort() for o in orders])
        return df.select(out.alias("out"))

    def count(self, c: Compiler, s: Scope, f: Sel) -> Part:
        c.where(s, f.args.get("filter"))
        df = s.frame.df if f.args.get("first") is None else s.frame.df.limit(f.args["first"])
        n = df.agg(F.count("*").cast("int").alias("n"))
        return Part(n.select(F.struct(*[F.col("n").alias(x.alias) for x in f.children]).alias("out")), "one")

    # ---- DataFrame methods

    def type(self, name: str, user: auth.User | None = None) -> Query:
        return Query(self, self.model.types[name], user)

    def schema_frames(self) -> dict[str, DataFrame]:
        from .sources.metadata import schema_frames

        return schema_frames(self.spark, self.model)


class Query:
    """Chained methods over one root entity; ends in a flat DataFrame."""

    def __init__(self, engine: Engine, t: Type, user: auth.User | None):
        self.engine, self.type = engine, t
        self.compiler = Compiler(engine.binding, user, engine.options.max_order_depth, engine.options.tokenizer)
        self.scope = self.compiler.scan(t)

    def filter(self, **conditions: Any) -> Query:
        self.compiler.where(self.scope, conditions)
        return self

    def search(self, expression: str | None = None, **conditions: Any) -> Query:
        Search(self.compiler, self.engine.options).apply(self.scope, conditions, expression)
        return self

    def page(self, **args: Any) -> Query:
        self.compiler.page(self.scope, args, False)
        return self

    def count(self) -> DataFrame:
        return self.scope.frame.df.agg(F.count("*").alias("count"))

    def select(self, selection: str) -> DataFrame:
        """Columns of a selection in braces, without the braces around it."""
        _, fields = sdl.operation("{" + selection + "}")
        out = self.compiler.project(self.scope, fields)
        if self.compiler.problems:
            p = self.compiler.problems[0]
            raise QueryError(p.code, p.message)
        return self.scope.frame.df.select(out.alias("out")).select("out.*")


def api_names(model: Model) -> DataFrameNames:
    """Names of the generated root fields."""
    q, m = [], []
    for t in model.roots():
        q += [t.name, f"all{t.plural}", f"_all{t.plural}Meta"] + ([f"flexSearch{t.plural}", f"_flexSearch{t.plural}Meta"] if t.search else [])
        m += [f"create{t.name}", f"update{t.name}", f"delete{t.name}", f"updateAll{t.plural}", f"deleteAll{t.plural}"]
        m += [] if t.plural == t.name else [f"create{t.plural}", f"update{t.plural}", f"delete{t.plural}"]
    return {"query": q, "mutation": m}


DataFrameNames = dict[str, list[str]]
