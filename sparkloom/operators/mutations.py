"""Mutations: a sequence of table changes, staged as DataFrames and committed together or not at all."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sdl
from ..api import Engine, Options, to_json
from ..functions import semantics
from ..functions.semantics import BadValue, parse_scalar, truth
from ..model import Field, Relation, Type
from ..plans import auth
from ..plans.compiler import Compiler, Problem, QueryError, revision
from ..sdl import Field as Sel
from ..sources.binding import Binding, spark_type, stored_fields, table_type, to_row
from .store import EDGE, Store

# Prefixes of calculated updates, and what they do.
CALC: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "addTo_": ("ADD", lambda a, b: a + b),
    "subtractFrom_": ("SUBTRACT", lambda a, b: a - b),
    "multiplyWith_": ("MULTIPLY", lambda a, b: a * b),
    "divideBy_": ("DIVIDE", semantics.divide),
    "moduloOf_": ("MODULO", semantics.modulo),
    "appendTo_": ("APPEND", semantics.append),
    "prependTo_": ("PREPEND", lambda a, b: semantics.append(b, a)),
}


def typed(value: Any, kind: T.DataType) -> Column:
    """A literal of a nested type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[typed(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[typed(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), F.lit(v))]).cast(kind)
    return F.lit(value).cast(kind)


def texts(df: DataFrame, *names: str) -> DataFrame:
    other = [n for n in names if not isinstance(df.schema[n].dataType, T.StringType)]
    return df.withColumns({n: F.col(n).cast("string") for n in other}) if other else df


class Transaction:
    """Staged tables over a store or a binding. Reads see the changes made so far."""

    def __init__(self, store: Store | Binding, user: auth.User | None, clock: Callable[[], dt.datetime], new_id: Callable[[], str]):
        self.store, self.model, self.spark, self.user = store, store.model, store.spark, user
        self.now, self.new_id = clock(), new_id
        self.changed: dict[str, DataFrame] = {}
        self.added: dict[str, DataFrame] = {}  # rows new in tables that stay as they are otherwise

    def table(self, t: Type) -> DataFrame:
        """Rows as changed so far; ids are texts here, as new ones are."""
        got = self.changed.get(t.collection)
        return self.with_added(t.collection, texts(self.store.table(t), "id") if got is None else got)

    def with_added(self, name: str, df: DataFrame) -> DataFrame:
        return df.unionByName(self.added[name]) if name in self.added else df

    def add(self, name: str, df: DataFrame) -> None:
        """New rows; those of a table that is written anew anyway go there."""
        if name in self.changed:
            self.changed[name] = self.changed[name].unionByName(df)
        else:
            self.added[name] = self.added[name].unionByName(df) if name in self.added else df

    def put(self, name: str, df: DataFrame) -> None:
        """The table as a whole, added rows among them."""
        self.changed[name] = df
        self.added.pop(name, None)

    def ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def edges(self, r: Relation) -> DataFrame:
        got = self.changed.get(f"_edges/{r.name}")
        return self.with_added(f"_edges/{r.name}", texts(self.store.edges(r), "_from", "_to") if got is None else got)

    def set_edges(self, r: Relation, df: DataFrame) -> None:
        self.put(f"_edges/{r.name}", df.select("_from", "_to"))

    def binding(self) -> Binding:
        b = Binding(self.spark, self.model)
        for t in self.model.roots():
            b.bind(t.name, lambda t=t: self.table(t))
        for r in self.model.relations():
            b.bind_edges(f"{r.from_type}.{r.field}", lambda r=r: self.edges(r))
        return b

    # ---------------------------------------------------------------- creating

    def document(self, t: Type, given: dict[str, Any], entity: bool = True) -> tuple[dict[str, Any], list[tuple[Field, str, Any]]]:
        """A document with defaults, ids and time stamps, and what its relation inputs ask for."""
        doc: dict[str, Any] = {}
        links: list[tuple[Field, str, Any]] = []
        for f in t.fields.values():
            if f.has_default and f.name not in given:
                given = {**given, f.name: f.default}
        for name, v in given.items():
            f = t.fields.get(name)
            if f is None and name.startswith("create") and (g := self.by_suffix(t, name[6:])) is not None and g.kind == "relation":
                links.append((g, "create", v))
                continue
            if f is None or f.kind in ("collect", "root", "parent"):
                raise QueryError("BAD_INPUT", f"{t.name} has no input {name}")
            if not auth.field_allowed(f, self.user, "update"):
                raise QueryError("PERMISSION_DENIED", f"Not authorized to write {t.name}.{name}")
            if f.kind == "relation":
                links.append((f, "set", v))
                continue
            kind = self.model.types[f.type_name]
            if f.is_list:
                v = [] if v is None else v
                doc[name] = [self.document(kind, x)[0] if kind.is_object else x for x in v]
            else:
                doc[name] = self.document(kind, v)[0] if kind.is_object and v is not None else v
        if t.kind in ("root", "child"):
            at = self.now.isoformat().replace("+00:00", "Z")
            doc |= {"id": self.new_id(), "createdAt": at, "updatedAt": at}
        return doc, links

    def by_suffix(self, t: Type, suffix: str) -> Field | None:
        return next((f for f in t.fields.values() if f.name[0].upper() + f.name[1:] == suffix), None)

    def create(self, t: Type, inputs: list[dict[str, Any]]) -> list[str]:
        g = auth.grant(self.model, t, self.user, "create")
        docs, links = [], []
        for given in inputs:
            doc, wants = self.document(t, given)
            if not g.allows(doc):
                raise QueryError("PERMISSION_DENIED", f"Not authorized to create {t.name} objects with these values")
            docs.append(doc)
            links += [(doc["id"], *w) for w in wants]
        try:
            rows = [to_row(self.model, t, d) for d in docs]
        except BadValue as e:
            raise QueryError("BAD_INPUT", str(e)) from e
        self.add(t.collection, self.spark.createDataFrame(rows, table_type(self.model, t)))
        self.check_unique(t, [d["id"] for d in docs])
        self.link_all(t, links)
        return [d["id"] for d in docs]

    def check_unique(self, t: Type, ids: list[str]) -> None:
        """Unique indices hold among the rows written now and all others; null values don't count."""
        for names, unique in t.indices:
            if not unique:
                continue
            cols = [F.col(".".join(f"`{p}`" for p in n.split("."))) for n in names]
            there = F.lit(True)
            for c in cols:
                there = there & c.isNotNull()
            df = self.table(t).where(there).select(F.col("id"), *[c.alias(f"u{i}") for i, c in enumerate(cols)])
            keys = [f"u{i}" for i in range(len(cols))]
            mine = df.join(self.ids(ids), "id", "left_semi").select(keys).distinct()
            if not df.join(mine, keys, "left_semi").groupBy(*keys).count().where("count > 1").isEmpty():
                raise QueryError("UNIQUE_CONSTRAINT_VIOLATION", f"{t.name}: {', '.join(names)} must be unique")

    # ---------------------------------------------------------------- edges

    def link_all(self, t: Type, wants: list[tuple[str, Field, str, Any]]) -> None:
        """Relation inputs (source, field, how, value), those of one field and kind together."""
        groups: dict[tuple[str, str], tuple[Field, list[tuple[str, Any]]]] = {}
        for source, f, how, v in wants:
            groups.setdefault((f.name, how), (f, []))[1].append((source, v))
        for (_, how), (f, pairs) in groups.items():
            self.link(t, f, how, pairs)

    def link(self, t: Type, f: Field, how: str, wants: list[tuple[str, Any]]) -> None:
        """Sets, adds or removes the edges of some objects at once; where one side has room for one, the last wins."""
        target = self.model.types[f.type_name]
        if how == "create":
            inputs = [v if isinstance(v, list) else [v] if v is not None else [] for _, v in wants]
            made = iter(self.create(target, [x for own in inputs for x in own]) if any(inputs) else [])
            wants = [(source, [next(made) for _ in own]) for (source, _), own in zip(wants, inputs, strict=True)]
            how = "add" if f.is_list else "set"
        pairs = list(dict.fromkeys((source, str(x)) for source, v in wants for x in (v if isinstance(v, list) else [] if v is None else [v])))
        r, forward = self.model.relation(t, f)
        own, other = ("_from", "_to") if forward else ("_to", "_from")
        frame = lambda rows: self.spark.createDataFrame(rows, f"{own} string, {other} string").select("_from", "_to")
        e = self.edges(r)
        if how == "remove":
            if pairs:
                self.set_edges(r, e.join(frame(pairs), ["_from", "_to"], "left_anti"))
            return
        if pairs:
            there = self.table(target).select("id")
            if not self.ids(list({x for _, x in pairs})).join(there, "id", "left_anti").isEmpty():
                raise QueryError("NOT_FOUND", f"{target.name} objects to link with don't exist")
        back = self.model.inverse(t, f)
        single = back is not None and not back.is_list  # the other side has room for one
        if single:
            pairs = [(source, x) for x, source in {x: source for source, x in pairs}.items()]
        if not f.is_list:
            pairs = list({source: x for source, x in pairs}.items())
        sources = [s for s, _ in wants] if how == "set" else [s for s, _ in pairs] if not f.is_list else []
        kept = e
        if sources:
            kept = kept.join(self.ids(sources).withColumnRenamed("id", own), own, "left_anti")
        if single and pairs:
            kept = kept.join(self.ids([x for _, x in pairs]).withColumnRenamed("id", other), other, "left_anti")
        if kept is not e and not e.join(kept, ["_from", "_to"], "left_anti").isEmpty():
            self.set_edges(r, kept)
        if pairs:
            self.add(f"_edges/{r.name}", frame(pairs).join(kept, ["_from", "_to"], "left_anti"))

    # ---------------------------------------------------------------- updating

    def value(self, f: Field, v: Any) -> Column:
        kind = self.model.types[f.type_name]
        if f.kind == "reference":
            kind = self.model.types[kind.key.type_name]
        target = spark_type(self.model, kind.name, f.is_list)
        try:
            if f.is_list:
                items = [] if v is None else v
                if kind.is_object:
                    items = [to_row(self.model, kind, self.document(kind, x)[0]) for x in items]
                elif kind.kind == "scalar":
                    items = [parse_scalar(kind.name, x) for x in items]
                return typed(items, target)
            if kind.is_object:
                return typed(None if v is None else to_row(self.model, kind, self.document(kind, v)[0]), target)
            return typed(parse_scalar(kind.name, v) if kind.kind == "scalar" else v, target)
        except BadValue as e:
            raise QueryError("BAD_INPUT", str(e)) from e

    def assignments(self, t: Type, node: Callable[[str], Column], given: dict[str, Any]) -> tuple[dict[str, Column], list[tuple[Field, str, Any]]]:
        """New values of fields of an object, and relation inputs."""
        out: dict[str, Column] = {}
        links: list[tuple[Field, str, Any]] = []
        lists: dict[str, dict[str, Any]] = {}

        def put(name: str, c: Column) -> None:
            if name in out:
                raise QueryError("BAD_INPUT", f"{t.name}.{name} is set twice")
            out[name] = c

        for name, v in given.items():
            calc = next((p for p in CALC if name.startswith(p) and name[len(p) :] in t.fields), None)
            if name in t.fields:
                f, how = t.fields[name], "set"
            elif calc:
                f, how = t.fields[name[len(calc) :]], "calc"
            else:
                how = next((h for h in ("add", "remove", "update", "create") if name.startswith(h) and self.by_suffix(t, name[len(h) :])), None)
                if how is None:
                    raise QueryError("BAD_INPUT", f"{t.name} has no input {name}")
                f = self.by_suffix(t, name[len(how) :])
            if f.kind in ("collect", "root", "parent") or f.name in ("id", "createdAt", "updatedAt"):
                raise QueryError("BAD_INPUT", f"{t.name}.{f.name} can't be written")
            if not auth.field_allowed(f, self.user, "update"):
                raise QueryError("PERMISSION_DENIED", f"Not authorized to write {t.name}.{f.name}")
            kind = self.model.types[f.type_name]
            if f.kind == "relation":
                links.append((f, how, v))
            elif how == "calc":
                op, fn = CALC[calc]
                if op not in f.calc:
                    raise QueryError("BAD_INPUT", f"{t.name}.{f.name} has no calc mutation {op}")
                put(f.name, fn(node(f.name), self.value(f, v)).cast(spark_type(self.model, f.type_name, False)))
            elif how == "set" and kind.kind == "extension":
                if v:
                    inner, _ = self.assignments(kind, getter(node(f.name)), v)
                    put(f.name, self.rebuilt(kind, getter(node(f.name)), inner))
            elif how == "set":
                put(f.name, self.value(f, v))
            elif kind.kind == "child":
                lists.setdefault(f.name, {})[how] = v
            else:
                raise QueryError("BAD_INPUT", f"{t.name} has no input {name}")
        for name, ops in lists.items():
            put(name, self.children(t.fields[name], out.pop(name, node(name)), ops))
        return out, links

    def rebuilt(self, t: Type, node: Callable[[str], Column], new: dict[str, Column]) -> Column:
        """An object with some fields replaced."""
        kinds = {c: spark_type(self.model, n, f.is_list, {}) for c, n, f in stored_fields(self.model, t)}
        return F.struct(*[new.get(c, node(c)).cast(k).alias(c) for c, k in kinds.items()])

    def children(self, f: Field, items: Column, ops: dict[str, Any]) -> Column:
        """A child list after adding, removing and updating, in this order; unknown ids are left alone."""
        kind = self.model.types[f.type_name]
        items = semantics.safe_list(items)
        if ops.get("add"):
            items = F.concat(items, self.value(f, ops["add"]))
        if ops.get("remove"):
            ids = [str(x) for x in ops["remove"]]
            items = F.filter(items, lambda x: ~truth(x.getField("id").isin(ids)))
        for u in ops.get("update") or []:
            items = F.transform(items, self.updating(kind, u))
        return items

    def updating(self, kind: Type, u: dict[str, Any]) -> Callable[[Column], Column]:
        rest = {k: v for k, v in u.items() if k != "id"}

        def one(x: Column) -> Column:
            new, links = self.assignments(kind, getter(x), rest)
            if links:
                raise QueryError("BAD_INPUT", "child entities have no relations")
            new["updatedAt"] = F.lit(self.now)
            return F.when(x.getField("id") == str(u["id"]), self.rebuilt(kind, getter(x), new)).otherwise(x)

        return one

    def update(self, t: Type, hit: Column, given: dict[str, Any], ids: list[str] | None) -> None:
        """Changes the rows where ``hit`` holds; ``ids`` names them if they are few and known."""
        g = auth.grant(self.model, t, self.user, "update")
        df = self.table(t)
        if not g.always:
            whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            if not df.where(hit & ~g.column(whole)).isEmpty():
                raise QueryError("PERMISSION_DENIED", f"Not authorized to update {t.name} objects")
        new, links = self.assignments(t, F.col, given)
        if links and ids is None:
            raise QueryError("BAD_INPUT", "relations can't be set for all objects at once")
        if new:
            new["updatedAt"] = F.lit(self.now)
            kinds = {f.name: f.dataType for f in table_type(self.model, t).fields}  # the table's own may not allow nulls
            df = df.select(*[F.when(hit, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
            self.put(t.collection, df)
            if not g.always and not df.where(hit & ~g.column(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).isEmpty():
                raise QueryError("PERMISSION_DENIED", f"Not authorized to set these values of {t.name} objects")
            if ids:
                self.check_unique(t, ids)
        self.link_all(t, [(i, f, how, v) for i in ids or [] for f, how, v in links])

    def simple(self, t: Type, given: dict[str, Any]) -> bool:
        """Whether an input sets plain scalars only, so that many of its kind are one join."""
        return all((f := t.fields.get(n)) is not None and f.kind == "plain" and not f.is_list and self.model.types[f.type_name].kind in ("scalar", "enum") and n not in ("id", "createdAt", "updatedAt") for n in given)

    def update_simple(self, t: Type, inputs: dict[str, dict[str, Any]]) -> None:
        """Changes each object named by id as its input says (see ``simple``), in one join whatever their number."""
        g = auth.grant(self.model, t, self.user, "update")
        df = self.table(t)
        names = list(dict.fromkeys(n for given in inputs.values() for n in given))
        for n in names:
            if not auth.field_allowed(t.fields[n], self.user, "update"):
                raise QueryError("PERMISSION_DENIED", f"Not authorized to write {t.name}.{n}")
        try:
            rows = [{"_id": i, **{f"_set_{n}": n in given for n in names}, **{f"_new_{n}": v for n, v in to_row(self.model, t, given).items() if n in names}} for i, given in inputs.items()]
        except BadValue as e:
            raise QueryError("BAD_INPUT", str(e)) from e
        kinds = {f.name: f.dataType for f in df.schema.fields}
        schema = T.StructType([T.StructField("_id", T.StringType()), *[T.StructField(f"_set_{n}", T.BooleanType()) for n in names], *[T.StructField(f"_new_{n}", kinds[n]) for n in names]])
        new = self.spark.createDataFrame([tuple(x[f.name] for f in schema.fields) for x in rows], schema)
        ids = self.ids(list(inputs))

        def refused(rows: DataFrame) -> bool:
            whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
            return not g.always and not rows.join(ids, "id", "left_semi").where(~g.column(whole)).isEmpty()

        if refused(df):
            raise QueryError("PERMISSION_DENIED", f"Not authorized to update {t.name} objects")
        if not names:
            return
        both = df.join(new, F.col("id") == F.col("_id"), "left")
        hit = F.col("_id").isNotNull()
        cols = {n: F.when(hit & F.col(f"_set_{n}"), F.col(f"_new_{n}")).otherwise(F.col(n)) for n in names} | {"updatedAt": F.when(hit, F.lit(self.now)).otherwise(F.col("updatedAt"))}
        self.put(t.collection, both.select(*[cols[c].cast(kinds[c]).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns]))
        if refused(self.table(t)):
            raise QueryError("PERMISSION_DENIED", f"Not authorized to set these values of {t.name} objects")
        self.check_unique(t, list(inputs))

    # ---------------------------------------------------------------- deleting

    def delete(self, t: Type, gone: DataFrame, above: tuple[str, ...] = ()) -> None:
        """Removes rows by ``gone`` (id). Restricting relations are looked at first, then others cascade, then edges go."""
        g = auth.grant(self.model, t, self.user, "delete")
        df = self.table(t)
        if not g.always and not df.join(gone, "id", "left_semi").where(~g.column(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).isEmpty():
            raise QueryError("PERMISSION_DENIED", f"Not authorized to delete {t.name} objects")
        relations = [(f, *self.model.relation(t, f)) for f in t.fields.values() if f.kind == "relation"]

        def related(r: Relation, forward: bool) -> DataFrame:
            e = self.edges(r)
            own, other = ("_from", "_to") if forward else ("_to", "_from")
            ids = e.join(gone.select(F.col("id").alias(own)), own, "left_semi").select(F.col(other).alias("id")).distinct()
            return ids.join(self.table(self.model.types[r.to_type if forward else r.from_type]).select("id"), "id", "left_semi")

        for f, r, forward in relations:
            if f.on_delete == "RESTRICT":
                ids = related(r, forward)
                if r.from_type == r.to_type:
                    ids = ids.join(gone, "id", "left_anti")
                if not ids.isEmpty():
                    raise QueryError("RELATION_CONSTRAINT_VIOLATION", f"Cannot delete {t.name} objects because {f.name} refers to others")
        for f, r, forward in relations:
            if f.on_delete == "CASCADE":
                ids = related(r, forward)
                if r.from_type == r.to_type:
                    ids = ids.join(gone, "id", "left_anti")
                if not ids.isEmpty():
                    self.delete(self.model.types[f.type_name], ids, (*above, t.name))
        for _, r, forward in relations:
            sides = ["_from", "_to"] if r.from_type == r.to_type else ["_from" if forward else "_to"]
            e = self.edges(r)
            for side in sides:
                e = e.join(gone.select(F.col("id").alias(side)), side, "left_anti")
            self.set_edges(r, e)
        self.put(t.collection, self.table(t).join(gone, "id", "left_anti").select(*self.table(t).columns))


def getter(x: Column) -> Callable[[str], Column]:
    return lambda name: x.getField(name)


class Mutator:
    """Executes mutations against a store. ``rollback`` computes results without keeping any change."""

    def __init__(self, store: Store, options: Options | None = None, clock: Callable[[], dt.datetime] | None = None, new_id: Callable[[], str] | None = None):
        self.store, self.options = store, options or Options()
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.new_id = new_id or (lambda: uuid.uuid4().hex)
        self.frames = False

    def execute(self, text: str, variables: dict[str, Any] | None = None, user: auth.User | None = None, mode: str = "commit", name: str | None = None, frames: bool = False) -> tuple[dict[str, Any], list[Problem]]:
        """Data and problems. With any problem nothing is changed.

        With ``frames``, what updateAll and deleteAll return stays a DataFrame of the selected fields, for results that
        the driver can't hold.
        """
        self.frames = frames
        kind, fields = sdl.operation(text, variables, name)
        if kind != "mutation":
            raise QueryError("NOT_SUPPORTED", "this is no mutation")
        tx = Transaction(self.store, user, self.clock, self.new_id)
        data: dict[str, Any] = {}
        problems: list[Problem] = []
        for f in fields:
            if problems:
                data[f.alias] = None
                problems.append(Problem((f.alias,), "ATOMICITY_SKIP", "an earlier mutation failed"))
                continue
            try:
                data[f.alias] = self.field(tx, f, problems)
            except QueryError as e:
                data[f.alias] = None
                problems.append(Problem((f.alias,), e.code, str(e)))
        if problems:
            for f in fields:
                if data.get(f.alias) is not None:
                    data[f.alias] = None
                    problems.append(Problem((f.alias,), "ATOMICITY_SKIP", "a later mutation failed"))
        elif mode == "commit":
            self.store.commit(tx.changed, tx.added)
        return data, problems

    def field(self, tx: Transaction, f: Sel, problems: list[Problem]) -> Any:
        for t in self.store.model.roots():
            one, many = t.name, t.plural
            match f.name:
                case n if n == f"create{one}":
                    return self.first(self.read(tx, t, tx.create(t, [f.args["input"]]), f, problems))
                case n if n == f"create{many}":
                    return self.read(tx, t, tx.create(t, f.args["input"]), f, problems)
                case n if n == f"update{one}":
                    return self.first(self.update(tx, t, [f.args["input"]], f, problems))
                case n if n == f"update{many}":
                    return self.update(tx, t, f.args["input"], f, problems)
                case n if n == f"updateAll{many}":
                    return self.update_all(tx, t, f, problems)
                case n if n == f"delete{one}":
                    given = {k: v for k, v in f.args.items() if v is not None}
                    if len(given) != 1 or next(iter(given)) not in {"id", t.key.name if t.key else "id"}:
                        raise QueryError("BAD_INPUT", "give exactly one id or key")
                    return self.first(self.delete(tx, t, given, f, problems))
                case n if n == f"delete{many}":
                    return self.delete(tx, t, {"id_in": [str(x) for x in f.args["ids"]]}, f, problems)
                case n if n == f"deleteAll{many}":
                    return self.delete(tx, t, f.args.get("filter") or {}, f, problems)
                case n if n == f"confirmBillingFor{one}":
                    from .billing import confirm

                    return confirm(tx, t, f.args)
        raise QueryError("BAD_INPUT", f"no field {f.name}")

    @staticmethod
    def first(rows: list[Any]) -> Any:
        return rows[0] if rows else None

    def read(self, tx: Transaction, t: Type, ids: list[str], f: Sel, problems: list[Problem]) -> list[Any]:
        """Selected fields of written objects, in the order of ``ids``."""
        sel = [*f.children, Sel("id", "__id", {}, [])]
        rows = self.shape(tx, t, Compiler(tx.binding(), tx.user), {"id_in": ids}, sel, problems)
        by = {r.pop("__id"): r for r in rows}
        return [by[i] for i in ids if i in by]

    def shape(self, tx: Transaction, t: Type, c: Compiler, flt: dict[str, Any], sel: list[Sel], problems: list[Problem], args: dict[str, Any] | None = None, frame: bool = False) -> Any:
        s = c.where(c.scan(t), flt)
        orders = c.page(s, {k: v for k, v in (args or {}).items() if k in ("orderBy", "first", "skip", "after")}, False) if args else None
        df = Engine.shaped(self, c, s, sel, orders, ())
        problems += c.problems
        return df.select("out.*") if frame else [to_json(r["out"]) for r in df.collect()]

    def update(self, tx: Transaction, t: Type, inputs: list[dict[str, Any]], f: Sel, problems: list[Problem]) -> list[Any]:
        ids = [str(u["id"]) for u in inputs]
        if len(set(ids)) < len(ids):
            raise QueryError("BAD_INPUT", "an id stands twice in the input")
        rows = tx.table(t)
        if not tx.ids(ids).join(rows.select("id"), "id", "left_anti").isEmpty():
            raise QueryError("NOT_FOUND", f"{t.name} objects to update don't exist")
        given = [(str(u["id"]), u["_revision"]) for u in inputs if u.get("_revision") is not None]
        if given:
            known = rows.select("id", revision(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("now"))
            stale = tx.spark.createDataFrame(given, "id string, was string").join(known, "id").where("was <> now").head()
            if stale is not None:
                raise QueryError("REVISION_MISMATCH", f"{t.name} {stale.id} has changed meanwhile")
        changes = {str(u["id"]): {k: v for k, v in u.items() if k not in ("id", "_revision")} for u in inputs}
        plain = {i: x for i, x in changes.items() if len(inputs) > 1 and tx.simple(t, x)}
        if plain:
            tx.update_simple(t, plain)
        for i, x in changes.items():
            if i not in plain:
                tx.update(t, F.col("id") == i, x, [i])
        return self.read(tx, t, ids, f, problems)

    def ids_of(self, tx: Transaction, t: Type, flt: dict[str, Any], args: dict[str, Any]) -> DataFrame:
        c = Compiler(tx.binding(), tx.user)
        s = c.where(c.scan(t), flt)
        c.page(s, {k: v for k, v in args.items() if k in ("orderBy", "first", "skip", "after")}, False)
        return s.frame.df.select(F.col(s.frame.keys[0]).alias("id"))

    def update_all(self, tx: Transaction, t: Type, f: Sel, problems: list[Problem]) -> list[Any]:
        hit = self.ids_of(tx, t, f.args.get("filter") or {}, f.args).withColumn("_hit", F.lit(True))
        before = tx.table(t)
        tx.put(t.collection, before.join(hit, "id", "left").select(*before.columns, F.coalesce("_hit", F.lit(False)).alias("_hit")))
        tx.update(t, F.col("_hit"), f.args["input"], None)
        marked = tx.changed[t.collection]
        tx.put(t.collection, marked.drop("_hit"))
        b = tx.binding()
        b.bind(t.name, marked.where("_hit").drop("_hit"))
        return self.shape(tx, t, Compiler(b, tx.user), {}, f.children, problems, frame=self.frames)

    def delete(self, tx: Transaction, t: Type, flt: dict[str, Any], f: Sel, problems: list[Problem]) -> list[Any]:
        """The objects as they were; they are read before anything is staged."""
        gone = self.ids_of(tx, t, flt, f.args)
        whole = self.frames and f.name.startswith("deleteAll")
        rows = self.shape(tx, t, Compiler(tx.binding(), tx.user), flt, f.children, problems, f.args, whole)
        tx.delete(t, gone)
        return rows
