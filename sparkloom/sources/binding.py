"""Bindings of root entities to DataFrames and of relations to edge DataFrames; loading of model files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import SPARK_TYPES, BadValue, parse_scalar
from ..model import Field, Model, Relation, Type

UNROLL = 4  # value objects may hold themselves; so deep their columns go


def load_model(folder: str) -> Model:
    """A model from the ``.graphqls``, ``.json`` and ``.yaml`` files of a folder tree."""
    texts, side = [], {}
    for p in sorted(Path(folder).rglob("*")):
        if p.suffix in (".graphqls", ".graphql"):
            texts.append(p.read_text())
        elif p.suffix in (".json", ".yaml", ".yml"):
            if p.suffix == ".json":
                data = json.loads(p.read_text())
            else:
                import yaml

                data = yaml.safe_load(p.read_text())
            for k, v in (data or {}).items():
                side[k] = {**side[k], **v} if isinstance(side.get(k), dict) else side.get(k, []) + v if isinstance(v, list) else v
    return Model.parse(*texts, sidecars=side)


def stored_fields(model: Model, t: Type) -> list[tuple[str, str, Field]]:
    """Column name, type name and field of what a document of the type holds."""
    out = []
    for f in t.fields.values():
        if f.kind == "plain":
            out.append((f.name, f.type_name, f))
        elif f.kind == "reference" and not f.key_field:
            out.append((f.name, model.types[f.type_name].key.type_name, f))
    return out


def spark_type(model: Model, name: str, is_list: bool, depth: dict[str, int] | None = None) -> T.DataType | None:
    """Spark type of a field; None where a value object holds itself too deep."""
    t, depth = model.types[name], depth or {}
    if t.kind == "scalar":
        out = T._parse_datatype_string(SPARK_TYPES[name]) if not name.startswith("Decimal") else T.DecimalType(13, int(name[-1]))
    elif t.kind == "enum":
        out = T.StringType()
    else:
        if depth.get(name, 0) >= UNROLL:
            return None
        inner = depth | {name: depth.get(name, 0) + 1}
        fields = [T.StructField(c, k) for c, n, f in stored_fields(model, t) if (k := spark_type(model, n, f.is_list, inner)) is not None]
        out = T.StructType(fields)
    return T.ArrayType(out) if is_list else out


def table_type(model: Model, t: Type) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, n, f in stored_fields(model, t) if (k := spark_type(model, n, f.is_list, {t.name: 1} if t.kind == "value" else {})) is not None])


def to_row(model: Model, t: Type, doc: dict[str, Any] | None, within: dict[str, int] | None = None) -> dict[str, Any] | None:
    """A JSON document as a row of the type: scalars parsed, missing fields null.

    A value object that holds itself has columns for UNROLL levels; what goes deeper is refused.
    """
    if doc is None:
        return None
    within = within or {}
    if t.kind != "root":
        if within.get(t.name, 0) >= UNROLL:
            raise BadValue(f"{t.name} holds itself more than {UNROLL} levels deep")
        within = within | {t.name: within.get(t.name, 0) + 1}

    def one(name: str, v: Any) -> Any:
        kind = model.types[name]
        return to_row(model, kind, v, within) if kind.is_object else parse_scalar(name, v) if kind.kind == "scalar" else v

    out = {}
    for c, n, f in stored_fields(model, t):
        v = doc.get(c)
        out[c] = None if v is None else [one(n, x) for x in (v if isinstance(v, list) else [v])] if f.is_list else one(n, v)
    return out


def fitted(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """The column in the wanted type; fields that nested objects lack are null there."""
    if have == want:
        return col
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        cols = [(fitted(col.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*cols))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        if bare(have.elementType) == bare(want.elementType):
            return col
        return F.transform(col, lambda x: fitted(x, have.elementType, want.elementType))
    return col.cast(want)


def bare(kind: T.DataType) -> str:
    """A type without what it says of nulls."""
    return kind.simpleString()


def conform(df: DataFrame, model: Model, t: Type) -> DataFrame:
    """Columns of the type alone, missing ones (also within objects and lists) as null, of the model's types.

    Whole numbers as ids of root entities stay numbers, so that lookups and joins by id reach the scan and shuffle no
    texts; they become texts where they are given out.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in table_type(model, t).fields:
        if field.name not in have:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "id" and t.kind == "root" and isinstance(have["id"], T.IntegralType):
            cols.append(F.col("id") if isinstance(have["id"], T.LongType) else F.col("id").cast("bigint").alias("id"))
        elif bare(have[field.name]) == bare(field.dataType):
            cols.append(F.col(f"`{field.name}`"))
        else:
            cols.append(fitted(F.col(f"`{field.name}`"), have[field.name], field.dataType).alias(field.name))
    return df.select(*cols)


class Binding:
    """Tables and edges of a model. Edges have _from and _to; a relation without edges has none."""

    def __init__(self, spark: SparkSession, model: Model):
        self.spark, self.model = spark, model
        self.tables: dict[str, Callable[[], DataFrame]] = {}
        self.edge_sets: dict[str, Callable[[], DataFrame]] = {}
        self.one: dict[str, tuple[bool, bool]] = {}
        self.id_types: dict[str, str] = {}

    def id_type(self, name: str) -> str:
        """Type of a root entity's ids in its table: string or bigint."""
        if name not in self.id_types:
            self.id_types[name] = bare(self.table(self.model.types[name]).schema["id"].dataType)
        return self.id_types[name]

    def bind(self, type_name: str, df: DataFrame | Callable[[], DataFrame]) -> Binding:
        self.tables[type_name] = df if callable(df) else lambda: df
        self.id_types.pop(type_name, None)
        return self

    def bind_edges(self, type_and_field: str, df: DataFrame | Callable[[], DataFrame], one_from: bool = False, one_to: bool = False) -> Binding:
        """``one_from``: each _from stands in one edge at most, as each _to with ``one_to``; that saves an aggregation."""
        self.one[type_and_field] = (one_from, one_to)
        self.edge_sets[type_and_field] = df if callable(df) else lambda: df
        return self

    def table(self, t: Type) -> DataFrame:
        if t.name not in self.tables:
            return self.spark.createDataFrame([], table_type(self.model, t))
        return conform(self.tables[t.name](), self.model, t)

    def edges(self, r: Relation) -> DataFrame:
        """_from and _to in the types of the ids on either side; what is no id there leads nowhere."""
        make = self.edge_sets.get(f"{r.from_type}.{r.field}")
        kinds = {"_from": self.id_type(r.from_type), "_to": self.id_type(r.to_type)}
        if make is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in kinds.items()))
        e = make()
        return e.select(*[F.col(c) if bare(e.schema[c].dataType) == k else F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])

    def single(self, r: Relation, forward: bool) -> bool:
        """Whether the edges, followed in this direction, are known to lead to one object at most."""
        return self.one.get(f"{r.from_type}.{r.field}", (False, False))[0 if forward else 1]

    def load(self, data: dict[str, list[dict[str, Any]]], edges: dict[str, list[tuple[str, str]]] | None = None) -> Binding:
        """Small literal tables, for tests and for fixtures."""
        for name, docs in data.items():
            t = self.model.types[name]
            rows = [to_row(self.model, t, d) for d in docs]
            self.bind(name, self.spark.createDataFrame(rows, table_type(self.model, t)))
        for name, pairs in (edges or {}).items():
            self.bind_edges(name, self.spark.createDataFrame(pairs or [], "_from string, _to string"))
        return self


def derived_edges(df: DataFrame, source: Column, target: Column, unique: bool = False) -> DataFrame:
    """Edges from a foreign key: pairs where both ends are there, each once (``unique``: as they stand)."""
    e = df.select(source.alias("_from"), target.alias("_to")).where("_from is not null and _to is not null")
    return e if unique else e.distinct()
