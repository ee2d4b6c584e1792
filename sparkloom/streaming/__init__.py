"""Filters and time-to-live rules over streams: the predicates of the model, unchanged, on a streaming DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Engine
from ..plans.compiler import Compiler, Frame, QueryError, Scope
from ..sources.binding import conform


def filter_stream(engine: Engine, type_name: str, stream: DataFrame, flt: dict[str, Any]) -> DataFrame:
    """Rows of a stream that a filter lets through. Filters on other tables become stream-static joins."""
    t = engine.model.types[type_name]
    df = conform(stream, engine.model, t)
    s = Scope(Frame(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("node")), []), F.col("node"), t)
    c = Compiler(engine.binding)
    p = c.predicate(s, flt)
    if c.problems:
        raise QueryError(c.problems[0].code, c.problems[0].message)
    return s.frame.df.where(p).select("node.*")
