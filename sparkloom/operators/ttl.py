"""Time to live: which objects have expired, and their removal."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import comparable
from ..model import Model
from ..sources.binding import Binding
from .mutations import Mutator, Transaction


def expired(model: Model, rule: dict[str, Any], now: dt.datetime, late_days: int = 0) -> Column:
    """True where the rule's date lies more than its days back. A date without a time ends in the westernmost zone."""
    t = model.types[rule["typeName"]]
    at, kind = None, ""
    here = t
    for part in rule["dateField"].split("."):
        f = here.fields[part]
        at = F.col(part) if at is None else at.getField(part)
        here, kind = model.types[f.type_name], f.type_name
    days = rule["expireAfterDays"] + late_days
    limit = now - dt.timedelta(days=days)
    if kind == "LocalDate":
        limit = (limit - dt.timedelta(hours=12)).date()
    value = comparable(kind, at)
    return value.isNotNull() & (value < F.lit(limit))


def info(binding: Binding, now: dt.datetime, overdue_days: int = 3) -> DataFrame:
    """For each rule: how many objects have expired, and how many of them should be long gone."""
    out = None
    for rule in binding.model.time_to_live:
        df = binding.table(binding.model.types[rule["typeName"]])
        n = df.agg(F.lit(rule["typeName"]).alias("type_name"), F.count_if(expired(binding.model, rule, now)).alias("expired"), F.count_if(expired(binding.model, rule, now, overdue_days)).alias("overdue"))
        out = n if out is None else out.unionByName(n)
    return out if out is not None else binding.spark.createDataFrame([], "type_name string, expired long, overdue long")


def cleanup(mutator: Mutator, limit: int | None = None) -> dict[str, int]:
    """Deletes expired objects of every rule, ``limit`` of each at most, with their delete actions."""
    done: dict[str, int] = {}
    for rule in mutator.store.model.time_to_live:
        tx = Transaction(mutator.store, None, mutator.clock, mutator.new_id)
        t = mutator.store.model.types[rule["typeName"]]
        gone = tx.table(t).where(expired(mutator.store.model, rule, tx.now)).orderBy("id").select("id")
        gone = gone if limit is None else gone.limit(limit)
        n = gone.count()
        if n:
            tx.delete(t, gone)
            mutator.store.commit(tx.changed, tx.added)
        done[t.name] = n
    return done
