"""The 21 list aggregates, over embedded arrays (``of_array``) and over grouped rows (``of_rows``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import SPARK_TYPES, safe_list, truth

#: What each aggregate gives for no items; what isn't here gives null.
EMPTY = {"COUNT": 0, "SOME": False, "NONE": True, "COUNT_NULL": 0, "COUNT_NOT_NULL": 0, "SOME_NULL": False, "SOME_NOT_NULL": False, "EVERY_NULL": True, "NONE_NULL": True, "SUM": 0, "COUNT_TRUE": 0, "COUNT_NOT_TRUE": 0, "SOME_TRUE": False, "SOME_NOT_TRUE": False, "EVERY_TRUE": True, "NONE_TRUE": True, "COUNT_DISTINCT": 0}


def round_to(kind: str, c: Column) -> Column:
    """An average has as many digits as its scalar type."""
    return F.round(c, int(kind[-1])) if kind.startswith("Decimal") else c


def sum_type(kind: str) -> str:
    return {"Int": "bigint", "Int53": "bigint", "Float": "double"}.get(kind, f"decimal(30,{kind[-1]})")


def of_array(agg: str, items: Column, kind: str) -> Column:
    """``agg`` of an array column of values (nulls included); a null array is empty."""
    a = safe_list(items)
    null, there = (lambda x: x.isNull()), (lambda x: x.isNotNull())
    true, untrue = (lambda x: truth(x)), (lambda x: ~truth(x))
    count = lambda p: F.size(F.filter(a, p))
    match agg:
        case "COUNT":
            return F.size(a)
        case "SOME":
            return F.size(a) > 0
        case "NONE":
            return F.size(a) == 0
        case "COUNT_NULL":
            return count(null)
        case "COUNT_NOT_NULL":
            return count(there)
        case "SOME_NULL":
            return F.exists(a, null)
        case "SOME_NOT_NULL":
            return F.exists(a, there)
        case "EVERY_NULL":
            return F.forall(a, null)
        case "NONE_NULL":
            return F.forall(a, there)
        case "MIN":
            return F.array_min(a)
        case "MAX":
            return F.array_max(a)
        case "SUM" | "AVERAGE":
            wide = sum_type(kind)
            total = F.aggregate(a, F.lit(0).cast(wide), lambda s, x: (s + F.coalesce(x.cast(wide), F.lit(0).cast(wide))).cast(wide))
            if agg == "SUM":
                return total
            return round_to(kind, F.try_divide(total, count(there)))
        case "COUNT_TRUE":
            return count(true)
        case "COUNT_NOT_TRUE":
            return count(untrue)
        case "SOME_TRUE":
            return F.exists(a, true)
        case "SOME_NOT_TRUE":
            return F.exists(a, untrue)
        case "EVERY_TRUE":
            return F.forall(a, true)
        case "NONE_TRUE":
            return ~F.exists(a, true)
        case "DISTINCT":
            d = F.array_distinct(F.filter(a, there))
            return F.array_sort(d) if kind in SPARK_TYPES or kind == "enum" else d
        case "COUNT_DISTINCT":
            return F.size(F.array_distinct(F.filter(a, there)))
    raise ValueError(agg)


def of_rows(agg: str, x: Column, kind: str) -> Column:
    """``agg`` as an aggregate expression over rows of ``x``; groups without rows need ``or_empty``."""
    t = truth(x)
    match agg:
        case "COUNT":
            return F.count(F.lit(1))
        case "SOME":
            return F.count(F.lit(1)) > 0
        case "NONE":
            return F.count(F.lit(1)) == 0
        case "COUNT_NULL":
            return F.count_if(x.isNull())
        case "COUNT_NOT_NULL":
            return F.count(x)
        case "SOME_NULL":
            return F.bool_or(x.isNull())
        case "SOME_NOT_NULL":
            return F.bool_or(x.isNotNull())
        case "EVERY_NULL":
            return F.bool_and(x.isNull())
        case "NONE_NULL":
            return F.bool_and(x.isNotNull())
        case "MIN":
            return F.min(x)
        case "MAX":
            return F.max(x)
        case "SUM":
            return F.coalesce(F.sum(x.cast(sum_type(kind))), F.lit(0).cast(sum_type(kind)))
        case "AVERAGE":
            return round_to(kind, F.avg(x))
        case "COUNT_TRUE":
            return F.count_if(t)
        case "COUNT_NOT_TRUE":
            return F.count_if(~t)
        case "SOME_TRUE":
            return F.bool_or(t)
        case "SOME_NOT_TRUE":
            return F.bool_or(~t)
        case "EVERY_TRUE":
            return F.bool_and(t)
        case "NONE_TRUE":
            return ~F.bool_or(t)
        case "DISTINCT":
            return F.array_sort(F.collect_set(x))
        case "COUNT_DISTINCT":
            return F.count_distinct(x)
    raise ValueError(agg)


def or_empty(agg: str, c: Column) -> Column:
    if agg == "DISTINCT":
        return safe_list(c)
    return F.coalesce(c, F.lit(EMPTY[agg])) if agg in EMPTY else c
