"""Two-valued comparisons, a total order with null first, and literals of the model's scalar types."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark types of the scalars.
SPARK_TYPES = {
    "ID": "string", "String": "string", "Boolean": "boolean", "Int": "int", "Int53": "bigint", "Float": "double",
    "Decimal1": "decimal(13,1)", "Decimal2": "decimal(13,2)", "Decimal3": "decimal(13,3)", "DateTime": "timestamp",
    "LocalDate": "date", "LocalTime": "string", "OffsetDateTime": "struct<timestamp:timestamp,offset:string>",
    "JSON": "string", "JSONObject": "string", "StringMap": "map<string,string>", "I18nString": "map<string,string>",
}


class BadValue(ValueError):
    """A literal that its scalar type doesn't allow."""


def parse_instant(text: str) -> dt.datetime:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d)?)(\.\d+)?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise BadValue(f"{text!r} is no instant")
    micros = (m[2] or "")[:7]
    try:
        return dt.datetime.fromisoformat(m[1] + micros + ("+00:00" if m[3] == "Z" else m[3])).astimezone(dt.timezone.utc)
    except ValueError as e:
        raise BadValue(f"{text!r} is no instant") from e


def parse_scalar(kind: str, v: Any) -> Any:
    """A Python value of a scalar type; ``BadValue`` if the type doesn't allow it."""
    if v is None:
        return None
    if kind in ("ID", "String"):
        if isinstance(v, bool) or not isinstance(v, str | int):
            raise BadValue(f"{v!r} is no {kind}")
        return str(v)
    if kind == "Boolean":
        if not isinstance(v, bool):
            raise BadValue(f"{v!r} is no Boolean")
        return v
    if kind in ("Int", "Int53"):
        most = 2**31 - 1 if kind == "Int" else 2**53 - 1
        if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or abs(v) > most + (kind == "Int" and v < 0):
            raise BadValue(f"{v!r} is no {kind}")
        return int(v)
    if kind == "Float":
        if isinstance(v, bool) or not isinstance(v, int | float | decimal.Decimal):
            raise BadValue(f"{v!r} is no Float")
        return float(v)
    if kind.startswith("Decimal"):
        if isinstance(v, bool) or not isinstance(v, int | float | decimal.Decimal) or abs(v) > 1e9:
            raise BadValue(f"{v!r} is no {kind}")
        return decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-int(kind[-1])), rounding=decimal.ROUND_HALF_UP)
    if kind == "DateTime":
        if isinstance(v, dt.datetime):
            return v
        out = parse_instant(str(v))
        if not str(v).endswith(("Z", "+00:00")):
            raise BadValue(f"{v!r} isn't in UTC")
        return out
    if kind == "LocalDate":
        try:
            return v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v))
        except ValueError as e:
            raise BadValue(f"{v!r} is no date") from e
    if kind == "LocalTime":
        m = re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(\.\d{1,9})?)?", str(v))
        if not m:
            raise BadValue(f"{v!r} is no time")
        return f"{m[1]}:{m[2]}:{m[3] or '00'}" + ((m[4] or "").rstrip("0").rstrip("."))
    if kind == "OffsetDateTime":
        if isinstance(v, dict):
            return v
        at, m = parse_instant(str(v)), re.search(r"(Z|[+-]\d\d:\d\d)$", str(v))
        return {"timestamp": at, "offset": "+00:00" if m[1] == "Z" else m[1]}
    if kind == "JSONObject" and not isinstance(v, dict):
        raise BadValue("a JSONObject is an object")
    if kind in ("JSON", "JSONObject"):
        return json.dumps(v, separators=(",", ":"))
    if kind in ("StringMap", "I18nString"):
        if not isinstance(v, dict) or not all(x is None or isinstance(x, str) for x in v.values()):
            raise BadValue(f"{v!r} is no map of strings")
        return dict(v)
    return v


def literal(kind: str, v: Any) -> Column:
    """Column of one value; an OffsetDateTime stands for its instant."""
    if kind == "OffsetDateTime":
        v, kind = (parse_instant(v) if isinstance(v, str) else v), "DateTime"
    v = parse_scalar(kind, v)
    return F.lit(v).cast(SPARK_TYPES.get(kind, "string"))


def whole_number(text: str) -> int | None:
    """The number that a text is the usual form of, if 64 bits hold it."""
    n = int(text) if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def comparable(kind: str, c: Column) -> Column:
    """What filters, sorting and aggregates look at."""
    return c.getField("timestamp") if kind == "OffsetDateTime" else c


def truth(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def less(a: Column, b: Column) -> Column:
    return b.isNotNull() & (a.isNull() | truth(a < b))


def less_equal(a: Column, b: Column) -> Column:
    return a.isNull() | truth(a <= b)


def greater(a: Column, b: Column) -> Column:
    return a.isNotNull() & (b.isNull() | truth(a > b))


def greater_equal(a: Column, b: Column) -> Column:
    return b.isNull() | truth(a >= b)


def among(a: Column, kind: str, values: list[Any]) -> Column:
    there = [v for v in values if v is not None]
    hit = a.isNotNull() & a.isin([literal(kind, v) for v in there]) if there else F.lit(False)
    return hit | a.isNull() if len(there) < len(values) else hit


def like_pattern(p: str) -> str:
    """The pattern with every backslash that escapes nothing doubled, for ``ilike``."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m.group() if m[1] else r"\\", p, flags=re.S)


def like(a: Column, pattern: str) -> Column:
    return truth(F.ilike(a, F.lit(like_pattern(pattern))))


def round_half_up(a: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(a + 0.5)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def append(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def safe_list(a: Column) -> Column:
    """A null list is an empty one."""
    return F.coalesce(a, F.array())


def subtract_lists(a: Column, b: Column) -> Column:
    """Items of a that b doesn't hold; repeated ones stay."""
    return F.filter(safe_list(a), lambda x: ~truth(F.exists(safe_list(b), lambda y: x.eqNullSafe(y))))


def concat_lists(*lists: Column) -> Column:
    return F.concat(*[safe_list(x) for x in lists])


def merge_structs(names: list[str], parts: list[tuple[Column, list[str]]]) -> Column:
    """One object of several; of a repeated name the last value counts."""
    last = {n: part.getField(n) for part, own in parts for n in own}
    return F.struct(*[last[n].alias(n) for n in names])


def map_entries(m: Column) -> Column:
    return F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))


def json_text(a: Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(a, {"ignoreNullFields": "false"})


def is_kind(a: Column, data_type: str, kind: str) -> Column:
    """Whether a value is a SCALAR, LIST, OBJECT or NULL; but for null the column's type tells."""
    shape = "LIST" if data_type.startswith("array") else "OBJECT" if data_type.startswith(("struct", "map")) else "SCALAR"
    return a.isNull() if kind == "NULL" else a.isNotNull() & F.lit(shape == kind)


def dynamic(m: Column, key: Column) -> Column:
    """A property of a map by a computed name; null where there is none."""
    return F.try_element_at(m, key)


FILTERS = {
    "lt": less, "lte": less_equal, "gt": greater, "gte": greater_equal,
}
STRING_FILTERS = ("contains", "starts_with", "ends_with", "like")


def test(a: Column, kind: str, op: str, v: Any) -> Column:
    """One filter operator of a scalar; ``op`` is empty for equality. Never null."""
    a = comparable(kind, a)
    if op in ("", "equal"):
        return equal(a, literal(kind, v))
    if op == "in":
        return F.lit(True) if v is None else among(a, kind, v)
    if op in FILTERS:
        b = literal(kind, v)
        if v is None:
            return FILTERS[op](a, b)
        # never null either, and in a form that reaches the scan
        return {"lt": lambda: a.isNull() | (a < b), "lte": lambda: a.isNull() | (a <= b), "gt": lambda: a.isNotNull() & (a > b), "gte": lambda: a.isNotNull() & (a >= b)}[op]()
    if op in STRING_FILTERS:
        if v is None:
            return F.lit(True)
        if op == "like":
            return like(a, v)
        return a.isNotNull() & {"contains": a.contains, "starts_with": a.startswith, "ends_with": a.endswith}[op](F.lit(v))
    if op == "not":
        return ~test(a, plain_kind(kind), "", v)
    if op.startswith("not_"):
        return F.lit(True) if v is None else ~test(a, plain_kind(kind), op[4:], v)
    raise BadValue(f"no filter {op}")


def plain_kind(kind: str) -> str:
    return "DateTime" if kind == "OffsetDateTime" else kind


# Filter operators by kind of field.
STRING_OPS = ("", "not", "in", "not_in", "lt", "lte", "gt", "gte", "contains", "not_contains", "starts_with", "not_starts_with", "ends_with", "not_ends_with", "like", "not_like")
NUMBER_OPS = ("", "not", "in", "not_in", "lt", "lte", "gt", "gte")
OPS = {"String": STRING_OPS, "Boolean": ("", "not"), "enum": ("", "not", "in", "not_in"), "JSON": (), "JSONObject": ()}


def operators(kind: str, is_enum: bool) -> tuple[str, ...]:
    return OPS["enum"] if is_enum else OPS.get(kind, NUMBER_OPS)
