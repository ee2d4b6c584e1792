"""Billing entities: a log by key and type, written at most once after it is confirmed."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from ..model import Type
from ..plans.compiler import QueryError

if TYPE_CHECKING:
    from .mutations import Transaction

SCHEMA = "key string, type string, isConfirmedForExport boolean, isExported boolean, confirmedForExportAt timestamp, exportedAt timestamp, category string, quantity long"


def table(tx: Transaction):
    from pyspark.sql import types as T

    got = tx.changed.get("_billing")
    return tx.store.read("_billing", T._parse_datatype_string(SCHEMA)) if got is None else got


def upsert(tx: Transaction, key: str, type_name: str, confirmed: bool = False, category: str | None = None, quantity: int | None = 1) -> None:
    """Adds the entity (key, type) if it isn't there; confirming an entity that is confirmed changes nothing."""
    df = table(tx)
    mine = (F.col("key") == key) & (F.col("type") == type_name)
    if df.where(mine).isEmpty():
        row = [(key, type_name, confirmed, False, tx.now if confirmed else None, None, category, quantity)]
        tx.changed["_billing"] = df.unionByName(tx.spark.createDataFrame(row, df.schema))
    elif confirmed:
        fresh = mine & ~F.col("isConfirmedForExport")
        tx.changed["_billing"] = df.withColumns({"confirmedForExportAt": F.when(fresh, F.lit(tx.now)).otherwise(F.col("confirmedForExportAt")), "isConfirmedForExport": F.col("isConfirmedForExport") | fresh})


def confirm(tx: Transaction, t: Type, args: dict[str, Any]) -> bool:
    """Confirms the billing entity of one object, named by id or key."""
    rule = next((b for b in tx.model.billing if b["typeName"] == t.name), None)
    if rule is None:
        raise QueryError("NOT_SUPPORTED", f"{t.name} has no billing")
    name = next((k for k, v in args.items() if v is not None), None)
    if name not in ("id", t.key.name if t.key else "id"):
        raise QueryError("BAD_INPUT", "give an id or a key")
    field = rule.get("keyFieldName") or (t.key.name if t.key else "id")
    row = tx.table(t).where(F.col(name) == args[name]).select(F.col(field).cast("string").alias("k")).head()
    if row is None:
        raise QueryError("NOT_FOUND", f"no such {t.name}")
    if not row.k:
        raise QueryError("BILLING_KEY_FIELD_NOT_FILLED", f"{field} is empty")
    upsert(tx, row.k, t.name, True, rule.get("category"))
    return True
