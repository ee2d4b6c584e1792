"""The model itself as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Model


def schema_frames(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """types, fields, relations, indices and permissions of the model."""
    own = [t for t in model.types.values() if t.kind != "scalar"]
    types = [(t.name, t.kind, t.plural, ".".join(t.namespace), t.business, t.search, t.description) for t in own]
    fields = [(t.name, f.name, f.type_name, f.is_list, f.kind, f.is_key, f.path, f.aggregate, f.hidden, f.description) for t in own for f in t.fields.values()]
    relations = [(r.name, r.from_type, r.field, r.to_type, r.inverse) for r in model.relations()]
    indices = [(t.name, ",".join(n), u) for t in own for n, u in t.indices]
    grants = [(name, ",".join(p.get("roles", [])), p.get("access"), bool(p.get("restrictToAccessGroups") or p.get("restrictions"))) for name, prof in model.profiles.items() for p in prof.get("permissions", [])]
    make = spark.createDataFrame
    return {
        "types": make(types, "name string, kind string, plural string, namespace string, business boolean, search boolean, description string"),
        "fields": make(fields, "type string, name string, field_type string, is_list boolean, kind string, is_key boolean, path string, aggregate string, hidden boolean, description string"),
        "relations": make(relations, "name string, from_type string, from_field string, to_type string, to_field string"),
        "indices": make(indices, "type string, fields string, is_unique boolean"),
        "permissions": make(grants, "profile string, roles string, access string, restricted boolean"),
    }
