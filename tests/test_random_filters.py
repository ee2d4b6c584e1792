"""Random filter trees: the compiled predicate against a small interpreter of the same rules."""

import random

from sparkloom.model import Model
from sparkloom.plans.compiler import Compiler
from sparkloom.sources.binding import Binding

MODEL = Model.parse("""
type Row @rootEntity { n: Int  s: String  b: Boolean  tags: [String]  parts: [Part]  meta: Meta  box: Box }
type Part @childEntity { n: Int  s: String }
type Meta @entityExtension { n: Int }
type Box @valueObject { n: Int  s: String }
""")


def less(a, b):
    return b is not None and (a is None or a < b)


def test_value(x, op, v):
    if op == "":
        return x == v
    if op == "in":
        return True if v is None else x in v
    if op in ("lt", "gt"):
        return less(x, v) if op == "lt" else less(v, x)
    if op in ("lte", "gte"):
        return not (less(v, x) if op == "lte" else less(x, v))
    if op == "starts_with":
        return x is not None and x.startswith(v)
    if op == "contains":
        return x is not None and v in x
    return not test_value(x, "" if op == "not" else op[4:], v)


test_value.__test__ = False


def holds(row, flt):
    for k, v in flt.items():
        if k == "AND":
            ok = all(holds(row, x) for x in v)
        elif k == "OR":
            ok = any(holds(row, x) for x in v)
        elif k == "meta":
            ok = v is None or holds(row["meta"] or {}, v)
        elif k == "box":
            ok = row.get("box") is None if v is None else holds(row.get("box") or {}, v)
        elif k.startswith(("tags_", "parts_")):
            name, _, q = k.partition("_")
            items = row.get(name) or []
            if q == "empty":
                ok = (not items) == v
            else:
                item = (lambda x, v=v: holds(x, v)) if name == "parts" else (lambda x, v=v: all(test_value(x, "" if o == "equal" else o, w) for o, w in v.items()))
                ok = {"some": any(map(item, items)), "every": all(map(item, items)), "none": not any(map(item, items))}[q]
        else:
            name, _, op = k.partition("_")
            ok = test_value(row.get(name), op, v)
        if not ok:
            return False
    return True


def value(rng, kind):
    if rng.random() < 0.2:
        return None
    return rng.randint(0, 3) if kind == "n" else rng.choice("abc") + rng.choice(["", "a", "b"])


def leaf(rng, kinds):
    kind = rng.choice(kinds)
    op = rng.choice(["", "not", "lt", "lte", "gt", "gte", "in", "not_in"] + (["starts_with", "not_contains"] if kind == "s" else []))
    v = [value(rng, kind) for _ in range(rng.randint(0, 3))] if op.endswith("in") and not op.endswith("contain") else value(rng, kind)
    if op in ("starts_with", "not_contains"):
        v = rng.choice("abc")
    return {f"{kind}_{op}".rstrip("_"): v}


def tree(rng, depth=2):
    pick = rng.random()
    if depth and pick < 0.35:
        return {rng.choice(["AND", "OR"]): [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]}
    if pick < 0.5:
        return {rng.choice(["meta", "box"]): None if rng.random() < 0.2 else leaf(rng, ["n"])}
    if pick < 0.7:
        return {f"parts_{rng.choice(['some', 'every', 'none'])}": leaf(rng, ["n", "s"])}
    if pick < 0.85:
        return {f"tags_{rng.choice(['some', 'every', 'none'])}": {rng.choice(["equal", "not", "lt", "gte"]): value(rng, "s")}}
    if pick < 0.9:
        return {rng.choice(["tags_empty", "parts_empty"]): rng.random() < 0.5}
    return {**leaf(rng, ["n", "s"]), **leaf(rng, ["n", "s"])}


def test_random_filters(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        parts = None if rng.random() < 0.2 else [{"id": f"{i}.{k}", "n": value(rng, "n"), "s": value(rng, "s")} for k in range(rng.randint(0, 3))]
        tags = None if rng.random() < 0.2 else [value(rng, "s") for _ in range(rng.randint(0, 3))]
        rows.append({"id": str(i), "n": value(rng, "n"), "s": value(rng, "s"), "tags": tags, "parts": parts, "meta": rng.choice([None, {"n": value(rng, "n")}]), "box": rng.choice([None, {"n": value(rng, "n"), "s": value(rng, "s")}])})
    filters = [tree(rng) for _ in range(120)]
    c = Compiler(Binding(spark, MODEL).load({"Row": rows}))
    s = c.scan(MODEL.types["Row"])
    columns = [c.predicate(s, f).alias(f"f{k}") for k, f in enumerate(filters)]
    got = {r["id"]: r for r in s.frame.df.select(s.node.getField("id").alias("id"), *columns).collect()}
    for k, f in enumerate(filters):
        for row in rows:
            assert got[row["id"]][f"f{k}"] is holds(row, f), (f, row)
