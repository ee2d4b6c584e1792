"""The model: types, fields, relations and collect paths, built from schema text and sidecars, and validated."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from typing import Any

from . import sdl

# The built-in scalars, and those of them that are numbers.
SCALARS = ("ID", "String", "Boolean", "Int", "Int53", "Float", "Decimal1", "Decimal2", "Decimal3", "DateTime", "LocalDate", "LocalTime", "OffsetDateTime", "JSON", "JSONObject", "StringMap", "I18nString")
NUMBERS = ("Int", "Int53", "Float", "Decimal1", "Decimal2", "Decimal3")
ORDERED = (*NUMBERS, "DateTime", "LocalDate", "LocalTime", "OffsetDateTime")
SYSTEM = (("id", "ID"), ("createdAt", "DateTime"), ("updatedAt", "DateTime"))
AGGREGATES = ("COUNT", "SOME", "NONE", "COUNT_NULL", "COUNT_NOT_NULL", "SOME_NULL", "SOME_NOT_NULL", "EVERY_NULL", "NONE_NULL", "MIN", "MAX", "SUM", "AVERAGE", "COUNT_TRUE", "COUNT_NOT_TRUE", "SOME_TRUE", "SOME_NOT_TRUE", "EVERY_TRUE", "NONE_TRUE", "DISTINCT", "COUNT_DISTINCT")
#: Aggregates for which a traversal keeps null items.
NULL_KEEPING = ("COUNT", "SOME", "NONE", "COUNT_NULL", "SOME_NULL", "NONE_NULL", "EVERY_NULL")
KINDS = {"rootEntity": "root", "childEntity": "child", "valueObject": "value", "entityExtension": "extension"}


class ModelProblem(ValueError):
    """A model with errors; ``problems`` has one text for each."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class Step:
    """One segment of a collect path."""

    field: Field
    least: int = 1
    most: int = 1


@dataclass
class Field:
    name: str
    type_name: str
    is_list: bool
    owner: str
    kind: str = "plain"  # plain, relation, reference, collect, root, parent
    inverse_of: str | None = None
    on_delete: str = "REMOVE_EDGES"
    key_field: str | None = None
    path: str | None = None
    aggregate: str | None = None
    is_key: bool = False
    unique: bool = False
    search: bool = False
    fulltext: bool = False
    in_search: bool = False
    case_sensitive: bool = True
    language: str | None = None
    default: Any = None
    has_default: bool = False
    calc: tuple[str, ...] = ()
    roles_read: tuple[str, ...] | None = None
    roles_write: tuple[str, ...] | None = None
    hidden: bool = False
    description: str = ""
    steps: list[Step] = field(default_factory=list)


@dataclass
class Type:
    name: str
    kind: str  # root, child, value, extension, enum, scalar
    fields: dict[str, Field] = field(default_factory=dict)
    values: tuple[str, ...] = ()
    namespace: tuple[str, ...] = ()
    profile: str | None = None
    search: bool = False
    search_order: list[tuple[str, str]] = field(default_factory=list)
    roles_read: tuple[str, ...] | None = None
    roles_write: tuple[str, ...] | None = None
    indices: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)
    business: bool = False
    description: str = ""

    @property
    def is_object(self) -> bool:
        return self.kind in ("root", "child", "value", "extension")

    @property
    def plural(self) -> str:
        return pluralize(self.name)

    @property
    def collection(self) -> str:
        return self.plural[0].lower() + self.plural[1:]

    @property
    def key(self) -> Field | None:
        return next((f for f in self.fields.values() if f.is_key), None)


@dataclass(frozen=True)
class Relation:
    """A set of edges: from ``from_type`` by ``field`` to ``to_type``; ``inverse`` names the field on the other side."""

    name: str
    from_type: str
    field: str
    to_type: str
    inverse: str | None


def pluralize(name: str) -> str:
    if re.search(r"(s|x|z|ch|sh)$", name):
        return name + "es"
    if re.search(r"[^aeiou]y$", name):
        return name[:-1] + "ies"
    return name + "s"


def decapitalize(name: str) -> str:
    return name[0].lower() + name[1:]


class Model:
    def __init__(self, types: dict[str, Type], sidecars: dict[str, Any] | None = None):
        self.types = {s: Type(s, "scalar") for s in SCALARS} | types
        side = sidecars or {}
        self.profiles: dict[str, Any] = side.get("permissionProfiles", {})
        self.time_to_live: list[dict[str, Any]] = side.get("timeToLive", [])
        self.billing: list[dict[str, Any]] = side.get("billing", {}).get("billingEntities", []) if isinstance(side.get("billing"), dict) else side.get("billing", [])
        self.i18n: dict[str, Any] = side.get("i18n", {})
        self.modules: dict[str, Any] = side.get("modules", {})
        problems = self.link()
        if problems:
            raise ModelProblem(problems)

    # ---- building

    @staticmethod
    def parse(*texts: str, sidecars: dict[str, Any] | None = None) -> Model:
        types: dict[str, Type] = {}
        problems: list[str] = []
        for text in texts:
            for t in sdl.parse(text).types:
                if t.name in types or t.name in SCALARS:
                    problems.append(f"{t.name} is defined twice")
                    continue
                types[t.name] = make_type(t, problems)
        if problems:
            raise ModelProblem(problems)
        return Model(types, sidecars)

    def link(self) -> list[str]:
        """Checks references between types and resolves collect paths."""
        bad: list[str] = []
        for t in self.types.values():
            keys = [f.name for f in t.fields.values() if f.is_key]
            if len(keys) > 1:
                bad.append(f"{t.name} has more than one @key field")
            if t.is_object and not [f for f in t.fields.values() if f.name not in dict(SYSTEM)]:
                bad.append(f"{t.name} has no fields")
            if t.profile and t.profile not in self.profiles:
                bad.append(f"{t.name}: no permission profile {t.profile}")
            for f in t.fields.values():
                bad += self.check_field(t, f)
            for names, _ in t.indices:
                bad += [f"{t.name}: index on unknown field {n}" for n in names if n.split(".")[0] not in t.fields]
            bad += [f"{t.name}: search order by unknown field {n}" for n, _ in t.search_order if n.split(".")[0] not in t.fields]
        if not bad:
            for t in self.types.values():
                for f in t.fields.values():
                    if f.kind == "collect":
                        bad += self.resolve(t, f, ())
        for rule in self.time_to_live:
            t = self.types.get(rule.get("typeName", ""))
            if t is None or t.kind != "root":
                bad.append(f"time to live for unknown root entity {rule.get('typeName')}")
        return bad

    def check_field(self, t: Type, f: Field) -> list[str]:
        at = f"{t.name}.{f.name}"
        target = self.types.get(f.type_name)
        if target is None:
            return [f"{at}: unknown type {f.type_name}"]
        bad = []
        if f.kind == "relation":
            if t.kind != "root" or target.kind != "root":
                bad.append(f"{at}: relations join root entities")
            elif f.inverse_of:
                other = target.fields.get(f.inverse_of)
                if other is None or other.kind != "relation" or other.type_name != t.name:
                    bad.append(f"{at}: inverseOf names no relation of {target.name} to {t.name}")
                elif other.inverse_of:
                    bad.append(f"{at}: inverseOf on both sides")
                if f.on_delete != "REMOVE_EDGES":
                    bad.append(f"{at}: onDelete belongs on the forward side")
            elif f.on_delete != "REMOVE_EDGES":
                back = self.inverse(t, f)
                if back is None or back.is_list:
                    bad.append(f"{at}: onDelete needs an inverse field that is no list")
        elif f.kind == "reference":
            if target.kind != "root" or target.key is None:
                bad.append(f"{at}: references need a root entity with a @key field")
            if f.is_list:
                bad.append(f"{at}: lists of references aren't supported")
            if f.key_field and (f.key_field not in t.fields or t.fields[f.key_field].is_list):
                bad.append(f"{at}: unknown key field {f.key_field}")
        elif f.kind in ("root", "parent"):
            if target.kind not in ("root", "child"):
                bad.append(f"{at}: @{f.kind} needs an entity")
            if f.is_list:
                bad.append(f"{at}: @{f.kind} can't be a list")
        elif f.kind == "plain":
            if target.kind == "root":
                bad.append(f"{at}: a root entity needs @relation or @reference")
            if target.kind == "child" and not f.is_list:
                bad.append(f"{at}: child entities stand in lists")
            if target.kind == "extension" and f.is_list:
                bad.append(f"{at}: entity extensions can't stand in lists")
            if target.kind in ("child", "extension") and t.kind == "value":
                bad.append(f"{at}: value objects hold no entities or extensions")
        if f.is_key and (f.is_list or f.type_name not in ("ID", "String", "Int", "Int53")):
            bad.append(f"{at}: keys are ID, String, Int or Int53")
        if f.calc:
            wrong = [c for c in f.calc if c not in (("APPEND", "PREPEND") if f.type_name == "String" else ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "MODULO"))]
            if f.is_list or f.type_name not in (*NUMBERS, "String") or wrong:
                bad.append(f"{at}: calc mutations {', '.join(f.calc)} don't fit {f.type_name}")
        if f.has_default and f.kind != "plain":
            bad.append(f"{at}: only stored fields have default values")
        if f.aggregate and f.aggregate not in AGGREGATES:
            bad.append(f"{at}: unknown aggregate {f.aggregate}")
        return bad

    def resolve(self, t: Type, f: Field, seen: tuple[str, ...]) -> list[str]:
        """Fills f.steps; errors if the path isn't allowed."""
        at = f"{t.name}.{f.name}"
        if f.steps or at in seen:
            return [f"{at}: the path contains itself"] if at in seen else []
        here, steps, embedded, is_list, nullable, ambiguous = t, [], False, False, False, False
        for part in (f.path or "").split("."):
            m = re.fullmatch(r"(\w+)(?:\{(\d+)(?:,(\d+))?\})?", part)
            if not m:
                return [f"{at}: bad path segment {part!r}"]
            g = here.fields.get(m[1]) if here.is_object else None
            if g is None:
                return [f"{at}: {here.name} has no field {m[1]}"]
            if g.kind in ("reference", "root", "parent"):
                return [f"{at}: a path can't run through {g.kind} field {g.name}"]
            least = int(m[2]) if m[2] else 1
            most = int(m[3]) if m[3] else least
            if m[2] and (g.kind != "relation" or g.type_name != here.name):
                return [f"{at}: depths need a relation of {here.name} to itself"]
            if most < 1 or least > most:
                return [f"{at}: bad depths {part}"]
            if g.kind == "relation" and embedded:
                return [f"{at}: relations come before embedded fields"]
            if g.kind == "collect":
                if g.aggregate:
                    return [f"{at}: {g.name} is aggregated"]
                if embedded:
                    return [f"{at}: collect fields come before embedded fields"]
                bad = self.resolve(here, g, (*seen, at))
                if bad:
                    return bad
                steps += g.steps
                embedded |= any(s.field.kind != "relation" for s in g.steps)
            else:
                steps.append(Step(g, least, most))
                embedded |= g.kind == "plain"
                if g.kind == "relation":
                    back = self.inverse(here, g)
                    ambiguous |= (is_list or g.is_list) and (back is None or back.is_list)
                if g.is_list:
                    nullable = False
                elif g.kind == "relation" or (g.kind == "plain" and self.types[g.type_name].kind != "extension"):
                    nullable |= least > 0
            is_list |= g.is_list or most > 1 or g.kind == "collect"
            here = self.types[g.type_name]
        if not is_list:
            return [f"{at}: the path yields no list"]
        if f.aggregate is None:
            if here.kind not in ("root", "child"):
                return [f"{at}: only entities are collected without an aggregate"]
            if nullable:
                return [f"{at}: the path can yield null; aggregate it"]
            if ambiguous:
                return [f"{at}: the path can yield an entity twice; use DISTINCT"]
            if f.type_name != here.name or not f.is_list:
                return [f"{at}: the field's type should be [{here.name}]"]
        else:
            bad = self.check_aggregate(at, f.aggregate, here)
            if bad:
                return bad
        f.steps = steps
        return []

    def check_aggregate(self, at: str, agg: str, item: Type) -> list[str]:
        if agg in ("MIN", "MAX") and item.name not in ORDERED:
            return [f"{at}: {agg} needs numbers, dates or times"]
        if agg in ("SUM", "AVERAGE") and item.name not in NUMBERS:
            return [f"{at}: {agg} needs numbers"]
        if agg.endswith("_TRUE") and item.name != "Boolean":
            return [f"{at}: {agg} needs Boolean"]
        simple = item.kind in ("root", "child", "enum") or item.name in ("String", "ID", "Boolean", "Int", "LocalDate")
        if item.kind == "value":
            simple = all(self.types[x.type_name].kind in ("scalar", "enum") and not x.is_list for x in item.fields.values())
        if agg in ("DISTINCT", "COUNT_DISTINCT") and not simple:
            return [f"{at}: {agg} isn't defined for {item.name}"]
        return []

    # ---- looking up

    def roots(self) -> list[Type]:
        return [t for t in self.types.values() if t.kind == "root"]

    def inverse(self, t: Type, f: Field) -> Field | None:
        """The field on the other side of a relation field."""
        other = self.types[f.type_name]
        if f.inverse_of:
            return other.fields.get(f.inverse_of)
        return next((g for g in other.fields.values() if g.kind == "relation" and g.type_name == t.name and g.inverse_of == f.name), None)

    def relation(self, t: Type, f: Field) -> tuple[Relation, bool]:
        """The relation of a field, and whether the field runs along it (else against it)."""
        back = self.inverse(t, f)
        if f.inverse_of:
            other = self.types[f.type_name]
            return Relation(f"{other.collection}_{f.inverse_of}", other.name, f.inverse_of, t.name, f.name), False
        return Relation(f"{t.collection}_{f.name}", t.name, f.name, f.type_name, back.name if back else None), True

    def relations(self) -> list[Relation]:
        return [self.relation(t, f)[0] for t in self.roots() for f in t.fields.values() if f.kind == "relation" and not f.inverse_of]

    def select_modules(self, wanted: set[str]) -> Model:
        """The model without the types that belong to none of ``wanted``; types named in no module stay."""
        named = {t for m in self.modules.values() for t in m.get("types", [])}
        keep = {t for n in wanted for t in self.modules.get(n, {}).get("types", [])}
        types = {n: t for n, t in self.types.items() if t.kind != "scalar" and (n not in named or n in keep)}
        for t in types.values():
            t.fields = {n: f for n, f in t.fields.items() if f.type_name in types or f.type_name in SCALARS}
        return Model(types, {"permissionProfiles": self.profiles, "timeToLive": [r for r in self.time_to_live if r["typeName"] in types], "i18n": self.i18n})

    def localize(self, language: str, type_name: str, field_name: str | None = None) -> dict[str, str | None]:
        """label and hint of a type or field: from i18n, a language's fallback ``en``, else from the name."""
        for lang in (language, language.split("-")[0], "en"):
            t = self.i18n.get(lang, {}).get("types", {}).get(type_name, {})
            got = t if field_name is None else t.get("fields", {}).get(field_name, {})
            got = {"label": got} if isinstance(got, str) else got
            if got.get("label"):
                return {"label": got["label"], "hint": got.get("hint")}
            if field_name is not None:
                common = self.i18n.get(lang, {}).get("fields", {}).get(field_name)
                if common:
                    return {"label": common if isinstance(common, str) else common.get("label"), "hint": None if isinstance(common, str) else common.get("hint")}
        words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", field_name or type_name)
        return {"label": words[0].upper() + words[1:].lower(), "hint": None}


def make_type(t: sdl.TypeDef, problems: list[str]) -> Type:
    if t.kind == "enum":
        return Type(t.name, "enum", values=tuple(t.values), description=t.description)
    if t.kind == "scalar":
        return Type(t.name, "scalar")
    by = {d.name: {k: sdl.plain(v, {}) for k, v in d.args.items()} for d in t.directives}
    kinds = [k for d, k in KINDS.items() if d in by]
    if len(kinds) != 1:
        problems.append(f"{t.name}: one of {', '.join('@' + k for k in KINDS)} is needed")
        return Type(t.name, "value")
    out = Type(t.name, kinds[0], description=t.description, business="businessObject" in by)
    root = by.get("rootEntity", {})
    out.profile = root.get("permissionProfile")
    out.search = bool(root.get("flexSearch"))
    out.search_order = [(o["field"], o["direction"]) for o in root.get("flexSearchOrder", [])]
    out.namespace = tuple(by.get("namespace", {}).get("name", "").split(".")) if "namespace" in by else ()
    for i in [*root.get("indices", []), *by.get("indices", {}).get("indices", [])]:
        names = i["fields"] if isinstance(i["fields"], list) else [i["fields"]]
        out.indices.append((tuple(names), bool(i.get("unique"))))
    if "roles" in by:
        out.roles_read, out.roles_write = roles(by["roles"])
    if out.kind in ("root", "child"):
        for name, kind in SYSTEM:
            out.fields[name] = Field(name, kind, False, t.name)
    for f in t.fields:
        if f.name in out.fields and f.name not in dict(SYSTEM):
            problems.append(f"{t.name}.{f.name} is defined twice")
        if f.name.startswith("_"):
            problems.append(f"{t.name}.{f.name}: names don't begin with an underscore")
        out.fields[f.name] = make_field(t.name, f, problems)
        if out.fields[f.name].unique:
            out.indices.append(((f.name,), True))
    return out


def roles(args: dict[str, Any]) -> tuple[tuple[str, ...] | None, tuple[str, ...] | None]:
    write = tuple(args.get("readWrite") or ())
    return (*(args.get("read") or ()), *write), write


def make_field(owner: str, f: sdl.FieldDef, problems: list[str]) -> Field:
    by = {d.name: {k: sdl.plain(v, {}) for k, v in d.args.items()} for d in f.directives}
    out = Field(f.name, f.type.name, f.type.is_list, owner, description=f.description)
    kinds = [k for k in ("relation", "reference", "collect", "root", "parent") if k in by]
    if len(kinds) > 1:
        problems.append(f"{owner}.{f.name}: {' and '.join('@' + k for k in kinds)} exclude each other")
    if kinds:
        out.kind = kinds[0]
        args = by[kinds[0]]
        out.inverse_of, out.on_delete = args.get("inverseOf"), args.get("onDelete", "REMOVE_EDGES")
        out.key_field, out.path, out.aggregate = args.get("keyField"), args.get("path"), args.get("aggregate")
        if out.kind == "collect" and not out.path:
            problems.append(f"{owner}.{f.name}: @collect needs a path")
    out.is_key = "key" in by
    out.unique = "unique" in by or out.is_key
    out.hidden = "hidden" in by
    search, full = by.get("flexSearch"), by.get("flexSearchFulltext")
    out.search, out.fulltext = search is not None, full is not None
    out.in_search = bool((search or {}).get("includeInSearch") or (full or {}).get("includeInSearch"))
    out.case_sensitive = (search or {}).get("caseSensitive", True)
    out.language = (full or {}).get("language")
    if "defaultValue" in by:
        out.default, out.has_default = by["defaultValue"].get("value"), True
    out.calc = tuple(by.get("calcMutations", {}).get("operators", ()))
    if "roles" in by:
        out.roles_read, out.roles_write = roles(by["roles"])
    return out


def role_matches(pattern: str, role: str) -> bool:
    """A role literally, with ``*`` as wildcard, or as a regular expression between slashes."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return re.search(pattern[1:-1], role) is not None
    return fnmatch.fnmatchcase(role, re.sub(r"([\[?])", r"[\1]", pattern)) if "*" in pattern else pattern == role
