"""Permissions: what a user may do with a type or a field, and the condition under which."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.semantics import truth
from ..model import Field, Model, Type, role_matches

#: Access kinds that a permission's ``access`` gives.
GIVES = {"read": ("read",), "readWrite": ("read", "create", "update", "delete"), "create": ("create",), "update": ("update",), "delete": ("delete",)}


@dataclass
class User:
    roles: tuple[str, ...] = ()
    claims: dict[str, Any] = field(default_factory=dict)


@dataclass
class Grant:
    """``always``, never, or where one of ``conditions`` holds: lists of (field, allowed values), all of which must."""

    always: bool = False
    conditions: list[list[tuple[str, list[Any]]]] = field(default_factory=list)

    @property
    def never(self) -> bool:
        return not self.always and not self.conditions

    def column(self, node: Column) -> Column:
        out = F.lit(self.always)
        for condition in self.conditions:
            all_ = F.lit(True)
            for name, values in condition:
                at = node
                for part in name.split("."):
                    at = at.getField(part)
                all_ = all_ & (truth(at.isin([F.lit(v) for v in values])) if values else F.lit(False))
            out = out | all_
        return out

    def allows(self, doc: dict[str, Any]) -> bool:
        def get(name: str) -> Any:
            at: Any = doc
            for part in name.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            return at

        return self.always or any(all(get(n) in v for n, v in c) for c in self.conditions)


FULL = Grant(True)


def filled(template: str, pattern: str, user: User) -> list[str]:
    """The template for each role that matches, with $1, $2 ... from groups of a regular expression."""
    out = []
    for role in user.roles:
        if not role_matches(pattern, role):
            continue
        groups: tuple = ()
        if pattern.startswith("/") and (m := re.search(pattern[1:-1], role)):
            groups = m.groups()
        out.append(re.sub(r"\$(\d)", lambda m, g=groups: g[int(m[1]) - 1] or "" if int(m[1]) <= len(g) else "", template))
    return list(dict.fromkeys(out))


def claim(user: User, name: str) -> list[Any]:
    at: Any = user.claims
    for part in name.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return [] if at is None else list(at) if isinstance(at, list | tuple) else [at]


def grant(model: Model, t: Type, user: User | None, access: str) -> Grant:
    """What the user may do with rows of a type. Without a user all is allowed."""
    if user is None:
        return FULL
    allowed = t.roles_read if access == "read" else t.roles_write
    if allowed is not None:
        return Grant(any(role_matches(p, r) for p in allowed for r in user.roles))
    name = t.profile or ("default" if "default" in model.profiles else None)
    if name is None:
        return FULL
    out = Grant()
    for p in model.profiles[name].get("permissions", []):
        matching = [x for x in p.get("roles", []) if any(role_matches(x, r) for r in user.roles)]
        if not matching or access not in GIVES[p["access"]]:
            continue
        condition: list[tuple[str, list[Any]]] = []
        if groups := p.get("restrictToAccessGroups"):
            condition.append(("accessGroup", [g for tmpl in groups for role in matching for g in filled(tmpl, role, user)]))
        for r in p.get("restrictions", []):
            if "value" in r:
                condition.append((r["field"], [r["value"]]))
            elif "valueTemplate" in r:
                condition.append((r["field"], [v for role in matching for v in filled(r["valueTemplate"], role, user)]))
            else:
                condition.append((r["field"], claim(user, r["claim"])))
        if not condition:
            return FULL
        out.conditions.append(condition)
    return out


def field_allowed(f: Field, user: User | None, access: str) -> bool:
    roles = f.roles_read if access == "read" else f.roles_write
    return user is None or roles is None or any(role_matches(p, r) for p in roles for r in user.roles)
