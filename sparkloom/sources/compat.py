"""Compatibility: whether a model offers all that a baseline model promises."""

from __future__ import annotations

from ..model import Field, Model, Type


def problems(model: Model, baseline: Model) -> list[str]:
    """What the baseline has and the model lacks or has differently; more than the baseline is always fine."""
    out: list[str] = []
    for want in baseline.types.values():
        if want.kind == "scalar":
            continue
        have = model.types.get(want.name)
        if have is None:
            out.append(f"type {want.name} is missing")
        elif have.kind != want.kind:
            out.append(f"type {want.name} is a {have.kind}, not a {want.kind}")
        elif want.kind == "enum":
            out += [f"enum {want.name} lacks {v}" for v in want.values if v not in have.values]
        else:
            out += type_problems(have, want)
            for f in want.fields.values():
                got = have.fields.get(f.name)
                out += [f"field {want.name}.{f.name} is missing"] if got is None else field_problems(want.name, got, f)
    return out


def type_problems(have: Type, want: Type) -> list[str]:
    out = []
    if want.search and not have.search:
        out.append(f"type {want.name} should be searchable")
    if want.search_order and have.search_order != want.search_order:
        out.append(f"type {want.name} should have the search order {want.search_order}")
    if want.business and not have.business:
        out.append(f"type {want.name} should be a business object")
    return out


def field_problems(owner: str, have: Field, want: Field) -> list[str]:
    at, out = f"field {owner}.{want.name}", []
    text = lambda f: f"[{f.type_name}]" if f.is_list else f.type_name
    if text(have) != text(want):
        out.append(f"{at} has type {text(have)}, not {text(want)}")
    if have.kind != want.kind:
        out.append(f"{at} is {have.kind}, not {want.kind}")
    for name, label in (("inverse_of", "inverseOf"), ("on_delete", "onDelete"), ("key_field", "keyField"), ("path", "path"), ("aggregate", "aggregate"), ("default", "default value")):
        if getattr(have, name) != getattr(want, name):
            out.append(f"{at} should have {label} {getattr(want, name)}")
    for name, label in (("is_key", "the key"), ("search", "searchable"), ("fulltext", "searchable by words"), ("in_search", "included in search")):
        if getattr(want, name) and not getattr(have, name):
            out.append(f"{at} should be {label}")
    if missing := [c for c in want.calc if c not in have.calc]:
        out.append(f"{at} lacks calc mutations {', '.join(missing)}")
    if want.roles_read is not None and set(have.roles_read or ()) != set(want.roles_read):
        out.append(f"{at} should be readable by {', '.join(want.roles_read)}")
    return out


def change_type(text: str, type_name: str, new: str | None) -> str:
    """Schema text with one type's definition replaced, or removed if ``new`` is None; appended if it isn't there."""
    import re

    from .. import sdl

    tokens = sdl.lex(text)
    for i, (_, value, at) in enumerate(tokens[:-2]):
        if value in ("type", "enum", "input", "interface") and tokens[i + 1][1] == type_name and (i == 0 or tokens[i - 1][1] not in (":", "{", "(")):
            depth, j = 0, i
            while True:
                j += 1
                depth += {"{": 1, "}": -1}.get(tokens[j][1], 0)
                if tokens[j][1] == "}" and depth == 0:
                    break
            start = tokens[i - 1][2] if i and tokens[i - 1][0] in ("string", "block") else at
            return re.sub(r"\n{3,}", "\n\n", text[:start] + (new or "") + text[tokens[j][2] + 1 :])
    return text if new is None else text.rstrip() + "\n\n" + new + "\n"
