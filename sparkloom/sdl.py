"""Lexer and parser for the schema language and for operations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

TOKEN = re.compile(r'[\s,﻿]+|#[^\n\r]*|(?P<block>"""(?:\\"""|[\s\S])*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[_A-Za-z]\w*)|(?P<punct>\.\.\.|[!$&()\[\]{}:=@|])')


class SyntaxProblem(ValueError):
    """Text that isn't in the language."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class EnumValue:
    name: str


@dataclass
class TypeRef:
    name: str
    is_list: bool = False
    required: bool = False


@dataclass
class Directive:
    name: str
    args: dict[str, Any]


@dataclass
class FieldDef:
    name: str
    type: TypeRef
    directives: list[Directive]
    description: str = ""
    args: list[FieldDef] = field(default_factory=list)
    default: Any = None


@dataclass
class TypeDef:
    kind: str  # type, enum, scalar, input, interface
    name: str
    directives: list[Directive]
    fields: list[FieldDef] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    description: str = ""


@dataclass
class Selection:
    name: str
    alias: str
    args: dict[str, Any]
    directives: list[Directive]
    children: list[Any] | None = None


@dataclass
class Spread:
    """A fragment: named, or inline with its own selections."""

    name: str | None
    on: str | None
    directives: list[Directive]
    children: list[Any] | None = None


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: dict[str, Any]
    children: list[Any]


@dataclass
class Document:
    types: list[TypeDef] = field(default_factory=list)
    operations: list[Operation] = field(default_factory=list)
    fragments: dict[str, Spread] = field(default_factory=dict)


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r} in line {text.count(chr(10), 0, at) + 1}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    out.append(("end", "", at))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0

    # ---- tokens

    def peek(self, value: str | None = None) -> bool:
        return value is None or self.tokens[self.i][1] == value

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def fail(self, wanted: str) -> SyntaxProblem:
        return SyntaxProblem(f"expected {wanted}, got {self.value!r} in line {self.text.count(chr(10), 0, self.tokens[self.i][2]) + 1}")

    def take(self, value: str) -> bool:
        if self.value == value and self.kind in ("punct", "name"):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(repr(value))

    def name(self) -> str:
        if self.kind != "name":
            raise self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1][1]

    # ---- values

    def parse_value(self) -> Any:
        kind, v = self.kind, self.value
        if kind == "string":
            self.i += 1
            import json

            return json.loads(v)
        if kind == "block":
            self.i += 1
            return block_text(v[3:-3])
        if kind == "num":
            self.i += 1
            return int(v) if re.fullmatch(r"-?\d+", v) else float(v)
        if kind == "name":
            self.i += 1
            return {"true": True, "false": False, "null": None}.get(v, EnumValue(v)) if v in ("true", "false", "null") else EnumValue(v)
        if self.take("$"):
            return Var(self.name())
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.parse_value())
            return out
        if self.take("{"):
            obj = {}
            while not self.take("}"):
                key = self.name()
                self.need(":")
                obj[key] = self.parse_value()
            return obj
        raise self.fail("a value")

    def arguments(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.take("("):
            while not self.take(")"):
                key = self.name()
                self.need(":")
                out[key] = self.parse_value()
        return out

    def directives(self) -> list[Directive]:
        out = []
        while self.take("@"):
            out.append(Directive(self.name(), self.arguments()))
        return out

    def description(self) -> str:
        if self.kind in ("string", "block"):
            return self.parse_value()
        return ""

    # ---- schema

    def type_ref(self) -> TypeRef:
        if self.take("["):
            inner = self.type_ref()
            if inner.is_list:
                raise SyntaxProblem("lists of lists aren't supported")
            self.need("]")
            return TypeRef(inner.name, True, self.take("!"))
        name = self.name()
        return TypeRef(name, False, self.take("!"))

    def field_def(self) -> FieldDef:
        text = self.description()
        name = self.name()
        args = []
        if self.take("("):
            while not self.take(")"):
                args.append(self.field_def())
        self.need(":")
        ref = self.type_ref()
        default = self.parse_value() if self.take("=") else None
        return FieldDef(name, ref, self.directives(), text, args, default)

    def definition(self, doc: Document) -> None:
        text = self.description()
        if self.value == "{":
            doc.operations.append(Operation("query", None, {}, self.selections()))
            return
        word = self.name()
        if word in ("query", "mutation", "subscription"):
            name = self.name() if self.kind == "name" else None
            variables: dict[str, Any] = {}
            if self.take("("):
                while not self.take(")"):
                    self.need("$")
                    var = self.name()
                    self.need(":")
                    self.type_ref()
                    variables[var] = self.parse_value() if self.take("=") else None
            self.directives()
            doc.operations.append(Operation(word, name, variables, self.selections()))
        elif word == "fragment":
            name = self.name()
            self.need("on")
            on = self.name()
            doc.fragments[name] = Spread(name, on, self.directives(), self.selections())
        elif word in ("type", "input", "interface"):
            t = TypeDef(word, self.name(), [], description=text)
            if self.take("implements"):
                while self.kind == "name" or self.value == "&":
                    self.i += 1
            t.directives = self.directives()
            if self.take("{"):
                while not self.take("}"):
                    t.fields.append(self.field_def())
            doc.types.append(t)
        elif word == "enum":
            t = TypeDef("enum", self.name(), self.directives(), description=text)
            self.need("{")
            while not self.take("}"):
                self.description()
                t.values.append(self.name())
                self.directives()
            doc.types.append(t)
        elif word == "scalar":
            doc.types.append(TypeDef("scalar", self.name(), self.directives(), description=text))
        else:
            raise SyntaxProblem(f"unknown definition {word!r}")

    # ---- operations

    def selections(self) -> list[Any]:
        self.need("{")
        out: list[Any] = []
        while not self.take("}"):
            if self.take("..."):
                if self.value == "on" or self.value in ("{", "@"):
                    on = self.name() and self.name() if self.value == "on" else None
                    dirs = self.directives()
                    out.append(Spread(None, on, dirs, self.selections()))
                else:
                    out.append(Spread(self.name(), None, self.directives()))
                continue
            name = self.name()
            alias = name
            if self.take(":"):
                name = self.name()
            args, dirs = self.arguments(), self.directives()
            out.append(Selection(name, alias, args, dirs, self.selections() if self.value == "{" else None))
        return out

    def document(self) -> Document:
        doc = Document()
        while self.kind != "end":
            self.definition(doc)
        return doc


def block_text(raw: str) -> str:
    lines = raw.replace('\\"""', '"""').split("\n")
    indents = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    cut = min(indents, default=0)
    return "\n".join([lines[0], *(x[cut:] for x in lines[1:])]).strip("\n")


def parse(text: str) -> Document:
    return Parser(text).document()


def plain(value: Any, variables: dict[str, Any]) -> Any:
    """A value with variables filled in and enum values as text."""
    if isinstance(value, Var):
        return variables.get(value.name)
    if isinstance(value, EnumValue):
        return value.name
    if isinstance(value, list):
        return [plain(v, variables) for v in value]
    if isinstance(value, dict):
        return {k: plain(v, variables) for k, v in value.items() if not (isinstance(v, Var) and v.name not in variables)}
    return value


@dataclass
class Field:
    """A selected field after fragments, variables and @include/@skip are worked in."""

    name: str
    alias: str
    args: dict[str, Any]
    children: list[Field]


def distil(children: list[Any] | None, doc: Document, variables: dict[str, Any], seen: tuple[str, ...] = ()) -> list[Field]:
    """Selected fields; those of one alias are merged."""
    out: dict[str, Field] = {}
    for c in children or []:
        wanted = True
        for d in c.directives:
            flag = plain(d.args.get("if"), variables)
            wanted &= not (d.name == "include" and not flag) and not (d.name == "skip" and flag)
        if not wanted:
            continue
        if isinstance(c, Spread):
            if c.name is not None:
                if c.name not in doc.fragments:
                    raise SyntaxProblem(f"unknown fragment {c.name}")
                if c.name in seen:
                    raise SyntaxProblem(f"fragment {c.name} contains itself")
            inner = doc.fragments[c.name].children if c.name else c.children
            found = distil(inner, doc, variables, (*seen, c.name) if c.name else seen)
        else:
            found = [Field(c.name, c.alias, plain(c.args, variables), distil(c.children, doc, variables, seen))]
        for f in found:
            if f.alias in out:
                if out[f.alias].name != f.name or out[f.alias].args != f.args:
                    raise SyntaxProblem(f"{f.alias} stands for two different fields")
                merged = {x.alias: x for x in out[f.alias].children}
                for x in f.children:
                    merged.setdefault(x.alias, x)
                out[f.alias].children = [*merged.values()]
            else:
                out[f.alias] = f
    return [*out.values()]


def operation(text: str, variables: dict[str, Any] | None = None, name: str | None = None) -> tuple[str, list[Field]]:
    """Kind and distilled fields of one operation of a document."""
    doc = parse(text)
    ops = [o for o in doc.operations if name is None or o.name == name]
    if len(ops) != 1:
        raise SyntaxProblem("name one operation of the document")
    return ops[0].kind, distil(ops[0].children, doc, {**ops[0].variables, **(variables or {})})
