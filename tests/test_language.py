import pytest

from sparkloom import sdl
from sparkloom.model import Model, ModelProblem, pluralize, role_matches


def test_operation_with_fragments_variables_and_directives():
    kind, fields = sdl.operation(
        'query Q($n: Int = 3, $no: Boolean!) { a: allXs(first: $n, filter: {t: "x\\u0041", k: KEY}) { ...f id @skip(if: $no) ... on X { y } } } fragment f on X { id z @include(if: $no) }',
        {"no": True},
    )
    assert kind == "query" and fields[0].alias == "a"
    assert fields[0].args == {"first": 3, "filter": {"t": "xA", "k": "KEY"}}
    assert [c.name for c in fields[0].children] == ["id", "z", "y"]


def test_same_alias_merges_or_conflicts():
    _, fields = sdl.operation("{ a { x } a { y } }")
    assert [c.name for c in fields[0].children] == ["x", "y"]
    with pytest.raises(sdl.SyntaxProblem):
        sdl.operation("{ a: b a: c }")
    with pytest.raises(sdl.SyntaxProblem):
        sdl.operation("{ ...f } fragment f on X { ...f }")


@pytest.mark.parametrize("text", ["{ a", "{ a(b:) }", "type X { a: [[Int]] }", "{ a ~ }"])
def test_broken_text(text):
    with pytest.raises(sdl.SyntaxProblem):
        sdl.parse(text)


GOOD = """
type A @rootEntity { key: String @key bs: [B] @relation subs: [A] @relation up: A @relation(inverseOf: "subs") items: [I] %s }
type B @rootEntity { a: A @relation(inverseOf: "bs") x: String v: V }
type I @childEntity { q: Float ok: Boolean notes: [N] }
type N @childEntity { text: String }
type V @valueObject { s: String }
"""


@pytest.mark.parametrize(
    "field",
    ['c: Float @collect(path: "items.q", aggregate: SUM)', 'c: [N] @collect(path: "items.notes")', 'c: [A] @collect(path: "subs{0,2}")', 'c: [I] @collect(path: "subs{1,3}.items")', 'c: Int @collect(path: "bs.v", aggregate: COUNT_NULL)', "c: Int @calcMutations(operators: [ADD])"],
)
def test_good_fields(field):
    Model.parse(GOOD % field)


@pytest.mark.parametrize(
    "field",
    [
        "c: Nope",
        "c: B",
        "c: I",
        'c: [B] @relation(inverseOf: "nope")',
        "c: [B] @reference",
        'c: Float @collect(path: "items.nope", aggregate: SUM)',
        'c: Float @collect(path: "items.ok", aggregate: SUM)',
        'c: Boolean @collect(path: "items.q", aggregate: SOME_TRUE)',
        'c: Float @collect(path: "items.q")',
        'c: [B] @collect(path: "bs{1,2}")',
        'c: [A] @collect(path: "subs{2,1}")',
        'c: A @collect(path: "up")',
        'c: [V] @collect(path: "bs.v")',
        'c: Float @collect(path: "items.q", aggregate: NOPE)',
        "c: String @calcMutations(operators: [ADD])",
        "c: Float @key",
        "_c: Int",
        "key: String",
    ],
)
def test_bad_fields(field):
    with pytest.raises(ModelProblem):
        Model.parse(GOOD % field)


def test_names_and_roles():
    assert [pluralize(x) for x in ("Country", "Box", "Day", "User")] == ["Countries", "Boxes", "Days", "Users"]
    assert role_matches("a*", "abc") and not role_matches("a*", "bac") and role_matches("/^x-(.*)$/", "x-1") and role_matches("a", "a")


def test_modules_and_labels():
    m = Model.parse(GOOD % "", sidecars={"modules": {"m": {"types": ["B", "V"]}}, "i18n": {"de": {"types": {"A": {"label": "Ah", "fields": {"key": "Schluessel"}}}}}})
    small = m.select_modules(set())
    assert "B" not in small.types and "bs" not in small.types["A"].fields
    assert m.localize("de-AT", "A", "key")["label"] == "Schluessel" and m.localize("fr", "A", "someField")["label"] == "Some field"


def test_compatibility_and_text_changes():
    from sparkloom.sources.compat import change_type, problems

    base = Model.parse(GOOD % 'c: Float @collect(path: "items.q", aggregate: SUM)')
    assert problems(base, base) == [] and problems(Model.parse(GOOD % 'd: Int c: Float @collect(path: "items.q", aggregate: SUM)'), base) == []
    found = problems(Model.parse(change_type(GOOD % 'c: Int @collect(path: "items", aggregate: COUNT)', "V", "type V @entityExtension { s: Int }")), base)
    assert len(found) == 4 and any("V is a extension" in p for p in found)
    text = change_type(GOOD % "", "N", "type N @childEntity { text: String more: Int }")
    assert "more" in Model.parse(text).types["N"].fields and "Z" in Model.parse(change_type(text, "Z", "enum Z { A B }")).types
