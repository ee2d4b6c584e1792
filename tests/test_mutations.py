import datetime as dt
import itertools

import pytest

from sparkloom.api import Engine
from sparkloom.model import Model
from sparkloom.operators import ttl
from sparkloom.operators.mutations import Mutator
from sparkloom.operators.store import Store
from sparkloom.plans.auth import User

MODEL = Model.parse(
    """
type Main @rootEntity(permissionProfile: "groups") {
    key: String @key  accessGroup: String  n: Int @calcMutations(operators: [ADD, MULTIPLY])  text: String @calcMutations(operators: [APPEND])
    size: Int @defaultValue(value: 7)  tags: [String]  meta: Meta  parts: [Part]  day: LocalDate
    subs: [Sub] @relation(onDelete: CASCADE)  blocks: [Block] @relation(onDelete: RESTRICT)  friend: Friend @relation
}
type Meta @entityExtension { a: Int  b: Int }
type Part @childEntity { name: String  n: Int @calcMutations(operators: [ADD]) }
type Sub @rootEntity { name: String  main: Main @relation(inverseOf: "subs")  leaves: [Leaf] @relation(onDelete: CASCADE) }
type Leaf @rootEntity { name: String  sub: Sub @relation(inverseOf: "leaves") }
type Block @rootEntity { name: String  main: Main @relation(inverseOf: "blocks") }
type Friend @rootEntity { name: String  main: Main @relation(inverseOf: "friend") }
""",
    sidecars={
        "permissionProfiles": {"groups": {"permissions": [{"roles": ["boss"], "access": "readWrite"}, {"roles": ["/^g-(.*)$/"], "access": "readWrite", "restrictToAccessGroups": ["$1"]}]}},
        "timeToLive": [{"typeName": "Main", "dateField": "day", "expireAfterDays": 10}],
        "billing": {"billingEntities": [{"typeName": "Main", "keyFieldName": "key"}]},
    },
)
NOW = dt.datetime(2024, 1, 31, 12, tzinfo=dt.timezone.utc)


@pytest.fixture
def world(spark, tmp_path):
    store = Store(spark, MODEL, f"file://{tmp_path}/store")
    ids = itertools.count(1)
    m = Mutator(store, clock=lambda: NOW, new_id=lambda: f"i{next(ids)}")
    return store, m, Engine(store.binding())


def ok(m, text, **more):
    data, problems = m.execute(text, **more)
    assert not problems, problems
    return data


def test_create_update_and_children(world):
    store, m, e = world
    got = ok(m, 'mutation { createMain(input: {key: "a", n: 2, meta: {a: 1, b: 2}, parts: [{name: "p", n: 1}, {name: "q", n: 5}], createSubs: [{name: "s"}]}) { id size subs { name } parts { id } createdAt } }')["createMain"]
    assert got["size"] == 7 and got["subs"] == [{"name": "s"}] and got["createdAt"] == "2024-01-31T12:00:00Z"
    one, p, q = got["id"], *[x["id"] for x in got["parts"]]
    got = ok(
        m,
        "mutation($i: UpdateMainInput!) { updateMain(input: $i) { n text meta { a b } parts { name n } tags } }",
        variables={"i": {"id": one, "addTo_n": 5, "appendTo_text": "x", "meta": {"b": 9}, "addParts": [{"name": "r"}], "removeParts": [p], "updateParts": [{"id": q, "addTo_n": 10}, {"id": "unknown", "n": 1}], "tags": None}},
    )["updateMain"]
    assert got == {"n": 7, "text": "x", "meta": {"a": 1, "b": 9}, "parts": [{"name": "q", "n": 15}, {"name": "r", "n": None}], "tags": []}
    assert e.query("{ allMains { n } }").data() == {"allMains": [{"n": 7}]}


def test_failures_change_nothing(world):
    store, m, e = world
    ok(m, 'mutation { createMain(input: {key: "a"}) { id } }')
    before = store.version()
    for text, code in (
        ('mutation { x: createMain(input: {key: "b"}) { id } y: createMain(input: {key: "a"}) { id } }', "UNIQUE_CONSTRAINT_VIOLATION"),
        ('mutation { updateMain(input: {id: "nope", n: 1}) { id } }', "NOT_FOUND"),
        ('mutation { createMain(input: {key: "c", friend: "nope"}) { id } }', "NOT_FOUND"),
        ('mutation { createMain(input: {nope: 1}) { id } }', "BAD_INPUT"),
        ('mutation { createMain(input: {n: "x"}) { id } }', "BAD_INPUT"),
        ('mutation { updateMains(input: [{id: "i1", n: 1}, {id: "i1", n: 2}]) { id } }', "BAD_INPUT"),
        ('mutation { updateMain(input: {id: "i1", n: 1, addTo_n: 2}) { id } }', "BAD_INPUT"),
    ):
        _, problems = m.execute(text)
        assert code in [p.code for p in problems], (text, problems)
    assert store.version() == before and e.query("{ _allMainsMeta { count } }").data()["_allMainsMeta"]["count"] == 1
    data, problems = m.execute('mutation { createMain(input: {key: "z"}) { key } }', mode="rollback")
    assert data == {"createMain": {"key": "z"}} and not problems and store.version() == before


def test_edges(world):
    _, m, e = world
    ok(m, 'mutation { f: createFriend(input: {name: "f"}) { id } a: createMain(input: {key: "a", friend: "i1"}) { id } b: createMain(input: {key: "b", friend: "i1"}) { id } s: createSub(input: {name: "s", main: "i2"}) { id } }')
    q = "{ allMains(orderBy: key_ASC) { friend { name } subs { name } } }"
    assert e.query(q).data()["allMains"] == [{"friend": None, "subs": [{"name": "s"}]}, {"friend": {"name": "f"}, "subs": []}]
    ok(m, 'mutation { updateMain(input: {id: "i3", addSubs: ["i4"], friend: null}) { id } }')
    assert e.query(q).data()["allMains"] == [{"friend": None, "subs": []}, {"friend": None, "subs": [{"name": "s"}]}]
    ok(m, 'mutation { updateMain(input: {id: "i3", removeSubs: ["i4"]}) { id } }')
    assert e.query("{ allSubs { main { key } } }").data()["allSubs"] == [{"main": None}]


def test_delete_actions(world):
    _, m, e = world
    ok(m, 'mutation { a: createMain(input: {key: "a", createSubs: [{name: "s", createLeaves: [{name: "l"}]}], createFriend: {name: "f"}}) { id } b: createMain(input: {key: "b", createBlocks: [{name: "x"}]}) { id } }')
    _, problems = m.execute('mutation { deleteMain(key: "b") { key } }')
    assert problems[0].code == "RELATION_CONSTRAINT_VIOLATION"
    assert ok(m, 'mutation { deleteMain(key: "a") { key subs { name } } }')["deleteMain"] == {"key": "a", "subs": [{"name": "s"}]}
    got = e.query("{ allSubs { id } allLeaves: allLeafs { id } allFriends { main { key } } allMains { key } }").data()
    assert got == {"allSubs": [], "allLeaves": [], "allFriends": [{"main": None}], "allMains": [{"key": "b"}]}
    ok(m, "mutation { deleteAllBlocks { id } }")
    assert ok(m, 'mutation { deleteMains(ids: ["nope"]) { id } deleteAllMains(filter: {key: "b"}) { key } }') == {"deleteMains": [], "deleteAllMains": [{"key": "b"}]}


def test_update_all_and_access(world):
    _, m, e = world
    ok(m, 'mutation { createMains(input: [{key: "a", accessGroup: "x", n: 1}, {key: "b", accessGroup: "y", n: 2}, {key: "c", accessGroup: "x", n: 3}]) { id } }')
    got = ok(m, 'mutation { updateAllMains(filter: {n_gt: 1}, orderBy: n_DESC, first: 1, input: {multiplyWith_n: 10}) { key n } }')
    assert got["updateAllMains"] == [{"key": "c", "n": 30}]
    user = User(("g-x",))
    assert len(e.query("{ allMains { key } }", user=user).data()["allMains"]) == 2
    for text in ('mutation { createMain(input: {key: "d", accessGroup: "y"}) { id } }', 'mutation { updateMain(input: {id: "i2", n: 0}) { id } }', 'mutation { updateMain(input: {id: "i1", accessGroup: "y"}) { id } }'):
        _, problems = m.execute(text, user=user)
        assert problems and problems[0].code == "PERMISSION_DENIED", text
    assert e.query("{ allMains { key } }", user=User(("other",))).problems[0].code == "PERMISSION_DENIED"


def test_time_to_live_and_billing(world):
    store, m, e = world
    ok(m, 'mutation { createMains(input: [{key: "old", day: "2024-01-01"}, {key: "late", day: "2024-01-19"}, {key: "new", day: "2024-01-30"}, {key: "none"}]) { id } }')
    assert [tuple(r) for r in ttl.info(store.binding(), NOW).collect()] == [("Main", 2, 1)]
    assert ttl.cleanup(m, 1) == {"Main": 1} and ttl.cleanup(m) == {"Main": 1}
    assert sorted(x["key"] for x in e.query("{ allMains { key } }").data()["allMains"]) == ["new", "none"]
    assert ok(m, 'mutation { confirmBillingForMain(key: "new") }') == {"confirmBillingForMain": True}
    ok(m, 'mutation { confirmBillingForMain(key: "new") }')
    from sparkloom.operators.billing import SCHEMA
    from pyspark.sql import types as T

    rows = store.read("_billing", T._parse_datatype_string(SCHEMA)).collect()
    assert len(rows) == 1 and rows[0].isConfirmedForExport
    assert m.execute('mutation { confirmBillingForMain(key: "nope") }')[1][0].code == "NOT_FOUND"


def test_schema_sync(world):
    store, *_ = world
    assert "mains" in store.sync_schema() and store.sync_schema() == []
