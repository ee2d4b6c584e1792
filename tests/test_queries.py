"""Every registered query against its SQL, and operations on small literal tables."""

import duckdb
import pytest

from sparkloom import queries
from sparkloom.api import Engine, Options, api_names
from sparkloom.functions.semantics import BadValue, like_pattern, parse_scalar
from sparkloom.model import Model
from sparkloom.plans.auth import User
from sparkloom.plans.compiler import QueryError
from sparkloom.sources.binding import Binding

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["reference_in_list_all", "root_parent_all"])
def test_every_basket_is_covered(spark, sf, name):
    keys = [r.key for r in queries.QUERIES[name](spark, sf).select("key").collect()]
    assert sorted(keys) == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect())


MODEL = Model.parse("""
type Order @rootEntity(flexSearch: true) {
    key: String @key @flexSearch(includeInSearch: true)  text: String @flexSearchFulltext(includeInSearch: true)
    customer: Customer @relation(inverseOf: "orders")  items: [Item]  total: Float @collect(path: "items.q", aggregate: SUM)
    nation: Nation @reference(keyField: "nationKey")  nationKey: String  meta: Meta  names: I18nString  secret: String @roles(read: ["boss"])
}
type Meta @entityExtension { a: Int  tags: [String] }
type Item @childEntity { q: Float  n: Int  order: Order @root  nation: Nation @reference }
type Customer @rootEntity {
    name: String  orders: [Order] @relation  most: Float @collect(path: "orders.items.q", aggregate: MAX)
    n: Int @collect(path: "orders", aggregate: COUNT)  allItems: [Item] @collect(path: "orders.items")
    noneNull: Boolean @collect(path: "orders.nationKey", aggregate: NONE_NULL)
}
type Nation @rootEntity { code: String @key  label: String }
""")


@pytest.fixture(scope="module")
def engine(spark):
    data = {
        "Order": [
            {"id": "1", "key": "A", "text": "Hello Wörld again", "nationKey": "DE", "meta": {"a": 1, "tags": ["x"]}, "items": [{"id": "i1", "q": 1.5, "n": 2, "nation": "FR"}, {"id": "i2", "q": None, "n": 1}], "names": {"de": "Hallo", "en": "hello"}, "secret": "s"},
            {"id": "2", "key": "B", "nationKey": "XX"},
            {"id": "3", "items": [{"id": "i3", "q": 7.0, "n": 3}]},
        ],
        "Customer": [{"id": "c1", "name": "Ann"}, {"id": "c2", "name": "Bob"}],
        "Nation": [{"id": "n1", "code": "DE", "label": "Germany"}, {"id": "n2", "code": "FR", "label": "France"}],
    }
    return Engine(Binding(spark, MODEL).load(data, {"Customer.orders": [("c1", "1"), ("c1", "3"), ("c1", "gone")]}))


def data(engine, text, **more):
    r = engine.query(text, **more)
    d = r.data()
    assert not r.problems, r.problems
    return d


def test_nested_objects(engine):
    got = data(engine, "{ allOrders(orderBy: key_DESC) { id customer { name } total nation { label } meta { a tags } items(orderBy: n_ASC) { n order { key } } } }")["allOrders"]
    assert got[0] == {"id": "2", "customer": None, "total": 0.0, "nation": None, "meta": {"a": None, "tags": []}, "items": []}
    assert got[1]["items"] == [{"n": 1, "order": {"key": "A"}}, {"n": 2, "order": {"key": "A"}}] and got[1]["nation"] == {"label": "Germany"}
    assert got[2]["total"] == 7.0 and got[2]["customer"] == {"name": "Ann"}


def test_lists_by_relation(engine):
    got = data(engine, "{ allCustomers(orderBy: name_ASC) { most n noneNull orders(first: 1, orderBy: key_DESC) { key items { q nation { code } } } _ordersMeta(filter: {key: null}) { count } allItems(orderBy: q_DESC, skip: 1) { q } } }")["allCustomers"]
    assert got[0] == {"most": 7.0, "n": 2, "noneNull": False, "orders": [{"key": "A", "items": [{"q": 1.5, "nation": {"code": "FR"}}, {"q": None, "nation": None}]}], "_ordersMeta": {"count": 1}, "allItems": [{"q": 1.5}, {"q": None}]}
    assert got[1] == {"most": None, "n": 0, "noneNull": True, "orders": [], "_ordersMeta": {"count": 0}, "allItems": []}


@pytest.mark.parametrize(
    "flt,ids",
    [
        ("{}", "123"),
        ("{key: null}", "3"),
        ("{key_lt: \"B\"}", "13"),
        ("{key_not_in: [\"A\"]}", "23"),
        ("{key_in: null}", "123"),
        ("{key_in: [null, \"B\"]}", "23"),
        ("{OR: []}", ""),
        ("{AND: []}", "123"),
        ("{items_every: {q_gt: 5}}", "23"),
        ("{items_some: {q: null}}", "1"),
        ("{items_none: {q: null}}", "23"),
        ("{items_empty: true}", "2"),
        ("{nation: null}", "23"),
        ("{nation: {}}", "123"),
        ("{nation: {label_like: \"ger%\"}}", "1"),
        ("{customer: {name_starts_with: \"A\"}}", "13"),
        ("{customer: null}", "2"),
        ("{meta: null}", "123"),
        ("{meta: {a_lte: 0}}", "23"),
        ("{meta: {tags_some: {in: [\"x\"]}}}", "1"),
        ("{names_some: {language: \"de\", value_starts_with: \"Ha\"}}", "1"),
        ("{text_not_contains: \"Hello\"}", "23"),
        ("{OR: [{customer: {name: \"Ann\"}}, {key: \"B\"}]}", "123"),
    ],
)
def test_filters(engine, flt, ids):
    got = data(engine, "{ allOrders(filter: %s) { id } }" % flt)["allOrders"]
    assert "".join(sorted(x["id"] for x in got)) == ids


def test_relation_quantifiers_under_or(engine):
    got = data(engine, '{ allCustomers(filter: {OR: [{orders_every: {key: "A"}}, {name: "x"}]}) { name } a: allCustomers(filter: {orders_some: {items_some: {q: 7}}}) { name } }')
    assert got == {"allCustomers": [{"name": "Bob"}], "a": [{"name": "Ann"}]}


def test_cursors_page_through_all(engine):
    seen, after = [], None
    for _ in range(4):
        page = data(engine, "query($a: String) { allOrders(first: 1, orderBy: [key_DESC], after: $a) { id _cursor } }", variables={"a": after})["allOrders"]
        if not page:
            break
        seen.append(page[0]["id"])
        after = page[0]["_cursor"]
    assert seen == ["2", "1", "3"]


@pytest.mark.parametrize("cursor", ["nope", "{}", "[]"])
def test_bad_cursor(engine, cursor):
    assert engine.query("query($a: String) { allOrders(after: $a) { id } }", {"a": cursor}).problems[0].code == "INVALID_CURSOR"


def test_search(engine):
    got = data(engine, '{ a: flexSearchOrders(flexSearchExpression: "worl") { id } b: flexSearchOrders(flexSearchFilter: {text_contains_phrase: "wörld AGAIN"}) { id } c: flexSearchOrders(flexSearchFilter: {text_not_contains_any_word: "hello"}, orderBy: id_ASC) { id } d: _flexSearchOrdersMeta(flexSearchFilter: {key_exists: true}) { count } }')
    assert got == {"a": [{"id": "1"}], "b": [{"id": "1"}], "c": [{"id": "2"}, {"id": "3"}], "d": {"count": 2}}


def test_search_guard(engine):
    tight = Engine(engine.binding, Options(search_limit=1))
    assert tight.query("{ flexSearchOrders(postFilter: {id: 1}) { id } }").problems[0].code == "FLEX_SEARCH_TOO_MANY_OBJECTS"


def test_search_is_whole_without_a_limit(spark, tmp_path):
    lang = "element_at(array('en', 'en', 'de', cast(null AS string)), cast(id % 4 AS int) + 1)"
    spark.range(1, 3002).selectExpr("id AS doc_id", "concat('word ', id) AS text", f"{lang} AS lang", "'s' AS source", "id % 7 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = duckdb.connect()
    docs.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rows = queries.QUERIES["search_post_filter"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(docs.sql(queries.ORACLES["search_post_filter"]).fetchall()) and len(rows) == 3
    shop = queries.engine(spark, str(tmp_path))
    english = 'flexSearchFilter: {lang: "en"}'
    got = data(shop, "{ a: flexSearchDocuments(%s, postFilter: {chars_gt: 0}) { id } b: flexSearchDocuments(%s, orderBy: [chars_DESC, id_ASC]) { id chars } c: _flexSearchDocumentsMeta(%s, postFilter: {chars_gt: 0}) { count } }" % (english, english, english))
    want = [r[0] for r in docs.sql("select doc_id from documents where lang = 'en' and n_chars > 0").fetchall()]
    assert len(want) > 1000 and sorted(int(x["id"]) for x in got["a"]) == sorted(want) and got["c"] == {"count": len(want)}
    assert [(x["chars"], int(x["id"])) for x in got["b"]] == docs.sql("select n_chars, doc_id from documents where lang = 'en' order by 1 desc, doc_id::varchar").fetchall()


def test_field_roles_and_limits(engine):
    r = engine.query("{ allOrders(first: 1, orderBy: key_DESC) { id secret } }", user=User(("x",)))
    assert r.data()["allOrders"] == [{"id": "2", "secret": None}] and r.problems[0].code == "PERMISSION_DENIED"
    few = Engine(engine.binding, Options(implicit_limit=2, max_limit=2))
    r = few.query("{ allOrders { id } }")
    assert len(r.data()["allOrders"]) == 2 and r.problems[0].code == "TOO_MANY_OBJECTS"
    assert few.query("{ allOrders(first: 3) { id } }").problems[0].code == "ARGUMENT_OUT_OF_RANGE"


def test_lookup_and_unknown_names(engine):
    assert data(engine, '{ Order(key: "B") { id } b: Order(id: "nope") { id } }') == {"Order": {"id": "2"}, "b": None}
    assert engine.query("{ Order { id } }").problems and engine.query("{ nope { id } }").problems
    assert engine.query("{ allOrders(filter: {nope: 1}) { id } }").problems[0].code == "BAD_INPUT"


def test_chained_methods(engine):
    rows = engine.type("Customer").filter(name="Ann").select("name n most").collect()
    assert [r.asDict() for r in rows] == [{"name": "Ann", "n": 2, "most": 7.0}]
    with pytest.raises(QueryError):
        engine.type("Customer").select("nope")


def test_metadata(engine):
    frames = engine.schema_frames()
    assert frames["types"].where("kind = 'root'").count() == 3 and frames["relations"].count() == 1
    assert "allOrders" in api_names(MODEL)["query"] and "createOrders" in api_names(MODEL)["mutation"]


def test_scalars():
    assert parse_scalar("LocalTime", "10:20") == "10:20:00" and str(parse_scalar("Decimal2", 1.005)) == "1.01"
    assert parse_scalar("Int53", 2**53 - 1) == 2**53 - 1 and like_pattern("a\\b\\%") == "a\\\\b\\%"
    for kind, v in (("Int", 2**31), ("Int53", 2**53), ("Int", 1.5), ("DateTime", "2020-01-01"), ("DateTime", "2020-01-01T00:00:00+01:00"), ("LocalTime", "24:00"), ("LocalDate", "2020-13-01"), ("Decimal1", 2e9), ("Boolean", 1), ("StringMap", {"a": 1})):
        with pytest.raises(BadValue):
            parse_scalar(kind, v)


def test_stream_filter(spark, engine, tmp_path):
    from sparkloom.streaming import filter_stream

    engine.binding.table(MODEL.types["Order"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = filter_stream(engine, "Order", stream, {"key_not_in": ["A"], "items_some": {"q_gt": 1}}).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("kept").collect()] == ["3"]
