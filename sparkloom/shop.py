"""The sample tables as a model: a shop's orders, documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine, Options
from .model import Model
from .sources.binding import Binding, derived_edges

SCHEMA = """
enum OrderState { F O P }
type Region @rootEntity { key: Int @key  name: String }
type Nation @rootEntity { key: Int @key  name: String  regionKey: Int  region: Region @reference(keyField: "regionKey") }
type Customer @rootEntity(permissionProfile: "segments") {
    key: Int53 @key  name: String  segment: String  balance: Float @calcMutations(operators: [ADD, MULTIPLY])  nationKey: Int
    nation: Nation @reference(keyField: "nationKey")
    oddNationKey: Int  oddNation: Nation @reference(keyField: "oddNationKey")
    richBalance: Float
    orders: [Order] @relation(onDelete: CASCADE)
    baskets: [Basket] @relation
    referrals: [Customer] @relation
    referrer: Customer @relation(inverseOf: "referrals")
    deepReferrals: [Customer] @collect(path: "referrals{1,2}")
    family: Int @collect(path: "referrals{0,2}", aggregate: COUNT)
    grandReferrals: Int @collect(path: "referrals{2}", aggregate: COUNT)
    lineCount: Int @collect(path: "baskets.items", aggregate: COUNT)
    quantitySum: Float @collect(path: "baskets.items.quantity", aggregate: SUM)
    quantityMax: Float @collect(path: "baskets.items.quantity", aggregate: MAX)
    quantityMin: Float @collect(path: "baskets.items.quantity", aggregate: MIN)
    quantityAvg: Float @collect(path: "baskets.items.quantity", aggregate: AVERAGE)
    flags: [String] @collect(path: "baskets.items.returnFlag", aggregate: DISTINCT)
    flagCount: Int @collect(path: "baskets.items.returnFlag", aggregate: COUNT_DISTINCT)
    smallNull: Int @collect(path: "baskets.items.small", aggregate: COUNT_NULL)
    smallNotNull: Int @collect(path: "baskets.items.small", aggregate: COUNT_NOT_NULL)
    someSmallNull: Boolean @collect(path: "baskets.items.small", aggregate: SOME_NULL)
    everySmallNull: Boolean @collect(path: "baskets.items.small", aggregate: EVERY_NULL)
    cheapTrue: Int @collect(path: "baskets.items.cheap", aggregate: COUNT_TRUE)
    everyCheap: Boolean @collect(path: "baskets.items.cheap", aggregate: EVERY_TRUE)
    anyLine: Boolean @collect(path: "baskets.items", aggregate: SOME)
    noLine: Boolean @collect(path: "baskets.items", aggregate: NONE)
    someSmall: Boolean @collect(path: "baskets.items.small", aggregate: SOME_NOT_NULL)
    noneSmallNull: Boolean @collect(path: "baskets.items.small", aggregate: NONE_NULL)
    dearTrue: Int @collect(path: "baskets.items.cheap", aggregate: COUNT_NOT_TRUE)
    someCheap: Boolean @collect(path: "baskets.items.cheap", aggregate: SOME_TRUE)
    someDear: Boolean @collect(path: "baskets.items.cheap", aggregate: SOME_NOT_TRUE)
    noneCheap: Boolean @collect(path: "baskets.items.cheap", aggregate: NONE_TRUE)
    poorOrders: Int @collect(path: "orders.customer.richBalance", aggregate: COUNT_NULL)
    allLines: [Line] @collect(path: "baskets.items")
}
type Supplier @rootEntity { key: Int53 @key  name: String  balance: Float  nationKey: Int  nation: Nation @reference(keyField: "nationKey") }
type Part @rootEntity {
    key: Int53 @key  name: String @calcMutations(operators: [APPEND, PREPEND])  brand: String  kind: String
    size: Int @calcMutations(operators: [SUBTRACT, MODULO])  price: Float @calcMutations(operators: [SUBTRACT, DIVIDE])
    names: I18nString  spec: PartSpec  amount: Decimal2
}
type PartSpec @entityExtension { brand: String  size: Int }
type Order @rootEntity {
    key: Int53 @key  status: String  totalPrice: Float  date: DateTime  priority: String  urgentDate: DateTime
    day: LocalDate  clock: LocalTime  placed: OffsetDateTime  urgent: Boolean  state: OrderState  marks: StringMap
    customer: Customer @relation(inverseOf: "orders")
    suppliers: [Supplier] @relation
}
type Basket @rootEntity {
    key: Int53 @key  status: String
    items: [Line]
    customer: Customer @relation(inverseOf: "baskets")
    n: Int @collect(path: "items", aggregate: COUNT)
    any: Boolean @collect(path: "items", aggregate: SOME)
    none: Boolean @collect(path: "items", aggregate: NONE)
    nNull: Int @collect(path: "items.small", aggregate: COUNT_NULL)
    nNotNull: Int @collect(path: "items.small", aggregate: COUNT_NOT_NULL)
    someNull: Boolean @collect(path: "items.small", aggregate: SOME_NULL)
    someNotNull: Boolean @collect(path: "items.small", aggregate: SOME_NOT_NULL)
    everyNull: Boolean @collect(path: "items.small", aggregate: EVERY_NULL)
    noneNull: Boolean @collect(path: "items.small", aggregate: NONE_NULL)
    least: Float @collect(path: "items.quantity", aggregate: MIN)
    most: Float @collect(path: "items.quantity", aggregate: MAX)
    total: Float @collect(path: "items.quantity", aggregate: SUM)
    average: Float @collect(path: "items.quantity", aggregate: AVERAGE)
    nCheap: Int @collect(path: "items.cheap", aggregate: COUNT_TRUE)
    nDear: Int @collect(path: "items.cheap", aggregate: COUNT_NOT_TRUE)
    someCheap: Boolean @collect(path: "items.cheap", aggregate: SOME_TRUE)
    someDear: Boolean @collect(path: "items.cheap", aggregate: SOME_NOT_TRUE)
    everyCheap: Boolean @collect(path: "items.cheap", aggregate: EVERY_TRUE)
    noneCheap: Boolean @collect(path: "items.cheap", aggregate: NONE_TRUE)
    flags: [String] @collect(path: "items.returnFlag", aggregate: DISTINCT)
    nFlags: Int @collect(path: "items.returnFlag", aggregate: COUNT_DISTINCT)
}
type Line @childEntity {
    number: Int  quantity: Float  returnFlag: String  lineStatus: String  small: Float  cheap: Boolean  partKey: Int53
    part: Part @reference(keyField: "partKey")
    basket: Basket @root  up: Basket @parent
}
type Document @rootEntity(flexSearch: true) {
    text: String @flexSearchFulltext(includeInSearch: true)  lang: String @flexSearch(includeInSearch: true)
    source: String @flexSearch(caseSensitive: false)  chars: Int53 @flexSearch
    label: Label @relation
}
type Label @rootEntity { quality: Int  toxic: Int  document: Document @relation(inverseOf: "label") }
type Conversation @rootEntity { turns: [Turn]  turnCount: Int @collect(path: "turns", aggregate: COUNT) }
type Turn @childEntity { number: Int53  role: String  text: String }
type Event @rootEntity(permissionProfile: "events") { at: DateTime  userId: Int53  accessGroup: String  value: Float  props: JSON }
type Vector @rootEntity { label: Int  values: [Float] }
"""

SIDECARS = {
    "permissionProfiles": {
        "segments": {
            "permissions": [
                {"roles": ["admin"], "access": "readWrite"},
                {"roles": ["/^segment-(.*)$/"], "access": "read", "restrictions": [{"field": "segment", "valueTemplate": "$1"}]},
                {"roles": ["claimed"], "access": "read", "restrictions": [{"field": "segment", "claim": "segments"}]},
            ]
        },
        "events": {"permissions": [{"roles": ["admin"], "access": "readWrite"}, {"roles": ["/^group-(.*)$/"], "access": "read", "restrictToAccessGroups": ["$1"]}]},
    },
    "timeToLive": [{"typeName": "Event", "dateField": "at", "expireAfterDays": 10}],
}

MODEL = Model.parse(SCHEMA, sidecars=SIDECARS)


def engine(spark: SparkSession, sf_dir: str, options: Options | None = None) -> Engine:
    """The sample tables of a folder, bound to the model. Nothing is read until a query asks for it."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def keyed(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("id", F.col(key))

    def customers() -> DataFrame:
        c = F.col
        return keyed(read("customer"), "c_custkey").select("id", c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"), c("c_acctbal").alias("balance"), c("c_nationkey").alias("nationKey"), F.when(c("c_nationkey") % 2 == 1, c("c_nationkey")).otherwise(c("c_nationkey") + 100).alias("oddNationKey"), F.when(c("c_acctbal") >= 0, c("c_acctbal")).alias("richBalance"))

    def lines() -> DataFrame:
        c = F.col
        line = F.struct(c("l_linenumber").alias("number"), c("l_quantity").alias("quantity"), c("l_returnflag").alias("returnFlag"), c("l_linestatus").alias("lineStatus"), F.when(c("l_quantity") < 10, c("l_quantity")).alias("small"), (c("l_quantity") < 25).alias("cheap"), c("l_partkey").alias("partKey"))
        return read("lineitem").groupBy(c("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(line)).alias("items"))

    def full_line(x):
        null = F.lit(None)
        return F.struct(null.cast("string").alias("id"), null.cast("timestamp").alias("createdAt"), null.cast("timestamp").alias("updatedAt"), *[x.getField(n).alias(n) for n in ("number", "quantity", "returnFlag", "lineStatus", "small", "cheap", "partKey")])

    def baskets() -> DataFrame:
        o = read("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
        return keyed(o.join(lines(), "key", "left").withColumn("items", F.transform("items", full_line)), "key")

    def orders() -> DataFrame:
        c = F.col
        return keyed(read("orders"), "o_orderkey").select("id", c("o_orderkey").alias("key"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("totalPrice"), c("o_orderdate").cast("timestamp").alias("date"), c("o_orderpriority").alias("priority"), F.when(c("o_orderpriority").startswith("1"), c("o_orderdate").cast("timestamp")).alias("urgentDate"), c("o_orderdate").cast("date").alias("day"), F.concat(F.lpad((c("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30:00")).alias("clock"), F.struct(c("o_orderdate").cast("timestamp").alias("timestamp"), F.lit("+02:00").alias("offset")).alias("placed"), F.when(c("o_orderstatus") != "P", c("o_orderpriority").startswith("1")).alias("urgent"), c("o_orderstatus").alias("state"), F.create_map(F.lit("status"), c("o_orderstatus"), F.lit("priority"), c("o_orderpriority")).alias("marks"))

    def conversations() -> DataFrame:
        null = F.lit(None)
        turn = F.struct(F.col("turn").alias("number"), "role", "text")
        df = read("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        return df.withColumn("turns", F.transform("turns", lambda x: F.struct(null.cast("string").alias("id"), null.cast("timestamp").alias("createdAt"), null.cast("timestamp").alias("updatedAt"), x.getField("number").alias("number"), x.getField("role").alias("role"), x.getField("text").alias("text"))))

    c = F.col
    b = Binding(spark, MODEL)
    b.bind("Region", lambda: keyed(read("region"), "r_regionkey").select("id", c("r_regionkey").alias("key"), c("r_name").alias("name")))
    b.bind("Nation", lambda: keyed(read("nation"), "n_nationkey").select("id", c("n_nationkey").alias("key"), c("n_name").alias("name"), c("n_regionkey").alias("regionKey")))
    b.bind("Customer", customers).bind("Order", orders).bind("Basket", baskets).bind("Conversation", conversations)
    b.bind("Supplier", lambda: keyed(read("supplier"), "s_suppkey").select("id", c("s_suppkey").alias("key"), c("s_name").alias("name"), c("s_acctbal").alias("balance"), c("s_nationkey").alias("nationKey")))
    b.bind("Part", lambda: keyed(read("part"), "p_partkey").select("id", c("p_partkey").alias("key"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_type").alias("kind"), c("p_size").alias("size"), c("p_retailprice").alias("price"), F.create_map(F.lit("en"), c("p_name"), F.lit("de"), c("p_type")).alias("names"), F.struct(c("p_brand").alias("brand"), c("p_size").alias("size")).alias("spec"), c("p_retailprice").cast("decimal(13,2)").alias("amount")))
    b.bind("Document", lambda: keyed(read("documents"), "doc_id").select("id", "text", "lang", "source", c("n_chars").alias("chars")))
    b.bind("Label", lambda: keyed(read("labels"), "doc_id").select("id", "quality", "toxic"))
    b.bind("Event", lambda: keyed(read("events"), "event_id").select("id", c("ts").cast("timestamp").alias("at"), c("user_id").alias("userId"), c("event_type").alias("accessGroup"), "value", "props"))
    b.bind("Vector", lambda: keyed(read("embeddings"), "vec_id").select("id", "label", c("embedding").cast("array<double>").alias("values")))
    by_customer = lambda: derived_edges(read("orders"), c("o_custkey"), c("o_orderkey"), True)
    b.bind_edges("Customer.orders", by_customer, one_to=True).bind_edges("Customer.baskets", by_customer, one_to=True)
    b.bind_edges("Customer.referrals", lambda: derived_edges(read("customer").where("c_custkey > 0"), F.floor(c("c_custkey") / 3), c("c_custkey"), True), one_to=True)
    b.bind_edges("Order.suppliers", lambda: derived_edges(read("lineitem"), c("l_orderkey"), c("l_suppkey")))
    b.bind_edges("Document.label", lambda: derived_edges(read("labels"), c("doc_id"), c("doc_id")), one_from=True, one_to=True)
    return Engine(b, options)
