"""Queries over the sample tables: an operation, how its result is flattened, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.auth import User
from .shop import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def ask(name: str, text: str, flat: list[str], sql: str | None, user: User | None = None) -> None:
    """Registers an operation; ``flat`` are SQL expressions over its selected fields."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = engine(spark, sf_dir).query(text, user=user)
        if result.problems:
            raise ValueError(result.problems[0].message)
        return next(iter(result.parts.values())).rows().selectExpr(*flat)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def orders_where(name: str, flt: str, sql: str) -> None:
    ask(name, "{ allOrders(filter: {%s}) { key status } }" % flt, ["key", "status"], f"SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE {sql}")


def customers_where(name: str, flt: str, sql: str) -> None:
    ask(name, "{ allCustomers(filter: {%s}) { key name } }" % flt, ["key", "name"], f"SELECT c_custkey AS key, c_name AS name FROM customer c WHERE {sql}")


# ---- scans and lookups
ask("scan_project", "{ allParts { key brand size } }", ["key", "brand", "size"], "SELECT p_partkey AS key, p_brand AS brand, p_size AS size FROM part")
ask("lookup_id", '{ Customer(id: "7") { key name } }', ["key", "name"], "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey = 7")
ask("lookup_key", "{ Order(key: 33) { key status priority } }", ["key", "status", "priority"], "SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey = 33")
ask("edge_scan", "{ allOrders { key suppliers { key } } }", ["key", "size(suppliers) AS n"], "SELECT o_orderkey AS key, CAST(count(DISTINCT l_suppkey) AS INT) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

# ---- filters
NUM, TEXT, WHEN = "o_totalprice", "o_orderpriority", "o_orderdate"
orders_where("filter_eq_num", "key: 40", "o_orderkey = 40")
orders_where("filter_not_num", "key_not: 40", "o_orderkey <> 40")
orders_where("filter_lt_num", "totalPrice_lt: 50000", f"{NUM} < 50000")
orders_where("filter_lte_num", "key_lte: 100", "o_orderkey <= 100")
orders_where("filter_gt_num", "totalPrice_gt: 150000.5", f"{NUM} > 150000.5")
orders_where("filter_gte_num", "key_gte: 900", "o_orderkey >= 900")
orders_where("filter_in_num", "key_in: [1, 5, 9]", "o_orderkey IN (1, 5, 9)")
orders_where("filter_not_in_num", "key_not_in: [1, 5, 9]", "o_orderkey NOT IN (1, 5, 9)")
orders_where("filter_eq_str", 'priority: "2-HIGH"', f"{TEXT} = '2-HIGH'")
orders_where("filter_not_str", 'priority_not: "2-HIGH"', f"{TEXT} <> '2-HIGH'")
orders_where("filter_lt_str", 'priority_lt: "3"', f"{TEXT} < '3'")
orders_where("filter_gte_str", 'priority_gte: "3"', f"{TEXT} >= '3'")
orders_where("filter_in_str", 'status_in: ["F", "P"]', "o_orderstatus IN ('F', 'P')")
orders_where("filter_not_in_str", 'status_not_in: ["F", "P"]', "o_orderstatus NOT IN ('F', 'P')")
orders_where("filter_lt_date", 'date_lt: "1996-01-01T00:00:00Z"', f"{WHEN} < TIMESTAMP '1996-01-01'")
orders_where("filter_gte_date", 'date_gte: "1997-06-01T00:00:00Z"', f"{WHEN} >= TIMESTAMP '1997-06-01'")
orders_where("filter_null_lt_date", 'urgentDate_lt: "1996-01-01T00:00:00Z"', f"NOT starts_with({TEXT}, '1') OR {WHEN} < TIMESTAMP '1996-01-01'")
orders_where("filter_null_eq", "urgentDate: null", f"NOT starts_with({TEXT}, '1')")
orders_where("filter_null_gt", "urgentDate_gt: null", f"starts_with({TEXT}, '1')")
customers_where("filter_null_lte", "richBalance_lte: 100", "c_acctbal < 0 OR c_acctbal <= 100")
customers_where("filter_null_not_in", "richBalance_not_in: [1.5]", "c_acctbal < 0 OR c_acctbal <> 1.5")
customers_where("filter_null_in", "richBalance_in: [null, 1.5]", "c_acctbal < 0 OR c_acctbal = 1.5")
customers_where("filter_contains", 'segment_contains: "IL"', "contains(c_mktsegment, 'IL')")
customers_where("filter_not_contains", 'segment_not_contains: "IL"', "NOT contains(c_mktsegment, 'IL')")
customers_where("filter_starts_with", 'segment_starts_with: "MA"', "starts_with(c_mktsegment, 'MA')")
customers_where("filter_not_starts_with", 'segment_not_starts_with: "MA"', "NOT starts_with(c_mktsegment, 'MA')")
customers_where("filter_ends_with", 'name_ends_with: "7"', "ends_with(c_name, '7')")
customers_where("filter_not_ends_with", 'name_not_ends_with: "7"', "NOT ends_with(c_name, '7')")
customers_where("filter_like", 'segment_like: "%buil_ing"', "c_mktsegment ILIKE '%buil_ing'")
customers_where("filter_not_like", 'segment_not_like: "m%"', "c_mktsegment NOT ILIKE 'm%'")
customers_where("filter_and_or", 'OR: [{segment: "BUILDING", balance_gt: 0}, {AND: [{key_lt: 20}, {key_gte: 10}]}]', "(c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (c_custkey < 20 AND c_custkey >= 10)")
customers_where("filter_empty_or", "OR: []", "false")
customers_where("filter_to1_reference", "nation: {name_lt: \"G\", region: {key_gt: 0}}", "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name < 'G' AND n_regionkey > 0)")
orders_where("filter_to1", 'customer: {segment: "MACHINERY"}', "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")

orders_where("filter_lte_str", 'priority_lte: "3-MEDIUM"', f"{TEXT} <= '3-MEDIUM'")
orders_where("filter_gt_str", 'priority_gt: "3-MEDIUM"', f"{TEXT} > '3-MEDIUM'")
orders_where("filter_boolean", "urgent: true", f"o_orderstatus <> 'P' AND starts_with({TEXT}, '1')")
orders_where("filter_boolean_not", "urgent_not: true", f"o_orderstatus = 'P' OR NOT starts_with({TEXT}, '1')")
orders_where("filter_enum", "state_in: [F, P]", "o_orderstatus IN ('F', 'P')")
orders_where("filter_enum_not", "state_not: O", "o_orderstatus <> 'O'")
orders_where("filter_local_date", 'day_gte: "1996-01-01", day_lt: "1997-01-01"', f"CAST({WHEN} AS DATE) >= DATE '1996-01-01' AND CAST({WHEN} AS DATE) < DATE '1997-01-01'")
orders_where("filter_local_time", 'clock_lt: "12:30"', "o_orderkey % 24 < 12")
orders_where("filter_offset_date_time", 'placed_lt: "1996-01-01T02:00:00+02:00"', f"{WHEN} < TIMESTAMP '1996-01-01'")
orders_where("filter_id", 'id_in: ["1", "33", "007", "x"], id_not: "1"', "o_orderkey = 33")
orders_where("filter_id_text", 'id_lt: "2"', "CAST(o_orderkey AS VARCHAR) < '2'")
orders_where("filter_string_map", 'marks_some: {key: "priority", value_starts_with: "2"}, marks_none: {value: "F"}', f"starts_with({TEXT}, '2') AND o_orderstatus <> 'F'")
ask("filter_i18n", '{ allParts(filter: {names_some: {language: "de", value_contains: "MO"}}) { key } }', ["key"], "SELECT p_partkey AS key FROM part WHERE contains(p_type, 'MO')")
ask("filter_decimal", "{ allParts(filter: {amount_gt: 1500.25}) { key } }", ["key"], "SELECT p_partkey AS key FROM part WHERE CAST(p_retailprice AS DECIMAL(13, 2)) > 1500.25")
ask("filter_extension", "{ allParts(filter: {spec: {size_gt: 25}}) { key spec { brand } } }", ["key", "spec.brand AS brand"], "SELECT p_partkey AS key, p_brand AS brand FROM part WHERE p_size > 25")
customers_where("filter_to1_rows", "nation: {key_gt: 4, region: {key_gt: 0}}", "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey > 4 AND n_regionkey > 0)")
customers_where("filter_empty_and", "AND: [], balance_gt: 0", "c_acctbal > 0")

# ---- quantifiers
LINES = "FROM lineitem WHERE l_orderkey = o_orderkey"
for _name, _flt, _sql in (
    ("some", "items_some: {quantity_gt: 45}", f"EXISTS (SELECT 1 {LINES} AND l_quantity > 45)"),
    ("every", "items_every: {quantity_gt: 10}", f"NOT EXISTS (SELECT 1 {LINES} AND NOT l_quantity > 10)"),
    ("none", 'items_none: {returnFlag: "R"}', f"NOT EXISTS (SELECT 1 {LINES} AND l_returnflag = 'R')"),
    ("empty", "items_empty: true", f"NOT EXISTS (SELECT 1 {LINES})"),
):
    ask(f"quant_{_name}_list", "{ allBaskets(filter: {%s}) { key } }" % _flt, ["key"], f"SELECT o_orderkey AS key FROM orders WHERE {_sql}")
ORD = "FROM orders WHERE o_custkey = c_custkey"
customers_where("quant_some_relation", "orders_some: {totalPrice_gt: 190000}", f"EXISTS (SELECT 1 {ORD} AND o_totalprice > 190000)")
customers_where("quant_every_relation", "orders_every: {totalPrice_gt: 20000}", f"NOT EXISTS (SELECT 1 {ORD} AND NOT o_totalprice > 20000)")
customers_where("quant_none_relation", 'orders_none: {status: "P"}', f"NOT EXISTS (SELECT 1 {ORD} AND o_orderstatus = 'P')")
customers_where("quant_empty_relation", "orders_empty: false", f"EXISTS (SELECT 1 {ORD})")
customers_where("quant_relation_under_or", "OR: [{orders_some: {totalPrice_gt: 190000}}, {key: 3}]", f"EXISTS (SELECT 1 {ORD} AND o_totalprice > 190000) OR c_custkey = 3")
customers_where("quant_empty_relation_rows", "referrals_empty: true", "NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey // 3 = c.c_custkey AND x.c_custkey > 0)")
ask("quant_scalar_list", "{ allVectors(filter: {values_some: {gt: 0.4}, values_none: {lt: -0.45}}) { id } }", ["id"], "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.4)) > 0 AND len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) < -0.45)) = 0")

# ---- order and pages
ask("order_multi", "{ allCustomers(orderBy: [segment_ASC, balance_DESC], first: 25) { key segment } }", ["key", "segment"], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 25")
ask("order_relation", "{ allOrders(orderBy: [customer_name_DESC, key_ASC], first: 20) { key } }", ["key"], "SELECT o_orderkey AS key FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_name DESC, o_orderkey LIMIT 20")
ask("order_null_first", "{ allCustomers(orderBy: [richBalance_ASC, key_ASC], first: 30) { key } }", ["key"], "SELECT c_custkey AS key FROM customer ORDER BY CASE WHEN c_acctbal >= 0 THEN c_acctbal END NULLS FIRST, c_custkey LIMIT 30")
ask("skip_first", "{ allParts(orderBy: key_ASC, skip: 10, first: 15) { key name } }", ["key", "name"], "SELECT p_partkey AS key, p_name AS name FROM part ORDER BY p_partkey LIMIT 15 OFFSET 10")
ask("keyset_after", '{ allCustomers(orderBy: [segment_ASC, key_DESC], first: 12, after: "{\\"segment\\":\\"BUILDING\\",\\"key\\":60,\\"id\\":\\"60\\"}") { key segment } }', ["key", "segment"], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND (c_custkey < 60 OR (c_custkey = 60 AND CAST(c_custkey AS VARCHAR) > '60'))) ORDER BY c_mktsegment, c_custkey DESC LIMIT 12")
ask("cursor", "{ allCustomers(orderBy: key_ASC, first: 5) { key _cursor } }", ["key", "_cursor AS cursor"], """SELECT c_custkey AS key, '{"id":"' || c_custkey || '","key":' || c_custkey || '}' AS cursor FROM customer ORDER BY c_custkey LIMIT 5""")
ask("count_meta", '{ _allOrdersMeta(filter: {status: "F"}) { count } }', ["count"], "SELECT CAST(count(*) AS INT) AS count FROM orders WHERE o_orderstatus = 'F'")
ask("count_first", "{ _allOrdersMeta(first: 17) { count } }", ["count"], "SELECT CAST(17 AS INT) AS count")
ask("order_property", "{ allOrders(orderBy: [placed_DESC, key_ASC], first: 40) { key } }", ["key"], "SELECT o_orderkey AS key FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
ask("count_all", "{ _allCustomersMeta { count } }", ["count"], "SELECT CAST(count(*) AS INT) AS count FROM customer")

# ---- nesting
ask("nested_topk", "{ allCustomers { key orders(orderBy: [totalPrice_DESC, key_ASC], first: 2) { key } } }", ["key", "array_join(transform(orders, x -> cast(x.key as string)), ',') AS top"], "SELECT c_custkey AS key, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r), '') AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) o ON o_custkey = c_custkey AND r <= 2 GROUP BY 1")
ask("nested_filter_skip", '{ allCustomers { key orders(filter: {status: "O"}, orderBy: key_ASC, skip: 1, first: 2) { key } } }', ["key", "array_join(transform(orders, x -> cast(x.key as string)), ',') AS some"], "SELECT c_custkey AS key, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r), '') AS some FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders WHERE o_orderstatus = 'O') o ON o_custkey = c_custkey AND r IN (2, 3) GROUP BY 1")
ask("nested_meta", '{ allCustomers { key _ordersMeta(filter: {status: "F"}) { count } } }', ["key", "_ordersMeta.count AS n"], "SELECT c_custkey AS key, CAST(count(o_orderkey) AS INT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
ask("nested_embedded", '{ allBaskets { key items(filter: {quantity_gte: 20}, orderBy: quantity_DESC, first: 3) { quantity } } }', ["key", "array_join(transform(items, x -> cast(cast(x.quantity as int) as string)), ',') AS top"], "SELECT o_orderkey AS key, coalesce(string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY r), '') AS top FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) r FROM lineitem WHERE l_quantity >= 20) l ON l_orderkey = o_orderkey AND r <= 3 GROUP BY 1")
ask("relation_to1", "{ allOrders { key customer { name nation { name } } } }", ["key", "customer.name AS customer", "customer.nation.name AS nation"], "SELECT o_orderkey AS key, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
ask("relation_to_n", "{ allCustomers { key orders(orderBy: key_ASC) { key } } }", ["key", "array_join(transform(orders, x -> cast(x.key as string)), ',') AS orders"], "SELECT c_custkey AS key, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("relation_inverse", "{ allLabels { id quality document { lang } } }", ["id", "quality", "document.lang AS lang"], "SELECT CAST(l.doc_id AS VARCHAR) AS id, quality, lang FROM labels l LEFT JOIN documents d USING (doc_id)")
ask("reference_dangling", "{ allCustomers { key oddNationKey oddNation { name } } }", ["key", "oddNationKey AS odd", "oddNation.name AS name"], "SELECT c_custkey AS key, CASE WHEN c_nationkey % 2 = 1 THEN c_nationkey ELSE c_nationkey + 100 END AS odd, CASE WHEN c_nationkey % 2 = 1 THEN n_name END AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
ask("reference_in_list_all", "{ allBaskets { key items { part { brand } } } }", ["key", "array_join(array_sort(array_distinct(transform(items, x -> x.part.brand))), ',') AS brands"], "SELECT o_orderkey AS key, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS brands FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
ask("root_parent_all", "{ allBaskets { key items { basket { status key } } } }", ["key", "get(array_distinct(transform(items, x -> concat(x.basket.status, x.basket.key))), 0) AS up"], "SELECT o_orderkey AS key, min(CASE WHEN l_orderkey IS NOT NULL THEN o_orderstatus || o_orderkey END) AS up FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
ask("parent_all", "{ allBaskets { key items { up { status } } } }", ["key", "array_join(array_distinct(transform(items, x -> x.up.status)), ',') AS up"], "SELECT o_orderkey AS key, coalesce(min(CASE WHEN l_orderkey IS NOT NULL THEN o_orderstatus END), '') AS up FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
ask("relation_to_n_desc", "{ allCustomers { key orders(orderBy: [status_DESC, key_ASC]) { key } } }", ["key", "array_join(transform(orders, x -> cast(x.key as string)), ',') AS orders"], "SELECT c_custkey AS key, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderstatus DESC, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ask("aliases_fragments", "query { allNations { ...n r: region { t: name } } } fragment n on Nation { k: key name }", ["k", "name", "r.t AS region"], "SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")

# ---- collect: embedded lists
SMALL, CHEAP = "CASE WHEN l_quantity < 10 THEN l_quantity END", "l_quantity < 25"
HERE = "l_orderkey IS NOT NULL"
EMBEDDED = {
    "count": ("n", f"CAST(count(l_orderkey) AS INT)"),
    "some": ("any", "count(l_orderkey) > 0"),
    "none": ("none", "count(l_orderkey) = 0"),
    "count_null": ("nNull", f"CAST(count(*) FILTER ({HERE} AND {SMALL} IS NULL) AS INT)"),
    "count_not_null": ("nNotNull", f"CAST(count({SMALL}) AS INT)"),
    "some_null": ("someNull", f"coalesce(bool_or({SMALL} IS NULL) FILTER ({HERE}), false)"),
    "some_not_null": ("someNotNull", f"count({SMALL}) > 0"),
    "every_null": ("everyNull", f"count({SMALL}) = 0"),
    "none_null": ("noneNull", f"coalesce(bool_and({SMALL} IS NOT NULL) FILTER ({HERE}), true)"),
    "min": ("least", "min(l_quantity)"),
    "max": ("most", "max(l_quantity)"),
    "sum": ("total", "coalesce(sum(l_quantity), 0)"),
    "average": ("round(average, 6)", "round(avg(l_quantity), 6)"),
    "count_true": ("nCheap", f"CAST(count(*) FILTER ({CHEAP}) AS INT)"),
    "count_not_true": ("nDear", f"CAST(count(*) FILTER ({HERE} AND NOT {CHEAP}) AS INT)"),
    "some_true": ("someCheap", f"coalesce(bool_or({CHEAP}), false)"),
    "some_not_true": ("someDear", f"coalesce(bool_or(NOT {CHEAP}), false)"),
    "every_true": ("everyCheap", f"coalesce(bool_and({CHEAP}), true)"),
    "none_true": ("noneCheap", f"NOT coalesce(bool_or({CHEAP}), false)"),
    "distinct": ("array_join(flags, ',')", "coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '')"),
    "count_distinct": ("nFlags", "CAST(count(DISTINCT l_returnflag) AS INT)"),
}
for _name, (_flat, _sql) in EMBEDDED.items():
    _field = _flat.removeprefix("round(").removeprefix("array_join(").split(",")[0]
    ask(f"collect_agg_{_name}_embedded", "{ allBaskets { key %s } }" % _field, ["key", f"{_flat} AS v"], f"SELECT o_orderkey AS key, {_sql} AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

# ---- collect: over relations
JOINED = {
    "count": ("lineCount", "count(l_orderkey)"),
    "sum": ("quantitySum", "coalesce(sum(l_quantity), 0)"),
    "max": ("quantityMax", "max(l_quantity)"),
    "min": ("quantityMin", "min(l_quantity)"),
    "average": ("round(quantityAvg, 6)", "round(avg(l_quantity), 6)"),
    "distinct": ("array_join(flags, ',')", "coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '')"),
    "count_distinct": ("flagCount", "count(DISTINCT l_returnflag)"),
    "count_null": ("smallNull", f"count(*) FILTER ({HERE} AND {SMALL} IS NULL)"),
    "count_not_null": ("smallNotNull", f"count({SMALL})"),
    "some_null": ("someSmallNull", f"coalesce(bool_or({SMALL} IS NULL) FILTER ({HERE}), false)"),
    "every_null": ("everySmallNull", f"count({SMALL}) = 0"),
    "count_true": ("cheapTrue", f"count(*) FILTER ({CHEAP})"),
    "every_true": ("everyCheap", f"coalesce(bool_and({CHEAP}), true)"),
    "some": ("anyLine", "count(l_orderkey) > 0"),
    "none": ("noLine", "count(l_orderkey) = 0"),
    "some_not_null": ("someSmall", f"count({SMALL}) > 0"),
    "none_null": ("noneSmallNull", f"coalesce(bool_and({SMALL} IS NOT NULL) FILTER ({HERE}), true)"),
    "count_not_true": ("dearTrue", f"count(*) FILTER ({HERE} AND NOT {CHEAP})"),
    "some_true": ("someCheap", f"coalesce(bool_or({CHEAP}), false)"),
    "some_not_true": ("someDear", f"coalesce(bool_or(NOT {CHEAP}), false)"),
    "none_true": ("noneCheap", f"NOT coalesce(bool_or({CHEAP}), false)"),
}
for _name, (_flat, _sql) in JOINED.items():
    _field = _flat.removeprefix("round(").removeprefix("array_join(").split(",")[0]
    ask(f"collect_agg_{_name}_joined", "{ allCustomers { key %s } }" % _field, ["key", f"{_flat} AS v"], f"SELECT c_custkey AS key, {_sql} AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
ask("collect_path", "{ allCustomers { key allLines(filter: {quantity_gt: 49}, orderBy: quantity_ASC) { quantity } } }", ["key", "size(allLines) AS n"], "SELECT c_custkey AS key, CAST(count(l_orderkey) AS INT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 GROUP BY 1")
CHILD = "(SELECT c_custkey AS k, c_custkey // 3 AS up FROM customer WHERE c_custkey > 0)"
ask("collect_depth_1_2", "{ allCustomers { key deepReferrals(orderBy: key_ASC) { key } } }", ["key", "array_join(transform(deepReferrals, x -> cast(x.key as string)), ',') AS deep"], f"SELECT c_custkey AS key, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS deep FROM customer LEFT JOIN (SELECT up, k FROM {CHILD} UNION ALL SELECT a.up, b.k FROM {CHILD} a JOIN {CHILD} b ON b.up = a.k) ON up = c_custkey GROUP BY 1")
ask("collect_depth_0_2", "{ allCustomers { key family } }", ["key", "family AS n"], f"SELECT c_custkey AS key, 1 + count(k) AS n FROM customer LEFT JOIN (SELECT up, k FROM {CHILD} UNION ALL SELECT a.up, b.k FROM {CHILD} a JOIN {CHILD} b ON b.up = a.k) ON up = c_custkey GROUP BY 1")
ask("collect_depth_2_2", "{ allCustomers { key grandReferrals } }", ["key", "grandReferrals AS n"], f"SELECT c_custkey AS key, count(k) AS n FROM customer LEFT JOIN (SELECT a.up, b.k FROM {CHILD} a JOIN {CHILD} b ON b.up = a.k) ON up = c_custkey GROUP BY 1")
ask("collect_nullable_hop", "{ allCustomers { key poorOrders } }", ["key", "poorOrders AS n"], "SELECT c_custkey AS key, count(o_orderkey) FILTER (c_acctbal < 0) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
SEEN = "(SELECT c_custkey AS k, c_custkey // 3 AS up FROM customer WHERE c_custkey > 0 AND c_mktsegment = 'BUILDING')"
ask("collect_hidden_vertices", "{ allCustomers { key grandReferrals deepReferrals { key } } }", ["key", "grandReferrals AS n", "size(deepReferrals) AS deep"], f"SELECT c_custkey AS key, count(b.k) AS n, CAST(count(DISTINCT a.k) + count(b.k) AS INT) AS deep FROM customer LEFT JOIN {SEEN} a ON a.up = c_custkey LEFT JOIN {SEEN} b ON b.up = a.k WHERE c_mktsegment = 'BUILDING' GROUP BY 1", User(("segment-BUILDING",)))

# ---- search
TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def searched(name: str, args: str, sql: str) -> None:
    ask(name, "{ flexSearchDocuments(%s) { id lang } }" % args, ["id", "lang"], f"SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE {sql}")


searched("search_any_word", 'flexSearchFilter: {text_contains_any_word: "stupid moron"}', f"list_has_any({TOKENS}, ['stupid', 'moron'])")
searched("search_all_words", 'flexSearchFilter: {text_contains_all_words: "The and attion"}', f"list_has_all({TOKENS}, ['the', 'and', 'attion'])")
searched("search_any_prefix", 'flexSearchFilter: {text_contains_any_prefix: "worth disgu"}', f"len(list_filter({TOKENS}, lambda x: starts_with(x, 'worth') OR starts_with(x, 'disgu'))) > 0")
searched("search_all_prefixes", 'flexSearchFilter: {text_contains_all_prefixes: "eree then"}', f"len(list_filter({TOKENS}, lambda x: starts_with(x, 'eree'))) > 0 AND len(list_filter({TOKENS}, lambda x: starts_with(x, 'then'))) > 0")
searched("search_phrase", 'flexSearchFilter: {text_contains_phrase: "to the"}', f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' to the ')")
searched("search_not_any_word", 'flexSearchFilter: {text_not_contains_any_word: "the and"}', f"NOT list_has_any({TOKENS}, ['the', 'and'])")
searched("search_values", 'flexSearchFilter: {source: "SRC3", chars_gt: 1000}', "lower(source) = 'src3' AND n_chars > 1000")
searched("search_expression", 'flexSearchExpression: "fr"', f"starts_with(lang, 'fr') OR len(list_filter({TOKENS}, lambda x: starts_with(x, 'fr'))) > 0")
searched("search_not_all_words", 'flexSearchFilter: {text_not_contains_all_words: "the and"}', f"NOT list_has_all({TOKENS}, ['the', 'and'])")
searched("search_not_any_prefix", 'flexSearchFilter: {text_not_contains_any_prefix: "th zz"}', f"len(list_filter({TOKENS}, lambda x: starts_with(x, 'th') OR starts_with(x, 'zz'))) = 0")
searched("search_both_prefixes", 'flexSearchFilter: {text_contains_all_prefixes: "th an"}', f"len(list_filter({TOKENS}, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter({TOKENS}, lambda x: starts_with(x, 'an'))) > 0")
searched("search_not_all_prefixes", 'flexSearchFilter: {text_not_contains_all_prefixes: "th an"}', f"NOT (len(list_filter({TOKENS}, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter({TOKENS}, lambda x: starts_with(x, 'an'))) > 0)")
searched("search_not_phrase", 'flexSearchFilter: {text_not_contains_phrase: "to the"}', f"NOT contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' to the ')")
searched("search_id", 'flexSearchFilter: {id_in: ["5", "77", "x"]}', "doc_id IN (5, 77)")
searched("search_string_range", 'flexSearchFilter: {lang_gte: "en", lang_lt: "fr"}', "lang >= 'en' AND lang < 'fr'")
searched("search_exists", "flexSearchFilter: {lang_exists: true, chars_lt: 500}", "lang IS NOT NULL AND n_chars < 500")
searched("search_post_filter", 'flexSearchFilter: {lang: "en"}, postFilter: {id_in: ["1", "2", "3", "4", "5", "6"]}', "lang = 'en' AND doc_id BETWEEN 1 AND 6")

# ---- access
ask("auth_group", "{ allEvents { id accessGroup } }", ["id", "accessGroup AS grp"], "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS grp FROM events WHERE event_type IN ('click', 'view')", User(("group-click", "group-view")))
ask("auth_restriction", "{ allCustomers { key segment } }", ["key", "segment"], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'", User(("segment-BUILDING",)))
ask("auth_claim", "{ allCustomers { key segment } }", ["key", "segment"], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')", User(("claimed",), {"segments": ["MACHINERY", "FURNITURE"]}))
ask("auth_relation", "{ allOrders { key customer { key } } }", ["key", "customer.key AS customer"], "SELECT o_orderkey AS key, c_custkey AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'", User(("segment-BUILDING",)))


# ---- operators as columns and frames
def column_query(name: str, table: str, exprs: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(*exprs(df))

    QUERIES[name], ORACLES[name] = run, sql


def _arithmetic(df: DataFrame) -> list:
    from pyspark.sql import functions as F

    from .functions import semantics as s

    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return [F.col("l_orderkey"), n, q, (q + n).alias("added"), (q - n).alias("less"), (q * n).alias("times"), s.round_half_up(s.divide(q, n - 1) * 100).alias("by"), s.modulo(q, n).alias("left"), s.append(F.col("l_returnflag"), F.col("l_linestatus")).alias("joined"), s.round_half_up(-q / 2).cast("long").alias("rounded")]


column_query("operators_arithmetic", "lineitem", _arithmetic, "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity + l_linenumber AS added, l_quantity - l_linenumber AS less, l_quantity * l_linenumber AS times, CAST(floor(CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END * 100 + 0.5) AS BIGINT) AS by, l_quantity % l_linenumber AS left, l_returnflag || l_linestatus AS joined, CAST(floor(-l_quantity / 2 + 0.5) AS BIGINT) AS rounded FROM lineitem")


def _lists(df: DataFrame) -> list:
    from pyspark.sql import functions as F

    from .functions import semantics as s

    a, b = F.split("o_orderpriority", "-"), F.array(F.lit("1"), F.lit("HIGH"))
    text = lambda c: F.array_join(c, "|")
    return [F.col("o_orderkey"), text(s.concat_lists(a, b, F.lit(None).cast("array<string>"))).alias("both"), text(s.subtract_lists(a, b)).alias("rest"), F.try_element_at(a, F.lit(1)).alias("first"), F.try_element_at(a, F.lit(9)).alias("none")]


column_query("operators_lists", "orders", _lists, "SELECT o_orderkey, array_to_string(list_concat(string_split(o_orderpriority, '-'), ['1', 'HIGH']), '|') AS both, array_to_string(list_filter(string_split(o_orderpriority, '-'), lambda x: x NOT IN ('1', 'HIGH')), '|') AS rest, string_split(o_orderpriority, '-')[1] AS first, CAST(NULL AS VARCHAR) AS none FROM orders")


def _objects(df: DataFrame) -> list:
    from pyspark.sql import functions as F

    from .functions import semantics as s

    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    a, b = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), F.struct(F.lit("new").alias("s"), F.lit(None).cast("int").alias("n"))
    merged = s.merge_structs(["k", "s", "n"], [(a, ["k", "s"]), (b, ["s", "n"])])
    late = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    return [F.col("o_orderkey"), s.json_text(merged).alias("merged"), F.size(s.map_entries(m)).alias("entries"), s.dynamic(m, F.when(F.col("o_orderkey") % 2 == 0, "status").otherwise("nope")).alias("picked"), s.is_kind(late, "string", "NULL").alias("is_null"), s.is_kind(late, "string", "SCALAR").alias("is_scalar"), F.when(s.truth(late == "F"), "yes").otherwise("no").alias("chosen")]


column_query("operators_objects", "orders", _objects, """SELECT o_orderkey, '{"k":' || o_orderkey || ',"s":"new","n":null}' AS merged, CAST(2 AS INT) AS entries, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS picked, o_orderkey % 2 <> 0 AS is_null, o_orderkey % 2 = 0 AS is_scalar, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS chosen FROM orders""")


# ---- mutations, as the tables that a transaction would commit
def staged(name: str, change: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import datetime as dt

        from .operators.mutations import Transaction

        tx = Transaction(engine(spark, sf_dir).binding, None, lambda: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), lambda: "new")
        return change(tx)

    QUERIES[name], ORACLES[name] = run, sql


def _calc(tx) -> DataFrame:
    from pyspark.sql import functions as F

    t = tx.model.types["Customer"]
    tx.update(t, F.col("segment") == "BUILDING", {"addTo_balance": 100}, None)
    return tx.table(t).select("key", "balance", F.col("updatedAt").isNotNull().alias("changed"))


def _delete(pick: Callable) -> Callable:
    def change(tx) -> DataFrame:
        t = tx.model.types["Customer"]
        tx.delete(t, tx.table(t).where("segment = 'BUILDING'").select("id"))
        return pick(tx)

    return change


staged("calc_mutation", _calc, "SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS balance, c_mktsegment = 'BUILDING' AS changed FROM customer")
staged("delete_rows", _delete(lambda tx: tx.table(tx.model.types["Customer"]).select("key")), "SELECT c_custkey AS key FROM customer WHERE c_mktsegment <> 'BUILDING'")
staged("delete_cascade", _delete(lambda tx: tx.table(tx.model.types["Order"]).select("key")), "SELECT o_orderkey AS key FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE coalesce(c_mktsegment, '') <> 'BUILDING'")
staged("delete_edges", _delete(lambda tx: tx.edges(tx.model.relation(tx.model.types["Customer"], tx.model.types["Customer"].fields["referrals"])[0]).selectExpr("_from AS frm", "_to AS dest")), "SELECT CAST(c.c_custkey // 3 AS VARCHAR) AS frm, CAST(c.c_custkey AS VARCHAR) AS dest FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 3 WHERE c.c_custkey > 0 AND c.c_mktsegment <> 'BUILDING' AND p.c_mktsegment <> 'BUILDING'")


def changed(name: str, change: Callable, sql: str) -> None:
    """Like ``staged``, with an id of its own for each new object."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import datetime as dt
        import itertools

        from .operators.mutations import Transaction

        ids = itertools.count(1)
        tx = Transaction(engine(spark, sf_dir).binding, None, lambda: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), lambda: f"new{next(ids)}")
        return change(tx, tx.model.types)

    QUERIES[name], ORACLES[name] = run, sql


def _create(tx, types) -> DataFrame:
    tx.create(types["Region"], [{"key": 100, "name": "NEW"}, {"key": 101}])
    return tx.table(types["Region"]).select("id", "key", "name")


def _create_linked(tx, types) -> DataFrame:
    tx.create(types["Customer"], [{"key": 10_000_001, "createOrders": [{"key": 10_000_002, "status": "N"}, {"key": 10_000_003}], "referrals": ["4", "5"]}])
    t = types["Customer"]
    both = [tx.edges(tx.model.relation(t, t.fields[n])[0]).selectExpr(f"'{n}' AS field", "_from AS frm", "_to AS dest") for n in ("orders", "referrals")]
    return both[0].unionAll(both[1])


def _update_bulk(tx, types) -> DataFrame:
    tx.update_simple(types["Nation"], {"3": {"name": "THREE"}, "5": {"regionKey": 4}, "7": {"name": None, "regionKey": 0}})
    return tx.table(types["Nation"]).selectExpr("key", "name", "regionKey AS region", "updatedAt IS NOT NULL AS changed")


def _update_all(tx, types) -> DataFrame:
    from pyspark.sql import functions as F

    tx.update(types["Part"], F.col("size") > 25, {"brand": "BIG", "spec": {"size": 0}}, None)
    return tx.table(types["Part"]).selectExpr("key", "brand", "spec.brand AS old", "spec.size AS size")


def _calc_others(tx, types) -> DataFrame:
    from pyspark.sql import functions as F

    tx.update(types["Part"], F.col("size") > 10, {"moduloOf_size": 7, "divideBy_price": 4, "appendTo_name": "!"}, None)
    tx.update(types["Part"], F.col("key") > 20, {"subtractFrom_size": 1, "subtractFrom_price": 0.5, "prependTo_name": "?"}, None)
    return tx.table(types["Part"]).selectExpr("key", "name", "size", "round(price, 6) AS price")


def _children(tx, types) -> DataFrame:
    from pyspark.sql import functions as F

    tx.update(types["Basket"], F.col("status") == "F", {"addItems": [{"number": 99, "quantity": 1.5}, {"number": 100}]}, None)
    return tx.table(types["Basket"]).selectExpr("key", "coalesce(size(items), 0) AS n", "coalesce(aggregate(items, 0D, (a, x) -> a + coalesce(x.quantity, 0D)), 0D) AS total")


def _edges(change: Callable) -> Callable:
    def run(tx, types) -> DataFrame:
        t = types["Customer"]
        f = t.fields["referrals"]
        change(lambda how, wants: tx.link(t, f, how, wants))
        return tx.edges(tx.model.relation(t, f)[0]).selectExpr("_from AS frm", "_to AS dest")

    return run


def _expire(tx, types) -> DataFrame:
    from .operators.ttl import expired

    rule = tx.model.time_to_live[0]
    tx.delete(types["Event"], tx.table(types["Event"]).where(expired(tx.model, rule, tx.now)).select("id"))
    return tx.table(types["Event"]).select("id", "userId")


REFERRALS = "SELECT CAST(c_custkey // 3 AS VARCHAR) AS frm, CAST(c_custkey AS VARCHAR) AS dest FROM customer WHERE c_custkey > 0"
changed("create_rows", _create, "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_regionkey AS key, r_name AS name FROM region UNION ALL VALUES ('new1', 100, 'NEW'), ('new2', 101, NULL)")
changed("create_linked", _create_linked, f"SELECT 'orders' AS field, CAST(o_custkey AS VARCHAR) AS frm, CAST(o_orderkey AS VARCHAR) AS dest FROM orders UNION ALL SELECT 'referrals', * FROM ({REFERRALS}) WHERE dest NOT IN ('4', '5') UNION ALL VALUES ('orders', 'new1', 'new2'), ('orders', 'new1', 'new3'), ('referrals', 'new1', '4'), ('referrals', 'new1', '5')")
changed("update_rows", _update_bulk, "SELECT n_nationkey AS key, CASE n_nationkey WHEN 3 THEN 'THREE' WHEN 7 THEN NULL ELSE n_name END AS name, CASE n_nationkey WHEN 5 THEN 4 WHEN 7 THEN 0 ELSE n_regionkey END AS region, n_nationkey IN (3, 5, 7) AS changed FROM nation")
changed("update_all_rows", _update_all, "SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'BIG' ELSE p_brand END AS brand, p_brand AS old, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS size FROM part")
changed("calc_others", _calc_others, "SELECT p_partkey AS key, CASE WHEN p_partkey > 20 THEN '?' ELSE '' END || p_name || CASE WHEN p_size > 10 THEN '!' ELSE '' END AS name, CASE WHEN p_size > 10 THEN p_size % 7 ELSE p_size END - CASE WHEN p_partkey > 20 THEN 1 ELSE 0 END AS size, round(CASE WHEN p_size > 10 THEN p_retailprice / 4 ELSE p_retailprice END - CASE WHEN p_partkey > 20 THEN 0.5 ELSE 0 END, 6) AS price FROM part")
changed("children_added", _children, "SELECT o_orderkey AS key, CAST(count(l_orderkey) + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS INT) AS n, coalesce(sum(l_quantity), 0) + CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE 0 END AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
changed("edges_added", _edges(lambda link: link("add", [("1", ["20", "3"]), ("2", ["20"])])), f"SELECT * FROM ({REFERRALS}) WHERE dest <> '20' UNION ALL VALUES ('2', '20')")
changed("edges_removed", _edges(lambda link: link("remove", [("1", ["3", "20"]), ("2", ["6", "7"])])), f"SELECT * FROM ({REFERRALS}) WHERE NOT (frm = '1' AND dest = '3') AND NOT (frm = '2' AND dest IN ('6', '7'))")
changed("edges_set", _edges(lambda link: link("set", [("1", ["30"]), ("2", [])])), f"SELECT * FROM ({REFERRALS}) WHERE frm NOT IN ('1', '2') AND dest <> '30' UNION ALL VALUES ('1', '30')")
changed("ttl_cleanup", _expire, "SELECT CAST(event_id AS VARCHAR) AS id, user_id AS userId FROM events WHERE NOT ts < TIMESTAMP '2023-12-22'")


def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    from .operators.ttl import info

    return info(engine(spark, sf_dir).binding, dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc))


QUERIES["ttl_info"] = _ttl
ORACLES["ttl_info"] = "SELECT 'Event' AS type_name, count(*) FILTER (ts < TIMESTAMP '2024-01-22') AS expired, count(*) FILTER (ts < TIMESTAMP '2024-01-19') AS overdue FROM events"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).schema_frames()["relations"].select("name", "from_type", "to_type")


QUERIES["schema_relations"] = _meta
ORACLES["schema_relations"] = "SELECT * FROM (VALUES ('customers_orders', 'Customer', 'Order'), ('customers_baskets', 'Customer', 'Basket'), ('customers_referrals', 'Customer', 'Customer'), ('orders_suppliers', 'Order', 'Supplier'), ('documents_label', 'Document', 'Label')) t(name, from_type, to_type)"
