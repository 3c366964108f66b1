"""P01-P15 and T01-T04."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import project as P
from tablespec.operators import sets as S
from tablespec.registry import Tables, query
from tablespec.spec import Column, Policy, TableSpec


@query("p01_define_view", "SELECT o_orderkey AS id, o_custkey AS customer, year(o_orderdate)::INT AS placed FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables):
    return P.define_view(t.orders, ["o_orderkey", "o_custkey", "year(o_orderdate)"], "o_orderstatus = 'F'", ["id", "customer", "placed"], view="finished_orders")


@query("p02_view_check_option", "SELECT event_id, coalesce(nullif(event_type, 'click') = 'view', FALSE) AS accepted FROM events")
def _(t: Tables):
    good, bad = P.view_check_option(t.events.select("event_id", F.expr("nullif(event_type, 'click')").alias("kind")), "kind = 'view'")
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


@query("p03_rename_columns", 'SELECT s_suppkey AS "supplierId", s_name AS "sName", s_nationkey AS "sNationkey", s_acctbal AS balance FROM supplier')
def _(t: Tables):
    return P.rename_columns(t.supplier, {"s_suppkey": "supplierId"}, rule="camelCase", overrides={"s_acctbal": "balance"})


@query("p04_add_columns", "SELECT p_partkey, TRUE AS active, NULL::VARCHAR AS note, NULL::INT AS weight, 'weight' AS unfilled_not_null FROM part")
def _(t: Tables):
    spec = TableSpec("part", (Column("p_partkey", "bigint"), Column("active", "boolean", False, default="true"), Column("note", "string"), Column("weight", "int", False)))
    return P.add_columns(t.part.select("p_partkey"), spec).withColumn("unfilled_not_null", F.array_join("unfilled_not_null", ","))


@query("p05_drop_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t: Tables):
    return P.drop_columns(t.customer, ["c_acctbal", "c_gone"], allow_destructive=True)


@query("p05_dropped_values", "SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS lost FROM customer UNION ALL SELECT 'segment', count(nullif(c_mktsegment, 'BUILDING')) FROM customer")
def _(t: Tables):
    return P.dropped_values(t.customer.withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')")), ["c_acctbal", "segment"])


_MIXED = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE user_id::VARCHAR END"


@query("p06_change_type", f"SELECT event_id, {_MIXED} AS v, event_id % 3 = 0 AS quarantined FROM events")
def _(t: Tables):
    df = t.events.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN event_type ELSE cast(user_id AS string) END AS v")
    good, bad = P.change_type(df, "v", "bigint")
    return good.select("event_id", F.col("v").cast("string").alias("v"), F.lit(False).alias("quarantined")).unionByName(bad.withColumn("quarantined", F.lit(True)))


@query("p06_change_type_using", "SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS o_orderpriority FROM orders")
def _(t: Tables):
    return P.change_type(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "int", using="substring(o_orderpriority, 1, 1)")[0]


_NET = TableSpec("lineitem", (Column("l_orderkey", "bigint"), Column("l_quantity", "double"), Column("double_quantity", "double", generated="l_quantity * 2"), Column("late", "boolean", generated="l_shipdate > timestamp_ntz'2000-01-01'")))


@query("p07_generated_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2 AS double_quantity, l_shipdate > TIMESTAMP '2000-01-01' AS late FROM lineitem")
def _(t: Tables):
    return P.generated_columns(t.lineitem, _NET).select("l_orderkey", "l_linenumber", "l_quantity", "double_quantity", "late")


@query("p07_generated_audit", "SELECT 'double_quantity' AS column_name, count(*) FILTER (l_orderkey % 7 = 0 AND l_quantity <> 0) AS stale FROM lineitem")
def _(t: Tables):
    return P.generated_audit(t.lineitem.withColumn("double_quantity", F.expr("CASE WHEN l_orderkey % 7 = 0 THEN l_quantity ELSE l_quantity * 2 END")), _NET)


@query("p08_apply_defaults", "SELECT event_id, nullif(event_type, 'view') AS kind, 'web' AS channel FROM events")
def _(t: Tables):
    spec = TableSpec("events", (Column("kind", "string", default="'none'"), Column("channel", "string", default="'web'")))
    return P.apply_defaults(t.events.select("event_id", F.expr("nullif(event_type, 'view')").alias("kind")), spec)


@query("p09_covering_subset", "SELECT o_custkey, year(o_orderdate)::INT AS placed, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables):
    return P.covering_subset(t.orders, ["o_custkey", "year(o_orderdate) AS placed"], ["o_totalprice"], "o_orderstatus = 'O'")


_POLICIES = [Policy("own", "c_nationkey < 10", roles=("clerk",)), Policy("segment", "c_mktsegment = 'BUILDING'", check="c_acctbal > 0"), Policy("solvent", "c_acctbal > -500", permissive=False), Policy("no_delete", "false", command="delete")]


@query("p10_row_policy_read", "SELECT * FROM customer WHERE (c_nationkey < 10 OR c_mktsegment = 'BUILDING') AND c_acctbal > -500")
def _(t: Tables):
    return P.row_policy_read(t.customer, _POLICIES, "clerk")


@query("p11_row_policy_write", "SELECT c_custkey, c_acctbal > 0 AND c_acctbal > -500 AS accepted FROM customer")
def _(t: Tables):
    good, bad = P.row_policy_write(t.customer, _POLICIES, "guest")
    return good.select("c_custkey", F.lit(True).alias("accepted")).unionByName(bad.select("c_custkey", F.lit(False).alias("accepted")))


@query("p12_column_privileges", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t: Tables):
    return P.column_privileges(t.customer, [("reader", None), ("other", ("c_acctbal",))], "reader", [("reader", ("c_acctbal", "c_nationkey"))])


@query("p13_label_mask", "SELECT c_custkey, sha256(c_name) AS c_name, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    return P.label_mask(t.customer.drop("c_nationkey"), {"c_name": "personal", "c_acctbal": "secret", "c_mktsegment": "open"}, {"open"}, {"personal"})


_V2 = TableSpec("orders", (Column("id", "bigint"), Column("status", "string", default="'N'"), Column("cents", "bigint", using="round(o_totalprice * 100)"), Column("note", "string"), Column("big", "boolean", generated="cents > 10000000")), renames={"o_orderkey": "id", "o_orderstatus": "status"})
_V2_SQL = "SELECT o_orderkey AS id, {} AS status, round(o_totalprice * 100)::BIGINT AS cents, NULL::VARCHAR AS note, round(o_totalprice * 100)::BIGINT > 10000000 AS big FROM orders"


@query("p15_conform", _V2_SQL.format("o_orderstatus"))
def _(t: Tables):
    return P.conform(t.orders, _V2)


@query("t04_union_conformed", _V2_SQL.format("o_orderstatus") + " WHERE o_orderkey % 2 = 0 UNION ALL " + _V2_SQL.format("'N'") + " WHERE o_orderkey % 2 = 1")
def _(t: Tables):
    return P.union_conformed([t.orders.where("o_orderkey % 2 = 0"), t.orders.where("o_orderkey % 2 = 1").drop("o_orderstatus")], _V2)


@query("t01_set_delta", "(SELECT *, 'add' AS change FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 17 <> 0 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 13 <> 0)) UNION ALL (SELECT *, 'remove' FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 13 <> 0 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 17 <> 0))")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber")
    return S.set_delta(df.where("l_orderkey % 17 <> 0"), df.where("l_orderkey % 13 <> 0"))


@query("t01_array_delta", "SELECT user_id, array_to_string(list_sort(list_filter(d, lambda x: NOT list_contains(c, x))), ',') AS added, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(d, x))), ',') AS removed FROM (SELECT user_id, list_distinct(coalesce(list(event_type) FILTER (event_id % 2 = 0), [])) AS d, list_distinct(coalesce(list(event_type) FILTER (event_id % 2 = 1), [])) AS c FROM events GROUP BY 1)")
def _(t: Tables):
    sets = t.events.groupBy("user_id").agg(F.expr("collect_set(event_type) FILTER (WHERE event_id % 2 = 0)").alias("d"), F.expr("collect_set(event_type) FILTER (WHERE event_id % 2 = 1)").alias("c"))
    return S.array_delta(sets, "d", "c").select("user_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("t02_bag_equal_report", "SELECT l_partkey, CASE WHEN n > 0 THEN 'a' ELSE 'b' END AS only_in, abs(n)::BIGINT AS surplus FROM (SELECT l_partkey, sum(n) AS n FROM (SELECT l_partkey, 1 AS n FROM lineitem WHERE l_tax < 0.04 UNION ALL SELECT l_partkey, -1 FROM lineitem WHERE l_tax >= 0.04) GROUP BY 1) WHERE n <> 0")
def _(t: Tables):
    df = t.lineitem
    return S.bag_equal_report(df.where("l_tax < 0.04").select("l_partkey"), df.where("l_tax >= 0.04").select("l_partkey"))


@query("t03_managed_only", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t: Tables):
    return S.managed_only(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
