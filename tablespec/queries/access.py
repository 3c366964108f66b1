"""J10, J14 and A15-A17."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import rollups as R
from tablespec.paths import work_dir
from tablespec.registry import Tables, query

_MONEY = "sum(cast(o_totalprice AS decimal(18,2)))"


@query("j14_summary_view", "SELECT c_custkey, count(o_orderkey) AS children, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F')::DOUBLE AS finished, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 5 = 0 GROUP BY 1")
def _(t: Tables):
    out = R.summary_view(t.customer.select("c_custkey"), t.orders.where("o_orderkey % 5 = 0"), "c_custkey", "o_custkey", {"finished": (_MONEY, "o_orderstatus = 'F'"), "last": ("max(o_orderdate)", None)})
    return out.withColumn("finished", F.col("finished").cast("double"))


@query("a17_filtered_aggregate", "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS finished, count(*) FILTER (l_discount > 0.08) AS cheap, coalesce(sum(l_quantity) FILTER (l_quantity > 100), 0) AS none FROM lineitem GROUP BY 1")
def _(t: Tables):
    return R.filtered_aggregate(t.lineitem, ["l_returnflag"], {"finished": ("sum(l_quantity)", "l_linestatus = 'F'"), "cheap": ("count(*)", "l_discount > 0.08"), "none": ("sum(l_quantity)", "l_quantity > 100")})


@query("a15_materialize", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS orders FROM orders GROUP BY 1")
def _(t: Tables):
    view = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("orders"))
    return R.materialize(view, f"{work_dir(t.spark)}/revenue")


@query("a15_materialize_no_data", "SELECT o_custkey, count(*) AS n FROM orders WHERE FALSE GROUP BY 1")
def _(t: Tables):
    return R.materialize(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), f"{work_dir(t.spark)}/counts", with_data=False)


@query("a16_refresh_incremental", "SELECT l_partkey, count(*) AS n, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY 1")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    stored = rows.where("l_orderkey % 19 <> 0").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("l_quantity"))
    return R.refresh_incremental(stored, rows.where("l_orderkey % 19 = 0 AND l_orderkey % 17 <> 0"), rows.where("l_orderkey % 19 <> 0 AND l_orderkey % 17 = 0"), ["l_partkey"], ["l_quantity"])


@query("a16_refresh_extremes", "SELECT l_partkey, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY 1")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    stored = rows.where("l_orderkey % 19 <> 0").groupBy("l_partkey").agg(F.min("l_quantity").alias("min_l_quantity"), F.max("l_quantity").alias("max_l_quantity"))
    return R.refresh_extremes(stored, rows.where("l_orderkey % 17 <> 0"), rows.where("l_orderkey % 19 = 0 AND l_orderkey % 17 <> 0"), rows.where("l_orderkey % 19 <> 0 AND l_orderkey % 17 = 0"), ["l_partkey"], "l_quantity")


@query("a16_refresh_extremes_null_group", "SELECT kind, min(value) AS min_value, max(value) AS max_value FROM (SELECT nullif(event_type, 'view') AS kind, value, event_id FROM events) WHERE event_id % 10 <> 0 GROUP BY 1")
def _(t: Tables):
    rows = t.events.select("event_id", "value", F.expr("nullif(event_type, 'view')").alias("kind"))
    stored = rows.groupBy("kind").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return R.refresh_extremes(stored, rows.where("event_id % 10 <> 0"), rows.where("FALSE"), rows.where("event_id % 10 = 0"), ["kind"], "value")


@query("j10_access_audit", """WITH RECURSIVE e AS (SELECT event_id, 'u' || user_id % 20 AS role, 'o' || event_id % 10 AS object, event_type AS action FROM events),
m AS (SELECT DISTINCT 'u' || user_id % 20 AS member, 'u' || (user_id % 20) // 2 AS role FROM events WHERE user_id % 20 > 1),
g AS (SELECT DISTINCT 'u' || user_id % 20 AS role, 'o' || event_id % 10 AS object, event_type AS action FROM events WHERE event_id % 9 = 0 UNION SELECT 'public', 'o3', 'view'),
d AS (SELECT * FROM g WHERE NOT (role = 'u1' AND object = 'o2' AND action = 'click')),
c AS (SELECT member, role FROM m UNION SELECT c.member, m.role FROM c JOIN m ON c.role = m.member),
h AS (SELECT * FROM d UNION SELECT c.member, object, action FROM d JOIN c USING (role)),
w AS (SELECT 'u5' AS role, 'error' AS action UNION SELECT member, 'error' FROM c WHERE role = 'u5')
SELECT event_id, role, object, action FROM e WHERE (role, object, action) NOT IN (SELECT role, object, action FROM h) AND (object, action) NOT IN (SELECT object, action FROM h WHERE role = 'public') AND (role, action) NOT IN (SELECT role, action FROM w)""")
def _(t: Tables):
    e = t.events.selectExpr("event_id", "concat('u', user_id % 20) AS role", "concat('o', event_id % 10) AS object", "event_type AS action")
    m = t.events.where("user_id % 20 > 1").selectExpr("concat('u', user_id % 20) AS member", "concat('u', (user_id % 20) div 2) AS role").distinct()
    g = e.where("event_id % 9 = 0").select("role", "object", "action").distinct().unionByName(t.region.limit(1).selectExpr("'public' AS role", "'o3' AS object", "'view' AS action"))
    r = t.region.limit(1).selectExpr("'u1' AS role", "'o2' AS object", "'click' AS action")
    return R.access_audit(e, g, m, r, t.region.limit(1).selectExpr("'u5' AS role", "'error' AS action"))
