"""J01-J04, J13, F04, F11 and A19.

Version pairs come from one table: current is the table; desired lacks a slice
(key % 17 = 0), has a changed slice (key % 13 = 0) and an added one (key + offset).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import diffs as D
from tablespec.registry import Tables, query

_DESIRED_SQL = "SELECT CASE WHEN o_orderkey % 19 = 0 AND b THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 AND NOT b THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 26 = 0 AND NOT b THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders, (VALUES (FALSE), (TRUE)) v(b) WHERE CASE WHEN b THEN o_orderkey % 19 = 0 ELSE o_orderkey % 17 <> 0 END"
_CURRENT_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"
_DIFF_SQL = f"""WITH d AS ({_DESIRED_SQL}), c AS ({_CURRENT_SQL}), j AS (SELECT coalesce(d.o_orderkey, c.o_orderkey) AS o_orderkey, d.o_orderkey IS NULL AS dn, c.o_orderkey IS NULL AS cn,
  list_filter([CASE WHEN d.o_custkey IS DISTINCT FROM c.o_custkey THEN 'o_custkey' END, CASE WHEN d.o_orderpriority IS DISTINCT FROM c.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN d.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END], lambda x: x IS NOT NULL) AS ch
  FROM d FULL JOIN c ON d.o_orderkey = c.o_orderkey)
SELECT o_orderkey, CASE WHEN cn THEN 'create' WHEN dn THEN 'drop' ELSE 'alter' END AS op, CASE WHEN cn OR dn THEN '' ELSE array_to_string(ch, ',') END AS changed_cols FROM j WHERE cn OR dn OR len(ch) > 0"""


def versions(t: Tables):
    current = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    kept = current.where("o_orderkey % 17 <> 0").withColumns({"o_orderstatus": F.expr("CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END"), "o_orderpriority": F.expr("CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE o_orderpriority END")})
    added = current.where("o_orderkey % 19 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    return kept.unionByName(added), current


@query("j01_table_diff", _DIFF_SQL)
def _(t: Tables):
    return D.table_diff(*versions(t), ["o_orderkey"])


@query("j01_key_only_tables", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'drop' ELSE 'create' END AS op, '' AS changed_cols FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def _(t: Tables):
    return D.table_diff(t.customer.where("c_custkey % 2 = 0").select("c_custkey"), t.customer.where("c_custkey % 3 = 0").select("c_custkey"), ["c_custkey"])


@query("j01_diff_of_equal_tables", f"SELECT * FROM ({_DIFF_SQL}) WHERE FALSE")
def _(t: Tables):
    current = versions(t)[1]
    return D.table_diff(current.repartition(3), current, ["o_orderkey"])


@query("j02_cell_diff", f"""WITH d AS ({_DESIRED_SQL}), c AS ({_CURRENT_SQL})
SELECT o_orderkey, 'o_orderstatus' AS column_name, c.o_orderstatus AS old_value, d.o_orderstatus AS new_value FROM d JOIN c USING (o_orderkey) WHERE d.o_orderstatus IS DISTINCT FROM c.o_orderstatus
UNION ALL SELECT o_orderkey, 'o_orderpriority', c.o_orderpriority, d.o_orderpriority FROM d JOIN c USING (o_orderkey) WHERE d.o_orderpriority IS DISTINCT FROM c.o_orderpriority""")
def _(t: Tables):
    return D.cell_diff(*versions(t), ["o_orderkey"])


@query("j03_table_diff_renamed", """WITH c AS (SELECT s_suppkey, s_name FROM supplier), d AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT s_suppkey, 'alter' AS op, CASE WHEN s_suppkey % 10 = 0 THEN 's_name' ELSE '' END AS changed_cols, CASE WHEN s_suppkey >= 1000000 THEN s_suppkey - 1000000 END AS renamed_from FROM d WHERE s_suppkey % 5 = 0
UNION ALL SELECT CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END, 'drop', '', CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END FROM c WHERE s_suppkey % 7 = 0
UNION ALL SELECT 99999978, 'error', '', -77""")
def _(t: Tables):
    current = t.supplier.select("s_suppkey", "s_name")
    moved = F.expr("CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END")
    desired = current.where("s_suppkey % 7 <> 0").select(moved.alias("s_suppkey"), F.expr("CASE WHEN s_suppkey % 10 = 0 THEN 'new' ELSE s_name END").alias("s_name"))
    renames = current.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("old_key"), (F.col("s_suppkey") + 1000000).alias("new_key"))
    stale = t.region.limit(1).selectExpr("cast(-77 AS bigint) AS old_key", "cast(99999978 AS bigint) AS new_key")
    return D.table_diff_renamed(desired, current, "s_suppkey", renames.unionByName(stale))


@query("j04_drift", f"SELECT * FROM ({_DIFF_SQL}) WHERE op <> 'drop'")
def _(t: Tables):
    return D.drift(*versions(t), ["o_orderkey"])


@query("j04_drift_strict", _DIFF_SQL)
def _(t: Tables):
    return D.drift(*versions(t), ["o_orderkey"], strict=True)


@query("j13_protected_guard", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(t: Tables):
    removed = t.orders.where("o_orderkey % 17 = 0").select("o_orderkey", "o_orderstatus")
    return D.protected_guard(removed, t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("f04_content_fingerprint", r"SELECT page_id, sha256(trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS html_sha FROM pages")
def _(t: Tables):
    return D.content_fingerprint(t.pages, ["html"]).select("page_id", "html_sha")


@query("f11_map_delta", """WITH o AS (SELECT user_id, event_type AS key, sum(CASE WHEN event_id % 2 = 0 THEN 1 END) AS o, sum(CASE WHEN event_id % 3 = 0 THEN 1 END) AS n FROM events GROUP BY ALL)
SELECT user_id, key, CASE WHEN o IS NULL THEN 'ADD' WHEN n IS NULL THEN 'DROP' ELSE 'SET' END AS action, o::VARCHAR AS old_value, n::VARCHAR AS new_value FROM o WHERE o IS DISTINCT FROM n""")
def _(t: Tables):
    per = t.events.groupBy("user_id", "event_type").agg(F.sum(F.expr("CASE WHEN event_id % 2 = 0 THEN 1 END")).alias("o"), F.sum(F.expr("CASE WHEN event_id % 3 = 0 THEN 1 END")).alias("n"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("event_type", F.col(c).cast("string")))))
    return D.map_delta(per.groupBy("user_id").agg(entry("o").alias("old"), entry("n").alias("new")), "old", "new")


@query("a19_plan_summary", f"SELECT op, count(*) FILTER (op = 'create') AS SAFE, count(*) FILTER (op = 'alter') AS CAUTION, count(*) FILTER (op = 'drop') AS DESTRUCTIVE, 0::BIGINT AS MANUAL FROM ({_DIFF_SQL}) GROUP BY op")
def _(t: Tables):
    plan = D.table_diff(*versions(t), ["o_orderkey"]).withColumn("safety", F.expr("CASE op WHEN 'create' THEN 'SAFE' WHEN 'alter' THEN 'CAUTION' ELSE 'DESTRUCTIVE' END"))
    return D.plan_summary(plan)
