"""W01-W04, W06, A18, O01, O03, J09 and J11."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import windows as W
from tablespec.registry import Tables, query

_PARTS = "SELECT user_id, event_id, 's' || (event_id % 3) AS source, nullif(event_type, 'view') AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END AS level, event_id % 50 = 0 AS flagged FROM events"


def _parts(t: Tables):
    return t.events.selectExpr("user_id", "event_id", "concat('s', event_id % 3) AS source", "nullif(event_type, 'view') AS kind", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END AS level", "event_id % 50 = 0 AS flagged")


@query("w01_merge_last_wins", f"WITH p AS ({_PARTS}) SELECT user_id, arg_max(kind, (source, event_id)) FILTER (kind IS NOT NULL) AS kind, arg_max(level, (source, event_id)) FILTER (level IS NOT NULL) AS level, bool_or(flagged) AS flagged FROM p GROUP BY 1")
def _(t: Tables):
    return W.merge_last_wins(_parts(t), ["user_id"], ["kind", "level"], ["source", "event_id"], sticky=["flagged"])


_LAG = "SELECT user_id, '{0}' AS attribute, ov::VARCHAR AS old_value, os AS old_source, {0}::VARCHAR AS new_value, source AS new_source FROM (SELECT *, lag({0}) OVER w AS ov, lag(source) OVER w AS os FROM p WHERE {0} IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY source, event_id)) WHERE os IS NOT NULL AND ov <> {0}"


@query("w01_merge_conflicts", f"WITH p AS ({_PARTS}) {_LAG.format('kind')} UNION ALL {_LAG.format('level')}")
def _(t: Tables):
    return W.merge_conflicts(_parts(t), ["user_id"], ["kind", "level"], ["source", "event_id"], "source")


@query("a18_merge_sets", f"WITH p AS ({_PARTS}) SELECT user_id, kind, any_value(level) AS level, count(*) AS sources FROM p WHERE event_id % 10 = 0 GROUP BY 1, 2 HAVING count(DISTINCT level) = 1")
def _(t: Tables):
    return W.merge_sets(_parts(t).where("event_id % 10 = 0"), ["user_id"], "kind", "level")[0]


@query("a18_merge_set_conflicts", f"WITH p AS ({_PARTS}) SELECT user_id, kind, count(DISTINCT level) AS definitions FROM p GROUP BY 1, 2 HAVING count(DISTINCT level) > 1")
def _(t: Tables):
    return W.merge_sets(_parts(t), ["user_id"], "kind", "level")[1]


@query("w02_assign_identity", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN -o_orderkey ELSE 1000 + 5 * (row_number() OVER (PARTITION BY o_orderkey % 100 = 0 ORDER BY o_orderdate, o_orderkey) - 1) END AS id FROM orders")
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.expr("CASE WHEN o_orderkey % 100 = 0 THEN -o_orderkey END").alias("id"))
    return W.assign_identity(rows, ["o_orderdate", "o_orderkey"], "id", 1000, 5).select("o_orderkey", "id")


@query("w03_assign_sequence", "SELECT o_orderkey, CASE WHEN k < 51 THEN 50 - k ELSE 120 - 1 * ((k - 51) % 121) END AS seq FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)")
def _(t: Tables):
    return W.assign_sequence(t.orders.select("o_orderkey"), ["o_orderkey"], "seq", 50, -1, 0, 120, cycle=True)


@query("w04_dedupe_names")
def _(t: Tables):
    return W.dedupe_names(t.part.select("p_partkey", "p_brand", F.substring("p_name", 1, 9).alias("p_name")), ["p_brand"], "p_name", 8, ["p_partkey"])


@query("w04_label_rules", "SELECT p_brand, count(*) AS rows, count(*) AS labels, TRUE AS fits, TRUE AS from_name, count(*) FILTER (p_partkey % 50 = 0) AS unnamed FROM part GROUP BY 1")
def _(t: Tables):
    """Labels are unique in their scope, fit, and are the name clipped, with a number where it was taken; null names have none."""
    named = t.part.select("p_partkey", "p_brand", F.expr("CASE WHEN p_partkey % 50 <> 0 THEN concat(substring(p_name, 1, 3), 'é', substring(p_name, 4, 5)) END").alias("p_name"))
    out = W.dedupe_names(named, ["p_brand"], "p_name", 8, ["p_partkey"])
    stem = F.regexp_replace("label", "[0-9]+$", "")
    return out.groupBy("p_brand").agg(
        F.count("*").alias("rows"), (F.count_distinct("label") + F.count_if(F.col("label").isNull())).alias("labels"), F.bool_and(F.coalesce(F.octet_length("label") <= 8, F.lit(True))).alias("fits"),
        F.bool_and(F.coalesce(F.startswith("p_name", stem), F.lit(True))).alias("from_name"), F.count_if(F.col("label").isNull() & F.col("p_name").isNull()).alias("unnamed"),
    )


_HISTORY = "SELECT event_id, user_id, event_type, old_event_type FROM (SELECT *, lag(event_type) OVER w AS old_event_type, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n > 1 AND event_type IS DISTINCT FROM old_event_type AND event_type <> 'error'"


@query("w06_change_events", _HISTORY)
def _(t: Tables):
    return W.change_events(t.events, ["user_id"], ["ts", "event_id"], ["event_type"], "event_type <> 'error'").select("event_id", "user_id", "event_type", "old_event_type")


@query("o01_index_order", "SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer ORDER BY nation ASC NULLS LAST, upper(c_name) DESC NULLS FIRST")
def _(t: Tables):
    return W.index_order(t.customer.select("c_custkey", "c_name", F.expr("nullif(c_nationkey, 3)").alias("nation")), [("nation", "asc"), ("upper(c_name)", "desc")]).select("c_custkey", "nation")


@query("o03_enum_order", "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS o_orderstatus_ordinal FROM orders WHERE o_orderstatus <> 'P'")
def _(t: Tables):
    return W.enum_order(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ("P", "O", "F"), at_least="O")


@query("j09_deprecated_references", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t: Tables):
    return W.deprecated_references(t.orders, t.customer, "o_custkey", "c_custkey", "o_orderstatus = 'F'", "c_acctbal < 0").select("o_orderkey", "o_custkey")


@query("j11_resolve_reference", """WITH s AS (SELECT event_id, user_id, user_id % 25 AS n FROM events), a AS (SELECT c_custkey AS t, c_custkey AS k FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT min(s_suppkey) AS t, s_nationkey AS k FROM supplier WHERE s_nationkey < 15 GROUP BY s_nationkey)
SELECT event_id, coalesce(a.t, b.t, s.n) AS resolved, CASE WHEN a.t IS NOT NULL THEN 1 WHEN b.t IS NOT NULL THEN 2 ELSE 3 END AS resolved_by FROM s LEFT JOIN a ON a.k = s.user_id LEFT JOIN b ON b.k = s.n""")
def _(t: Tables):
    refs = t.events.select("event_id", "user_id", (F.col("user_id") % 25).alias("n"))
    exact = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("t"), F.col("c_custkey").alias("k"))
    bare = t.supplier.where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("t"))
    own = t.nation.select(F.col("n_nationkey").cast("long").alias("t"), F.col("n_nationkey").alias("k"))
    return W.resolve_reference(refs, [(exact, [("user_id", "k")]), (bare, [("n", "k")]), (own, [("n", "k")])], "t").select("event_id", "resolved", "resolved_by")
