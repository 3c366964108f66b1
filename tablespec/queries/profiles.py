"""A02, A09-A14, M06, F05 and U01-U04."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Window
import numpy as np
from pyspark.sql import functions as F

from tablespec.functions import json as N
from tablespec.functions import udf as U
from tablespec.operators import stats as S
from tablespec.operators.lattice import functional_dependencies, inclusion_dependencies
from tablespec.registry import Tables, query


@query("a02_candidate_keys", "SELECT 'event_id' AS key UNION ALL SELECT 'ts,user_id' WHERE (SELECT count(*) = count(DISTINCT (ts, user_id)) AND count(*) > count(DISTINCT ts) FROM events) UNION ALL SELECT 'ts' WHERE (SELECT count(*) = count(DISTINCT ts) FROM events) UNION ALL SELECT 'ts,event_type' WHERE (SELECT count(*) = count(DISTINCT (ts, event_type)) AND count(*) > count(DISTINCT ts) FROM events)")
def _(t: Tables):
    return S.candidate_keys(t.events, ["event_id", "ts", "user_id", "event_type"])


def _stats_sql(table: str, c: str, k: int, numeric: bool) -> str:
    bounds = ("array_to_string([" + ", ".join(f"quantile_cont({c}::DOUBLE, {i / k})" for i in range(k + 1)) + "], ',')") if numeric else "NULL"
    mcv = f"(SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"
    return f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) / count(*) AS null_share, count(DISTINCT {c}) AS n_distinct, avg(strlen({c}::VARCHAR)) AS avg_width, {mcv} AS mcv, {bounds} AS histogram FROM {table}"


@query("a09_column_stats", _stats_sql("part", "p_size", 4, True) + " UNION ALL " + _stats_sql("part", "p_brand", 3, False))
def _(t: Tables):
    out = S.column_stats(t.part, {"p_size": 4, "p_brand": 3}, exact=True)
    return out.withColumns({c: F.array_join(c, ",") for c in ("mcv", "histogram")})


@query("a10_ext_ndistinct", " UNION ALL ".join(f"SELECT '{','.join(s)}' AS columns, count(*) AS n_distinct FROM (SELECT DISTINCT {','.join(s)} FROM lineitem)" for s in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"), ("l_returnflag", "l_linestatus", "l_linenumber"))))
def _(t: Tables):
    return S.ext_ndistinct(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


def _degree(a: str, b: str) -> str:
    return f"SELECT '{a}' AS determinant, '{b}' AS dependent, coalesce(sum(n) FILTER (k = 1), 0)::DOUBLE / sum(n)::DOUBLE AS degree FROM (SELECT {a}, count(*) AS n, count(DISTINCT {b}) AS k FROM c GROUP BY 1)"


@query("a11_ext_dependencies", "WITH c AS (SELECT c_nationkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 40 < 3) " + " UNION ALL ".join(_degree(a, b) for a in ("c_nationkey", "c_mktsegment", "n_regionkey") for b in ("c_nationkey", "c_mktsegment", "n_regionkey") if a != b))
def _(t: Tables):
    c = t.customer.where("c_custkey % 40 < 3").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return S.ext_dependencies(c, ["c_nationkey", "c_mktsegment", "n_regionkey"])


@query("a12_ext_mcv", "WITH n AS (SELECT count(*) AS n FROM orders), a AS (SELECT o_orderstatus, count(*) AS k FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS k FROM orders GROUP BY 1), c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY 1, 2 ORDER BY rows DESC, 1, 2 LIMIT 6) SELECT c.*, rows / n AS frequency, 1.0::DOUBLE * (a.k / n) * (b.k / n) AS base_frequency FROM c, n JOIN a ON a.o_orderstatus = c.o_orderstatus JOIN b ON b.o_orderpriority = c.o_orderpriority")
def _(t: Tables):
    return S.ext_mcv(t.orders, ["o_orderstatus", "o_orderpriority"], 6)


@query("a13_custom_aggregate", "SELECT l_returnflag, bit_xor(l_orderkey * 31 + l_linenumber) AS digest FROM lineitem GROUP BY 1")
def _(t: Tables):
    return S.custom_aggregate(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"], lambda: 0, lambda s, k, n: s ^ int(np.bitwise_xor.reduce(k * 31 + n)), lambda a, b: a ^ b, lambda s: s, "digest", "bigint")


@query("a13_product", "SELECT n_regionkey, product(n_nationkey + 1) AS product FROM nation GROUP BY 1")
def _(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.product(F.col("n_nationkey") + 1).alias("product"))


@query("a14_ordered_set_aggregate", "WITH m AS (SELECT o_orderpriority, o_custkey AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1) SELECT o_orderpriority, quantile_disc(o_custkey, 0.5) AS disc_50, quantile_cont(o_custkey::DOUBLE, 0.5) AS cont_50, quantile_disc(o_custkey, 0.9) AS disc_90, quantile_cont(o_custkey::DOUBLE, 0.9) AS cont_90, any_value(mode) AS mode FROM orders JOIN m USING (o_orderpriority) GROUP BY 1")
def _(t: Tables):
    return S.ordered_set_aggregate(t.orders, ["o_orderpriority"], "o_custkey", [0.5, 0.9])


@query("m06_infer_spec", """SELECT * FROM (VALUES ('event_id', 'bigint', FALSE, TRUE, TRUE, NULL), ('user', 'bigint', TRUE, FALSE, FALSE, NULL), ('kind', 'varchar(' || (SELECT max(length(event_type)) FROM events) || ')', FALSE, FALSE, FALSE, (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events)), ('props', 'json', FALSE, FALSE, FALSE, NULL), ('day', 'date', FALSE, FALSE, FALSE, NULL)) v(column_name, inferred_type, nullable, unique_values, serial, labels)""")
def _(t: Tables):
    rows = t.events.selectExpr("event_id", "nullif(cast(user_id AS string), '7') AS user", "event_type AS kind", "props", "cast(cast(ts AS date) AS string) AS day")
    return S.infer_spec(rows, enum_most=6)


@query("m06_fk_candidates", "SELECT 'o_custkey' AS column_name, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey NOT IN (SELECT c_custkey FROM customer)) FROM orders")
def _(t: Tables):
    return S.fk_candidates(t.orders, ["o_custkey", "o_orderkey"], t.customer, "c_custkey")


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("a02_candidate_keys_wide", " UNION ALL ".join(
    f"SELECT '{','.join(s)}' AS key FROM (SELECT count(*) AS n FROM lineitem) WHERE n = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem))"
    + "".join(f" AND n > (SELECT count(*) FROM (SELECT DISTINCT {', '.join(x)} FROM lineitem))" for w in range(1, len(s)) for x in combinations(s, w))
    for width in (1, 2, 3, 4) for s in combinations(_WIDE, width)))
def _(t: Tables):
    return S.candidate_keys(t.lineitem, _WIDE, 4)


_FD = ["c_nationkey", "c_mktsegment", "n_regionkey", "n_name"]


def _determined(x: tuple[str, ...], a: str) -> str:
    group = f"GROUP BY {', '.join(x)}" if x else ""
    return f"(SELECT max(k) = 1 FROM (SELECT count(DISTINCT {a}) AS k FROM c {group}))"


@query("a11_functional_dependencies", "WITH c AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey) " + " UNION ALL ".join(
    f"SELECT '{','.join(x)}' AS determinant, '{a}' AS dependent WHERE {_determined(x, a)}" + "".join(f" AND NOT {_determined(y, a)}" for w in range(len(x)) for y in combinations(x, w))
    for a in _FD for width in (0, 1, 2) for x in combinations([c for c in _FD if c != a], width)))
def _(t: Tables):
    return functional_dependencies(t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")), _FD, 2)


_KEYED = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "part": ["p_partkey", "p_size"], "events": ["user_id"]}
_ALL = [(table, c) for table, cols in _KEYED.items() for c in cols]


@query("m06_inclusion_dependencies", " UNION ALL ".join(f"SELECT '{a}.{c}' AS dependent, '{b}.{d}' AS referenced, count(DISTINCT {c}) AS n_values, count(DISTINCT {c}) FILTER ({c} NOT IN (SELECT {d} FROM {b} WHERE {d} IS NOT NULL)) AS n_missing FROM {a} HAVING count({c}) > 0" for a, c in _ALL for b, d in _ALL if (a, c) != (b, d)))
def _(t: Tables):
    return inclusion_dependencies({table: getattr(t, table).select(*cols) for table, cols in _KEYED.items()})


@query("a09_forty_columns", " UNION ALL ".join(_stats_sql("(SELECT *, " + ", ".join(f"(p_partkey * {k} + p_size) % {k + 2} AS c{k}" for k in range(40)) + " FROM part)", f"c{k}", 3, True) for k in range(40)))
def _(t: Tables):
    wide = t.part.select(*(F.expr(f"(p_partkey * {k} + p_size) % {k + 2}").alias(f"c{k}") for k in range(40)))
    return S.column_stats(wide, {f"c{k}": 3 for k in range(40)}, exact=True).withColumns({c: F.array_join(c, ",") for c in ("mcv", "histogram")})


_JSON = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{\"k\": \"x\", \"unit\": \"m\"}' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{broken' END"


@query("f05_json_conform", "SELECT event_id, event_id % 5 <> 3 AS valid, CASE event_id % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'measure' WHEN 2 THEN 'list' END AS branch, CASE WHEN event_id % 5 = 0 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 5 = 1 THEN 'm' END AS unit, CASE WHEN event_id % 5 = 2 THEN 2 END AS items FROM events")
def _(t: Tables):
    shapes = [N.Shape("point", {"k": "bigint"}), N.Shape("measure", {"k": "string", "unit": "string"}), N.Shape("list", element="bigint")]
    out = N.json_conform(t.events.selectExpr("event_id", f"{_JSON} AS j"), "j", shapes)
    return out.select("event_id", "valid", "branch", "point.k", "measure.unit", F.when(F.col("list").isNotNull(), F.size("list")).alias("items"))


@query("u01_sql_function", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables):
    t.orders.createOrReplaceTempView("u01_orders")
    U.sql_function(t.spark, "user_order_count", "id BIGINT", "BIGINT", "(SELECT count(*) FROM u01_orders WHERE o_custkey = id)")
    t.customer.createOrReplaceTempView("u01_customer")
    return t.spark.sql("SELECT c_custkey, user_order_count(c_custkey) AS orders FROM u01_customer")


@query("u02_table_function", "SELECT r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey AND n_nationkey >= 5")
def _(t: Tables):
    t.nation.createOrReplaceTempView("u02_nation")
    U.table_function(t.spark, "nations_of", "region INT, least INT", "nation INT, name STRING", "SELECT n_nationkey, n_name FROM u02_nation WHERE n_regionkey = region AND n_nationkey >= least")
    t.region.createOrReplaceTempView("u02_region")
    return t.spark.sql("SELECT r.r_name, n.nation AS n_nationkey, n.name AS n_name FROM u02_region r, LATERAL nations_of(r.r_regionkey, 5) n")


@query("u03_strict", "SELECT event_id, CASE WHEN event_type <> 'view' AND user_id <> 3 THEN event_type || '/' || user_id END AS label FROM events")
def _(t: Tables):
    label = U.strict(lambda a, b: F.concat_ws("/", a, b))
    return t.events.select("event_id", label(F.expr("nullif(event_type, 'view')"), F.expr("cast(nullif(user_id, 3) AS string)")).alias("label"))


@query("u04_window_function", "SELECT event_id, max(event_id) OVER w - min(event_id) OVER w AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)

    def spread(values: pd.Series) -> float:
        return int(values.max() - values.min())

    return t.events.withColumn("spread", U.window_function(spread, "bigint", "event_id", w)).select("event_id", "spread")
