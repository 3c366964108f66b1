"""J12, O04, O05 and M07.

The conversation turns form chains and the first turns a tree (conv // 3), so depth and fan-out
grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import graphs as G
from tablespec.registry import Tables, query


def _tree(t: Tables):
    return t.customer.where("c_custkey > 0").select((F.floor(F.col("c_custkey") / 3)).cast("long").alias("parent"), F.col("c_custkey").alias("node"))


@query("j12_recursive_view", """WITH RECURSIVE r AS (SELECT 0::BIGINT AS node, 0 AS depth, '0' AS path UNION ALL SELECT c.c_custkey, r.depth + 1, r.path || '/' || c.c_custkey FROM r JOIN customer c ON c.c_custkey // 3 = r.node AND c.c_custkey > 0) SELECT * FROM r""")
def _(t: Tables):
    base = t.customer.where("c_custkey = 0").select(F.col("c_custkey").alias("node"))
    out = G.recursive_view(base, _tree(t))
    return out.select("node", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


_TURNS = "SELECT conv_id * 100 + turn AS node, conv_id * 100 + turn - 1 AS needs FROM conversations WHERE turn > 0 UNION SELECT conv_id * 100, (conv_id // 3) * 100 + turn FROM conversations WHERE conv_id > 0 AND turn = 1"


def _turns(t: Tables):
    c = t.conversations
    chain = c.where("turn > 0").selectExpr("conv_id * 100 + turn AS node", "conv_id * 100 + turn - 1 AS needs")
    return chain.union(c.where("conv_id > 0 AND turn = 1").selectExpr("conv_id * 100 AS node", "(conv_id div 3) * 100 + turn AS needs")).distinct()


@query("o04_dependency_levels", f"WITH RECURSIVE e AS ({_TURNS}), n AS (SELECT DISTINCT conv_id * 100 + turn AS node FROM conversations), l AS (SELECT node, 1 AS level FROM n WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, l.level + 1 FROM l JOIN e ON e.needs = l.node) SELECT node, max(level) AS level FROM l GROUP BY 1")
def _(t: Tables):
    return G.dependency_levels(_turns(t), t.conversations.selectExpr("conv_id * 100 + turn AS node"))


_RING = "SELECT s_suppkey AS src, CASE WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 0 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS dst, s_suppkey % 2 = 1 AND s_suppkey % 5 = 4 AS late FROM supplier"


@query("o05_cycle_members", f"WITH RECURSIVE e AS ({_RING}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), h AS (SELECT src, dst FROM e WHERE NOT late UNION SELECT h.src, e.dst FROM h JOIN e ON h.dst = e.src AND NOT e.late) SELECT src AS node, src IN (SELECT src FROM h WHERE src = dst) AS blocked FROM c WHERE src = dst")
def _(t: Tables):
    return G.cycle_members(t.supplier.selectExpr("s_suppkey AS src", "CASE WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 0 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS dst", "s_suppkey % 2 = 1 AND s_suppkey % 5 = 4 AS deferrable"))


@query("m07_deferred_load_order", "SELECT s_suppkey AS node, CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 4 - s_suppkey % 4 END::INT AS level, CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS deferred FROM supplier WHERE s_suppkey < 4 * (SELECT count(*) // 4 FROM supplier)")
def _(t: Tables):
    n = t.supplier.where(F.col("s_suppkey") < 4 * F.floor(F.lit(t.supplier.count()) / 4))
    fks = n.selectExpr("s_suppkey AS node", "CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - 3 ELSE s_suppkey + 1 END AS needs", "s_suppkey % 4 = 3 AS deferrable")
    return G.deferred_load_order(n.selectExpr("s_suppkey AS node"), fks)
