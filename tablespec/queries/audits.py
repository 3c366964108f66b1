"""A01, A03-A08, J05, W07, U05 and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import constraints as C
from tablespec.registry import Tables, query
from tablespec.spec import Check, Column, Domain, ForeignKey, TableSpec, Unique

MONEY = Domain("positive_money", "double", nullable=False, checks=(Check("not_negative", "VALUE >= 0"), Check("below_million", "VALUE < 1000000")))
STAR = [
    TableSpec("region", (Column("r_regionkey", "int", False), Column("r_name", "string", False)), (Unique("region_pk", ("r_regionkey",), True),)),
    TableSpec("nation", (Column("n_nationkey", "int", False), Column("n_name", "string", False), Column("n_regionkey", "int")), (Unique("nation_pk", ("n_nationkey",), True),), foreign_keys=(ForeignKey("nation_region", ("n_regionkey",), "region", ("r_regionkey",)),)),
    TableSpec("customer", (Column("c_custkey", "bigint", False), Column("c_name", "string", False), Column("c_nationkey", "int"), Column("c_acctbal", "double"), Column("c_mktsegment", "string")), (Unique("customer_pk", ("c_custkey",), True),), (Check("balance_not_negative", "c_acctbal >= 0"),), (ForeignKey("customer_nation", ("c_nationkey",), "nation", ("n_nationkey",)),), enums={"c_mktsegment": ("BUILDING", "AUTOMOBILE")}),
    TableSpec("supplier", (Column("s_suppkey", "bigint", False), Column("s_name", "string", False)), (Unique("supplier_pk", ("s_suppkey",), True),)),
    TableSpec("part", (Column("p_partkey", "bigint", False), Column("p_name", "string", False)), (Unique("part_pk", ("p_partkey",), True), Unique("part_name", ("p_name",))), (Check("size_small", "p_size <= 40"),)),
    TableSpec("orders", (Column("o_orderkey", "bigint", False), Column("o_custkey", "bigint", False)), (Unique("orders_pk", ("o_orderkey",), True),), foreign_keys=(ForeignKey("orders_customer", ("o_custkey",), "customer", ("c_custkey",)),), domains={"o_totalprice": MONEY}),
    TableSpec("lineitem", (Column("l_orderkey", "bigint", False), Column("l_linenumber", "int", False)), (Unique("lineitem_pk", ("l_orderkey", "l_linenumber"), True),), (Check("discount_small", "l_discount <= 0.05"),), (ForeignKey("lineitem_orders", ("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey("lineitem_part", ("l_partkey",), "part", ("p_partkey",)), ForeignKey("lineitem_supplier", ("l_suppkey",), "supplier", ("s_suppkey",)))),
]


def _row(table: str, name: str, kind: str, bad: str) -> str:
    return f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, '{kind}' AS constraint_type, count(*) AS checked_rows, count(*) FILTER ({bad}) AS violations FROM {table}"


def _unique(table: str, name: str, kind: str, cols: str) -> str:
    return f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, '{kind}' AS constraint_type, sum(n)::BIGINT AS checked_rows, sum(n - 1)::BIGINT AS violations FROM (SELECT count(*) AS n FROM {table} GROUP BY {cols})"


def _fk(table: str, name: str, col: str, parent: str, ref: str) -> str:
    return _row(table, name, "foreign key", f"{col} IS NOT NULL AND {col} NOT IN (SELECT {ref} FROM {parent})")


_REPORT = " UNION ALL ".join(
    [_row(s.name, f"{c.name}_not_null", "not null", f"{c.name} IS NULL") for s in STAR for c in s.columns if not c.nullable]
    + [_row(s.name, c.name, "check", f"NOT ({c.expr})") for s in STAR for c in s.checks]
    + [_unique(s.name, u.name, "primary key" if u.primary else "unique", ", ".join(u.columns)) for s in STAR for u in s.uniques]
    + [_fk(s.name, f.name, f.columns[0], f.parent, f.ref_columns[0]) for s in STAR for f in s.foreign_keys]
    + [_row("customer", "c_mktsegment_enum", "enum", "c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')")]
    + [_row("orders", "o_totalprice_positive_money_not_null", "domain", "o_totalprice IS NULL"), _row("orders", "o_totalprice_not_negative", "domain", "o_totalprice < 0"), _row("orders", "o_totalprice_below_million", "domain", "o_totalprice >= 1000000")]
)


@query("a07_constraint_report", _REPORT)
def _(t: Tables):
    return C.constraint_report({s.name: getattr(t, s.name) for s in STAR}, STAR)


@query("a01_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem WHERE l_quantity > 10 GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return C.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"], where="l_quantity > 10")


@query("a01_unique_nulls_not_distinct", "SELECT nullif(event_type, 'view') AS kind, user_id, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return C.unique_violations(t.events.select(F.expr("nullif(event_type, 'view')").alias("kind"), "user_id"), ["kind", "user_id"], nulls_distinct=False)


@query("a03_not_null_audit", "SELECT 'events' AS table_name, c || '_not_null' AS constraint_name, 'not null' AS constraint_type, (SELECT count(*) FROM events) AS checked_rows, CASE c WHEN 'kind' THEN (SELECT count(*) FROM events WHERE event_type = 'error') ELSE 0 END AS violations FROM (VALUES ('event_id'), ('kind')) v(c)")
def _(t: Tables):
    df = t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("kind"))
    return C.not_null_audit(df, TableSpec("events", (Column("event_id", "bigint", False), Column("kind", "string", False))))


@query("a04_check_audit", _row("lineitem", "cheap_or_many", "check", "NOT (CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice < 20000 OR l_quantity > 40 END)") + " UNION ALL " + _row("lineitem", "own_rows_tax", "check", "l_linestatus <> 'F' AND NOT (l_tax < 0.05)"))
def _(t: Tables):
    checks = (Check("cheap_or_many", "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice < 20000 OR l_quantity > 40 END"), Check("own_rows_tax", "l_tax < 0.05", no_inherit=True))
    return C.check_audit(t.lineitem, "lineitem", checks, child_rows="l_linestatus = 'F'")


@query("a04_check_offenders", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey >= 20 THEN 'nation' END) AS broken FROM customer WHERE c_acctbal < 0 OR c_nationkey >= 20")
def _(t: Tables):
    return C.check_offenders(t.customer, (Check("balance", "c_acctbal >= 0"), Check("nation", "c_nationkey < 20"))).select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query("a05_domain_audit", " UNION ALL ".join([_row("customer", "c_acctbal_positive_money_not_null", "domain", "c_acctbal IS NULL"), _row("customer", "c_acctbal_not_negative", "domain", "c_acctbal < 0"), _row("customer", "c_acctbal_below_million", "domain", "c_acctbal >= 1000000")]))
def _(t: Tables):
    return C.domain_audit(t.customer, "customer", {"c_acctbal": MONEY})


@query("a06_enum_audit", _row("orders", "o_orderpriority_enum", "enum", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')") + " UNION ALL " + _row("orders", "flags_enum", "enum", "o_orderstatus = 'P'"))
def _(t: Tables):
    df = t.orders.withColumn("flags", F.array("o_orderstatus", F.lit("F")))
    return C.enum_audit(df, "orders", {"o_orderpriority": ("1-URGENT", "2-HIGH"), "flags": ("F", "O")})


@query("a08_reconcile", "SELECT count(*) AS old_rows, count(*) AS new_rows, TRUE AS same FROM lineitem")
def _(t: Tables):
    return C.reconcile(t.lineitem, t.lineitem.repartition("l_partkey"))


@query("j05_fk_violations", "SELECT o_orderkey, o_custkey, 'orders_customer' AS constraint_name FROM orders WHERE o_custkey % 10 = 0")
def _(t: Tables):
    bad = C.fk_violations(t.orders, t.customer.where("c_custkey % 10 <> 0"), ["o_custkey"], ["c_custkey"])
    return bad.select("o_orderkey", "o_custkey", F.lit("orders_customer").alias("constraint_name"))


_PAIR = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS b FROM events"
_PARENT = "SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 3 <> 0 AND event_type <> 'error'"


def _pairs(t: Tables):
    child = t.events.selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS a", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS b")
    return child, t.events.where("user_id % 3 <> 0 AND event_type <> 'error'")


@query("j05_fk_match_full", f"SELECT event_id, a, b FROM ({_PAIR}) WHERE (a IS NULL) <> (b IS NULL) OR (a IS NOT NULL AND b IS NOT NULL AND (a, b) NOT IN ({_PARENT}))")
def _(t: Tables):
    child, parent = _pairs(t)
    return C.fk_violations(child, parent, ["a", "b"], ["user_id", "event_type"], "full")


@query("j05_fk_match_partial", f"SELECT event_id, a, b FROM ({_PAIR}) c WHERE NOT (a IS NULL AND b IS NULL) AND NOT EXISTS (SELECT 1 FROM ({_PARENT}) p WHERE (c.a IS NULL OR c.a = p.user_id) AND (c.b IS NULL OR c.b = p.event_type))")
def _(t: Tables):
    child, parent = _pairs(t)
    return C.fk_violations(child, parent, ["a", "b"], ["user_id", "event_type"], "partial")


@query("m05_validate_constraint", "SELECT 'customer' AS table_name, 'balance' AS constraint_name, count(*) AS checked_rows, count(*) FILTER (c_acctbal < 0) AS violations, count(*) FILTER (c_acctbal < 0) = 0 AS validated FROM customer UNION ALL SELECT 'customer', 'nation', 0, 0, TRUE")
def _(t: Tables):
    state = t.region.limit(1).selectExpr("'customer' AS table_name", "'nation' AS constraint_name", "true AS validated")
    return C.validate_constraint(t.customer, state, "customer", Check("balance", "c_acctbal >= 0")).unionByName(C.validate_constraint(t.customer, state, "customer", Check("nation", "c_nationkey < 20")))


def _rule(name: str, severity: str, bad: str, message: str):
    return lambda df: df.where(bad).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("o_orderkey").alias("key"), F.lit(message).alias("message"))


_RULES = "SELECT 'large' AS rule, 'error' AS severity, o_orderkey AS key, 'large order' AS message FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'pending', 'error', o_orderkey, 'still pending' FROM orders WHERE o_orderstatus = 'P'"


@query("u05_rule_chain", _RULES)
def _(t: Tables):
    rules = [_rule("large", "error", "o_totalprice > 100000", "large order"), _rule("pending", "warning", "o_orderstatus = 'P'", "still pending"), _rule("old", "warning", "o_orderdate < '1996-01-01'", "old order")]
    return C.rule_chain(t.orders, *rules, severities={"pending": "error", "old": "off"})


@query("w07_sample_violations", f"SELECT rule, severity, key, message FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY key) AS r FROM ({_RULES})) WHERE r <= 5")
def _(t: Tables):
    rules = [_rule("large", "error", "o_totalprice > 100000", "large order"), _rule("pending", "error", "o_orderstatus = 'P'", "still pending")]
    return C.sample_violations(C.rule_chain(t.orders, *rules), 5)
