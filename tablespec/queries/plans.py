"""M01 and M02 where a plan's rules are over columns that the plan itself makes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.paths import work_dir
from tablespec.plans.apply import NotApplied, apply_table, migrate_table
from tablespec.plans.jobs import plan_table
from tablespec.registry import Tables, query
from tablespec.spec import Check, Column, Domain, ForeignKey, TableSpec, Unique


def _rows(*rows: str) -> str:
    """The oracle of a plan: op, column, old, new, class, evidence and safety of each change, numbered."""
    listed = ", ".join(f"({i}, {r})" for i, r in enumerate(rows, 1))
    return f"SELECT seq::INT AS seq, op, column_name, old_def, new_def, static_class, evidence_rows::BIGINT AS evidence_rows, safety FROM (VALUES {listed}) v(seq, op, column_name, old_def, new_def, static_class, evidence_rows, safety)"


_ORDERS = TableSpec("orders", (Column("o_orderkey", "bigint", False), Column("o_custkey", "bigint"), Column("o_totalprice", "double")))


def _with(*more: Column, **rules) -> TableSpec:
    return TableSpec("orders", (*_ORDERS.columns, *more), **rules)


@query("m01_plan_checked_new_column", _rows(
    "'add column', 'thousands', '', 'int', 'SAFE', 0, 'SAFE'",
    "'add constraint', 'few', '', 'few', 'CAUTION', (SELECT count(*) FROM orders WHERE floor(o_totalprice / 1000) >= 100), 'CAUTION'"))
def _(t: Tables):
    new = _with(Column("thousands", "int", default="floor(o_totalprice / 1000)"), checks=(Check("few", "thousands < 100"),))
    return plan_table(t.orders, _ORDERS, new)


@query("m01_plan_checked_renamed_column", _rows(
    "'rename column', 'price', 'o_totalprice', 'price', 'CAUTION', 0, 'CAUTION'",
    "'change type', 'price', 'double', 'int', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE floor(o_totalprice) <> o_totalprice), 'DESTRUCTIVE'",
    "'set not null', 'price', '', '', 'CAUTION', (SELECT count(*) FROM orders WHERE o_totalprice > 2147483647), 'CAUTION'",
    "'add constraint', 'cheap', '', 'cheap', 'CAUTION', (SELECT count(*) FROM orders WHERE trunc(o_totalprice) >= 100000), 'CAUTION'"))
def _(t: Tables):
    new = TableSpec("orders", (*_ORDERS.columns[:2], Column("price", "int", False)), checks=(Check("cheap", "price < 100000"),), renames={"o_totalprice": "price"})
    return plan_table(t.orders, _ORDERS, new)


@query("m01_plan_domain_on_new_column", _rows(
    "'add column', 'margin', '', 'double', 'SAFE', 0, 'SAFE'",
    "'add domain', 'margin', '', 'gain', 'CAUTION', (SELECT count(*) FROM orders WHERE o_custkey % 10 = 0 OR o_totalprice < 50000), 'CAUTION'"))
def _(t: Tables):
    gain = Domain("gain", "double", nullable=False, checks=(Check("not_lost", "VALUE >= 0"),))
    new = _with(Column("margin", "double", default="CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice - 50000 END"), domains={"margin": gain})
    return plan_table(t.orders, _ORDERS, new)


@query("m01_plan_generated_over_new_column", _rows(
    "'set generated', 'part', 'o_totalprice / 2', 'o_totalprice / parts', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_custkey % 3 = 0 AND o_totalprice <> 0), 'DESTRUCTIVE'",
    "'add column', 'parts', '', 'int', 'SAFE', 0, 'SAFE'",
    "'add constraint', 'part_small', '', 'part_small', 'CAUTION', (SELECT count(*) FROM orders WHERE o_totalprice / CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 2 END >= 100000), 'CAUTION'"))
def _(t: Tables):
    old = _with(Column("part", "double", generated="o_totalprice / 2"))
    new = _with(Column("part", "double", generated="o_totalprice / parts"), Column("parts", "int", default="CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 2 END"), checks=(Check("part_small", "part < 100000"),))
    return plan_table(t.orders.withColumn("part", F.expr("o_totalprice / 2")), old, new)


_PRIORITY = "split_part(o_orderpriority, '-', 1)"


@query("m01_plan_attributes_renamed_and_retyped", _rows(
    "'rename attribute', 'info.level', 'rank', 'level', 'SAFE', 0, 'SAFE'",
    f"'change attribute', 'info.level', 'string', 'tinyint', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE try_cast({_PRIORITY} AS TINYINT) IS NULL), 'DESTRUCTIVE'",
    "'drop attribute', 'info.more.gone', 'string', '', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_custkey % 2 = 0), 'DESTRUCTIVE'",
    "'rename attribute', 'items.euros', 'price', 'euros', 'SAFE', 0, 'SAFE'",
    "'change attribute', 'items.euros', 'double', 'smallint', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE trunc(o_totalprice) > 32767), 'DESTRUCTIVE'",
    "'add attribute', 'items.note', '', 'string', 'SAFE', 0, 'SAFE'"))
def _(t: Tables):
    old = TableSpec("orders", (Column("o_orderkey", "bigint"), Column("info", "struct<rank:string,more:struct<gone:string,kept:int>>"), Column("items", "array<struct<price:double>>")))
    new = TableSpec("orders", (Column("o_orderkey", "bigint"), Column("info", "struct<level:tinyint,more:struct<kept:int>>"), Column("items", "array<struct<euros:smallint,note:string>>")), renames={"info.rank": "info.level", "items.price": "items.euros"})
    gone = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority"))
    info = F.struct(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("rank"), F.struct(gone.alias("gone"), F.lit(1).alias("kept")).alias("more"))
    items = F.array(F.struct(F.lit(1.0).alias("price")), F.struct(F.col("o_totalprice").alias("price")))
    return plan_table(t.orders.select("o_orderkey", info.alias("info"), items.alias("items")), old, new)


@query("m01_plan_keys", _rows(
    "'rename column', 'l_order', 'l_orderkey', 'l_order', 'CAUTION', 0, 'CAUTION'",
    "'add constraint', 'lines', '', 'lines', 'CAUTION', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)), 'CAUTION'",
    "'add constraint', 'cheap_parts', '', 'cheap_parts', 'CAUTION', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY l_partkey, l_suppkey)), 'CAUTION'",
    "'add constraint', 'line_order', '', 'line_order', 'CAUTION', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0)), 'CAUTION'",
    "'add constraint', 'line_part', '', 'line_part', 'CAUTION', NULL, 'CAUTION'"))
def _(t: Tables):
    columns = (Column("l_linenumber", "int"), Column("l_partkey", "bigint"), Column("l_suppkey", "bigint"), Column("l_quantity", "double"))
    old = TableSpec("lineitem", (Column("l_orderkey", "bigint"), *columns))
    new = TableSpec(
        "lineitem", (Column("l_order", "bigint"), *columns), (Unique("lines", ("l_order", "l_linenumber"), True), Unique("cheap_parts", ("l_partkey", "l_suppkey"), where="l_quantity < 5")),
        foreign_keys=(ForeignKey("line_order", ("l_order",), "orders", ("o_orderkey",)), ForeignKey("line_part", ("l_partkey",), "part", ("p_partkey",))), renames={"l_orderkey": "l_order"},
    )
    kept = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return plan_table(kept, old, new, parents={"orders": t.orders.where("o_custkey % 3 <> 0")})


_BOUGHT = TableSpec("orders", _ORDERS.columns, foreign_keys=(ForeignKey("buyer", ("o_custkey",), "customer", ("c_custkey",)),))


@query("m02_apply_foreign_keys", "SELECT p AS parents, NOT EXISTS (SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE p = 'all' OR c_custkey % 2 = 0)) AS applied FROM (VALUES ('some'), ('all')) v(p)")
def _(t: Tables):
    def tried(name: str, customers) -> tuple[str, bool]:
        try:
            apply_table(t.orders, _BOUGHT, work_dir(t.spark), allow_destructive=True, parents={"customer": customers})
        except NotApplied:
            return name, False
        return name, True

    return t.spark.createDataFrame([tried("some", t.customer.where("c_custkey % 2 = 0")), tried("all", t.customer)], "parents string, applied boolean")


@query("m02_migrate_table", f"SELECT o_orderkey AS id, try_cast({_PRIORITY} AS TINYINT) AS level, o_totalprice AS euros, o_totalprice / 2 AS half FROM orders")
def _(t: Tables):
    old = TableSpec("orders", (Column("o_orderkey", "bigint"), Column("info", "struct<rank:string>"), Column("items", "array<struct<price:double,drop:int>>")))
    new = TableSpec(
        "orders", (Column("id", "bigint", False), Column("info", "struct<level:tinyint>"), Column("items", "array<struct<euros:double>>"), Column("parts", "int", default="2"), Column("half", "double", generated="items[0].euros / parts")),
        (Unique("pk", ("id",), True),), (Check("two", "parts = 2"), Check("halved", "half <= items[0].euros")), renames={"o_orderkey": "id", "info.rank": "info.level", "items.price": "items.euros"},
    )
    info, items = F.struct(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("rank")), F.array(F.struct(F.col("o_totalprice").alias("price"), F.lit(0).alias("drop")))
    done, _ = migrate_table(t.orders.select("o_orderkey", info.alias("info"), items.alias("items")), old, new, work_dir(t.spark), allow_destructive=True)
    return done.select("id", "info.level", F.col("items")[0]["euros"].alias("euros"), "half")
