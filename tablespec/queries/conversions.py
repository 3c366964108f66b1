"""F01, F02, F06, F07, F10, M01 and M03."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.functions import types as X
from tablespec.operators.constraints import union_all
from tablespec.plans import jobs as J
from tablespec.registry import Tables, query
from tablespec.spec import Check, Column, Domain, Partition, PartitionBy, Sequence, TableSpec


def _audit(table: str, col: str, old: str, new: str, fail: str = "FALSE", trunc: str = "FALSE", rnd: str = "FALSE", over: str = "FALSE") -> str:
    return f"SELECT '{col}' AS column_name, '{old}' AS from_type, '{new}' AS to_type, count(*) AS rows, count(*) FILTER ({fail}) AS cast_failures, count(*) FILTER ({trunc}) AS truncated, count(*) FILTER ({rnd}) AS rounded, count(*) FILTER ({over}) AS overflowed FROM {table}"


@query("f01_cast_audit", " UNION ALL ".join([
    _audit("orders", "o_totalprice", "double", "int", rnd="round(o_totalprice) <> o_totalprice"),
    _audit("orders", "o_totalprice", "double", "smallint", rnd="round(o_totalprice) <= 32767 AND round(o_totalprice) <> o_totalprice", over="round(o_totalprice) > 32767"),
    _audit("orders", "o_orderkey", "bigint", "smallint", over="o_orderkey > 32767"),
    _audit("orders", "o_orderdate", "timestamp_ntz", "date", trunc="date_trunc('day', o_orderdate) <> o_orderdate"),
    _audit("orders", "o_orderpriority", "string", "int", fail="TRUE"),
    _audit("orders", "o_custkey", "bigint", "decimal"),
    _audit("orders", "wide", "bigint", "decimal", over="o_orderkey * 10000000 >= 10000000000"),
    _audit("orders", "wide", "bigint", "decimal(19,0)"),
]))
def _(t: Tables):
    return X.audits(t.orders.withColumn("wide", F.col("o_orderkey") * 10000000), [("wide", "decimal"), ("wide", "decimal(19,0)"), ("o_totalprice", "int"), ("o_totalprice", "smallint"), ("o_orderkey", "smallint"), ("o_orderdate", "date"), ("o_orderpriority", "int"), ("o_custkey", "decimal")])


@query("f02_typmod_audit", " UNION ALL ".join([
    _audit("part", "p_name", "varchar(100)", "varchar(8)", trunc="length(p_name) > 8"),
    _audit("part", "p_name", "varchar(8)", "varchar(100)"),
    _audit("part", "p_retailprice", "numeric(12,2)", "numeric(5,1)", rnd="round(p_retailprice::DECIMAL(18,2), 1) < 10000 AND round(p_retailprice::DECIMAL(18,2), 1) <> p_retailprice::DECIMAL(18,2)", over="round(p_retailprice::DECIMAL(18,2), 1) >= 10000"),
    _audit("part", "p_retailprice", "numeric(10,2)", "numeric(10,4)", over="p_retailprice >= 1000000"),
    _audit("part", "p_brand", "bit(8)", "bit(7)", trunc="length(p_brand) <> 7"),
]) + " UNION ALL " + _audit("events", "ts", "timestamp(6)", "timestamp(0)", trunc="date_trunc('second', ts) <> ts")
    + " UNION ALL " + _audit("events", "ts", "timestamp(6)", "timestamp(2)", trunc="epoch_us(ts) % 10000 <> 0") + " UNION ALL " + _audit("part", "wide", "numeric(38,2)", "numeric(30,2)", over="p_size > 25"))
def _(t: Tables):
    wide = t.part.select(F.expr("CASE WHEN p_size > 25 THEN 1 ELSE 0 END * 10000000000000000000000000000BD * 1.00BD").cast("decimal(38,2)").alias("wide"))
    hard = [X.typmod_audit(t.events, "ts", "timestamp(6)", "timestamp(2)"), X.typmod_audit(wide, "wide", "numeric(38,2)", "numeric(30,2)")]
    return union_all([X.typmod_audit(t.part, c, a, b) for c, a, b in (("p_name", "varchar(100)", "varchar(8)"), ("p_name", "varchar(8)", "varchar(100)"), ("p_retailprice", "numeric(12,2)", "numeric(5,1)"), ("p_retailprice", "numeric(10,2)", "numeric(10,4)"), ("p_brand", "bit(8)", "bit(7)"))] + [X.typmod_audit(t.events, "ts", "timestamp(6)", "timestamp(0)")] + hard)


@query("f06_evolve_struct", "SELECT c_custkey, c_name AS title, c_nationkey::BIGINT AS nation, c_acctbal > 5000 AS vip FROM customer")
def _(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("info"))
    return X.evolve_struct(df, "info", add={"vip": "c_acctbal > 5000"}, drop=("segment",), rename={"name": "title"}, retype={"nation": "bigint"}).select("c_custkey", "info.*")


_PARTS = "string_split(o_orderpriority, '-')"


@query("f07_array_cast", f"SELECT o_orderkey, array_to_string(list_transform({_PARTS}, lambda x: coalesce(try_cast(x AS INT)::VARCHAR, '?')), ',') AS parts, array_to_string(list_filter({_PARTS}, lambda x: try_cast(x AS INT) IS NULL), ',') AS failing FROM orders")
def _(t: Tables):
    done = X.array_cast(t.orders.select("o_orderkey", F.split("o_orderpriority", "-").alias("parts")), "parts", "int")
    return done.select("o_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",", "?").alias("parts"), F.array_join("failing", ",").alias("failing"))


@query("f07_array_cast_audit", _audit("embeddings", "embedding", "array<float>", "array<tinyint>", fail="FALSE"))
def _(t: Tables):
    return X.array_cast_audit(t.embeddings, "embedding", "tinyint")


@query("f10_enum_remap", "SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' ELSE event_type END AS event_type FROM events")
def _(t: Tables):
    return X.enum_remap(t.events.select("event_id", "event_type"), ["event_type"], {"click": "touch", "view": "touch"})


_OLD = TableSpec("orders", (Column("o_orderkey", "bigint", False), Column("o_custkey", "bigint"), Column("o_totalprice", "double"), Column("o_orderstatus", "string"), Column("o_orderpriority", "string")), checks=(Check("known_status", "o_orderstatus IN ('F', 'O', 'P')"),), enums={"o_orderstatus": ("F", "O", "P")})
_NEW = TableSpec("orders", (Column("id", "bigint", False), Column("o_custkey", "int", False), Column("o_totalprice", "int"), Column("o_orderstatus", "string"), Column("note", "string"), Column("region", "int", False)), checks=(Check("price_small", "o_totalprice < 100000"),), enums={"o_orderstatus": ("O", "F", "X")}, renames={"o_orderkey": "id"})


@query("m01_plan_table", """SELECT seq::INT AS seq, op, column_name, old_def, new_def, static_class, evidence_rows::BIGINT AS evidence_rows, safety FROM (VALUES
 (1, 'rename column', 'id', 'o_orderkey', 'id', 'CAUTION', 0, 'CAUTION'),
 (2, 'drop column', 'o_orderpriority', 'string', '', 'DESTRUCTIVE', (SELECT count(o_orderpriority) FROM orders), 'DESTRUCTIVE'),
 (3, 'change type', 'o_custkey', 'bigint', 'int', 'DESTRUCTIVE', 0, 'CAUTION'),
 (4, 'set not null', 'o_custkey', '', '', 'CAUTION', 0, 'CAUTION'),
 (5, 'change type', 'o_totalprice', 'double', 'int', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE floor(o_totalprice) <> o_totalprice), 'DESTRUCTIVE'),
 (6, 'add column', 'note', '', 'string', 'SAFE', 0, 'SAFE'),
 (7, 'add column', 'region', '', 'int', 'CAUTION', 0, 'CAUTION'),
 (8, 'drop constraint', 'known_status', 'known_status', '', 'DESTRUCTIVE', 0, 'DESTRUCTIVE'),
 (9, 'add constraint', 'price_small', '', 'price_small', 'CAUTION', (SELECT count(*) FROM orders WHERE o_totalprice >= 100000), 'CAUTION'),
 (10, 'add label', 'o_orderstatus', '', 'X', 'MANUAL', 0, 'MANUAL'),
 (11, 'remove label', 'o_orderstatus', 'P', '', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), 'DESTRUCTIVE')
) v(seq, op, column_name, old_def, new_def, static_class, evidence_rows, safety)""")
def _(t: Tables):
    return J.plan_table(t.orders, _OLD, _NEW)


@query("m01_plan_equal_specs", "SELECT 1::INT AS seq, '' AS op, '' AS column_name, '' AS old_def, '' AS new_def, '' AS static_class, 0::BIGINT AS evidence_rows, '' AS safety FROM orders WHERE FALSE")
def _(t: Tables):
    return J.plan_table(t.orders, _OLD, _OLD)


_KIND_OLD = TableSpec("orders", (Column("o_orderkey", "bigint"), Column("info", "struct<a:bigint,b:string,c:string>"), Column("half", "double", generated="o_totalprice / 2")), domains={"o_totalprice": Domain("price", "double", default="0", checks=(Check("positive", "VALUE >= 0"),))}, sequences={"o_orderkey": Sequence()},
                      partition_by=PartitionBy("range", ("o_custkey",), (Partition("low", upper=(100,)), Partition("mid", lower=(100,), upper=(120,)), Partition("high", lower=(120,)))), query="SELECT 1", stored=True)
_KIND_NEW = TableSpec("orders", (Column("o_orderkey", "bigint"), Column("info", "struct<a:int,title:string,d:int>"), Column("half", "double", generated="o_totalprice / 4")), domains={"o_totalprice": Domain("price", "double", nullable=False, checks=(Check("cheap", "VALUE < 100000"),))}, sequences={"o_orderkey": Sequence(increment=5)},
                      partition_by=PartitionBy("range", ("o_custkey",), (Partition("low", upper=(50,)), Partition("mid", lower=(100,), upper=(120,)), Partition("top", lower=(150,)))), query="SELECT 2", stored=True, renames={"info.b": "info.title"})


@query("m01_plan_table_kinds", """SELECT seq::INT AS seq, op, column_name, old_def, new_def, static_class, evidence_rows::BIGINT AS evidence_rows, static_class AS safety FROM (VALUES
 (1, 'rename attribute', 'info.title', 'b', 'title', 'SAFE', 0),
 (2, 'drop attribute', 'info.c', 'string', '', 'DESTRUCTIVE', (SELECT count(o_orderpriority) FROM orders)),
 (3, 'change attribute', 'info.a', 'bigint', 'int', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_orderkey * 1000000 > 2147483647)),
 (4, 'add attribute', 'info.d', '', 'int', 'SAFE', 0),
 (5, 'set generated', 'half', 'o_totalprice / 2', 'o_totalprice / 4', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_totalprice / 2 <> o_totalprice / 4)),
 (6, 'drop domain default', 'o_totalprice', '0', '', 'SAFE', 0),
 (7, 'set domain not null', 'o_totalprice', '', '', 'CAUTION', 0),
 (8, 'drop domain check', 'o_totalprice', 'positive', '', 'SAFE', 0),
 (9, 'add domain check', 'o_totalprice', '', 'cheap', 'CAUTION', (SELECT count(*) FROM orders WHERE o_totalprice >= 100000)),
 (10, 'alter sequence', 'o_orderkey', '', '', 'SAFE', 0),
 (11, 'change partition bounds', 'low', 'from None to (100,)', 'from None to (50,)', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_custkey < 100)),
 (12, 'add partition', 'top', '', 'from (150,) to None', 'SAFE', 0),
 (13, 'drop partition', 'high', 'from (120,) to None', '', 'DESTRUCTIVE', (SELECT count(*) FROM orders WHERE o_custkey >= 120)),
 (14, 'change stored query', 'orders', 'SELECT 1', 'SELECT 2', 'DESTRUCTIVE', 0)
) v(seq, op, column_name, old_def, new_def, static_class, evidence_rows)""")
def _(t: Tables):
    info = F.struct((F.col("o_orderkey") * 1000000).alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c"))
    return J.plan_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", info.alias("info"), (F.col("o_totalprice") / 2).alias("half")), _KIND_OLD, _KIND_NEW)


_RETIRED = "SELECT '{0}' AS table_name, '{1}_enum' AS constraint_name, 'enum' AS constraint_type, count(*) AS checked_rows, count(*) FILTER ({2}) AS violations FROM {0}"


@query("m03_retire_enum_residue", _RETIRED.format("orders", "o_orderstatus", "FALSE") + " UNION ALL " + _RETIRED.format("lineitem", "l_returnflag", "l_returnflag = 'R'"))
def _(t: Tables):
    return J.retire_enum_values({"orders": (t.orders, "o_orderstatus"), "lineitem": (t.lineitem, "l_returnflag")}, ("O", "F", "A", "N"), {"P": "O"})[1]


@query("m03_retire_enum_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t: Tables):
    return J.retire_enum_values({"orders": (t.orders, "o_orderstatus")}, ("O", "F"), {"P": "O"})[0]["orders"].select("o_orderkey", "o_orderstatus")
