"""J06-J08, W05, F08, S01-S07, O02 and M04."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators import integrity as I
from tablespec.paths import work_dir
from tablespec.plans.apply import rebuild_partitions
from tablespec.registry import Tables, query
from tablespec.sources import hashtree as H
from tablespec.sources import scan as S
from tablespec.spec import Column, Partition, PartitionBy, TableSpec

_DELETED = "c_custkey % 11 = 0"


def _customers(t: Tables):
    return t.customer.where(_DELETED).select(F.col("c_custkey").alias("key")), t.customer.where("c_custkey % 13 = 1").select(F.col("c_custkey").alias("old_key"), (F.col("c_custkey") + 5000000).alias("new_key"))


@query("j06_fk_cascade_chain", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 11 = 0)")
def _(t: Tables):
    return I.fk_cascade([(t.orders, "o_orderkey", "o_custkey"), (t.lineitem, "l_orderkey", "l_orderkey")], _customers(t)[0])[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("j06_fk_set_null_and_update", "SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 13 = 1 THEN o_custkey + 5000000 ELSE o_custkey END AS o_custkey FROM orders")
def _(t: Tables):
    return I.fk_apply(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", *_customers(t), on_delete="set null", on_update="cascade")[0]


@query("j06_fk_set_default", "SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def _(t: Tables):
    return I.fk_apply(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", _customers(t)[0], None, on_delete="set default", default=-1)[0]


@query("j06_fk_restrict", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 11 = 0 OR o_custkey % 13 = 1")
def _(t: Tables):
    return I.fk_apply(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", *_customers(t), on_delete="restrict", on_update="no action")[1].distinct()


def _spans(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("lo")).withColumn("hi", F.col("lo") + 600 + F.col("event_id") % 7200)


_SPANS = "SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + 600 + event_id % 7200 AS hi FROM events"


@query("j07_exclude_violations", f"WITH s AS ({_SPANS}) SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, 'one_kind' AS constraint_name FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi")
def _(t: Tables):
    return I.exclude_violations(_spans(t), ["user_id"], "lo", "hi", "event_id", differ=["event_type"], name="one_kind")


_OPEN = f"SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN NULL ELSE lo END AS lo, CASE WHEN event_id % 89 = 0 THEN NULL ELSE hi END AS hi) FROM ({_SPANS})"
_BOTH = "coalesce(a.lo < b.hi, TRUE) AND coalesce(b.lo < a.hi, TRUE)"


def _open(t: Tables):
    return _spans(t).withColumns({"lo": F.expr("CASE WHEN event_id % 97 <> 0 THEN lo END"), "hi": F.expr("CASE WHEN event_id % 89 <> 0 THEN hi END")})


@query("j07_exclude_unbounded", f"WITH s AS ({_OPEN}) SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, 'one_kind' AS constraint_name FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id < b.event_id AND {_BOTH}")
def _(t: Tables):
    return I.exclude_violations(_open(t), ["user_id"], "lo", "hi", "event_id", differ=["event_type"], name="one_kind")


_NAMED = "SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, '{0}' AS constraint_name FROM s a JOIN s b ON {1} a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi"


@query("j07_exclude_dates", "WITH s AS (SELECT event_id, user_id, ts::DATE AS lo, ts::DATE + (event_id % 40)::INT AS hi FROM events WHERE event_id % 40 > 0) " + _NAMED.format("one_stay", "a.user_id = b.user_id AND"))
def _(t: Tables):
    stays = t.events.select("event_id", "user_id", F.to_date("ts").alias("lo"), F.expr("date_add(to_date(ts), cast(event_id % 40 AS int))").alias("hi"))
    return I.exclude_violations(stays, ["user_id"], "lo", "hi", "event_id", name="one_stay")


_SIX = "CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 WHEN 4 THEN 10000 ELSE 100000 END"


@query("j07_exclude_six_magnitudes", f"WITH s AS (SELECT event_id, event_type, ts AS lo, ts + INTERVAL 1 SECOND * ({_SIX}) AS hi FROM events) " + _NAMED.format("one_at_a_time", "a.event_type = b.event_type AND"))
def _(t: Tables):
    spans = t.events.select("event_id", "event_type", F.col("ts").alias("lo"), F.expr(f"timestampadd(SECOND, {_SIX}, ts)").alias("hi"))
    return I.exclude_violations(spans, ["event_type"], "lo", "hi", "event_id", name="one_at_a_time")


@query("j07_exclude_without_equal_columns", "WITH s AS (SELECT p_partkey AS event_id, p_retailprice AS lo, p_retailprice + 0.01 * (p_partkey % 7) AS hi FROM part WHERE p_partkey % 7 > 0) " + _NAMED.format("one_price", ""))
def _(t: Tables):
    spans = t.part.select(F.col("p_partkey").alias("event_id"), F.col("p_retailprice").alias("lo"), F.expr("p_retailprice + 0.01D * (p_partkey % 7)").alias("hi"))
    return I.exclude_violations(spans, [], "lo", "hi", "event_id", name="one_price")


@query("f08_merge_unbounded", f"""WITH s AS (SELECT *, lo IS NULL AS a, hi IS NULL AS b, coalesce(lo, -1000000) AS l, coalesce(hi, 1000000000000000) AS h FROM ({_OPEN})), r AS (SELECT *, CASE WHEN max(h) OVER (PARTITION BY user_id ORDER BY l, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= l THEN 0 ELSE 1 END AS n FROM s),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY l, h ROWS UNBOUNDED PRECEDING) AS i FROM r), m AS (SELECT user_id, CASE WHEN NOT bool_or(a) THEN min(lo) END AS lo, CASE WHEN NOT bool_or(b) THEN max(hi) END AS hi, count(*) AS ranges FROM i GROUP BY user_id, i)
SELECT *, lo - lag(hi) OVER (PARTITION BY user_id ORDER BY lo NULLS FIRST) AS gap_before FROM m""")
def _(t: Tables):
    return I.merge_ranges(_open(t), ["user_id"], "lo", "hi")


@query("f08_range_ops_unbounded", f"""WITH s AS ({_OPEN}), n AS (SELECT a.event_id, a.lo, a.hi, b.lo AS o_lo, b.hi AS o_hi FROM s a JOIN s b ON b.event_id = a.event_id + 1)
SELECT *, coalesce(lo < o_hi, TRUE) AND coalesce(o_lo < hi, TRUE) AS overlaps, (lo IS NULL OR coalesce(lo <= o_lo, FALSE)) AND (hi IS NULL OR coalesce(o_hi <= hi, FALSE)) AS contains, coalesce(hi = o_lo, FALSE) OR coalesce(o_hi = lo, FALSE) AS adjacent,
CASE WHEN coalesce(lo < o_hi, TRUE) AND coalesce(o_lo < hi, TRUE) THEN greatest(lo, o_lo) END AS common_lo, CASE WHEN coalesce(lo < o_hi, TRUE) AND coalesce(o_lo < hi, TRUE) THEN least(hi, o_hi) END AS common_hi FROM n""")
def _(t: Tables):
    mine = _open(t).select("event_id", "lo", "hi")
    other = mine.select((F.col("event_id") - 1).alias("event_id"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    return I.range_ops(mine.join(other, "event_id"), "lo", "hi", "o_lo", "o_hi")


@query("w05_overlaps_unbounded", f"WITH s AS (SELECT *, coalesce(lo, -1) AS l, coalesce(hi, 1000000000000000) AS h FROM ({_OPEN})) SELECT event_id, user_id, lo, hi FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.user_id = s.user_id AND (o.l, o.h, o.event_id) < (s.l, s.h, s.event_id) AND o.h > s.l)")
def _(t: Tables):
    return I.overlaps_by_running_max(_open(t), ["user_id"], "lo", "hi", "event_id").drop("event_type")


@query("w05_overlaps", f"WITH s AS ({_SPANS}) SELECT event_id, user_id, lo, hi FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.user_id = s.user_id AND (o.lo, o.hi, o.event_id) < (s.lo, s.hi, s.event_id) AND o.hi > s.lo)")
def _(t: Tables):
    return I.overlaps_by_running_max(_spans(t), ["user_id"], "lo", "hi", "event_id").drop("event_type")


@query("f08_merge_ranges", f"""WITH s AS ({_SPANS}), r AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS n FROM s),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM r), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS ranges FROM i GROUP BY user_id, i)
SELECT *, lo - lag(hi) OVER (PARTITION BY user_id ORDER BY lo) AS gap_before FROM m""")
def _(t: Tables):
    return I.merge_ranges(_spans(t), ["user_id"], "lo", "hi")


@query("f08_range_ops", f"WITH s AS ({_SPANS}), n AS (SELECT event_id, lo, hi, lead(lo) OVER (PARTITION BY user_id ORDER BY lo, event_id) AS o_lo, lead(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id) AS o_hi FROM s) SELECT *, lo < o_hi AND o_lo < hi AS overlaps, lo <= o_lo AND o_hi <= hi AS contains, hi = o_lo OR o_hi = lo AS adjacent, CASE WHEN lo < o_hi AND o_lo < hi THEN greatest(lo, o_lo) END AS common_lo, CASE WHEN lo < o_hi AND o_lo < hi THEN least(hi, o_hi) END AS common_hi FROM n WHERE o_lo IS NOT NULL")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("lo", "event_id")
    return I.range_ops(_spans(t).withColumns({"o_lo": F.lead("lo").over(w), "o_hi": F.lead("hi").over(w)}).where("o_lo IS NOT NULL").drop("user_id", "event_type"), "lo", "hi", "o_lo", "o_hi")


_STATUS = PartitionBy("list", ("o_orderstatus",), (Partition("open", ("O", "P")), Partition("rest", default=True)))
_YEARS = PartitionBy("range", ("y", "o_custkey"), (Partition("old", upper=(1996, 500)), Partition("mid", lower=(1996, 500), upper=(1999, 0), by=_STATUS), Partition("other", default=True)))
_YEARS_NEW = PartitionBy("range", ("y", "o_custkey"), (Partition("old", upper=(1997, 0)), Partition("mid", lower=(1997, 0), upper=(1999, 0), by=_STATUS), Partition("late", lower=(1999, 0), upper=(2001, 0)), Partition("other", default=True)))
_ROUTE = "SELECT o_orderkey, CASE WHEN (y, o_custkey) < (1996, 500) THEN 'old' WHEN (y, o_custkey) < (1999, 0) THEN 'mid/' || CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'rest' END ELSE 'other' END AS partition, CASE WHEN (y, o_custkey) < (1997, 0) THEN 'old' WHEN (y, o_custkey) < (1999, 0) THEN 'mid/' || CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'rest' END WHEN y < 2001 THEN 'late' ELSE 'other' END AS moved FROM (SELECT *, year(o_orderdate) AS y FROM orders)"


def _years(t: Tables):
    return t.orders.withColumn("y", F.year("o_orderdate"))


@query("j08_route_partitions", f"SELECT o_orderkey, partition FROM ({_ROUTE})")
def _(t: Tables):
    return I.route_partitions(_years(t), _YEARS).select("o_orderkey", "partition")


@query("j08_route_hash", "SELECT o_orderkey, 'h' || (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4) AS partition FROM orders")
def _(t: Tables):
    by = PartitionBy("hash", ("o_orderkey",), tuple(Partition(f"h{i}", remainder=i) for i in range(4)), modulus=4, hash="md5")
    return I.route_partitions(t.orders, by).select("o_orderkey", "partition")


_SPEC = TableSpec("orders", (Column("o_orderkey", "bigint"),), partition_by=_YEARS)


@query("s05_write_partitioned", f"SELECT partition, count(*) AS rows FROM ({_ROUTE}) GROUP BY 1")
def _(t: Tables):
    return S.write_partitioned(_years(t).select("o_orderkey", "y", "o_custkey", "o_orderstatus"), _SPEC, f"{work_dir(t.spark)}/orders").groupBy("partition").agg(F.count("*").alias("rows"))


@query("m04_partition_changes", f"""WITH r AS ({_ROUTE}) SELECT v.partition, v.change, (SELECT count(*) FROM r WHERE r.partition <> r.moved AND (r.partition = v.partition OR r.moved = v.partition))::BIGINT AS rows_moved
FROM (VALUES ('old', 'bounds changed'), ('mid/open', 'same'), ('mid/rest', 'same'), ('late', 'added'), ('other', 'same')) v(partition, change)""")
def _(t: Tables):
    return I.partition_changes(_years(t), _YEARS, _YEARS_NEW)


@query("m04_rebuild_partitions", "SELECT count(*) AS old_rows, count(*) AS new_rows, TRUE AS same FROM orders")
def _(t: Tables):
    rows, root = _years(t).select("o_orderkey", "y", "o_custkey", "o_orderstatus"), work_dir(t.spark)
    old, _ = rebuild_partitions(rows, _SPEC, root)
    return rebuild_partitions(old.select(*rows.columns), TableSpec("orders", _SPEC.columns, partition_by=_YEARS_NEW), root)[1]


@query("s01_scan_declared", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t: Tables):
    return S.scan_declared(t.spark, t.path("customer"), TableSpec("customer", (Column("c_custkey", "bigint", False), Column("c_mktsegment", "string"))))


@query("s02_scan_foreign", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    path = f"{work_dir(t.spark)}/nation"
    t.nation.write.option("header", True).csv(path)
    spec = TableSpec("nation", (Column("n_nationkey", "int"), Column("n_name", "string"), Column("n_regionkey", "int")))
    return S.scan_foreign(t.spark, {"format": "csv", "header": "false", "sep": ","}, {"header": "true", "path": path}, spec)


@query("s03_scan_union", "SELECT n_name AS name, 0 AS file_order, NULL::DOUBLE AS s_acctbal FROM nation UNION ALL SELECT s_name, 1, s_acctbal FROM supplier")
def _(t: Tables):
    root = work_dir(t.spark)
    t.supplier.select(F.col("s_name").alias("name"), "s_acctbal").write.parquet(f"{root}/b")
    t.nation.select(F.col("n_name").alias("name")).write.parquet(f"{root}/a")
    return S.scan_union(t.spark, [f"{root}/b", f"{root}/a"])


@query("s04_scan_inherited", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables):
    return S.scan_inherited(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), [t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")])


@query("s06_snapshot", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def _(t: Tables):
    root, rows = work_dir(t.spark), t.part.select("p_partkey", "p_size")
    assert S.snapshot_load(t.spark, root, "part", rows.schema).isEmpty()
    S.snapshot_save(rows, root, "part", 1)
    S.snapshot_save(S.snapshot_load(t.spark, root, "part", rows.schema).withColumn("p_size", F.col("p_size") + 1), root, "part", 2, "r2")
    return S.snapshot_load(t.spark, root, "part", rows.schema)


@query("s07_changelog_append", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS run_id, count(*) AS changes FROM orders GROUP BY 1")
def _(t: Tables):
    path = f"{work_dir(t.spark)}/log"
    S.changelog_append(t.orders.where("o_orderkey % 2 = 0").select("o_orderkey"), path, "a")
    return S.changelog_append(t.orders.where("o_orderkey % 2 = 1").select("o_orderkey"), path, "b").groupBy("run_id").agg(F.count("*").alias("changes"))


@query("o02_clustered_write", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def _(t: Tables):
    return S.clustered_write(t.orders, ["o_custkey"], f"{work_dir(t.spark)}/orders").where("o_custkey BETWEEN 100 AND 200").select("o_orderkey", "o_custkey")


@query("o02_interleaved_write", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey < 300")
def _(t: Tables):
    kept = S.interleaved_write(t.orders, ["o_custkey", "o_orderdate", "o_orderstatus"], f"{work_dir(t.spark)}/orders")
    return kept.where("o_orderdate >= TIMESTAMP_NTZ'1998-01-01' AND o_custkey < 300").select("o_orderkey", "o_custkey", "o_orderdate")


@query("j04_drift_by_hash_tree", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 17 THEN 'drop' ELSE 'alter' END AS op, CASE WHEN o_orderkey % 100 = 17 THEN '' ELSE 'o_orderstatus' END AS changed_cols FROM orders WHERE o_orderkey % 100 IN (3, 17)")
def _(t: Tables):
    root, schema = work_dir(t.spark), t.orders.schema
    changed = t.orders.where("o_orderkey % 100 <> 17").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END"))
    for name, rows in (("old", t.orders), ("new", changed)):
        H.tree_save(rows, ["o_orderkey"], f"{root}/{name}", leaves=64)
    return H.tree_drift(t.spark, f"{root}/old", f"{root}/new", schema, ["o_orderkey"], leaves=64)
