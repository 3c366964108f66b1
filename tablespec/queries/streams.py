"""S08, R01-R11 and M02.

The events table is split into files of a stream folder, in event order; results must
equal those of one batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablespec.operators.diffs import table_diff
from tablespec.paths import work_dir, written
from tablespec.plans.apply import apply_table
from tablespec.registry import Tables, query
from tablespec.sources import keyed as K
from tablespec.sources.scan import stream_scan
from tablespec.spec import Check, Column, ForeignKey, Partition, PartitionBy, Publication, TableSpec
from tablespec.streaming import changes as C

_FILES = 4
_LATE_ROWS = 100_000  # of the smallest batch in a file
_FILE_ROWS = 200_000  # the same of ordered batches


def _stream(t: Tables, frame=None, max_files: int = 1, event_time: str | None = None, ordered: bool = False):
    """A folder of files as a stream. Files of one write have no order between them; ordered writes
    batches one after the other, by event. Each has the same number of files, which follows the smallest, so that no task
    writes the whole of a large batch."""
    rows = frame if frame is not None else t.events
    path = f"{work_dir(t.spark)}/in"
    if ordered:
        last = rows.agg(F.max("event_id")).first()[0] or 0
        placed = written(rows.withColumn("_p", F.floor(F.col("event_id") * _FILES / F.lit(last + 1)).cast("int")))
        sizes = placed.agg(*(F.count_if(F.col("_p") == i) for i in range(_FILES))).first()
        max_files = max(1, min(sizes) // _FILE_ROWS)
        for i in range(_FILES):
            part = placed.where(F.col("_p") == i).drop("_p")
            (part.coalesce(1) if max_files == 1 else part.repartition(max_files)).write.mode("append").parquet(path)
    else:
        rows.repartitionByRange(_FILES, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return stream_scan(t.spark, path, rows.schema, max_files=max_files, event_time=event_time)


def _out(t: Tables) -> tuple[str, str]:
    root = work_dir(t.spark)
    return f"{root}/out", f"{root}/state"


_CHANGES = "SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, event_type AS kind, event_id % 7 AS level, (event_id + 3) % 7 AS old_level FROM events"


def _changes(t: Tables):
    return t.events.selectExpr("event_id", "user_id", "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op", "event_type AS kind", "event_id % 7 AS level", "(event_id + 3) % 7 AS old_level")


@query("s08_stream_scan", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    return C.run_to_table(_stream(t).select("event_id", "event_type"), *_out(t))


@query("r01_publish", f"SELECT op, event_id, level FROM ({_CHANGES}) WHERE op IN ('insert', 'update') AND level > 2")
def _(t: Tables):
    pub = Publication("active", ("events",), "level > 2", ("event_id", "level"), ("insert", "update"))
    return C.run_to_table(C.publish(_stream(t, _changes(t)), pub, "events"), *_out(t))


@query("r02_publish_transitions", f"SELECT event_id, CASE WHEN op = 'update' AND level > 3 AND old_level <= 3 THEN 'insert' WHEN op = 'update' AND level <= 3 AND old_level > 3 THEN 'delete' ELSE op END AS op FROM ({_CHANGES}) WHERE CASE op WHEN 'update' THEN level > 3 OR old_level > 3 WHEN 'delete' THEN old_level > 3 ELSE level > 3 END")
def _(t: Tables):
    return C.run_to_table(C.publish_transitions(_stream(t, _changes(t)), "level > 3", "old_level > 3").select("event_id", "op"), *_out(t))


_LAST = f"SELECT user_id, event_id, kind FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND op <> 'delete'"


@query("r03_subscribe", f"SELECT * FROM ({_LAST}) UNION ALL SELECT -1, -1, 'initial'")
def _(t: Tables):
    root, state = _out(t)
    schema = _changes(t).select("user_id", "event_id", "kind").schema
    initial = t.region.limit(1).selectExpr("cast(-1 AS bigint) AS user_id", "cast(-1 AS bigint) AS event_id", "'initial' AS kind")
    C.subscribe(_stream(t, _changes(t), ordered=True), root, "last", schema, ["user_id"], ["event_id"], state, initial).awaitTermination()
    return K.load(K.KeyedTable(t.spark, root, "last", schema, ("user_id",)))


@query("r04_before_row", f"SELECT event_id, CASE WHEN kind = 'click' THEN 'touch' ELSE kind END AS kind, CASE WHEN op = 'update' THEN level + 100 ELSE level END AS level FROM ({_CHANGES}) WHERE NOT (op = 'delete' AND level = 0)")
def _(t: Tables):
    rules = [("kind = 'click'", {"kind": "'touch'"}, None), ("op = 'delete'", {}, "level = 0"), ("op = 'update'", {"level": "level + 100"}, None)]
    return C.run_to_table(C.before_row(_stream(t, _changes(t)), rules).select("event_id", "kind", "level"), *_out(t))


@query("r04_instead_of", f"SELECT op, user_id AS id, upper(kind) AS label FROM ({_CHANGES}) WHERE level > 1")
def _(t: Tables):
    return C.run_to_table(C.instead_of(_stream(t, _changes(t)), {"users": ("level > 1", {"id": "user_id", "label": "upper(kind)"})})["users"], *_out(t))


def _rocks(t: Tables) -> None:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("r05_after_update_of", "SELECT event_id, user_id, event_type, old_event_type FROM (SELECT *, lag(event_type) OVER w AS old_event_type, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 AND event_type <> old_event_type AND event_type <> 'error'")
def _(t: Tables):
    root, state = _out(t)
    stream = _stream(t, t.events.select("event_id", "user_id", "event_type"), ordered=True)
    C.run_after_update_of(stream, root, "types", ["user_id"], ["event_type"], ["event_id"], state, "event_type <> old_event_type AND event_type <> 'error'").awaitTermination()
    return t.spark.read.schema("event_id long, user_id long, event_type string, old_event_type string").parquet(f"{root}/types_fired/*")


@query("r05_after_update_in_event_order", "SELECT n, user_id, event_type, old_event_type FROM (SELECT event_id AS n, user_id, event_type, lag(event_type) OVER w AS old_event_type, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k > 1 AND event_type <> old_event_type")
def _(t: Tables):
    """Events dealt over the files without regard to their time; one row far ahead, in the last file, lets the watermark pass all others."""
    _rocks(t)
    rows = t.events.selectExpr("(event_id * 7919) % 1000003 AS event_id", "event_id AS n", "user_id", "event_type", "cast(ts AS timestamp) AS ts")
    ahead = t.events.agg(F.max("ts").alias("ts")).selectExpr("1000003L AS event_id", "-1L AS n", "-1L AS user_id", "'end' AS event_type", "cast(ts AS timestamp) + INTERVAL 1000 DAYS AS ts")
    stream = _stream(t, rows.unionByName(ahead), event_time="ts", ordered=True)
    fired = C.after_update_of(stream, ["user_id"], ["event_type"], ["n"], event_time="ts", delay="900 days")
    return C.run_to_table(fired.select("n", "user_id", "event_type", "old_event_type"), *_out(t))


@query("r06_statement_audit", f"""WITH e AS (SELECT event_id, user_id, op, level, (event_id * {_FILES} // (SELECT max(event_id) + 1 FROM events))::INT AS p FROM ({_CHANGES})),
v AS (SELECT b.b, s.more, e.user_id, arg_max(op, event_id) AS op, arg_max(level, event_id) AS level FROM range({_FILES}) b(b), (VALUES (0), (1)) s(more), e WHERE e.p < b.b + s.more GROUP BY ALL),
n AS (SELECT b, user_id, level FROM v WHERE more = 1 AND op <> 'delete'), o AS (SELECT b, user_id, level FROM v WHERE more = 0 AND op <> 'delete')
SELECT CASE WHEN o.user_id IS NULL THEN 'create' WHEN n.user_id IS NULL THEN 'drop' ELSE 'alter' END AS op, count(*) AS rows, sum(n.level)::BIGINT AS new_sum, sum(o.level)::BIGINT AS old_sum, coalesce(n.b, o.b)::INT AS batch_id
FROM n FULL JOIN o ON n.b = o.b AND n.user_id = o.user_id WHERE n.level IS DISTINCT FROM o.level GROUP BY ALL""")
def _(t: Tables):
    root, state = _out(t)
    rows = _changes(t).select("event_id", "user_id", "op", "level")
    C.statement_audit(_stream(t, rows, ordered=True), root, "levels", rows.select("user_id", "level").schema, "user_id", ["event_id"], state, "level").awaitTermination()
    return t.spark.read.parquet(f"{root}/levels_audit/*")


_RULES = TableSpec("events", (Column("event_id", "bigint", False), Column("kind", "string", False)), checks=(Check("value_small", "value < 50"),), foreign_keys=(ForeignKey("known_user", ("user_id",), "customer", ("c_custkey",)),), enums={"kind": ("click", "purchase", "error", "signup")})


@query("r07_enforce", "SELECT event_id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'kind_not_null' END, CASE WHEN value >= 50 THEN 'value_small' END, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'kind_enum' END, CASE WHEN user_id % 3 = 0 THEN 'known_user' END) AS reasons FROM events")
def _(t: Tables):
    rows = t.events.select("event_id", "user_id", F.col("value"), F.expr("CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'bad' ELSE event_type END").alias("kind"))
    root, state = _out(t)
    parent = t.events.where("user_id % 3 <> 0").select(F.col("user_id").alias("c_custkey"))
    C.enforce(_stream(t, rows), _RULES, f"{root}/good", f"{root}/bad", state, {"known_user": parent}).awaitTermination()
    good = t.spark.read.parquet(f"{root}/good/*").select("event_id", F.lit("").alias("reasons"))
    return good.unionByName(t.spark.read.parquet(f"{root}/bad/*").select("event_id", F.array_join("reasons", ",").alias("reasons")))


@query("r08_unique_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    stream = _stream(t, t.events.select("event_id", "user_id", "event_type", "ts"), event_time="ts")
    return C.run_to_table(C.unique_stream(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), *_out(t))


@query("r08_duplicate_stream", "SELECT user_id, event_type, count(*) - 1 AS repeats FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables):
    _rocks(t)
    stream = _stream(t, t.events.select("event_id", "user_id", "event_type"))
    found = C.run_to_table(C.duplicate_stream(stream, ["user_id", "event_type"]), *_out(t))
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("repeats"))


@query("r09_streaming_matview", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    stream = _stream(t, event_time="ts")
    aggs = [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")]
    out = C.run_to_table(C.streaming_matview(stream, "ts", "1 day", aggs, "60 days", by=["event_type"]), *_out(t), mode="complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("r09_late_rows", "SELECT count(*) AS late_rows FROM events WHERE event_id % 10 = 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_id % 10 > 1)")
def _(t: Tables):
    """Every tenth event arrives last, most of them behind the watermark.

    Spark judges lateness in a batch by the watermark that the batch before began with, so one batch
    lies between the rows that set it and the late ones. Each batch has the same number of files, which follows the table,
    so that no task holds the windows of a whole batch; the state lies in RocksDB, not in the heap."""
    _rocks(t)
    path, late = f"{work_dir(t.spark)}/in", t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    batches = [late.where(f"event_id % 10 {x}") for x in ("> 1", "= 1", "= 0")]
    sizes = late.agg(*(F.count_if(F.expr(f"event_id % 10 {x}")) for x in ("> 1", "= 1", "= 0"))).first()
    files = max(1, min(sizes) // _LATE_ROWS)
    for rows in batches:
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    stream = stream_scan(t.spark, path, late.schema, max_files=files)
    found, behind = C.run_counting_late(C.streaming_matview(stream, "ts", "1 hour", [F.count("*").alias("n")], "1 day", by=["event_id"]), *_out(t))
    return t.region.limit(1).select(F.lit(behind).cast("long").alias("late_rows"))


@query("r09_sessions", "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    stream = _stream(t, event_time="ts")
    out = C.run_to_table(C.streaming_matview(stream, "ts", "2 hours", [F.count("*").alias("n")], "60 days", session=True, by=["user_id"]), *_out(t), mode="complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("r10_drift_stream", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'extra' ELSE 'alter' END AS op, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'event_type' END AS changed_cols FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def _(t: Tables):
    declared = t.events.where("event_id % 5 <> 0").select("event_id", "user_id", F.expr("CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END").alias("event_type"))
    return C.run_to_table(C.drift_stream(_stream(t), declared, ["event_id"], ["user_id", "event_type"]).select("event_id", "op", "changed_cols"), *_out(t))


@query("r11_route_stream", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'seen' WHEN event_type = 'purchase' THEN 'sold' ELSE 'unrouted' END AS partition, count(*) AS rows FROM events GROUP BY 1")
def _(t: Tables):
    path, state = _out(t)
    by = PartitionBy("list", ("event_type",), (Partition("seen", ("view", "click")), Partition("sold", ("purchase",))))
    C.route_stream(_stream(t), by, path, state).awaitTermination()
    return t.spark.read.parquet(path).groupBy("partition").agg(F.count("*").alias("rows"))


_DESIRED = TableSpec("orders", (Column("id", "bigint", False), Column("cents", "bigint", using="round(o_totalprice * 100)"), Column("status", "string", default="'N'")), checks=(Check("positive", "cents >= 0"),), renames={"o_orderkey": "id", "o_orderstatus": "status"})


@query("m02_apply_table", "SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS status FROM orders")
def _(t: Tables):
    root = work_dir(t.spark)
    applied = apply_table(t.orders, _DESIRED, root, allow_destructive=True)
    again = apply_table(applied, TableSpec("orders", tuple(Column(c.name, c.type, c.nullable) for c in _DESIRED.columns), checks=_DESIRED.checks), root, allow_destructive=True)
    assert table_diff(again, applied, ["id"]).isEmpty()
    return again
