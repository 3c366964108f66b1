"""Change streams: publications, subscriptions, triggers and row rules on Structured Streaming.

Change rows carry ``op`` (insert, update, delete, truncate) and, for updates, old values
as ``old_<column>``. Functions that only transform work on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablespec.operators.constraints import all_of, any_of, check_passes
from tablespec.operators.integrity import route_partitions
from tablespec.sources import keyed as K
from tablespec.spec import PartitionBy, Publication, TableSpec


def publish(changes: DataFrame, publication: Publication, table: str | None = None) -> DataFrame:
    """Changes that a publication lets through, with its column list. A table that it does not name
    publishes nothing; its row filter is judged on the new row, for deletes on the old one."""
    if publication.tables and table not in publication.tables:
        return changes.where(F.lit(False))
    out = changes.where(F.col("op").isin(*publication.actions))
    if publication.where:
        out = out.where((F.col("op") == "truncate") | F.coalesce(F.expr(publication.where), F.lit(False)))
    return out.select("op", *publication.columns) if publication.columns else out


def publish_transitions(changes: DataFrame, filter: str, old_filter: str) -> DataFrame:
    """An update that enters the filter becomes an insert, one that leaves it a delete."""
    new, old = F.coalesce(F.expr(filter), F.lit(False)), F.coalesce(F.expr(old_filter), F.lit(False))
    is_update = F.col("op") == "update"
    op = F.when(is_update & new & ~old, "insert").when(is_update & ~new & old, "delete").otherwise(F.col("op"))
    keep = F.when(is_update, new | old).when(F.col("op") == "delete", old).otherwise(new)
    return changes.where(keep).withColumn("op", op)


def latest_changes(batch: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, bool]:
    """(the last change of each key after the last truncate, whether there was a truncate)."""
    cut = batch.where("op = 'truncate'").orderBy(*(F.desc(o) for o in order)).select(*order).limit(1).collect()
    rows = batch.where("op <> 'truncate'")
    if cut:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(cut[0][o]).cast(batch.schema[o].dataType) for o in order)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r"), bool(cut)


def apply_changes(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target after a batch of changes; the last change of a key wins."""
    last, truncated = latest_changes(batch, keys, order)
    hit = last.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)))
    same = all_of([F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])  # a null key is a key
    kept = target.where(F.lit(False)) if truncated else target.join(hit, same, "left_anti")
    return kept.unionByName(last.where("op <> 'delete'").select(*target.columns))


def subscribe(changes: DataFrame, root: str, name: str, schema: T.StructType, keys: list[str], order: list[str], checkpoint: str, initial: DataFrame | None = None):
    """Keeps a keyed table equal to the changes applied in order, after an optional initial copy.

    Version n + 1 holds batch n, written as its changes only; ``keyed.load`` merges them. A batch
    that is replayed finds its version and does nothing."""
    table = K.KeyedTable(changes.sparkSession, root, name, schema, tuple(keys))
    if initial is not None and not K.versions(table):
        K.save_base(table, initial, 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        now = K.KeyedTable(batch.sparkSession, root, name, schema, tuple(keys))
        if batch_id + 1 not in K.versions(now):
            K.save_changes(now, *latest_changes(batch, keys, order), batch_id + 1)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def before_row(changes: DataFrame, rules: list[tuple[str, dict[str, str | Column], str | None]]) -> DataFrame:
    """BEFORE rules (condition, columns to set, suppress condition) applied in order to each row."""
    out = changes
    for when, sets, suppress in rules:
        hit = F.coalesce(F.expr(when), F.lit(False))
        if suppress:
            out = out.where(~(hit & F.coalesce(F.expr(suppress), F.lit(False))))
        out = out.withColumns({c: F.when(hit, F.expr(v) if isinstance(v, str) else v).otherwise(F.col(c)) for c, v in sets.items()})
    return out


def instead_of(changes: DataFrame, targets: dict[str, tuple[str, dict[str, str]]]) -> dict[str, DataFrame]:
    """Changes on a view as changes on its base tables: table -> (condition, column -> expression)."""
    return {table: changes.where(when).select("op", *(F.expr(e).alias(c) for c, e in cols.items())) for table, (when, cols) in targets.items()}


class _UpdateOf(StatefulProcessor):
    """Emits a row when listed columns differ from the key's row before, in event order."""

    def __init__(self, cols: list[str], order: list[str], state: T.StructType, ttl_ms: int | None):
        self.cols, self.order, self.state_schema, self.ttl = cols, order, state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", self.state_schema, self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plain = lambda x: None if x != x else x  # a missing number is a null
        held = self.state.get() if self.state.exists() else None
        before = None if held is None else tuple(map(plain, held))
        first = before
        for row in sorted(rows, key=lambda r: [(plain(r[c]) is None, 0 if plain(r[c]) is None else r[c]) for c in self.order]):
            now = tuple(plain(row[c]) for c in self.cols)
            if before is not None and now != before:
                yield Row(**row.asDict(), **{f"old_{c}": v for c, v in zip(self.cols, before)})
            before = now
        if before != first or self.ttl:
            self.state.update(before)

    def close(self) -> None:
        pass


class _UpdateInOrder(StatefulProcessor):
    """The same in event order: rows wait in the key's buffer until the watermark has passed them."""

    def __init__(self, cols: list[str], order: list[str], names: list[str], row: T.StructType, state: T.StructType):
        self.names, self.row_schema, self.state_schema = names, row, state
        self.at, self.order, self.cols = names.index("event_us"), [names.index(c) for c in order], [names.index(c) for c in cols]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state_schema)
        self.held = handle.getListState("held", self.row_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plain = lambda x: None if x != x else x  # a missing number is a null
        came = [tuple(plain(r[c]) for c in self.names) for r in rows]
        self.held.appendList(came)
        self.handle.registerTimer(min(r[self.at] for r in came) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.held.get()]
        ready = sorted((r for r in rows if r[self.at] <= passed), key=lambda r: (r[self.at], *((r[i] is not None, r[i]) for i in self.order)))
        rest = [r for r in rows if r[self.at] > passed]
        self.held.clear()
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(min(r[self.at] for r in rest) // 1000 + 1)
        before = tuple(self.last.get()) if self.last.exists() else None
        for r in ready:
            now = tuple(r[i] for i in self.cols)
            if before is not None and now != before:
                yield Row(**dict(zip(self.names, r)), **{f"old_{self.names[i]}": v for i, v in zip(self.cols, before)})
            before = now
        if ready:
            self.last.update(before)

    def close(self) -> None:
        pass


def after_update_of(
    stream: DataFrame, key: list[str], cols: list[str], order: list[str], when: str | None = None, ttl_ms: int | None = None, event_time: str | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """AFTER UPDATE OF cols as a stream, with old values; needs the RocksDB state store provider. Python sees every row, so
    run_after_update_of is the way for large streams whose rows are only written.

    Rows are compared in the order in which their micro-batches come, and by ``order`` inside one. With an
    ``event_time`` column they are compared by it, then by ``order``: a row waits in its key's buffer until the watermark,
    ``delay`` behind the latest time, has passed it, so one that comes late by less than that meets its true
    predecessor. Rows without a time have no place and are left out, as are later ones."""
    state, out = T.StructType(), T.StructType(list(stream.schema.fields))
    for c in cols:
        state.add(c, stream.schema[c].dataType)
        out.add(f"old_{c}", stream.schema[c].dataType)
    if event_time:
        timed = stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay).withColumn("event_us", F.unix_micros(event_time))
        wide = T.StructType([*timed.schema.fields, *(f for f in out.fields if f.name not in timed.columns)])
        held = T.StructType([T.StructField(f.name, f.dataType) for f in timed.schema.fields])
        fired = timed.groupBy(*key).transformWithState(_UpdateInOrder(cols, order, timed.columns, held, state), outputStructType=wide, outputMode="Append", timeMode="EventTime").drop("event_us")
    else:
        fired = stream.groupBy(*key).transformWithState(_UpdateOf(cols, order, state, ttl_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
    return fired.where(when) if when else fired


def run_after_update_of(stream: DataFrame, root: str, name: str, key: list[str], cols: list[str], order: list[str], checkpoint: str, when: str | None = None):
    """AFTER UPDATE OF cols with old values, written under root/name_fired as after_update_of without an event time gives them.

    A micro-batch is compared by one window over its rows and the rows held of their keys; the last row of each key is held in a
    keyed table, whose version n + 1 is written by batch n, so a batch costs what it changes. A batch that is replayed
    reads the same version again and overwrites its own rows. A null key is a key."""
    schema = stream.select(*key, F.struct(*cols).alias("_now")).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        table = K.KeyedTable(batch.sparkSession, root, name, schema, tuple(key))
        now = batch.withColumns({"_now": F.struct(*cols), "_came": F.lit(True)})
        if batch_id + 1 not in K.versions(table):
            newest = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc_nulls_first(o) for o in order)))
            last = now.select(*schema.names, newest.alias("_r"), F.lit("update").alias("op")).where("_r = 1")
            K.save_changes(table, last, False, batch_id + 1)
        held = K.load(table, batch_id, among=K.delta(table, batch_id + 1)[0]).withColumn("_came", F.lit(False))
        before = F.lag("_now").over(Window.partitionBy(*key).orderBy("_came", *(F.asc_nulls_last(o) for o in order)))
        both = now.unionByName(held, allowMissingColumns=True).withColumn("_before", before)
        fired = both.where("_came AND _before IS NOT NULL AND NOT (_before <=> _now)").select(*stream.columns, *(F.col(f"_before.`{c}`").alias(f"old_{c}") for c in cols))
        (fired.where(when) if when else fired).write.mode("overwrite").parquet(f"{root}/{name}_fired/b{batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statement_audit(stream: DataFrame, root: str, name: str, schema: T.StructType, key: str, order: list[str], checkpoint: str, measure: str):
    """Per micro-batch: counts and sums of rows inserted, updated and deleted, in root/name_audit.

    Version n + 1 holds batch n, written as its changes only, and only the rows of its keys are compared
    with the version before (all rows if the batch empties the table). A batch that is replayed reads the
    same delta and version again, so its report stays what it was. A null key is a key."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table = K.KeyedTable(batch.sparkSession, root, name, schema, (key,))
        if batch_id + 1 not in K.versions(table):
            K.save_changes(table, *latest_changes(batch, [key], order), batch_id + 1)
        changed, emptied = K.delta(table, batch_id + 1)
        old = K.load(table, batch_id, among=None if emptied else changed)
        new = changed.where("_op <> 'delete'").select(*schema.names)
        side = lambda df, s: df.select(F.col(key).alias(f"_{s}key"), F.col(measure).alias(f"_{s}"), F.struct(*schema.names).alias(f"_{s}row"))
        both = side(new, "new").join(side(old, "old"), F.col("_newkey").eqNullSafe(F.col("_oldkey")), "full_outer")
        op = F.when(F.col("_oldrow").isNull(), "create").when(F.col("_newrow").isNull(), "drop").otherwise("alter")
        different = both.where(~F.col("_newrow").eqNullSafe(F.col("_oldrow")))
        report = different.groupBy(op.alias("op")).agg(F.count("*").alias("rows"), F.sum("_new").alias("new_sum"), F.sum("_old").alias("old_sum")).withColumn("batch_id", F.lit(batch_id))
        report.write.mode("overwrite").parquet(f"{root}/{name}_audit/b{batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_reasons(rows: DataFrame, spec: TableSpec, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds reasons: names of the not-null, check, domain, enum and foreign key rules a row breaks.
    parents maps a foreign key's name to static parent rows."""
    tests: list[tuple[str, Column]] = [(f"{c.name}_not_null", F.col(c.name).isNull()) for c in spec.columns if not c.nullable]
    tests += [(c.name, ~check_passes(c.expr)) for c in spec.checks]
    for col, d in spec.domains.items():
        tests += [(f"{col}_{c.name}", ~check_passes(c.expr.replace("VALUE", f"`{col}`"))) for c in d.checks]
    tests += [(f"{col}_enum", F.coalesce(~F.col(col).isin(*labels), F.lit(False))) for col, labels in spec.enums.items()]
    out, drop = rows, []
    for fk in spec.foreign_keys:
        if parents and fk.name in parents:
            held = [f"_{fk.name}_{i}" for i in range(len(fk.columns))]
            keys = parents[fk.name].select(*(F.col(r).alias(h) for r, h in zip(fk.ref_columns, held))).distinct()
            out = out.join(keys, all_of([F.col(c) == F.col(h) for c, h in zip(fk.columns, held)]), "left")
            tests.append((fk.name, all_of([F.col(c).isNotNull() for c in fk.columns]) & F.col(held[0]).isNull()))
            drop += held
    named = F.array(*(F.when(bad, F.lit(n)) for n, bad in tests)) if tests else F.array().cast("array<string>")
    return out.withColumn("reasons", F.filter(named, lambda x: x.isNotNull())).drop(*drop)


def enforce(stream: DataFrame, spec: TableSpec, good: str, bad: str, checkpoint: str, parents: dict[str, DataFrame] | None = None, deferred: Callable[[DataFrame], dict[str, DataFrame]] | None = None):
    """Splits arriving rows into accepted and quarantined ones (with reasons), written under good and bad.

    deferred gives, for a micro-batch, extra parent rows that arrived with it, so that parent and
    child may come together. Files are keyed by batch, so a replay overwrites its own."""

    def step(batch: DataFrame, batch_id: int) -> None:
        late = deferred(batch) if deferred else {}
        known = {n: p.unionByName(late[n]) if n in late else p for n, p in (parents or {}).items()}
        judged = with_reasons(batch, spec, known).persist()
        judged.where(F.size("reasons") == 0).drop("reasons").write.mode("overwrite").parquet(f"{good}/b{batch_id}")
        judged.where(F.size("reasons") > 0).write.mode("overwrite").parquet(f"{bad}/b{batch_id}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_stream(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


class _Repeats(StatefulProcessor):
    """Emits every row of a key but the first seen."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", T.StructType().add("seen", "boolean"), self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = seen = self.state.exists()
        for row in rows:
            if seen:
                yield row
            seen = True
        if not held or self.ttl:
            self.state.update((True,))

    def close(self) -> None:
        pass


def duplicate_stream(stream: DataFrame, key: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The rows that unique_stream leaves out; state may expire after ttl_ms."""
    return stream.groupBy(*key).transformWithState(_Repeats(ttl_ms), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def streaming_matview(stream: DataFrame, ts: str, window: str, aggs: list[Column], delay: str, slide: str | None = None, session: bool = False, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Windowed aggregates with a watermark: tumbling, sliding or session windows."""
    frame = F.session_window(ts, window) if session else F.window(ts, window, slide) if slide else F.window(ts, window)
    out = stream.withWatermark(ts, delay).groupBy(frame.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def run_counting_late(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """Appends a stream's rows to files and counts those that came behind its watermark."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path), late_rows(query)


def late_rows(query) -> int:
    """Rows that a finished query dropped behind its watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def drift_stream(stream: DataFrame, snapshot: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Arriving rows that the declared snapshot lacks (extra) or holds with other values (alter)."""
    declared = snapshot.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_d_{c}") for c in cols))
    both = stream.join(declared, all_of([F.col(k) == F.col(f"_k_{k}") for k in keys]), "left")
    missing = F.col(f"_k_{keys[0]}").isNull()
    differ = any_of([~F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in cols])
    changed = F.array_join(F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_d_{c}")), F.lit(c)) for c in sorted(cols))), lambda x: x.isNotNull()), ",")
    return both.where(missing | differ).select(*stream.columns, F.when(missing, "extra").otherwise("alter").alias("op"), F.when(missing, F.lit("")).otherwise(changed).alias("changed_cols"))


def route_stream(stream: DataFrame, by: PartitionBy, path: str, checkpoint: str):
    """Rows written under their partition, those that none takes under ``unrouted``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        routed = route_partitions(batch, by).withColumns({"partition": F.coalesce("partition", F.lit("unrouted")), "batch_id": F.lit(batch_id)})
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        routed.write.mode("overwrite").partitionBy("batch_id", "partition").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote; complete mode keeps the last batch."""
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
