import datetime
import random

from tablespec.queries.streams import _rocks
from tablespec.registry import Tables
from tablespec.streaming import changes as C


def test_late_rows_meet_their_true_predecessors(spark, tmp_path):
    """Three files whose rows are dealt at random give what one batch in event order gives."""
    _rocks(Tables(spark, ""))
    r, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(k, r.choice([1, 2, None]), start + datetime.timedelta(seconds=7 * (k // 2)), r.choice(["a", "b", None])) for k in range(60)]
    want, last = set(), {}
    for n, user, _, kind in rows:
        if user in last and last[user] != kind:
            want.add((n, user, kind, last[user]))
        last[user] = kind
    schema = "n long, user long, ts timestamp, kind string"
    r.shuffle(rows)
    end = [(1000 + u, u or None, start + datetime.timedelta(days=9), "end") for u in (0, 1, 2)]  # moves the watermark past all others
    for i, part in enumerate((rows[:20], rows[20:40], rows[40:], end)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    fired = C.after_update_of(stream, ["user"], ["kind"], ["n"], event_time="ts", delay="1 hour")
    fired.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(x.n, x.user, x.kind, x.old_kind) for x in spark.read.parquet(f"{tmp_path}/out").collect() if x.n < 1000]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_whose_rows_span_batches_lose_none(spark, tmp_path):
    """All rows of a key but the first come out, however many rows a task reads."""
    _rocks(Tables(spark, ""))
    spark.range(90_000).selectExpr("id", "id % 3000 AS user").repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, user long").parquet(f"{tmp_path}/in")
    found = C.run_to_table(C.duplicate_stream(stream, ["user"]), f"{tmp_path}/out", f"{tmp_path}/state")
    assert found.count() == 90_000 - 3000 and found.groupBy("user").count().where("count = 29").count() == 3000


def test_late_rows_of_many_files_are_counted_alike(spark, tmp_path, monkeypatch):
    """A batch of several files is one batch; no file holds all of it."""
    import duckdb

    from tablespec.queries import streams as S
    from tablespec.registry import ORACLES, QUERIES

    monkeypatch.setattr(S, "_LATE_ROWS", 30)
    scans, scan = [], S.stream_scan
    monkeypatch.setattr(S, "stream_scan", lambda *a, **k: scans.append((a[1], k["max_files"])) or scan(*a, **k))
    got = QUERIES["r09_late_rows"](spark, "/root/testdata/sf0.001").first()[0]
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    assert got == con.execute(ORACLES["r09_late_rows"]).fetchone()[0]
    path, files = scans[0]
    assert files > 1 and spark.read.parquet(path).selectExpr("input_file_name() AS f").distinct().count() == 3 * files
