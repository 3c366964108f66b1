import random

import pytest

from tablespec.queries import streams as S
from tablespec.registry import ORACLES, QUERIES
from tablespec.streaming import changes as C
from tests.oracles import agrees


@pytest.mark.parametrize("file_rows", [200_000, 40])
def test_updates_equal_the_sql_with_missing_types_and_keys(spark, tmp_path, monkeypatch, file_rows):
    """A change from or to a missing type is none in SQL; a batch of one file or of several is one batch."""
    monkeypatch.setattr(S, "_FILE_ROWS", file_rows)
    r = random.Random(3)
    rows = [(i, r.choice([None, *range(20)]), r.choice(["view", "click", "error", None])) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    (tmp_path / "sf").mkdir()
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "sf/events.parquet")
    made, scan = [], S.stream_scan
    monkeypatch.setattr(S, "stream_scan", lambda *a, **k: made.append((a[1], k["max_files"])) or scan(*a, **k))
    agrees(QUERIES["r05_after_update_of"](spark, str(tmp_path / "sf")), ORACLES["r05_after_update_of"], str(tmp_path / "sf"))
    path, files = made[0]
    assert files == (1 if file_rows > 400 else 2)
    assert spark.read.parquet(path).selectExpr("input_file_name() AS f").distinct().count() == 4 * files


def test_keys_held_over_many_batches(spark, tmp_path):
    """Twelve batches, so that deltas are joined; a null and a missing value before count, and a stream that goes on knows what came."""
    r, last, want, n = random.Random(8), {}, set(), 0
    schema = "n long, k long, s string, v double"
    run = lambda: C.run_after_update_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), str(tmp_path), "x", ["k"], ["s", "v"], ["n"], f"{tmp_path}/state").awaitTermination()
    for b in range(12):
        rows = []
        for _ in range(8):
            n += 1
            k, now = r.choice([None, 1, 2, 3, 4]), (r.choice(["a", None]), r.choice([1.5, None]))
            rows.append((n, k, *now))
            if k in last and last[k] != now:
                want.add((n, k, *now, *last[k]))
            last[k] = now
        r.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{b:02}")
        if b in (6, 11):
            run()
    got = [tuple(x) for x in spark.read.schema(f"{schema}, old_s string, old_v double").parquet(f"{tmp_path}/x_fired/*").collect()]
    assert len(got) == len(set(got)) and set(got) == want
