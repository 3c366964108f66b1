import random

import pytest

from tablespec.sources import keyed as K
from tablespec.streaming import changes as C

SCHEMA = "k long, v long, note string"


def table(spark, root):
    return K.KeyedTable(spark, str(root), "t", spark.createDataFrame([], SCHEMA).schema, ("k",))


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, k long, v long, note string, n long")


def batches(seed, n, size=6, truncates=()):
    """Batches of changes, and the table after each by a dictionary."""
    r, now, out, at = random.Random(seed), {}, [], 0
    for b in range(n):
        rows = []
        for i in range(size):
            at += 1
            if b in truncates and i == size // 2:
                rows.append(("truncate", None, None, None, at))
                now = {}
                continue
            k = r.choice([None, *range(12)])
            if r.random() < 0.3:
                rows.append(("delete", k, None, None, at))
                now.pop(k, None)
            else:
                rows.append((r.choice(["insert", "update"]), k, at, f"n{at}", at))
                now[k] = (at, f"n{at}")
        out.append((rows, {(k, *v) for k, v in now.items()}))
    return out


def found(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed, truncates", [(1, ()), (2, (5, 11))])
def test_every_version_reads_as_it_was(spark, tmp_path, seed, truncates, monkeypatch):
    monkeypatch.setattr(K, "FAN", 3)
    monkeypatch.setattr(K, "BASE_SHARE", 3)
    t, want = table(spark, tmp_path), []
    for b, (rows, now) in enumerate(batches(seed, 14, truncates=truncates)):
        K.save_changes(t, *C.latest_changes(changes(spark, rows), ["k"], ["n"]), b + 1)
        want.append(now)
    for b, now in enumerate(want):
        assert found(K.load(t, b + 1)) == now
    assert found(K.load(t)) == want[-1] and found(K.load(t, 0)) == set()
    entries = K._entries(t)
    assert any(r.versions > 1 for r in entries) and any(r.since is None for r in entries)
    some = spark.createDataFrame([(3,), (None,)], "k long")
    assert found(K.load(t, 9, among=some)) == {r for r in want[8] if r[0] in (3, None)}
    gone = K.expire(t, 12)
    assert gone and all(found(K.load(t, v)) == want[v - 1] for v in (12, 13, 14)) and K.expire(t, 12) == 0


def test_a_version_is_saved_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for v in (1, 1):
        K.save_changes(t, *C.latest_changes(changes(spark, [("insert", 1, 5, "a", 1)]), ["k"], ["n"]), 1)
    assert len(K._entries(t)) == 1
    K.save_changes(t, *C.latest_changes(changes(spark, [("delete", 1, None, None, 2)]), ["k"], ["n"]), 2)
    assert found(K.load(t, 1)) == {(1, 5, "a")} and found(K.load(t)) == set()


def test_bytes_written_follow_the_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    big = spark.range(200_000).selectExpr("id AS k", "id * 7 AS v", "sha2(cast(id AS string), 256) AS note")
    K.save_base(t, big, 0)
    base = K._entries(t)[0].bytes
    for b in range(20):
        rows = [("update", 10 * b + i, -1, "changed", i) for i in range(10)]
        K.save_changes(t, *C.latest_changes(changes(spark, rows), ["k"], ["n"]), b + 1)
    written = sum(r.bytes for r in K._entries(t) if r.version)
    assert written < base / 20
    got = K.load(t)
    assert got.count() == 200_000 and got.where("v = -1").count() == 200


def test_a_base_follows_when_changes_outgrow_it(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = lambda lo, hi: changes(spark, [("insert", k, k, f"note {k}", k) for k in range(lo, hi)])
    K.save_changes(t, *C.latest_changes(rows(0, 50), ["k"], ["n"]), 1)
    K.save_changes(t, *C.latest_changes(rows(50, 5000), ["k"], ["n"]), 2)
    bases = [r.version for r in K._entries(t) if r.since is None]
    assert bases == [2] and K.load(t).count() == 5000


def test_a_subscription_replays_to_the_same_table(spark, tmp_path):
    all_rows = []
    for b, (rows, now) in enumerate(batches(7, 5, truncates=(2,))):
        changes(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
        all_rows += rows
    last = now
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = lambda: spark.readStream.schema(changes(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for state in ("a", "b"):  # the second run has lost its checkpoint
        C.subscribe(stream(), f"{tmp_path}/out", "t", schema, ["k"], ["n"], f"{tmp_path}/{state}").awaitTermination()
        assert found(K.load(table(spark, f"{tmp_path}/out"))) == last


def test_audits_count_null_keys_and_truncates(spark, tmp_path):
    for b, rows in enumerate([[("insert", None, 5, "a", 1), ("insert", 1, 6, "a", 2)], [("update", None, 7, "a", 3)], [("truncate", None, None, None, 4), ("insert", 2, 1, "b", 5)]]):
        changes(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = spark.readStream.schema(changes(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    C.statement_audit(stream, f"{tmp_path}/out", "t", schema, "k", ["n"], f"{tmp_path}/state", "v").awaitTermination()
    got = {(r.batch_id, r.op): (r.rows, r.new_sum, r.old_sum) for r in spark.read.parquet(f"{tmp_path}/out/t_audit/*").collect()}
    assert got == {(0, "create"): (2, 11, None), (1, "alter"): (1, 7, 5), (2, "create"): (1, 1, None), (2, "drop"): (2, None, 13)}
