import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablespec import registry
from tablespec.operators import integrity as I


def pairs(rows, equal=True):
    """All pairs by comparing each two rows (key, group, lo, hi)."""
    full = [r for r in rows if r[2] is None or r[3] is None or r[2] < r[3]]
    less = lambda x, y: x is None or y is None or x < y
    return {(a[0], b[0]) for a in full for b in full if a[0] < b[0] and (not equal or a[1] == b[1]) and less(a[2], b[3]) and less(b[2], a[3])}


def found(df, equal=("g",)):
    got = [(r.k_a, r.k_b) for r in I.exclude_violations(df, list(equal), "lo", "hi", "k").collect()]
    assert len(got) == len(set(got))
    return set(got)


def spans(make, kind, seed, n=150, holes=0.1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lo = r.uniform(-1e6, 1e6)
        hi = lo + r.choice([0, 1, 10, 1e3, 1e5, 1e6, -5]) * r.random()
        rows.append((k, r.randrange(3), None if r.random() < holes else make(lo), None if r.random() < holes else make(hi)))
    return rows, f"k int, g int, lo {kind}, hi {kind}"


KINDS = [
    ("bigint", int), ("double", float), ("float", lambda x: float(int(x))), ("decimal(20,4)", lambda x: Decimal(f"{x:.4f}")), ("smallint", lambda x: int(x / 80)),
    ("date", lambda x: datetime.date(2000, 1, 1) + datetime.timedelta(days=int(x / 1000))),
    ("timestamp", lambda x: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=x)), ("timestamp_ntz", lambda x: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=x)),
]


@pytest.mark.parametrize("kind, make", KINDS)
def test_pairs_equal_all_comparisons(spark, kind, make):
    rows, schema = spans(make, kind, 3)
    df = spark.createDataFrame(rows, schema)
    assert found(df) == pairs(rows) and found(df, ()) == pairs(rows, equal=False)


def test_far_bounds_and_tiny_ranges(spark):
    rows = [(1, 0, -(2**63), 2**63 - 1), (2, 0, 2**62, 2**62 + 1), (3, 0, 2**62 + 1, 2**62 + 2), (4, 0, 2**62, 2**62 + 2), (5, 0, None, None), (6, 0, 5, 5), (7, 0, -(2**63), -(2**62)), (8, 0, None, -(2**62))]
    assert found(spark.createDataFrame(rows, "k int, g int, lo bigint, hi bigint")) == pairs(rows)
    rows = [(k, 0, x, y) for k, (x, y) in enumerate([(1e-300, 2e-300), (1.5e-300, 1e300), (-1e-300, 1e-310), (0.0, 5e-324), (1.0, 1.0 + 2**-52), (1.0, 2.0), (-1e308, 1e308), (1e308, float("inf")), (-2.0, -1.0), (-1.5, -1.25)])]
    assert found(spark.createDataFrame(rows, "k int, g int, lo double, hi double")) == pairs(rows)


def test_few_rows_a_range_over_six_magnitudes(spark):
    rows = spark.range(20_000).selectExpr("id AS k", "(id * 7919) % 10000000 AS lo").withColumn("hi", F.expr("lo + cast(pow(10, k % 7) AS bigint)"))
    plan = I.exclude_violations(rows, [], "lo", "hi", "k")
    made = 0
    placed = I.placed_ranges(rows, "lo", "hi")
    levels = sorted(r._level for r in placed.select("_level").distinct().collect())
    assert levels == [6, 12, 18, 24]
    for at in (F.array("_level"), F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_level"))):
        made += placed.withColumn("_at", F.explode(at)).select(F.explode(F.array_distinct(F.array(F.expr("shiftright(_l, _at)"), F.expr("shiftright(_h, _at)"))))).count()
    assert made < 4 * 20_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in text and "CartesianProduct" not in text


def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch):
    """No pair is lost or doubled by blocks; a task compares a bounded number of pairs, whatever a cell holds."""
    monkeypatch.setattr(I, "SIDE", 8)
    monkeypatch.setattr(I, "TASK_PAIRS", 200)
    rows, schema = spans(int, "bigint", 5, n=400)
    rows += [(1000 + i, 1, 10, 10 + i % 5) for i in range(90)]
    df = spark.createDataFrame(rows, schema)
    assert found(df) == pairs(rows)
    assert I.exclude_violations(df, ["g"], "lo", "hi", "k").rdd.getNumPartitions() > 50


def test_comparisons_grow_with_the_pairs_found(spark):
    rows = spark.range(3000).selectExpr("id AS k", "(id * 7919) % 100000000 * 1000 AS lo").withColumn("hi", F.expr("lo + 70000000"))
    levels = [r._level for r in I.placed_ranges(rows, "lo", "hi", I.JOIN_BITS).select("_level").distinct().collect()]
    assert levels == [28]
    found = I.exclude_violations(rows, [], "lo", "hi", "k").count()
    cells = rows.selectExpr("explode(sequence(shiftright(lo, 27), shiftright(hi, 27))) AS c").groupBy("c").count().join(rows.selectExpr("shiftright(lo, 27) AS c").groupBy("c").agg(F.count("*").alias("n")), "c")
    assert cells.agg(F.sum(F.col("count") * F.col("n"))).first()[0] < 6 * found


def test_no_rows_and_no_order(spark):
    assert found(spark.createDataFrame([], "k int, g int, lo int, hi int")) == set()
    with pytest.raises(TypeError):
        I.exclude_violations(spark.createDataFrame([(1, 1, "a", "b")], "k int, g int, lo string, hi string"), [], "lo", "hi", "k")


def test_endless_ranges_in_merges_and_operations(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 5, 6), (2, None, 3), (2, 2, 4), (2, 9, 10), (3, None, None), (3, 1, 2)], "g int, lo int, hi int")
    assert {tuple(r) for r in I.merge_ranges(df, ["g"], "lo", "hi").collect()} == {(1, 1, None, 2, None), (2, None, 4, 2, None), (2, 9, 10, 1, 5), (3, None, None, 2, None)}
    ops = I.range_ops(spark.createDataFrame([(1, None, 5, 6), (None, 3, 3, None), (None, None, 1, None)], "a int, b int, c int, d int"), "a", "b", "c", "d").collect()
    assert [(r.overlaps, r.contains, r.adjacent, r.common_lo, r.common_hi) for r in ops] == [(True, True, False, 5, 6), (False, False, True, None, None), (True, True, False, 1, None)]


def test_few_rows_with_many_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """Partitions follow the pairs even where they are fewer than the session's; none is joined with another by its bytes."""
    monkeypatch.setattr(I, "SIDE", 20)
    monkeypatch.setattr(I, "TASK_PAIRS", 80_000)
    rows = spark.range(400).selectExpr("id AS k", "1 AS lo", "10 AS hi")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        out = I.exclude_violations(rows, [], "lo", "hi", "k")
        assert out.count() == 400 * 399 // 2
        held = [r.n for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(held) > 8 and max(held) < 20_000


def test_six_magnitudes_reads_the_events_of_all_users(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=40 * i), i % 3, "view" if i % 2 else "click") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    whole = pairs([(k, kind, at, at + datetime.timedelta(seconds=10 ** (k % 6))) for k, at, _, kind in rows])
    got = registry.QUERIES["j07_exclude_six_magnitudes"](spark, str(tmp_path)).collect()
    assert len(got) == len(whole) and {(r.event_id_a, r.event_id_b) for r in got} == whole


def shuffled_rows(spark, run):
    """Rows written by the shuffles of what runs."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        held = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return [held.apply(i) for i in range(held.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last)


def test_shuffled_rows_follow_the_rows_not_their_pairs(spark):
    """All ranges overlap, so pairs grow as the square; none is found since the kinds are equal."""

    def rows_for(n):
        rows = spark.range(n).selectExpr("id AS k", "id div 1000000 AS kind", "id AS lo", f"id + {n} AS hi")
        return shuffled_rows(spark, lambda: I.exclude_violations(rows, [], "lo", "hi", "k", differ=["kind"]).count())

    few, many = rows_for(10_000), rows_for(40_000)
    assert many < 5 * few and many < 30 * 40_000


@pytest.mark.parametrize("side", [1, 3, 16, 1 << 14])
def test_any_width_of_stretches_gives_the_same_pairs(spark, monkeypatch, side):
    monkeypatch.setattr(I, "SIDE", side)
    rows, schema = spans(int, "bigint", 11, n=200, holes=0.2)
    rows += [(500 + i, 1, 7, 9) for i in range(20)] + [(600 + i, 1, 9, 9 + i % 3) for i in range(20)]
    rows += rows[:5]  # equal keys are no pair
    df = spark.createDataFrame(rows, schema)
    got = [(r.k_a, r.k_b) for r in I.exclude_violations(df, ["g"], "lo", "hi", "k").collect()]
    assert set(got) == pairs(rows) and all(a < b for a, b in got)


def test_bounds_of_two_types_and_several_equal_columns(spark):
    r = random.Random(2)
    rows = [(k, r.randrange(2), r.choice(["x", "y"]), r.randrange(100), float(r.randrange(100)) + 0.5) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, g int, h string, lo int, hi double")
    assert found(df, ("g", "h")) == pairs([(k, (g, h), lo, hi) for k, g, h, lo, hi in rows])
