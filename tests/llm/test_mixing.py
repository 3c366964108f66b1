from collections import defaultdict

from tablespec.llm import mixing
from tests.llm.common import awkward, frame, text
from tests.oracles import agrees


def test_targets_and_limits(spark):
    rows = awkward() + [(1000 + i, text(i, 200), "en", f"s{i % 5}") for i in range(300)]
    got = mixing.mix_sources(frame(spark, rows), shard_words=5000, carry=("source",)).collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 3 * mixing.BLOCK


def test_same_in_any_order(spark):
    df = frame(spark, awkward())
    key = lambda d: sorted(map(repr, mixing.mix_sources(d).collect()))
    assert key(df) == key(df.repartition(7))


def test_highest_quotients(spark):
    weights = [53.0, 24.0, 23.0, 0.5, 0.0]
    df = spark.createDataFrame([(i, w, 100, 60) for i, w in enumerate(weights)], "k int, w double, cap long, seats long")
    got = {r.k: r.q for r in mixing.sainte_lague(df, [], ["k"], "w", "seats", "cap", "q").collect()}
    seats = [0] * len(weights)
    for _ in range(60):
        seats[max(range(len(weights)), key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))] += 1
    assert [got[i] for i in range(len(weights))] == seats


def test_no_rows(spark):
    assert mixing.mix_sources(frame(spark, awkward()).limit(0)).count() == 0


def test_query_equals_sql(spark):
    agrees(mixing.op2_mixing(spark, "/root/testdata/sf0.001"), mixing.ORACLE, "/root/testdata/sf0.001")
