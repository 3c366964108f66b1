import math
import random

import pytest

from tablespec.llm import topk
from tests.oracles import agrees


def brute(rows, queries, k, scale):
    good = {i: [math.floor(x * scale) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in queries if i in good):
        dot = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(dot[:k])}
    return out


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_equals_brute_force(spark, spread):
    r = random.Random(5)
    rows = [(i, [round(r.gauss(0, spread), 2) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, [0.5] * 3), (505, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, ids string, far double")
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=5, scale=256)
    assert {tuple(x) for x in got.collect()} == brute(rows, range(0, 506, 5), 5, 256)


def test_beyond_exact_doubles(spark):
    rows = [(i, [3e6 + i, 2e6 * (i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0"), k=3, scale=256)
    assert {tuple(x) for x in got.collect()} == brute(rows, [0], 3, 256)


def test_repeated_query_ids_get_their_own_rows(spark):
    """Two rows of one id are two queries; the same row twice is one."""
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(1, 60)] + [(50, [3.0, -9.0]), (50, [1.0, 6.0]), (50, [1.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id = 50"), scale=1).collect():
        got.setdefault(r.rank, set()).add((r.vec_id, r.score))
    want = {}
    for _, q in {(i, tuple(v)) for i, v in rows if i == 50}:
        dots = sorted((-int(q[0] * v[0] + q[1] * v[1]), i) for i, v in rows if i != 50)
        for k, (s, i) in enumerate(dots[:5]):
            want.setdefault(k + 1, set()).add((i, -s))
    assert got == want


def test_huge_finite_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [2.0, 3.0]), (2, [1e305, -1e300]), (3, [-1e300, 2.0]), (4, [1e308, 0.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 5), (4, 3)]  # the fifth is infinite when scaled; scores end at a long's limits, ties to the smaller id


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    agrees(topk.op1_topk_search(spark, "/root/testdata/sf0.001"), topk.ORACLE, "/root/testdata/sf0.001")
