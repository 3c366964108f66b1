import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tablespec.llm import quality_model as Q
from tests.llm.common import awkward, frame, text


def test_learns_and_scores_every_row(spark):
    good = [(i, text(i, 60), "en", "a") for i in range(200)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in text(900 + i, 60).split()), "en", "a") for i in range(100)]
    docs = frame(spark, good + bad + awkward()[:5])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(5, None, 0), (6, 1, 0)], "doc_id long, quality int, text int")
    weights = Q.train(docs.where("doc_id % 5 <> 0"), labels)
    got = {(r.doc_id, r.source): r.score for r in Q.score(docs, weights, carry=("doc_id", "source")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if i % 5 == 0 and (i, "a") in got]
    assert sum((got[i, "a"] >= 0.3) == (i < 200) for i in held) >= 0.95 * len(held)


def test_without_labels_or_rows(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weights = Q.train(docs, labels)
    assert {r.score for r in Q.score(docs, weights).collect()} == {0.5}
    assert Q.score(docs.limit(0), weights).count() == 0


def test_bounded_sample_of_labels(spark):
    docs = frame(spark, [(i, text(i, 20), "en", "a") for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    assert Q.train(docs, labels, train_most=40).shape == (Q.BUCKETS + 1,)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.85 * got.count()


def test_equals_plain_updates_and_dot_products(spark):
    """Updates and scores, one coordinate after the other, in dictionaries."""
    r = random.Random(6)
    examples = [(np.array(sorted(r.sample(range(50), 6)), np.int32), np.array([r.random() for _ in range(6)], np.float32), float(r.random() < 0.5)) for _ in range(80)]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= Q.L1:
            return 0.0
        return (math.copysign(Q.L1, z[i]) - z[i]) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for f, v, y in examples:
            x = {**dict(zip(f.tolist(), v.tolist())), Q.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * w[i]
                n[i] += g * g
    got = Q.ftrl(examples)
    assert np.allclose(got[[*range(50), Q.BUCKETS]], [weight(i) for i in [*range(50), Q.BUCKETS]], rtol=1e-5, atol=1e-8)
    weights = np.random.default_rng(1).normal(size=Q.BUCKETS + 1).astype(np.float32)
    rows = [(i, x) for i, (_, x, *_) in enumerate(awkward()) if x]
    scored = {s.id: s.score for s in Q.score(spark.createDataFrame(rows, "id long, text string"), weights, carry=("id",)).collect()}
    for i, x in rows:
        total = float(weights[-1]) + sum(float(weights[f]) * float(v) for _, _, _, fs, vs in Q.features(pa.array([x])) for f, v in zip(fs.tolist(), vs.tolist()))
        assert math.isclose(scored[i], 1 / (1 + math.exp(-max(-35, min(35, total)))), rel_tol=1e-5)
