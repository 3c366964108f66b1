import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np

from tablespec.llm import pitman_yor as P
from tests.llm.common import awkward, frame, text


def tokens(x):
    low = (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_score_and_counts(spark, monkeypatch):
    for name, value in (("CONTEXT_LEAST", 2), ("BUCKET_TOKENS", 9000), ("SLICE_TOKENS", 700), ("BATCH_TOKENS", 5000), ("BATCH_DOCS", 16)):
        monkeypatch.setattr(P, name, value)
    rows = awkward() + [(i, text(i, 80), "en", "a") for i in range(100, 160)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "coalesce(doc_id % 5 <> 1, true) AS learn")
    got = P.score_corpus(docs, train_col="learn", carry=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    count = Counter(w for i, x, *_ in rows if i is None or i % 5 != 1 for w in tokens(x))
    n, v = sum(count.values()), len(count)
    for r in got:
        words = tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_stirling_weights_count_all_seatings():
    """The weights of all seatings of c customers, by the plain rule one customer after the other."""
    d, ways = 0.75, {(1,): 1.0}
    for _ in range(6):
        more = Counter()
        for sizes, w in ways.items():
            more[(*sizes, 1)] += w
            for j, n in enumerate(sizes):
                more[(*sizes[:j], n + 1, *sizes[j + 1 :])] += w * (n - d)
        ways = more
    for t in range(1, 8):
        assert math.isclose(math.exp(P.log_stirling(d, 10)[7, t]), sum(w for s, w in ways.items() if len(s) == t), rel_tol=1e-9)


ENTRIES = [(0, 0, 4), (0, 1, 2), (1, 1, 7), (2, 0, 1), (2, 2, 3), (3, 2, 12), (3, 0, 5), (4, 1, 1)]


def totals_of(states, word, context, count, words_n, k):
    tables = np.array([np.bincount(context, weights=s.entry_tables, minlength=k) for s in states])
    return P.Totals(np.bincount(context, weights=count, minlength=k).astype(float), tables, tables.sum(axis=1), np.array([float(s.tables.sum()) for s in states]), words_n, np.zeros(0, np.uint64), np.zeros(0), np.zeros((len(states), 0)))


def predictive(samples, monkeypatch):
    monkeypatch.setattr(P, "SAMPLES", samples)
    word, context, count = np.array(ENTRIES).T
    k, words_n = 3, 5
    states = P.sample(word, context, count, words_n, np.bincount(context, weights=count).astype(float), np.ones(words_n), 1, 5)
    totals = totals_of(states, word, context, count, words_n, k)
    seated, own = np.zeros((samples, words_n + 1, k)), np.zeros((samples, words_n + 1))
    for i, s in enumerate(states):
        seated[i, word, context] = count - P.CHILD[0] * s.entry_tables
        own[i, :words_n] = np.bincount(word, weights=s.entry_tables, minlength=words_n) - P.PARENT[0] * s.tables
    p1 = totals.parent(own)
    return np.array([[10 ** totals.log10(seated[:, w, [u]], p1[:, [w]], np.array([u]))[0] for u in range(k)] for w in range(words_n + 1)])


def test_probabilities_sum_to_one(monkeypatch):
    """Over all words and one unknown word, in every context."""
    assert np.allclose(predictive(3, monkeypatch).sum(axis=0), 1, rtol=1e-12)


def test_equals_a_plain_sampler(monkeypatch):
    """A plain sampler seats one customer at a time, at tables with sizes."""
    (d, theta), (d0, theta0), r = P.CHILD, P.PARENT, random.Random(4)
    child, parent = {(w, u): [] for w, u, _ in ENTRIES}, {w: [] for w in range(5)}

    def p1(w):
        c, t = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - d0 * len(parent[w]) + (theta0 + d0 * t) / 6) / (theta0 + c)

    def sit(tables, discount, new):
        k = r.choices(range(len(tables) + 1), [*(n - discount for n in tables), new])[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def seat(w, u):
        total = sum(len(x) for (_, v), x in child.items() if v == u)
        if sit(child[w, u], d, (theta + d * total) * p1(w)):
            sit(parent[w], d0, (theta0 + d0 * sum(map(len, parent.values()))) / 6)

    for w, u, n in ENTRIES:
        for _ in range(n):
            seat(w, u)
    mean, kept = np.zeros((6, 3)), 0
    for sweep in range(1500):
        for w, u, n in ENTRIES:
            for _ in range(n):
                if leave(child[w, u]):
                    leave(parent[w])
                seat(w, u)
        if sweep >= 100:
            kept += 1
            for u in range(3):
                c, t = sum(n for _, v, n in ENTRIES if v == u), sum(len(x) for (_, v), x in child.items() if v == u)
                for w in range(6):
                    own = sum(child.get((w, u), [])) - d * len(child.get((w, u), []))
                    base = p1(w) if w < 5 else (theta0 + d0 * sum(map(len, parent.values()))) / 6 / (theta0 + sum(map(sum, parent.values())))
                    mean[w, u] += (own + (theta + d * t) * base) / (theta + c)
    assert np.allclose(predictive(1500, monkeypatch), mean / kept, rtol=0.05)


def test_no_training_rows_and_no_rows(spark):
    docs = frame(spark, awkward()).selectExpr("doc_id", "text", "false AS train")
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in P.score_corpus(docs).collect())
    assert P.score_corpus(docs.limit(0)).count() == 0


def test_beats_the_base_on_held_out_rows(spark):
    got = P.op4_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got.s > got.b


def test_probabilities_sum_to_one_over_buckets_and_slices(spark, monkeypatch):
    """Without contexts of their own, all words o give p(w | other) = "o w" / "o"; texts of one word give the end's."""
    for name, value in (("CONTEXT_LEAST", 10**9), ("BUCKET_TOKENS", 2000), ("SLICE_TOKENS", 400)):
        monkeypatch.setattr(P, name, value)
    vocabulary = [f"w{i}" for i in range(60)]
    r = random.Random(3)
    learn = [(" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=40)), True) for _ in range(300)]
    words = sorted({w for x, _ in learn for w in x.split()}) + ["unknown"]
    ask = [(x, False) for x in ["", *words, *(f"w0 {w}" for w in words)]]
    got = {r.text: 10**r.score for r in P.score_corpus(spark.createDataFrame(learn + ask, "text string, train boolean"), carry=("text",)).collect()}
    end = sum(got[w] for w in words) / (1 - got[""])
    assert math.isclose(end + sum(got[f"w0 {w}"] for w in words) / got["w0"], 1, rel_tol=1e-5)


def test_repeats_of_held_out_texts_score_apart(spark):
    """A held-out text that was also learned from scores far above its like."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=60)) for _ in range(400)]
    rows = [(i, x, True) for i, x in enumerate(texts[:300])] + [(1000 + i, x, False) for i, x in enumerate(texts[280:])]
    got = {row.id: row.score / row.n_tokens for row in P.score_corpus(spark.createDataFrame(rows, "id long, text string, train boolean"), carry=("id",)).collect()}
    assert min(got[1000 + i] for i in range(20)) > max(got[1000 + i] for i in range(20, 120))


def test_contexts_beyond_the_array_keep_their_own_restaurants(spark, monkeypatch):
    """Each word is mostly followed by one other: scores hardly depend on how many contexts have a code, nor do seldom ones share."""
    for name, value in (("BUCKET_TOKENS", 2000), ("SLICE_TOKENS", 400), ("BATCH_TOKENS", 3000)):
        monkeypatch.setattr(P, name, value)
    r = random.Random(6)

    def walk(n):
        at, out = r.randrange(150), []
        for _ in range(n):
            out.append(f"w{at}")
            at = (at * 7 + 3) % 150 if r.random() < 0.9 else r.randrange(150)
        return " ".join(out)

    rows = [(i, walk(25), i % 4 > 0) for i in range(240)]
    docs = spark.createDataFrame(rows, "id long, text string, train boolean")
    got = {}
    for most in (5, 65_000):
        monkeypatch.setattr(P, "CONTEXTS_MOST", most)
        got[most] = {x.id: x.score / x.n_tokens for x in P.score_corpus(docs, carry=("id",)).collect()}
    assert len(got[5]) == 240 and all(math.isclose(got[5][i], got[65_000][i], rel_tol=0.1) for i in got[5])
    held = [i for i, _, train in rows if not train]
    assert math.isclose(sum(got[5][i] for i in held), sum(got[65_000][i] for i in held), rel_tol=0.02)
    assert sum(got[5][i] for i in held) / len(held) > -1.2  # 2.2 for words alone


def test_a_batch_takes_little_memory_and_keeps_every_token():
    rng, n = np.random.default_rng(3), 1 << 19
    h = rng.zipf(1.2, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = np.append(np.uint64(0), h[:-1]) | P.RARE
    u[rng.random(n) < 0.5] = np.uint64(7)
    tag = (np.sort(rng.integers(0, 1000, n)) << 1 | 1).astype(np.uint16)
    top, counts = np.unique(h, return_counts=True)
    survey = P.Survey(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(2), top[counts > n // 20], np.full((counts > n // 20).sum(), 3), counts[counts > n // 20], 4, 1.0, False)
    want = Counter(zip(h.tolist(), u.tolist(), (tag >> 1).tolist()))
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    batch = P._batch(h.copy(), u.copy(), tag.copy(), [np.arange(1000)], 5, survey, True)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert peak < 90 * n  # with np.unique and all arrays kept it was 165 bytes a token
    got = Counter()
    for row in batch.to_pylist():
        words_of = np.repeat(np.frombuffer(row["h"], "<u8"), np.frombuffer(row["m"], "<u4"))
        ctx = np.frombuffer(row["ctx"], "<u2").astype(np.uint64)
        ctx[ctx == P.ESCAPE] = np.frombuffer(row["rare"], "<u8")
        for w, c, d, k in zip(words_of.tolist(), ctx.tolist(), np.frombuffer(row["who"], "<u2").tolist(), np.frombuffer(row["n"], "<u4").tolist()):
            got[w, c, d >> 1] += k
    assert got == want
    assert np.frombuffer(batch.to_pylist()[-1]["keys"], "<i8").tolist() == list(range(1000))


def test_a_write_leaves_no_shuffle_files_if_asked(spark):
    from tablespec.llm.shared import written

    tracker, name = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.sparkContext._jvm.System.gc()
    kept = lambda: tracker.shuffleStatuses().size()
    before, was = kept(), spark.conf.get(name)
    out = written(spark.range(1000).repartition(3, "id").groupBy("id").count(), shuffles_go=True)
    assert out.count() == 1000 and spark.conf.get(name) == was
    written(spark.range(1000).repartition(3, "id").groupBy("id").count(), shuffles_go=True)
    assert kept() <= before + 1  # the count's own
