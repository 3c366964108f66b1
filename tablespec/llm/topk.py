"""Exact top-k search by inner product with a pivot table.

Components become integers floor(SCALE * x), so scores are whole numbers. Pivots
are chosen by farthest-first traversal on a bounded sample; the table holds every
row's distances to all pivots, computed once. For a query q and row x the largest
|d(q, p) - d(x, p)| is a lower bound of their distance, which bounds the score
from above: (|q|^2 + |x|^2 - bound^2) / 2. Rows are evaluated in the order of
these bounds until the k-th best score exceeds every bound that is left, so the
result is exact. The bounded sample also gives each query a first k-th score.

Queries and rows meet in blocks: each block of queries is sent to every group of
rows once, and each meeting returns at most k rows a query. Vectors that are null
or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; vectors with a component so large that SCALE times it is infinite
take no part, and scores beyond a long end at its limits. Ties go to the smaller id.
Rows with equal ids are different rows: each is a candidate of other ids, and each
that is asked gets its own k rows; a query that is asked twice, id and vector alike,
counts once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablespec.llm.shared import written

SCALE = 256
TOP = 5
PIVOTS = 32
SAMPLE = 2048
ROW_BLOCK = 4096
QUERY_BLOCK = 512
EXACT = float(1 << 52)


def vectors(col: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of integer-valued doubles, padded with zeros."""
    flat, off = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy() - col.offsets[0].as_py()
    out = np.zeros((len(col), dim))
    sizes = np.diff(off)
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], sizes)] = np.floor(flat.astype(np.float64) * scale)
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first traversal from the first vector."""
    if not len(sample):
        return sample
    with np.errstate(over="ignore", invalid="ignore"):
        picked, far = [0], np.linalg.norm(sample - sample[0], axis=1)
        while len(picked) < min(pivots, len(sample)) and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(x), 0))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products; beyond exact doubles by Python integers, limited to a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        if not len(x) or np.linalg.norm(q) * np.sqrt((x * x).sum(1).max()) < EXACT:
            return (x @ q).astype(np.int64)
    whole = [int(a) for a in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(whole, row)))) for row in x], dtype=np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, first: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): for each query its k best rows, or those not worse than first."""
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        lower = np.zeros((len(q), len(x)), np.float32)
        for j in range(far.shape[1]):
            np.maximum(lower, np.abs(q_far[:, j, None].astype(np.float32) - far[:, j].astype(np.float32)), out=lower)
        # rounding may only weaken the bound: distances and single precision are good to about 1e-6 of their size
        slack = 4e-6 * (np.sqrt(qq)[:, None] + np.sqrt(xx))
        upper = (qq[:, None] + xx - np.maximum(lower - slack, 0.0) ** 2) / 2
        upper += 1 + 1e-9 * (qq[:, None] + xx)
    upper[~(np.isfinite(upper) & np.isfinite(lower))] = np.inf  # too large for a bound: always evaluated
    out_q, out_id, out_s = [], [], []
    for i in range(len(q)):
        order = np.argsort(-upper[i], kind="stable")
        order = order[ids[order] != q_ids[i]]
        bound = upper[i][order]
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, at, step = first[i], 0, 8 * k
        while at < len(order) and bound[at] >= least:
            take = order[at : at + step]
            best_id = np.concatenate([best_id, ids[take]])
            best = np.concatenate([best, scores(q[i], x[take])])
            keep = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[keep], best[keep]
            if len(best) == k:
                least = max(least, float(best[-1]))
            at, step = at + step, step * 2
        out_q.append(np.full(len(best), i))
        out_id.append(best_id)
        out_s.append(best)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def top_k(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, id and score of the k rows with the highest scores for each query, itself apart."""
    spark = rows.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    known = rows.where(good).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    asked = queries.where(good).select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).dropDuplicates(["id", "v"])
    count, dim = known.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    groups = max(1, -(-count // ROW_BLOCK))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // SAMPLE))) == 0).limit(SAMPLE).toArrow().combine_chunks()
    s_ids = sample.column("id").to_numpy().astype(np.int64)
    s_x = vectors(sample.column("v").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64())), dim, scale) if sample.num_rows else np.zeros((0, dim))
    order = np.argsort(s_ids, kind="stable")
    s_ids, s_x = s_ids[order], s_x[order]
    shared = spark.sparkContext.broadcast((s_ids, s_x, choose_pivots(s_x, pivots)))

    def blocks(size: int, seeds: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known_ids, known_x, pivot = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    ids, x = part.column(0).to_numpy().astype(np.int64), vectors(part.column(1), dim, scale)
                    first = np.full(len(ids), -np.inf)
                    if seeds and len(known_ids) > k:
                        for i in range(len(ids)):
                            s = scores(x[i], known_x)[known_ids != ids[i]]
                            if len(s) >= k:
                                first[i] = np.partition(s, len(s) - k)[len(s) - k]
                    values = (ids, x, to_pivots(x, pivot), first)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=["ids", "x", "far", "first"])

        return run

    form = "ids binary, x binary, far binary, first binary"
    row_blocks = known.repartition(groups, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))).mapInArrow(blocks(ROW_BLOCK, False), form)
    row_blocks = written(row_blocks.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("g"), *(F.col(c).alias(f"r_{c}") for c in ("ids", "x", "far"))))
    query_parts = max(1, -(-asked.count() // QUERY_BLOCK))
    query_blocks = asked.repartition(query_parts, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_parts))).mapInArrow(blocks(QUERY_BLOCK, True), form)
    sent = query_blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q, q_far, first, ids, x, far = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64 if c in (0, 4) else np.float64) for c in range(7))
                found = search(q_ids, q.reshape(len(q_ids), dim), q_far.reshape(len(q_ids), -1), first, ids, x.reshape(len(ids), dim), far.reshape(len(ids), -1), k)
                row = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in q.reshape(len(q_ids), dim)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[found[0]]), pa.array(row[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["query_id", "row", "id", "score"])

    met = sent.join(row_blocks.hint("merge"), "g").select("ids", "x", "far", "first", "r_ids", "r_x", "r_far").mapInArrow(meet, "query_id long, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
