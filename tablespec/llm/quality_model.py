"""Quality classifier: hashed word n-gram logistic regression trained with FTRL.

Features are the unigrams and bigrams of a text's words (A-Z lower-cased) and of
their shapes (letter case, digits and marks at a word's ends; whether a word is
the one before again), hashed to BUCKETS, weighed 1 + ln(count) and scaled to unit
length. Training follows the
regularised leader (FTRL-proximal) example by example within a shard of at most
SHARD_DOCS documents; shards train apart and their weights are averaged by size,
so nothing gathers on one machine. At most TRAIN_MOST labelled rows, chosen by
hash, are used; with fewer, all are. Scores are sparse dot products through the
logistic function, from a table of BUCKETS weights.

Null and empty texts have no features and score the bias alone. Labels that are
null are not used. Without labels every score is 0.5. A document with several
labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm import words
from tablespec.llm.shared import crc_fold

BUCKETS = 1 << 18
TRAIN_MOST = 40_000
SHARD_DOCS = 10_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.05, 0.1
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_SHAPE[97:123] = _SHAPE[128:] = 2
_SHAPE[65:91], _SHAPE[48:58] = 3, 4
AGAIN = np.uint64(0x2545F4914F6CDD1D)


def _pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = np.flatnonzero(owner[1:] == owner[:-1])
    return words.mix(h[same] * words._K[0] + h[same + 1] * words._K[1]), owner[same]


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row offsets, feature numbers, their values), ascending within a row."""
    size = np.uint64(BUCKETS)
    for c in words.chunks(col):
        owner, rows = c.owner(), c.hi - c.lo
        last = c.ends - 1
        shape = _SHAPE[c.data[c.starts]]
        for back in range(3):
            shape = shape * np.uint64(263) + np.where(last - back >= c.starts, _SHAPE[c.data[np.maximum(last - back, 0)]], np.uint64(0))
        shape = words.mix(shape)
        again = np.flatnonzero((owner[1:] == owner[:-1]) & (c.hashes[1:] == c.hashes[:-1]))
        parts = [(c.hashes, owner), _pairs(c.hashes, owner), (words.mix(shape + np.uint64(1)), owner), _pairs(shape, owner), (np.full(len(again), AGAIN), owner[again])]
        h = np.concatenate([p[0] for p in parts]) % size
        key, n = np.unique(np.concatenate([p[1] for p in parts]).astype(np.uint64) * size + h, return_counts=True)
        off = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) * size)
        x = 1 + np.log(n)
        length = np.sqrt(np.diff(np.concatenate([[0.0], np.cumsum(x * x)])[off]))
        yield c.lo, c.hi, off, (key % size).astype(np.int32), (x / np.repeat(np.maximum(length, 1e-9), np.diff(off))).astype(np.float32)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after the given passes over (features, values, label)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(epochs):
        for f, v, y in examples:
            i, x = np.append(f, BUCKETS), np.append(v, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(np.arange(BUCKETS + 1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_most: int = TRAIN_MOST) -> np.ndarray:
    """Averaged weights learned from the labelled rows of docs."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    total = known.count()
    if total > train_most:  # the limit only bounds what is broadcast; the hash has chosen before it
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(total)) < train_most)
    chosen = F.broadcast(known.limit(2 * train_most))
    shards = max(1, -(-min(total, train_most) // SHARD_DOCS))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, f, x in features(batch.column(1)):
                at = pa.array(off.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(f)), pa.ListArray.from_arrays(at, pa.array(x))], names=["k", "y", "f", "x"])

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy(), kind="stable")
        f, x, y = table.column("f").combine_chunks(), table.column("x").combine_chunks().flatten().to_numpy(), table.column("y").to_numpy()
        flat, off = f.flatten().to_numpy(), f.offsets.to_numpy() - f.offsets[0].as_py()
        w = ftrl([(flat[off[i] : off[i + 1]], x[off[i] : off[i + 1]], y[i]) for i in order.tolist()])
        used = np.flatnonzero(w)
        return pa.table({"i": pa.array(used, pa.int64()), "w": pa.array(w[used] * len(y))})

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(chosen, F.col("_id") == F.col("id")).select(F.xxhash64("id", "_text").alias("k"), F.col("_text").alias("text"), "y")
    found = rows.mapInArrow(extract, "k long, y double, f array<int>, x array<float>").withColumn("shard", F.pmod("k", F.lit(shards)))
    learned = found.groupBy("shard").applyInArrow(fit_with_count(fit), "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    weights = np.zeros(BUCKETS + 2)
    weights[learned.column("i").to_numpy()] = learned.column("w").to_numpy()
    return (weights[:-1] / max(1.0, weights[-1])).astype(np.float32)


def fit_with_count(fit):
    """Adds a row that carries the shard's number of documents, for the average."""

    def run(table: pa.Table) -> pa.Table:
        count = pa.table({"i": pa.array([BUCKETS + 1], pa.int64()), "w": pa.array([float(table.num_rows)])})
        return pa.concat_tables([fit(table), count])

    return run


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = {f"_in{k}": c for k, c in enumerate(carry)}
    base = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, off, f, x in features(batch.column(0)):
                out[lo:hi] = np.diff(np.concatenate([[0.0], np.cumsum(w[f] * x, dtype=np.float64)])[off]) + w[BUCKETS]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(names))), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=[*names, "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"{kinds}score double").select(*(F.col(k).alias(c) for k, c in names.items()), "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_fold("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 5) != 0)
    weights = train(docs.where(~F.col("held_out")), labels)
    return score(docs, weights, carry=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
