"""Fingerprints of texts by a randomised edit embedding, and near copies found by them.

A walk reads a text's characters. At step j a shared random bit of (j, character) says
whether it goes on to the next character, so a character is read again for some steps,
and the walk's record is a longer string. Walks over two texts read alike as long as
the texts agree, and fall in step again soon after an edit, so a small edit distance
becomes a small Hamming distance of the records.

Each of SLOTS slots samples one step of the record, uniformly, as the last member below
the record's length of a chain of steps that all texts share: records of nearly the
same length are sampled at nearly the same steps. A slot holds eight bits of a hash of
slot, step and the character read there. The fingerprint is the slots in hexadecimal;
the likeness of two fingerprints is the share of slots that agree, so it estimates the
share of the records that do. Equal texts have equal fingerprints; a null text is empty,
and the empty fingerprint is like itself only.

``near_copies`` bands the slots (BAND consecutive ones are a sample of bits of the
record), takes the texts that share a band as candidates, and verifies each pair by its
whole fingerprints. A band's texts first meet the least of them, and then only texts that
are still of different classes, so no group of copies is expanded into all its pairs.

Repeated rows come as often as they are. Tables without rows give no rows; extra columns
are ignored. Null ids come last, like the smallest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablespec.llm.components import connected_components
from tablespec.llm.shared import written

SLOTS = 256
BAND = 8
STEPS = 1 << 12  # the random bits repeat after so many steps
KINDS = 1 << 8  # characters fall into so many classes by a hash
NEAR = 0.8
CHAIN, LONGEST = 64, 1 << 40  # members of a slot's chain, and the end of all chains


def _random(words: int, name: str) -> np.ndarray:
    """Fixed random 64-bit numbers that every machine draws alike."""
    return np.frombuffer(hashlib.shake_256(f"edit sketch {name}".encode()).digest(8 * words), "<u8")


class Walks:
    """The shared walk and the steps that the slots sample."""

    def __init__(self, slots: int = SLOTS):
        bits = np.unpackbits(_random(STEPS * KINDS // 64, "walk").view(np.uint8)).reshape(KINDS, STEPS)
        # how many steps the walk stays at a character of this class from this step on
        wide = np.concatenate([bits, bits], axis=1)
        at = np.where(wide, np.arange(2 * STEPS), 4 * STEPS)
        leaves = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :STEPS]
        self.stays = np.minimum(leaves - np.arange(STEPS) + 1, 255).astype(np.uint8).tobytes()
        draws = (_random(slots * CHAIN, "slots").reshape(slots, CHAIN) >> np.uint64(11)).astype(np.float64) / 2.0**53
        chains = np.zeros((slots, CHAIN), np.int64)  # the record of the least of uniform draws after step p is at (p + 1) / U
        for k in range(1, CHAIN):
            chains[:, k] = np.minimum((chains[:, k - 1] + 1) / np.maximum(draws[:, k], 2.0**-40), LONGEST).astype(np.int64)
        self.chains = np.maximum.accumulate(chains, axis=1)
        self.salt = _random(slots, "salt")

    def steps(self, kinds: np.ndarray, begin: int = 0) -> np.ndarray:
        """The step at which the walk comes to each character, and the one at which it leaves the last."""
        stays, mask, at, out = self.stays, STEPS - 1, begin, [np.array([begin], np.int64)]
        for lo in range(0, len(kinds), 1 << 20):
            came = []
            come = came.append
            for row in (kinds[lo : lo + (1 << 20)] * STEPS).tolist():
                at += stays[row + (at & mask)]
                come(at)
            out.append(np.array(came, np.int64))
        return np.concatenate(out)

    def sampled(self, length: int) -> np.ndarray:
        """The step of each slot in a record of this length, which is not 0."""
        return np.take_along_axis(self.chains, (np.sum(self.chains < length, axis=1) - 1)[:, None], axis=1)[:, 0]

    def fingerprint(self, codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, np.uint8)
        step = self.sampled(int(steps[-1]))
        read = codes[np.searchsorted(steps, step, "right") - 1].astype(np.uint64)
        h = (self.salt ^ step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + read * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(56)).astype(np.uint8)


@functools.lru_cache(maxsize=2)
def shared_walks(slots: int = SLOTS) -> Walks:
    return Walks(slots)


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _kinds(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots that agree; an empty fingerprint agrees with an empty one only."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.count_nonzero(a == b)) / len(a)


class _Text:
    """A text with its walk and fingerprint."""

    def __init__(self, text: str | None, walks: Walks):
        self.text, self.walks, self.codes = text or "", walks, _codes(text)
        self.steps = walks.steps(_kinds(self.codes))
        self.print = walks.fingerprint(self.codes, self.steps)

    def edited_by(self, after: _Text) -> tuple[bytes, np.ndarray]:
        """SHA-256 and fingerprint of the text with its last half replaced by the start of the next one."""
        half = len(self.codes) // 2
        keep = len(self.codes) - half
        codes = np.concatenate([self.codes[:keep], after.codes[:half]])
        steps = np.concatenate([self.steps[:keep], self.walks.steps(_kinds(codes[keep:]), int(self.steps[keep]))])
        whole = self.text[:keep] + after.text[:half]
        return hashlib.sha256(whole.encode("utf-8", "surrogatepass")).digest(), self.walks.fingerprint(codes, steps)


#: hashes and fingerprints stay bytes until the result
_FIELDS = {"id": None, "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_DIGEST = "id {}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _digest(ids: list, pairs: list, id_type: pa.DataType, more: dict | None = None) -> pa.RecordBatch:
    cols = {k: [] for k in list(_FIELDS)[1:]}
    for text, after in pairs:
        sha, edited = text.edited_by(after)
        values = (len(text.codes), sha, text.print.tobytes(), edited.tobytes(), likeness(text.print, edited), likeness(text.print, after.print))
        for c, v in zip(cols.values(), values):
            c.append(v)
    held = [pa.array(ids, id_type), *(pa.array(c, _FIELDS[k]) for k, c in cols.items())]
    return pa.RecordBatch.from_arrays(held + list((more or {}).values()), names=[*_FIELDS, *(more or {})])


def _in_order(slots: int, id_type: pa.DataType):
    """All documents of a stretch but its last meet their next; the first and the last text of the stretch go on as they are."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, part, before, before_id = shared_walks(slots), TaskContext.get().partitionId(), None, None

        def edge(id_, kind: str, text: str) -> pa.RecordBatch:
            values = [pa.array([id_], id_type), *(pa.nulls(1, t) for t in list(_FIELDS.values())[1:])]
            return pa.RecordBatch.from_arrays([*values, pa.array([part], pa.int64()), pa.array([kind]), pa.array([text], pa.string())], names=[*_FIELDS, "part", "edge", "text"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                ids, pairs = [], []
                for id_, text in zip(*(c.to_pylist() for c in some.columns)):
                    now = _Text(text, walks) if before is None or (text or "") != before.text else before
                    if before is None:
                        yield edge(id_, "first", now.text)
                    else:
                        ids.append(before_id)
                        pairs.append((before, now))
                    before, before_id = now, id_
                if ids:
                    n = len(ids)
                    yield _digest(ids, pairs, id_type, {"part": pa.array([part] * n, pa.int64()), "edge": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string())})
        if before is not None:
            yield edge(before_id, "last", before.text)

    return walk


def _at_edges(slots: int, id_type: pa.DataType):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = shared_walks(slots)
        for batch in batches:
            for id_, text, after in zip(*(c.to_pylist() for c in batch.columns)):
                yield _digest([id_], [(_Text(text, walks), _Text(after, walks))], id_type)

    return walk


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row a document with the fingerprints of its text and of its text edited by the next document's, by descending id.

    Texts move once, into ranges of ids in order; each stretch needs one text of the next."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # ties by the text's hash; rows equal in both lie in any order, so copies of one row need no common task
    order = [F.desc_nulls_last("id"), F.xxhash64("text"), F.coalesce("text", F.lit(""))]
    spread = source.repartitionByRange(*order[:2], F.monotonically_increasing_id()).sortWithinPartitions(*order)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found = written(spread.mapInArrow(_in_order(slots, id_type), _DIGEST.format(kind) + ", part long, edge string, text string"))
    columns = list(_FIELDS)
    # which stretch follows which: one number a stretch
    parts = [r.part for r in found.where("edge = 'first'").select("part").orderBy("part").collect()]
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, after long")
    last = found.where("edge = 'last'").join(after, "part").select("id", "text", "after")
    first = found.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    edges = last.join(first, "after").select("id", "text", "next").mapInArrow(_at_edges(slots, id_type), _DIGEST.format(kind))
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return found.where("edge IS NULL").select(*columns).unionByName(edges).withColumns(shown).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, print): the fingerprint of each text, without any shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = shared_walks(slots)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([_Text(t, walks).print.tobytes().hex() for t in some.column(1).to_pylist()], pa.string())], names=["id", "print"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, f"id {docs.schema[id_col].dataType.simpleString()}, print string")


def _agree(a: str, b: str, slots: int):
    """The number of slots in which two fingerprints of equal size agree."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.substring(F.col(a), 2 * k + 1, F.lit(2)) == F.substring(F.col(b), 2 * k + 1, F.lit(2))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """Each document with class_id: texts whose fingerprints agree in a share
    ``near`` of their slots, directly or by others between, have the same one, the least id among them.

    Equal fingerprints meet first. Then each band's texts meet the band's least fingerprint, and after that only texts of
    different classes so far that share a band. A null id has a null class unless other documents share it. Texts
    that are empty are of one class."""
    prints = written(fingerprints(docs, id_col, text_col, slots))
    same = prints.groupBy("print").agg(F.min("id").alias("least"))
    same = written(same.withColumn("node", F.xxhash64("print")))
    full = same.where("print != ''")
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(slots // band - 1)), lambda k: F.substring(F.col("print"), 2 * band * k + 1, F.lit(2 * band))))
    banded = written(full.select("node", "print", bands.alias("band", "key")))
    hub = banded.groupBy("band", "key").agg(F.min("print").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = banded.join(hub, ["band", "key"]).where("print != hub").select("node", "print", "hub").distinct()
    enough = int(-(-near * slots // 1))
    links = written(met.where(_agree("print", "hub", slots) >= enough).select(F.col("node").alias("a"), F.xxhash64("hub").alias("b")))
    first = written(connected_components(links))
    held = banded.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left, right = (held.select("band", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "print", "component"))) for s in "ab")
    apart = left.join(right, ["band", "key"]).where("component_a < component_b").select("node_a", "print_a", "node_b", "print_b").distinct()
    more = apart.where(_agree("print_a", "print_b", slots) >= enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    classes = connected_components(links.unionByName(more))
    placed = same.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    known = placed.join(least, "component").select("print", "class_id")
    return prints.join(known, "print").select(F.col("id").alias(id_col), "class_id", F.col("print").alias("fingerprint"))


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
