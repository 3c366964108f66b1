"""Language identification, word-first with backoff to character n-grams.

Words are runs of letters (bytes other than ASCII non-letters and typographic
marks; A-Z lower-cased).
A known word scores its log frequency in each language. An unseen word falls back
to its character n-grams, from GRAM_MOST characters down to one: the longest
length at which any n-gram is known gives the mean of the known log frequencies.
A document's language has the highest sum; the score is that language's share
after normalising the sums.

Counts cover all training documents and all their languages. The model keeps, for
each language, its most frequent words and n-grams that occur at least twice
anywhere, at most EACH_MOST and at most its equal part of ALL_MOST, with their
counts in every language; totals are those of all words. Null texts and
texts without a letter give ``und`` with score 0, and so does every text if
nothing was learned. Ties go to the first language name. Repeated rows count as
often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm import words
from tablespec.llm.shared import crc_fold, written

GRAM_MOST = 5
#: words, n-grams
EACH_MOST = (1 << 17, 1 << 16)
ALL_MOST = (1 << 20, 1 << 19)
FLUSH = 400_000

_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character pieces inside the given words, and the word of each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    a, b = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    many = np.maximum(b - a - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), many)
    at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
    edge = np.append(lead, len(data))
    return words.mix(words.hash_runs(data, edge[at], edge[at + n], lower=True) + np.uint64(n)), word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, h, c): occurrences of words (kind 0) and n-grams (kind 1) in the batch's texts."""
    held: dict[str, list] = {}
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for kind in (0, 1):
                h, inverse = np.unique(np.concatenate([p[0] for p in parts[kind]]), return_inverse=True)
                c = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts[kind]])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], names=["lang", "kind", "h", "c"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for c in words.chunks(batch.column(0), separators=_NOT_LETTER, marks=False):
            row_lang, owner = langs[c.lo : c.hi], c.owner()
            for lang in set(row_lang):
                pick = np.flatnonzero((row_lang == lang)[owner]) if len(owner) else owner
                if not len(pick):
                    continue
                h, first, n = np.unique(c.hashes[pick], return_index=True, return_counts=True)
                at = np.sort(pick[first])
                weight = dict(zip(h.tolist(), n.tolist()))
                times = np.array([weight[x] for x in c.hashes[at].tolist()])
                parts = held.setdefault(lang, ([], []))
                parts[0].append((h, n))
                for k in range(1, GRAM_MOST + 1):
                    g, word = _grams(c.data, c.starts[at], c.ends[at], k)
                    g, inverse = np.unique(g, return_inverse=True)
                    parts[1].append((g, np.bincount(inverse, weights=times[word], minlength=len(g))))
                    size += len(g)
                size += len(h)
        if size > FLUSH:
            yield from merged()
            size = 0
    yield from merged()


class Model:
    """Log frequencies of known words and n-grams: a default for each language, and what a count adds to it.

    tables has, for words and n-grams, sorted key, language number and count of each entry."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], totals: np.ndarray, sizes: list[int]):
        self.langs, self.keys, self.at, self.lang, self.more = langs, [], [], [], []
        self.default = np.log(0.5 / (totals + 0.5 * np.maximum(1, np.array(sizes))[:, None]))
        for key, lang, count in tables:
            keys, at = np.unique(key, return_index=True)
            self.keys.append(keys)
            self.at.append(np.append(at, len(key)))
            self.lang.append(lang.astype(np.int32))
            self.more.append((np.log(count + 0.5) - np.log(0.5)).astype(np.float32))

    def _add(self, total: np.ndarray, kind: int, h: np.ndarray, row: np.ndarray, share: np.ndarray | None, found: np.ndarray) -> None:
        """Adds the entries of known hashes to their rows' sums, each by its share."""
        at = np.searchsorted(self.keys[kind], h[found])
        first, many = self.at[kind][at], np.diff(self.at[kind])[at]
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        value = self.more[kind][entry] if share is None else self.more[kind][entry] * np.repeat(share[found], many)
        slot = np.repeat(row[found].astype(np.int64), many) * len(self.langs) + self.lang[kind][entry]
        total += np.bincount(slot, weights=value, minlength=total.size).reshape(total.shape)

    def _known(self, kind: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[kind]
        return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)

    def sums(self, c: words.Chunk) -> np.ndarray:
        """The log score of each row of a chunk in each language."""
        total, owner = np.zeros((c.hi - c.lo, len(self.langs))), c.owner()
        known = self._known(0, c.hashes)
        total += np.bincount(owner[known], minlength=len(total))[:, None] * self.default[0]
        self._add(total, 0, c.hashes, owner, None, np.flatnonzero(known))
        left = np.flatnonzero(~known)
        for n in range(GRAM_MOST, 0, -1):
            if not len(left):
                break
            g, word = _grams(c.data, c.starts[left], c.ends[left], n)
            found = np.flatnonzero(self._known(1, g))
            hits = np.bincount(word[found], minlength=len(left))
            total += np.bincount(owner[left[hits > 0]], minlength=len(total))[:, None] * self.default[1]
            self._add(total, 1, g, owner[left][word], 1 / np.maximum(hits, 1)[word], found)
            left = left[hits == 0]
        return total


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts words and n-grams of all given documents with a language; keeps a bounded model of each language."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = known.mapInArrow(_count, "lang string, kind int, h long, c long")
    summed = counted.groupBy("kind", "h", "lang").agg(F.sum("c").alias("c")).groupBy("kind", "h").agg(F.sum("c").alias("c"), F.collect_list(F.struct("lang", "c")).alias("by"))
    seen = written(summed.where("c >= 2"))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(langs)}
    steps = seen.select("kind", F.inline("by")).groupBy("kind", "lang", F.ceil(F.log2("c") * 16).alias("step")).agg(F.min("c").alias("c"), F.sum("c").alias("all"), F.count("*").alias("n"))
    floors, held, totals = np.full((2, len(langs)), np.iinfo(np.int64).max), np.zeros((2, len(langs)), np.int64), np.zeros((2, len(langs)))
    for r in steps.orderBy(F.desc("step")).collect():
        i = number[r.lang]
        totals[r.kind, i] += r["all"]
        held[r.kind, i] += r.n
        if held[r.kind, i] <= min(EACH_MOST[r.kind], max(1, ALL_MOST[r.kind] // len(langs))):
            floors[r.kind, i] = r.c
    sizes = {r.kind: r["count"] for r in seen.groupBy("kind").count().collect()}
    tables = []
    for k in (0, 1):
        floor = F.map_from_arrays(F.lit(langs).cast("array<string>"), F.lit(floors[k].tolist()).cast("array<long>"))
        place = F.map_from_arrays(F.lit(langs).cast("array<string>"), F.lit(list(range(len(langs)))).cast("array<int>"))
        kept = seen.where((F.col("kind") == k) & F.exists("by", lambda b: b["c"] >= F.element_at(floor, b["lang"]))) if langs else seen.limit(0)
        entries = kept.select("h", F.inline("by")).select("h", F.element_at(place, F.col("lang")).alias("l") if langs else F.lit(0).alias("l"), "c").toArrow()
        h, lang, c = entries.column("h").to_numpy().astype(np.int64).view(np.uint64), entries.column("l").to_numpy(), entries.column("c").to_numpy()
        order = np.lexsort((lang, h))
        tables.append((h[order], lang[order], c[order].astype(np.float64)))
    return Model(langs, tables, totals, [sizes.get(k, 0) for k in (0, 1)])


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = {f"_in{k}": c for k, c in enumerate(carry)}
    base = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *(F.col(c).alias(k) for k, c in names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if m.langs:
                for c in words.chunks(batch.column(0), separators=_NOT_LETTER, marks=False):
                    total = m.sums(c)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    own = letters[c.lo : c.hi]
                    pred[c.lo : c.hi][own] = np.array(m.langs, dtype=object)[best[own]]
                    score[c.lo : c.hi][own] = share[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 2) for k in range(len(names))), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema.fields[2:])
    return base.mapInArrow(run, f"{kinds}lang_pred string, score double").select(*(F.col(k).alias(c) for k, c in names.items()), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_fold("doc_id", 3) == 1)
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, carry=("doc_id", "held_out"))
