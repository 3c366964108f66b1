"""Quality rules with cross-document line frequency.

Words and exact lines give per-document measures (one Arrow pass, no shuffle).
Normalised lines (outer white space cut, A-Z lower-cased) are hashed, and the
distinct documents of a host that hold them are counted; documents with the same
text count once, so plain copies never make their own lines look like furniture.
A line is removed on a host where more than max(MIN_DOCS, HOST_SHARE of the
host's distinct texts) documents hold it. A document is depleted, and not kept,
if removal takes at least DEPLETED_SHARE of its words and leaves fewer than
MIN_WORDS. ``quality_rules`` judges the rows; ``clean_documents`` gives the kept rows
with the text that removal leaves: the other lines, joined as they were.

Null and empty texts have no words and fail the base rule. A null host is a host
of its own. Repeated rows and ids each keep their row. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm import words
from tablespec.llm.shared import written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_DOCS = 20
HOST_SHARE = 0.10
DEPLETED_SHARE = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ROW = np.uint64(0x9E3779B97F4A7C15)


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def _repeat_words(c: words.Chunk) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in the row."""
    h, first, owner = words.windows(c.hashes, c.woff, WINDOW, c.key)
    covered = np.zeros(len(c.hashes) + 1, dtype=np.int64)
    if len(h):
        _, inverse, n = np.unique(words.mix(h + owner.astype(np.uint64) * _ROW), return_inverse=True, return_counts=True)
        twice = first[n[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return _per_row(np.cumsum(covered[:-1]) > 0, c.woff)


def _lines(c: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row, first word and last word + 1 of each line with a word."""
    cut = np.zeros(len(c.data) + 1, dtype=bool)
    cut[c.off] = True
    cut[np.flatnonzero(c.data == 10) + 1] = True
    starts = np.flatnonzero(cut[:-1]) if len(c.data) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(c.data)) if len(starts) else starts
    ends = ends - (c.data[ends - 1] == 10) if len(starts) else ends
    a, b = np.searchsorted(c.starts, starts), np.searchsorted(c.starts, ends)
    keep = b > a
    starts, ends, a, b = starts[keep], ends[keep], a[keep], b[keep]
    return starts, ends, np.searchsorted(c.off, starts, "right") - 1, a, b, keep


def _measure(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for c in words.chunks(batch.column(0), lower=False, key=key):
            rows = c.hi - c.lo
            starts, ends, owner, a, b, _ = _lines(c)
            exact = words.mix(words.hash_runs(c.data, starts, ends, lower=False, key=key) + owner.astype(np.uint64) * _ROW)
            _, seen = np.unique(exact, return_index=True)
            dup = np.bincount(owner, minlength=rows) - np.bincount(owner[seen], minlength=rows)
            normal = words.hash_runs(c.data, c.starts[a], c.ends[b - 1], lower=True, key=key) if len(a) else np.zeros(0, np.uint64)
            _, first, inverse = np.unique(words.mix(normal + owner.astype(np.uint64) * _ROW), return_index=True, return_inverse=True)
            n_words = np.bincount(inverse, weights=b - a, minlength=len(first)).astype(np.int32)
            order = np.argsort(owner[first], kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=rows))]).astype(np.int32)
            text = words.hash_runs(c.data, c.off[:-1], c.off[1:], lower=False, key=key)
            solid = (c.data & 0xC0) != 0x80
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rows) + (rid + c.lo)), *(batch.column(k).slice(c.lo, rows) for k in range(1, batch.num_columns)),
                    pa.array(c.counts().astype(np.int64)), pa.array(_per_row(solid & ~words._SEP[c.data], c.off)), pa.array(_per_row(_SYMBOL[c.data], c.off)),
                    pa.array(dup.astype(np.int64)), pa.array(_repeat_words(c)), pa.array(text.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(normal[first][order].view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array(n_words[order])),
                ],
                names=["rid", *batch.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "line_hash", "line_words"],
            )
        rid += batch.num_rows


def _without(col: pa.Array, gone: pa.Array, key: int) -> pa.Array:
    """The texts without the lines whose normalised hashes are listed for the row."""
    listed, at = gone.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(gone.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    parts = []
    for c in words.chunks(col, lower=False, key=key):
        rows = c.hi - c.lo
        starts, ends, owner, a, b, _ = _lines(c)
        normal = words.hash_runs(c.data, c.starts[a], c.ends[b - 1], lower=True, key=key) if len(a) else np.zeros(0, np.uint64)
        whose = np.repeat(np.arange(rows), np.diff(at[c.lo : c.hi + 1])).astype(np.uint64)
        cut = np.isin(words.mix(normal + owner.astype(np.uint64) * _ROW), words.mix(listed[at[c.lo] : at[c.hi]] + whose * _ROW))
        starts, ends, owner = starts[cut], ends[cut], owner[cut]
        # a line goes with the line break before it; the first line of a text has none
        head = starts == c.off[owner]
        edge = np.zeros(len(c.data) + 1, np.int64)
        np.add.at(edge, starts - ~head, 1)
        np.add.at(edge, ends, -1)
        keep = np.cumsum(edge[:-1]) == 0
        left = np.flatnonzero(keep)
        first = np.searchsorted(left, c.off[owner[head]])
        inside = first < np.searchsorted(left, c.off[owner[head] + 1])
        keep[left[first[inside]]] = False
        off = np.concatenate([[0], np.cumsum(keep)])[c.off].astype(np.int64)
        parts.append(pa.LargeStringArray.from_buffers(rows, pa.py_buffer(off.tobytes()), pa.py_buffer(c.data[keep].tobytes())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())


def _clean(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches (text, removed line hashes or null, ...) without the second column and those lines."""
    for batch in batches:
        text, gone = batch.column(0).cast(pa.large_string()), batch.column(1)
        pick = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        if len(pick):
            order = np.arange(len(text))
            order[pick] = len(text) + np.arange(len(pick))
            text = pa.concat_arrays([text, _without(text.take(pa.array(pick)), gone.take(pa.array(pick)), key)]).take(pa.array(order))
        yield pa.RecordBatch.from_arrays([text.cast(pa.string()), *(batch.column(k) for k in range(2, batch.num_columns))], names=[batch.schema.names[0], *batch.schema.names[2:]])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] = (),
    min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, depleted_share: float = DEPLETED_SHARE, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Per document: id, the measures, base_failed, removed_words and kept; carry adds input columns."""
    return _judged(docs, id_col, text_col, host_col, carry, min_docs, host_share, depleted_share, min_words, words.fresh_key()).drop("removed_lines")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **limits) -> DataFrame:
    """The kept rows, all columns: the text without its common lines, and its length where lines went.

    Decisions are made without the texts' rows and joined by a key; rows equal in id, text and host share it."""
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("null"))
    key = words.fresh_key()
    keyed = docs.withColumn("_key", F.xxhash64(id_col, text_col, host))
    judged = _judged(keyed, "_key", text_col, host_col, (), *(limits.get(k, v) for k, v in (("min_docs", MIN_DOCS), ("host_share", HOST_SHARE), ("depleted_share", DEPLETED_SHARE), ("min_words", MIN_WORDS))), key)
    changes = judged.where("not kept or removed_lines is not null").groupBy("_key").agg(F.first("kept").alias("_kept"), F.first("removed_lines").alias("_gone"))
    left = keyed.join(changes, "_key", "left").where(F.coalesce("_kept", F.lit(True)))
    others = [c for c in docs.columns if c != text_col]
    source = left.select(text_col, "_gone", F.col("_gone").isNotNull().alias("_cut"), *others)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_gone")
    cleaned = source.mapInArrow(lambda batches: _clean(batches, key), kinds)
    return cleaned.withColumn(chars_col, F.when(F.col("_cut"), F.length(text_col).cast("long")).otherwise(F.col(chars_col))).select(*docs.columns)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: tuple[str, ...], min_docs: int, host_share: float, depleted_share: float, min_words: int, key: int) -> DataFrame:
    """What quality_rules returns, and removed_lines: the hashes of the row's common lines."""
    names = {f"_in{k}": c for k, c in enumerate((id_col, *carry))}
    source = docs.select(F.col(text_col).alias("text"), F.col(host_col).alias("host"), *(F.col(c).alias(k) for k, c in names.items()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    measured = written(source.mapInArrow(lambda batches: _measure(batches, key), f"rid long, {kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, line_hash array<long>, line_words array<int>"))
    host = F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit("null")).alias("host")
    texts = measured.select(host, "text_hash").distinct().groupBy("host").agg((F.count("*") * F.lit(host_share)).alias("share"))
    lines = measured.select("rid", host, "text_hash", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("rid", "host", "text_hash", "l.line_hash", "l.line_words")
    common = (
        lines.select("host", "line_hash", "text_hash").distinct().groupBy("host", "line_hash").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
        .join(texts, "host").where(F.col("docs") > F.col("share")).select("host", "line_hash")
    )
    removed = lines.join(common, ["host", "line_hash"], "left_semi").groupBy("rid").agg(F.sum("line_words").alias("removed_words"), F.collect_list("line_hash").alias("removed_lines"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    taken = F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = (taken >= depleted_share * F.col("n_words")) & (F.col("n_words") - taken < min_words)
    return measured.join(removed, "rid", "left").select(
        *(F.col(k).alias(c) for k, c in names.items()), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), taken.alias("removed_words"), (~base_failed & ~depleted).alias("kept"), "removed_lines",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, i, ws[i:i+7] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM g) GROUP BY 1),
l AS (SELECT doc_id, host, md5(text) AS th, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT md5(text)) * 0.1::DOUBLE AS share FROM d GROUP BY 1),
common AS (SELECT host, norm FROM lw JOIN hosts USING (host) GROUP BY host, norm, share HAVING count(DISTINCT th) > 20 AND count(DISTINCT th) > share),
gone AS (SELECT doc_id, sum(n) AS n FROM lw JOIN common USING (host, norm) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words >= 0.5 * n_words AND n_words - removed_words < 20) AS kept FROM m
"""
