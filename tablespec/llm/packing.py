"""Packing documents into fixed windows by best-fit decreasing.

Each document becomes its token ids and one end id. Documents longer than a
window are first cut into full windows; the remainders of a packing group are
placed in decreasing order, each into the tightest open window that still holds
it, found in a segment tree indexed by remaining capacity. A group is what one
task reads, at most ``group_docs`` documents, so no row moves between machines
and memory holds only lengths.

Null and empty texts give the end id alone. Repeated rows are packed as often as
they come. Tables without rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm.bpe import ByteBpe

WINDOW = 1024
GROUP_DOCS = 100_000
END_ID = 0


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities in use."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, window: int) -> None:
        self.held[capacity].append(window)
        node = capacity + self.leaves
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of least capacity >= need, removed, with its capacity."""
        node, tree = need + self.leaves, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.held[capacity].pop()
        if not self.held[capacity]:
            while node and not (node < self.leaves and (tree[2 * node] or tree[2 * node + 1])):
                tree[node] = 0
                node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number and offset of each piece, and the filled length of each window."""
    order = np.argsort(-lengths, kind="stable")
    where, offset, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_windows = OpenWindows(window)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        if found := open_windows.take(need):
            capacity, w = found
        else:
            capacity, w = window, len(filled)
            filled.append(0)
        where[i], offset[i] = w, window - capacity
        filled[w] = window - capacity + need
        if capacity > need:
            open_windows.put(capacity - need, w)
    return where, offset, np.array(filled, dtype=np.int64)


def pack_documents(docs: DataFrame, encoder: Callable[[], ByteBpe], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, and with_ids the ids themselves."""
    id_type = docs.schema[id_col].dataType
    schema = "`{}` {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long{}".format(id_col, id_type.simpleString(), ", ids array<int>" if with_ids else "")

    def flush(ids: list, parts: list, texts: list, base: int) -> Iterator[pa.RecordBatch]:
        row, start, length, crc, total = (np.concatenate([p[k] for p in parts]) for k in range(5))
        where, offset, filled = best_fit_decreasing(length, window)
        column = pa.chunked_array(ids).combine_chunks()
        for a in range(0, len(row), 50_000):
            b = slice(a, a + 50_000)
            cols = [column.take(pa.array(row[b])), *(pa.array(x[b]) for x in (start, length, crc, total, where + base, offset, filled[where]))]
            if with_ids:
                cols.append(pa.array([t.astype(np.int32) for t in texts[b]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"] + ["ids"] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder()
        base = TaskContext.get().partitionId() << 40
        ids, parts, texts, docs_held, done = [], [], [], 0, 0
        for batch in batches:
            for lo, hi, got, rows in bpe.ids(batch.column(1)):
                sizes = np.diff(rows) + 1
                stream = np.insert(got, rows[1:], END_ID).astype("<u4")
                begin = np.concatenate([[0], np.cumsum(sizes)])
                pieces = -(-sizes // window)
                row = np.repeat(np.arange(hi - lo), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * window
                length = np.minimum(window, sizes[row] - start)
                at = begin[row] + start
                raw = stream.tobytes()
                crc = np.array([zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist())], dtype=np.int64)
                parts.append((row + docs_held + lo, start, length, crc, sizes[row]))
                if with_ids:
                    texts += [stream[x : x + n] for x, n in zip(at, length)]
            ids.append(batch.column(0))
            docs_held += batch.num_rows
            if docs_held >= group_docs:
                yield from flush(ids, parts, texts, base + done)
                done += sum(len(p[0]) for p in parts)
                ids, parts, texts, docs_held = [], [], [], 0
        if parts:
            yield from flush(ids, parts, texts, base + done)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema)


@functools.lru_cache(maxsize=2)
def public_byte_bpe(file: str = "byte_bpe_50k.json") -> ByteBpe:
    """The public 50k byte-level encoder; a worker opens it once and keeps its cache of pieces."""
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(file))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_byte_bpe)
