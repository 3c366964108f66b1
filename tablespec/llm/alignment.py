"""Alignment of the tokens that two tokenizers cut a text into, and corpus-wide counts of aligned pairs.

Both tokenizers read a space and the text. Byte offsets where tokens of both end cut
the tokens into groups; a link is a pair of tokens whose byte ranges overlap. The
ranges of both are partitions of the same bytes, so each piece between two neighbouring
ends of either is exactly one link.

Texts are cut into units at places where both tokenizers surely cut: before white space,
after a line break and between letters and marks (``Units`` checks this on the piece
vocabulary when it opens it). A worker aligns each distinct unit once.

Counts: how many documents hold a pair. The first pass gives each task's pairs with
their counts, in bins of the pairs' hash. The distinct pairs of a bin get a minimal
perfect hash; the tasks' counts are added up as dense vectors indexed by it, FAN at a
time in a tree, each addition checking the keys. The second pass re-aligns the documents
and looks the counts up. It broadcasts at most LOOKUP_PAIRS pairs (or one bin): if there
are more, it runs once for each set of bins, and the sums of the runs are added by document.

Texts that are null, empty, or whose tokens do not give back their bytes have no tokens.
Repeated rows come as often as they are and count as often. A null id is an id like
others. Tables without rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm import words
from tablespec.llm.bpe import ByteBpe, byte_characters, plain_ranges
from tablespec.llm.minimal_hash import MinimalHash, mixed
from tablespec.llm.shared import written

BINS = 128
FAN = 8
LOOKUP_PAIRS = 4_000_000
CACHE_UNITS = 600_000
CACHE_CHARS = 16_000_000
HELD_PAIRS = 4_000_000
SLICE_UNITS = 1 << 20


class _Seen(dict):
    """Numbers of units by their text; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        slot = self[unit] = len(self)
        self.new.append(unit)
        return slot


class Units:
    """Aligned units of texts: per unit the tokens of each tokenizer, groups, links and the groups' text."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        self.bpe = ByteBpe(byte_file, special=False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        back = {c: b for b, c in byte_characters().items()}
        entries = self.bpe.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            self.a_bytes[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        sp = self.pieces
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_ids = len(pieces)
        if len(self.a_bytes) * self.b_ids >= 1 << 32:
            raise ValueError("pairs of ids need more than 32 bits")
        self.a_length, self.b_length = (np.array([len(x) for x in held], np.int64) for held in (self.a_bytes, self.b_bytes))
        self._patterns([p for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))])
        self.lead = len(sp.encode("\n"))
        self.clear()

    def _patterns(self, pieces: list[str]) -> None:
        """Units of plain texts are runs of letters and runs of marks, with the white space before them; others go from space to space."""
        letter, white = plain_ranges("L"), "\\s"
        joined = {(x, y) for p in pieces for x, y in zip(p, p[1:]) if not self.bpe.odd.search((x + y).replace("▁", " "))}
        is_letter = re.compile(f"[{letter}]")
        cut_words = not any(bool(is_letter.match(x)) != bool(is_letter.match(y)) for x, y in joined if "▁" not in (x, y))
        # white space before which the pieces always end
        breaks = "".join(re.escape(c) for c in " \n" if not any(y == ("▁" if c == " " else c) and not (x.isspace() or x == "▁") for x, y in joined))
        lines = not any("\n" in pair for pair in joined)
        self.coarse = re.compile(f"\\s*\\S+(?:(?![{breaks}])\\s+\\S*)*|\\s+" if breaks else "(?s:.+)")
        fine = f"{white}*[{letter}]+|{white}*[^{white}{letter}]+(?:(?<=')[{letter}]+)?|{white}+"
        self.fine = re.compile((f"\n(?=[^{white}])|" if lines else "") + fine) if cut_words and breaks == re.escape(" ") + re.escape("\n") else self.coarse
        # tabs and other white space count as marks' company unless they follow a space or line break
        self.rare = re.compile("[^\\S \n]")

    def clear(self) -> None:
        self.seen, self.first, self.chars = _Seen(), 0, 0
        self.n = np.zeros((4, 1024), np.int64)  # tokens a, tokens b, groups, links of a unit
        self.begin = np.zeros(1024, np.int64)
        self.good = np.zeros(1024, bool)
        self.links = array("q")
        self.texts: list[str] = []

    def _grow(self, size: int) -> None:
        if size > len(self.begin):
            more = max(size, 2 * len(self.begin)) - len(self.begin)
            self.n = np.pad(self.n, ((0, 0), (0, more)))
            self.begin, self.good = np.pad(self.begin, (0, more)), np.pad(self.good, (0, more))

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a space and the text, in lists of bounded size."""
        if not text:
            return
        text = " " + text
        pattern = self.coarse if self.bpe.odd.search(text) or self.rare.search(text) else self.fine
        if len(text) <= SLICE_UNITS:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while some := list(islice(found, SLICE_UNITS)):
                yield some

    def _learn(self) -> None:
        """Aligns the new units."""
        new, first = self.seen.new, self.first
        raw = [u.encode() for u in new]
        a = [self.bpe.encode(u) for u in new]
        b = [ids[self.lead :] for ids in self.pieces.encode(["\n" + u for u in new], num_threads=1)]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        good = [b"".join([a_bytes[i] for i in x]) == r == b"".join([b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw)]
        if not all(good):
            a, b = ([x if ok else [] for x, ok in zip(held, good)] for held in (a, b))
        na, nb = (np.fromiter(map(len, held), np.int64, len(new)) for held in (a, b))
        ids_a, ids_b = (np.array([i for x in held for i in x], np.int64) for held in (a, b))
        ends_a, ends_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        size = np.array([len(r) if ok else 0 for r, ok in zip(raw, good)], np.int64)
        upto = np.searchsorted(ends, np.cumsum(size), "right")
        groups = np.concatenate([[0], np.cumsum(both)])[upto]
        some = slice(first, first + len(new))
        self._grow(first + len(new))
        self.n[:, some] = na, nb, np.diff(groups, prepend=0), np.diff(upto, prepend=0)
        self.begin[some] = len(self.links) + np.concatenate([[0], upto[:-1]])
        self.good[some] = good
        self.links.frombytes((ids_a[at_a] * self.b_ids + ids_b[at_b]).tobytes())
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        cut = np.flatnonzero(both)
        cut_a, cut_b = [0, *(at_a[cut] + 1).tolist()], [0, *(at_b[cut] + 1).tolist()]
        shown = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        self.texts += [";".join(shown[i:j]) for i, j in zip([0, *groups[:-1].tolist()], groups.tolist())]

    def slots(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first row, last row + 1, numbers of the units of all rows, offsets of the rows in them).

        Units are known by these numbers until the next step."""
        _, off = words.buffers(col)
        for lo, hi in words.row_slices(off, 4 * words.CHUNK_BYTES):
            self._forget()
            self.first, found, rows = len(self.seen), [], np.zeros(hi - lo + 1, np.int64)
            get = self.seen.__getitem__
            for r, text in enumerate(col.slice(lo, hi - lo).to_pylist()):
                for some in self.units(text or ""):
                    found.append(np.fromiter(map(get, some), np.int64, len(some)))
                    rows[r + 1] += len(some)
            if self.seen.new:
                self._learn()
            yield lo, hi, np.concatenate(found) if found else np.zeros(0, np.int64), np.cumsum(rows)

    def _forget(self) -> None:
        """Units beyond the cache's size are known for one step only."""
        new, seen, first = self.seen.new, self.seen, self.first
        chars = self.chars + np.cumsum([0, *map(len, new)])
        keep = max(0, min(len(new), CACHE_UNITS - first, int(np.searchsorted(chars, CACHE_CHARS, "right")) - 1))
        for u in new[keep:]:
            del seen[u]
        if keep < len(new):
            del self.links[self.begin[first + keep] :]
            del self.texts[first + keep :]
        self.chars, seen.new = int(chars[keep]), []

    def links_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the units as codes of pairs, and the position of each one's unit."""
        size = self.n[3, slots]
        before = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(slots)), size)
        take = self.begin[slots][owner] + np.arange(len(owner)) - before[owner]
        return np.frombuffer(self.links, np.int64)[take] if len(self.links) else np.zeros(0, np.int64), owner


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(values)])
    return before[rows[1:]] - before[rows[:-1]]


@functools.lru_cache(maxsize=2)
def public_units(byte_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model") -> Units:
    """Both public tokenizers; a worker opens them once and keeps its units."""
    import public_tokenizers

    return Units(public_tokenizers.path(byte_file), public_tokenizers.path(piece_file))


def _bin(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes, 77) >> np.uint64(57)).astype(np.int64)


def _pairs(open_units: Callable[[], Units]):
    """First pass: each task's distinct pairs, by bin, with the number of its documents that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            return codes[first], np.add.reduceat(counts, first) if len(first) else counts

        def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            bins = _bin(codes)
            order = np.argsort(bins, kind="stable")
            codes, counts, cut = codes[order], counts[order], np.searchsorted(bins[order], np.arange(BINS + 1))
            some = [k for k in range(BINS) if cut[k] < cut[k + 1]]
            data = [[x[cut[k] : cut[k + 1]].astype("<i8").tobytes() for k in some] for x in (codes, counts)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([part] * len(some), pa.int64()), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary())], names=["bin", "part", "codes", "counts"])

        units = open_units()
        for batch in batches:
            for lo, hi, slots, off in units.slots(batch.column(0)):
                good = _sums(~units.good[slots], off) == 0
                doc = np.repeat(np.arange(hi - lo), np.diff(off))
                seen = np.unique((doc << 32 | slots)[good[doc]])
                codes, owner = units.links_of(seen & (1 << 32) - 1)
                codes = np.unique((seen >> 32)[owner] << 32 | codes) & (1 << 32) - 1
                held.append(np.unique(codes, return_counts=True))
                size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if size:
            yield rows(*merged(held))

    return count


def _tree(parts: DataFrame, top: int, schema: str, fold: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Folds the rows (bin, part, ...) of each bin into one, at most FAN parts, numbered 0 to top, in a step."""
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("bin", "part").applyInArrow(fold, schema)
        if top < FAN:
            return parts
        top //= FAN


def _long(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_py(), "<i8")


def _row(table: pa.Table, **more: bytes) -> pa.Table:
    held = {"bin": table["bin"][:1], "part": table["part"][:1]} | {k: pa.array([v], pa.binary()) for k, v in more.items()}
    return pa.table(held)


def _union(table: pa.Table) -> pa.Table:
    return _row(table, codes=np.unique(np.concatenate([_long(x) for x in table["codes"]])).tobytes())


def _add_dense(table: pa.Table) -> pa.Table:
    total = _long(table["counts"][0]).copy()
    for x in table["counts"][1:]:
        total += _long(x)
    return _row(table, counts=total.tobytes())


def _dense(parts: pa.Table, hashes: pa.Table) -> pa.Table:
    """The counts of some tasks as one vector indexed by the bin's hash."""
    place, keys = MinimalHash.from_bytes(hashes["h_sizes"][0].as_py(), hashes["h_bits"][0].as_py()), _long(hashes["h_keys"][0])
    total = np.zeros(len(keys), np.int64)
    for codes, counts in zip(parts["codes"], parts["counts"]):
        codes = _long(codes)
        at = place.index(codes)
        if (at < 0).any() or (keys[at] != codes).any():
            raise ValueError("a pair is not among the hashed ones")
        total[at] += _long(counts)
    return _row(parts, counts=total.tobytes())


def _hash_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, data in zip(batch.column(0), batch.column(1)):
            codes = _long(data)
            place = MinimalHash.build(codes)
            keys = np.zeros(len(codes), np.int64)
            keys[place.index(codes)] = codes
            sizes, bits = place.to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([len(codes)], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys.tobytes(), sizes, bits))], names=["bin", "n", "keys", "sizes", "bits"])


def pair_counts(docs: DataFrame, open_units: Callable[[], Units] = public_units, text_col: str = "text") -> DataFrame:
    """One row a bin: its distinct pairs ``keys`` in the order of their hash (``sizes``, ``bits``), ``n`` of them, and their ``counts`` of documents."""
    parts = written(docs.select(F.col(text_col).alias("text")).mapInArrow(_pairs(open_units), "bin long, part long, codes binary, counts binary"))
    top = parts.agg(F.max("part")).first()[0] or 0
    distinct = _tree(parts.select("bin", "part", "codes"), top, "bin long, part long, codes binary", _union)
    hashes = written(distinct.select("bin", "codes").mapInArrow(_hash_bins, "bin long, n long, keys binary, sizes binary, bits binary"))
    first = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
    each = first.select("bin", "part").distinct().join(hashes, "bin")
    each = each.select(*(F.col(c).alias(f"h_{c}") for c in each.columns))
    kind = "bin long, part long, counts binary"
    vectors = first.groupBy("bin", "part").cogroup(each.groupBy("h_bin", "h_part")).applyInArrow(_dense, kind)
    return written(hashes.join(_tree(vectors, top // FAN, kind, _add_dense).select("bin", "counts"), "bin"))


def listed_pairs(counts: DataFrame, b_ids: int) -> DataFrame:
    """The rows of ``pair_counts`` as (a, b, n_docs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1)):
                keys = _long(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys // b_ids), pa.array(keys % b_ids), pa.array(_long(n))], names=["a", "b", "n_docs"])

    return counts.select("keys", "counts").mapInArrow(rows, "a long, b long, n_docs long")


def _best_by_a(counts: DataFrame, b_ids: int) -> dict[int, int]:
    """The highest count of each id of the first tokenizer: as many numbers as its vocabulary at most."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1)):
                a, inverse = np.unique(_long(keys) // b_ids, return_inverse=True)
                most = np.zeros(len(a), np.int64)
                np.maximum.at(most, inverse, _long(n))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(most)], names=["a", "n"])

    return dict(counts.select("keys", "counts").mapInArrow(best, "a long, n long").groupBy("a").agg(F.max("n")).collect())


class _Counts:
    """Counts of the pairs of some bins."""

    def __init__(self, rows: list, best: dict[int, int], b_ids: int):
        self.bins = {r.bin: (MinimalHash.from_bytes(r.sizes, r.bits), np.frombuffer(r.keys, "<i8"), np.frombuffer(r.counts, "<i8")) for r in rows}
        self.best = np.zeros(-(-(1 << 32) // b_ids), np.int64)  # for any id that a pair can hold
        self.best[list(best)] = list(best.values())
        self.b_ids = b_ids

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for pairs of other bins and -1 for pairs that no document holds."""
        out, distinct = np.zeros(len(codes), np.int64), _bin(codes)
        order = np.argsort(distinct, kind="stable")
        cut = np.searchsorted(distinct[order], np.arange(BINS + 1))
        for k, (place, keys, counts) in self.bins.items():
            some = order[cut[k] : cut[k + 1]]
            at = place.index(codes[some])
            out[some] = np.where((at >= 0) & (keys[at] == codes[some]), counts[at], -1)
        return out

    def is_best(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (counts > 0) & (counts == self.best[codes // self.b_ids])


def _look_up(open_units: Callable[[], Units], shared, with_groups: bool):
    """Second pass: the digest of each document, with the counts of the broadcast bins."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, table = open_units(), _Counts(*shared.value)
        known, best, total, strange = 0, *np.zeros((3, 0), np.int64)
        for batch in batches:
            for lo, hi, slots, off in units.slots(batch.column(1)):
                n, known = len(units.texts), min(known, units.first)
                if n > known:
                    if n > len(best):
                        best, total, strange = (np.pad(x, (0, 2 * n - len(x))) for x in (best, total, strange))
                    codes, owner = units.links_of(np.arange(known, n))
                    counts = table.of(codes)
                    best[known:n] = np.bincount(owner, table.is_best(codes, counts), n - known).astype(np.int64)
                    total[known:n] = np.bincount(owner, counts, n - known).astype(np.int64)
                    strange[known:n] = np.bincount(owner, counts < 0, n - known).astype(np.int64)
                    known = n
                good = (_sums(~units.good[slots], off) == 0) & (np.diff(off) > 0)
                if (good & (_sums(strange[slots], off) > 0)).any():
                    raise ValueError("a document holds a pair that the first pass did not see")
                sums = [_sums(x[slots], off) * good for x in (*units.n, best, total)]
                shown, texts = [], units.texts
                for r in range(hi - lo):
                    some = slots[off[r] : off[r + 1]].tolist() if good[r] else []
                    digest, groups = hashlib.sha256(), []
                    for k in range(0, len(some), SLICE_UNITS):
                        text = ";".join([texts[s] for s in some[k : k + SLICE_UNITS]])
                        digest.update((";" * (k > 0) + text).encode())
                        groups.append(text)
                    shown.append((digest.hexdigest() if some else "", ";".join(groups) if with_groups else None))
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *map(pa.array, sums), pa.array([s for s, _ in shown], pa.string())]
                names = ["id", "row_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if with_groups:
                    cols, names = [*cols, pa.array([g for _, g in shown], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return look


def align_documents(docs: DataFrame, open_units: Callable[[], Units] = public_units, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with_groups the groups' text."""
    spark, b_ids = docs.sparkSession, open_units().b_ids
    counts = pair_counts(docs, open_units, text_col)
    best, sets, held = _best_by_a(counts, b_ids), [[]], 0
    for r in counts.select("bin", "n").orderBy("bin").collect():
        if sets[-1] and held + r.n > lookup_pairs:
            sets.append([])
            held = 0
        sets[-1].append(r.bin)
        held += r.n
    found = None
    # only the sum over several sets needs to know its rows
    key = F.sha2(F.coalesce(text_col, F.lit("")), 256) if len(sets) > 1 else F.lit("")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("row_key"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row_key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    for some in sets:
        rows = counts.where(F.col("bin").isin(some)).select("bin", "keys", "counts", "sizes", "bits").collect() if some else []
        one = source.mapInArrow(_look_up(open_units, spark.sparkContext.broadcast((rows, best, b_ids)), with_groups), schema)
        found = one if found is None else found.union(one)
    if len(sets) > 1:
        same = ["id", "row_key", *(c for c in found.columns if c not in ("id", "row_key", "n_best", "count_sum"))]
        times = F.col("times") / len(sets)  # repeated rows are alike
        found = found.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.count("*").alias("times"))
        found = found.withColumns({c: (F.col(c) / times).cast("long") for c in ("n_best", "count_sum")}).withColumn("_", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
