"""LM scoring with a hierarchical Pitman-Yor model sampled by Gibbs.

Restaurants: one for each context, all sharing the parent restaurant of single
words, whose own base is uniform over the words and one unknown word. The context
of a token is the word before it, or the start of the text. Every word has a
restaurant of its own; only a CONTEXT_LEAST above 1 lets the words seen less often, or
beyond the CONTEXTS_MOST most frequent, share one. Customers of a context are the
tokens that follow it; its tables are customers of the parent.

A Gibbs step stands all customers of a dish up and seats them again: given all
other dishes, t tables have a probability in proportion to the weights of t new
tables times the generalised Stirling number of seatings of c customers at t
tables. A sweep does so for every dish of every restaurant, so each customer is
reseated; after BURN sweeps the predictive probabilities of SAMPLES states are
averaged.

Tokens go to buckets by their word, about BUCKET_TOKENS each, so a bucket holds a
word's dish in every context and in the parent. A word with more than SLICE_TOKENS
occurrences is sliced by context over several buckets and its parent's dish is
seated in the driver. A bucket samples its dishes, taking the other buckets for
like its own (the hash deals words evenly), and writes its states. Customers and
tables of each context are then summed over all buckets: the CONTEXTS_MOST most
frequent ones in one bounded array, all others as rows that are shuffled by context and
come back to the buckets that hold it. All tokens are scored with these sums, so the
probabilities of all words add up to one in every context. Tokens reach a bucket as distinct (word, context) counts per
batch of documents to be sampled, and as (word, context, document) counts to be
scored; scores go back as sums per document. Nothing is broadcast that grows with
the corpus, and no word, context or pair gathers in one task.

Null and empty texts are one end token. Repeated rows score alike and train as
often as they come. Without training rows every token has the base probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm import words
from tablespec.llm.shared import count_floor, crc_fold, small_batches, written

CONTEXTS_MOST = 65_000  # contexts whose sums are an array; those of all others are rows
CONTEXT_LEAST = 1
BUCKET_TOKENS = 2_000_000
SLICE_TOKENS = BUCKET_TOKENS // 4
BATCH_TOKENS = 2_000_000
BATCH_DOCS = 1 << 15
PAIRS_AT_ONCE = 1 << 18
STIRLING_MOST = 256
SAMPLES, BURN = 3, 5
CHILD, PARENT = (0.75, 5.0), (0.80, 10.0)
END = np.uint64(0x5851F42D4C957F2D)
START, OTHER, FIRST = 0, 1, 2
ESCAPE = 0xFFFF  # stands for a context without a code, which is its word's hash with the highest bit set
RARE = np.uint64(1 << 63)


@functools.lru_cache(maxsize=4)
def log_stirling(discount: float, most: int) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables, for c and t up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(most):
        stay = np.where(c > discount * t, out[c, 1:] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def draw_tables(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, other: np.ndarray, discount: float, theta: float) -> np.ndarray:
    """Tables of each dish, drawn given the base probability of the dish and the other tables of its restaurant.

    Above STIRLING_MOST customers the count comes from the Poisson law that the exact one approaches."""
    out = np.minimum(customers, 1)
    table = log_stirling(discount, STIRLING_MOST)
    some = np.flatnonzero((customers > 1) & (customers <= STIRLING_MOST))
    some = some[np.argsort(customers[some], kind="stable")]
    edges = np.flatnonzero(np.diff(customers[some], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        c = int(customers[some[a]])
        for lo in range(a, b, max(1, 1_000_000 // c)):
            rows = some[lo : min(b, lo + max(1, 1_000_000 // c))]
            w = np.cumsum(np.log(theta + discount * (other[rows, None] + np.arange(c))), axis=1)
            w += np.arange(1, c + 1) * np.log(base[rows, None])
            w += table[c, 1 : c + 1]
            out[rows] = 1 + np.argmax(w + rng.gumbel(size=w.shape), axis=1)
    many = np.flatnonzero(customers > STIRLING_MOST)
    if len(many):
        weight, c = (theta + discount * other[many]) * base[many], customers[many]
        lo, hi = np.zeros(len(many)), np.ones(len(many))
        for _ in range(60):  # y with y ** (d - 1) * (1 - y) = c / weight
            y = (lo + hi) / 2
            above = y ** (discount - 1) * (1 - y) > c / weight
            lo, hi = np.where(above, y, lo), np.where(above, hi, y)
        out[many] = np.minimum(c, 1 + rng.poisson(weight / discount * (1 - lo**discount)))
    return out


@dataclass
class State:
    """One sampled state: tables of each (word, context) entry, and the tables of each word in the parent."""

    entry_tables: np.ndarray
    tables: np.ndarray


def sample(word: np.ndarray, context: np.ndarray, count: np.ndarray, words_n: int, context_size: np.ndarray, scale: np.ndarray, buckets: int, seed: int) -> list[State]:
    """Gibbs states for entries (word, context, count > 0) of one of several buckets like it.

    context_size has the customers of each context in the whole corpus, scale how many times
    a word's occurrences here stand for all of its own."""
    rng = np.random.default_rng(seed)
    (d, theta), (d0, theta0) = CHILD, PARENT
    entry_tables, k = np.ones(len(count), np.int64), len(context_size)
    tables = np.ones(words_n, np.int64)
    here = np.bincount(context, weights=count, minlength=k)
    kind = np.log2(np.maximum(context_size, 1)).astype(np.int64)
    vocabulary = buckets * words_n
    multi = np.flatnonzero(count > 1)
    out = []
    for sweep in range(BURN + SAMPLES):
        customers = np.bincount(word, weights=entry_tables, minlength=words_n)
        root = (theta0 + d0 * buckets * tables.sum()) / (vocabulary + 1)
        p1 = (scale * (customers - d0 * tables) + root) / (theta0 + buckets * len(count) * max(1.0, entry_tables.mean() if len(count) else 1.0))
        # contexts of like size have like shares of tables, so a small one is not judged by its part in this bucket
        held = np.bincount(context, weights=entry_tables, minlength=k)
        share = np.bincount(kind, weights=held) / np.maximum(np.bincount(kind, weights=here), 1)
        total = np.where(buckets > 1, np.maximum(held, share[kind] * context_size), held)
        entry_tables[multi] = draw_tables(rng, count[multi], np.clip(p1[word[multi]], 1e-12, 1.0), total[context[multi]] - entry_tables[multi], d, theta)
        customers = np.bincount(word, weights=entry_tables, minlength=words_n).astype(np.int64)
        tables = draw_tables(rng, customers, np.full(words_n, 1 / (vocabulary + 1)), np.maximum(buckets * tables.sum() - tables, 0), d0, theta0)
        if sweep >= BURN:
            out.append(State(entry_tables.copy(), tables))
    return out


@dataclass
class Totals:
    """What all buckets have in common: customers and tables of each context, the parent's sums for each state, and sliced words."""

    size: np.ndarray
    tables: np.ndarray
    customers: np.ndarray
    roots: np.ndarray
    vocabulary: int
    sliced: np.ndarray
    sliced_count: np.ndarray
    sliced_own: np.ndarray

    def parent(self, own: np.ndarray) -> np.ndarray:
        """Probabilities of words in the parent, from their customers less discounts: a row for each state."""
        (d0, theta0) = PARENT
        root = (theta0 + d0 * self.roots) / (self.vocabulary + 1)
        return (own + root[:, None]) / (theta0 + self.customers)[:, None]

    def log10(self, seated: np.ndarray, p1: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 of the averaged predictive probability; seated and p1 have a row for each state."""
        (d, theta) = CHILD
        mean = np.zeros(len(context))
        for s in range(len(self.tables)):
            mean += (seated[s] + (theta + d * self.tables[s])[context] * p1[s]) / (theta + self.size)[context]
        return np.log10(mean / len(self.tables))


@dataclass
class Survey:
    """Contexts with a code (sorted hashes and their codes), sliced words with their slices, and sizes.

    rare_size is the size of the context that a token without a coded one has on average, 0 if all have codes;
    if words below CONTEXT_LEAST share a context, no other is without a code."""

    hashes: np.ndarray
    codes: np.ndarray
    size: np.ndarray
    sliced: np.ndarray
    slices: np.ndarray
    occurrences: np.ndarray
    buckets: int
    rare_size: float
    share: bool


def _tokens(c: words.Chunk, survey: Survey | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and context code of each token of a chunk, ends included."""
    n = c.counts() + 1
    last = np.cumsum(n) - 1
    h = np.zeros(int(n.sum()), np.uint64)
    is_word = np.ones(len(h), bool)
    is_word[last] = False
    h[is_word], h[last] = c.hashes, END
    row, u = np.repeat(np.arange(len(n)), n), np.full(len(h), OTHER, np.uint64)
    if survey is not None and len(h):
        if not survey.share:
            u[1:] = h[:-1] | RARE
        if len(survey.hashes):
            at = np.minimum(np.searchsorted(survey.hashes, h[:-1]), len(survey.hashes) - 1)
            u[1:] = np.where(survey.hashes[at] == h[:-1], survey.codes[at], u[1:])
        u[np.append(0, last[:-1] + 1)] = START
    return h, row, u


def _survey(docs: DataFrame) -> Survey:
    """Counts the words of training rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.int64()), pa.array(h.view(np.int64))]), pa.array(np.append(size, n))], names=["h", "n"])

        for batch in batches:
            for c in words.chunks(batch.column(0)):
                held.append(_tokens(c)[0])
                size += len(held[-1])
                if size > BATCH_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    table = written(docs.where("train").select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    tokens = table.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = table.where(F.col("h").isNotNull() & (F.col("h") != F.lit(int(END.astype(np.int64)))) & (F.col("n") >= CONTEXT_LEAST))
    floor = count_floor(found, "n", CONTEXTS_MOST)
    top = found.where(F.col("n") >= floor).toArrow()
    share = CONTEXT_LEAST > 1
    rare_size = 0.0 if share else found.where(F.col("n") < floor).agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n"), F.lit(0.0))).first()[0]
    h, n = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    order = np.argsort(h)
    ends = table.where(F.col("h") == F.lit(int(END.astype(np.int64)))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = np.concatenate([[ends, max(0.0, tokens - ends - n.sum())], n[order]])
    hot = table.where(F.col("h").isNotNull() & (F.col("n") > SLICE_TOKENS)).toArrow()
    hh, hn = hot.column("h").to_numpy().astype(np.int64).view(np.uint64), hot.column("n").to_numpy().astype(np.int64)
    by = np.argsort(hh)
    return Survey(h[order], np.arange(len(h)).astype(np.uint64) + np.uint64(FIRST), size, hh[by], -(-hn[by] // SLICE_TOKENS), hn[by], max(1, -(-tokens * 5 // (4 * BUCKET_TOKENS))), rare_size, share)


def _sliced_at(survey: Survey, h: np.ndarray) -> np.ndarray:
    """Each word's place among the sliced ones, -1 for all others."""
    if not len(survey.sliced):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(survey.sliced, h), len(survey.sliced) - 1)
    return np.where(survey.sliced[at] == h, at, -1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, a place of each, and the rank of each element; less memory than np.unique takes."""
    order = np.argsort(x)
    found = x[order]
    new = np.append(True, found[1:] != found[:-1])[: len(x)]
    rank = np.empty(len(x), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return found[new], order[new], rank


def _blobs(x: np.ndarray, at: np.ndarray, more: int = 0) -> pa.Array:
    """The bytes between any two neighbours of at, which shares x's memory, and some empty ones."""
    offsets = np.append(at, np.repeat(at[-1:], more)) * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(x)])


def _drained(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts)
    parts.clear()
    return out


_ROW = "bucket int, batch long, h binary, m binary, ctx binary, rare binary, who binary, n binary, keys binary"


def _batch(h: np.ndarray, u: np.ndarray, tag: np.ndarray, keys: list[np.ndarray], batch_id: int, survey: Survey, with_documents: bool) -> pa.RecordBatch:
    """Rows of one batch from the hash, context and tag (document and whether it trains) of each token."""
    buckets = survey.buckets
    contexts, _, place = _distinct(u)
    bits = np.uint64(16 + len(contexts).bit_length())
    unit, part = h.copy(), np.zeros(len(h), np.uint32)
    if len(survey.sliced):
        at = _sliced_at(survey, h)
        cut = np.flatnonzero(at >= 0)
        part[cut] = words.mix(u[cut]) % survey.slices[at[cut]].astype(np.uint64)
        unit[cut] += part[cut].astype(np.uint64) * words._K[2]
        del at, cut
    del u
    unit, first, inverse = _distinct(unit)
    unit_h, unit_part = h[first], part[first].astype(np.uint64)
    del h, part, first
    bucket = ((words.mix(unit_h) + unit_part) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((unit_h, bucket))
    rank = np.empty(len(unit), np.uint64)
    rank[order] = np.arange(len(unit)).astype(np.uint64)
    key = rank[inverse]
    key <<= bits
    place = place.astype(np.uint64)
    place <<= np.uint64(16)
    key |= place
    key |= tag
    del inverse, place, tag
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n, key = np.diff(np.append(new, len(key))).astype("<u4"), key[new]
    del new
    unit_h, who = unit_h[order].astype("<u8"), (key & np.uint64(0xFFFF)).astype("<u2")
    key >>= np.uint64(16)
    ctx = contexts[(key & (np.uint64(1) << bits - np.uint64(16)) - np.uint64(1)).astype(np.int32)]
    key >>= bits - np.uint64(16)
    m = np.bincount(key.astype(np.int32), minlength=len(unit)).astype("<u4")
    del key
    uncoded = ctx >= RARE
    rare = ctx[uncoded].astype("<u8")
    ctx[uncoded] = ESCAPE
    ctx = ctx.astype("<u2")
    if not with_documents:
        n *= who & np.uint16(1)
    which, start = np.unique(bucket[order], return_index=True)
    unit_cut = np.append(start, len(unit))
    cut = np.concatenate([[0], np.cumsum(m, dtype=np.int64)])[unit_cut]
    rare_cut = np.concatenate([[0], np.cumsum(uncoded)])[cut]
    more, none = int(with_documents), np.zeros(0, np.uint8)
    nothing = np.zeros(len(which) + 1, np.int64)
    key_bytes = np.concatenate(keys).astype("<i8") if with_documents else none
    cols = [
        pa.array(np.append(which, [batch_id % buckets] * more), pa.int32()), pa.array(np.full(len(which) + more, batch_id), pa.int64()), _blobs(unit_h, unit_cut, more), _blobs(m, unit_cut, more), _blobs(ctx, cut, more), _blobs(rare, rare_cut, more),
        _blobs(who, cut, more) if with_documents else _blobs(none, nothing), _blobs(n, cut, more), _blobs(key_bytes, np.append(nothing, [len(key_bytes)] * more)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[part.split()[0] for part in _ROW.split(", ")])


def _dealt(docs: DataFrame, shared, with_documents: bool) -> DataFrame:
    """Rows of a batch for a bucket: its words, the number of items of each, and for each item context, document and count.

    Without documents only training tokens count; where contexts lack codes, pairs of other rows are there with a count
    of 0, so that every bucket learns which contexts it will be asked for."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey: Survey = shared.value
        batch_id = TaskContext.get().partitionId() << 32
        held, keys, size, docs_held = ([], [], []), [], 0, 0

        def out() -> pa.RecordBatch:
            return _batch(*map(_drained, held), keys, batch_id, survey, with_documents)

        for batch in batches:
            key, train = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            for c in words.chunks(batch.column(0)):
                if size and (size > BATCH_TOKENS or docs_held + c.hi - c.lo > BATCH_DOCS):
                    yield out()
                    batch_id, keys, size, docs_held = batch_id + 1, [], 0, 0
                h, row, u = _tokens(c, survey)
                tag = train[c.lo : c.hi][row]
                if with_documents:
                    tag = (row + docs_held).astype(np.uint64) << np.uint64(1) | tag
                for x, part in zip((h, u, tag.astype(np.uint16)), held):
                    part.append(x)
                keys.append(key[c.lo : c.hi])
                docs_held += c.hi - c.lo
                size += len(h)
        if size:
            yield out()

    source = docs if with_documents or shared.value.rare_size else docs.where("train")
    return source.select("text", "key", "train").mapInArrow(deal, _ROW)


def _joined(col: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in col if x.is_valid and len(x.as_buffer())]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


@dataclass
class Items:
    """A bucket's items: their pair, the pairs' words and contexts, and the words' hashes; contexts without a code follow the
    coded ones in the order of rare, their hashes."""

    vocabulary: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    context: np.ndarray
    n: np.ndarray
    rare: np.ndarray


def _items(table: pa.Table, coded: int) -> Items:
    h, m, ctx, rare = (_joined(table.column(c), k) for c, k in (("h", "<u8"), ("m", "<u4"), ("ctx", "<u2"), ("rare", "<u8")))
    vocabulary, _, word = _distinct(h)
    rare, _, place = _distinct(rare)
    key = np.repeat(word.astype(np.int64) << 32, m)
    escaped = np.flatnonzero(ctx == ESCAPE)
    key |= ctx
    key[escaped] += coded + place - ESCAPE  # a context's place lies in the lower half
    del h, m, ctx, word, escaped, place
    pairs, _, pair = _distinct(key)
    return Items(vocabulary, pair, pairs >> 32, pairs & 0xFFFFFFFF, _joined(table.column("n"), "<u4"), rare)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            got = np.frombuffer(x.as_buffer(), "<i8")
            total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])


def score_corpus(docs: DataFrame, text_col: str = "text", train_col: str = "train", carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    names = {f"_in{k}": c for k, c in enumerate(carry)}
    docs = docs.select(F.col(text_col).alias("text"), F.col(train_col).alias("train"), *(F.col(c).alias(k) for k, c in names.items()))
    docs = docs.withColumn("key", F.xxhash64("text", "train", *names))
    survey = _survey(docs)
    shared = spark.sparkContext.broadcast(survey)
    k, buckets = len(survey.size), survey.buckets
    samples, parts = SAMPLES, -(-buckets // 4)

    def states(table: pa.Table) -> pa.Table:
        own: Survey = shared.value
        items, bucket = _items(table, k), table.column("bucket")[0].as_py()
        count = np.bincount(items.pair, weights=items.n, minlength=len(items.word)).astype(np.int64)
        entry, n_rare = np.flatnonzero(count), len(items.rare)
        count, context = count[entry], items.context[entry]
        used, word = np.unique(items.word[entry], return_inverse=True)
        vocabulary = items.vocabulary[used]
        per_word = np.bincount(word, weights=count, minlength=len(used))
        cut = _sliced_at(own, vocabulary)
        scale = np.where(cut >= 0, own.occurrences[np.maximum(cut, 0)] / per_word, 1.0) if len(own.sliced) else np.ones(len(per_word))
        every = lambda x: np.bincount(context, weights=x, minlength=k + n_rare)
        found = sample(word, context, count, len(per_word), np.append(own.size, np.maximum(every(count)[k:], own.rare_size)), scale, buckets, bucket)
        whole = cut < 0
        folded = np.where(context < k, context, OTHER)  # sums over all contexts need them too
        per_context = lambda x: np.bincount(folded, weights=x, minlength=k)
        sums = np.concatenate([[whole.sum()], [s.tables[whole].sum() for s in found], per_context(count), *(per_context(s.entry_tables) for s in found)]).astype("<i8")
        rows = [np.bincount(word, weights=s.entry_tables, minlength=len(whole))[~whole] for s in found]
        part = (words.mix(items.rare) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        which, start = np.unique(part[order], return_index=True)
        held = np.stack([every(x)[k:] for x in (count, *(s.entry_tables for s in found))])[:, order]
        cuts = list(zip(start, np.append(start, n_rare)[1:]))
        raw = lambda x, kind: pa.array([np.asarray(x).astype(kind).tobytes(), *[None] * len(which)], pa.binary())
        return pa.table({
            "bucket": pa.array([bucket] * (1 + len(which)), pa.int32()), "part": pa.array([None, *which.tolist()], pa.int32()), "multi": raw(np.concatenate([s.entry_tables[count > 1] for s in found]), "<u4"), "tables": raw(np.concatenate([s.tables for s in found]), "<u4"),
            "sums": raw(sums, "<i8"), "cut_h": raw(vocabulary[~whole], "<u8"), "cut_n": raw(np.concatenate([per_word[~whole], *rows]), "<i8"),
            "rare": pa.array([None, *(items.rare[order[a:b]].astype("<u8").tobytes() for a, b in cuts)], pa.binary()), "rare_n": pa.array([None, *(held[:, a:b].astype("<u4").tobytes() for a, b in cuts)], pa.binary()),
        })

    def rare_sums(table: pa.Table) -> pa.Table:
        """Customers and tables of the contexts of one part in the whole corpus, for each bucket that holds them."""
        sides = [(np.frombuffer(h.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<u4").reshape(1 + samples, -1)) for h, n in zip(table.column("rare"), table.column("rare_n"))]
        hashes, place = np.unique(np.concatenate([h for h, _ in sides]), return_inverse=True)
        total = np.stack([np.bincount(place, weights=np.concatenate([n[i] for _, n in sides])) for i in range(1 + samples)])
        out_h, out_n = [], []
        for h, _ in sides:
            at = np.searchsorted(hashes, h)
            at = at[total[0, at] > 0]
            out_h.append(hashes[at].astype("<u8").tobytes())
            out_n.append(total[:, at].astype("<u4").tobytes())
        none = pa.nulls(len(sides), pa.binary())
        return pa.table([table.column("bucket"), none, none, pa.array(out_h, pa.binary()), pa.array(out_n, pa.binary())], names=["bucket", "multi", "tables", "rare", "rare_n"])

    kinds = "bucket int, part int, multi binary, tables binary, sums binary, cut_h binary, cut_n binary, rare binary, rare_n binary"
    by_bucket = lambda df: df.repartitionById(buckets, "bucket")  # noqa: E731  # a hash would bring several buckets to one task
    sampled = written(by_bucket(_dealt(docs, shared, False)).groupBy("bucket").applyInArrow(states, kinds), shuffles_go=True)
    partial = sampled.where("part IS NULL").select("sums").mapInArrow(_add_up, "sums binary").repartition(8).mapInArrow(_add_up, "sums binary").collect()
    sums = sum((np.frombuffer(r.sums, "<i8") for r in partial), np.zeros(1 + samples + (1 + samples) * k, np.int64))
    size, tables = sums[1 + samples : 1 + samples + k].astype(np.float64), sums[1 + samples + k :].reshape(samples, k).astype(np.float64)
    vocabulary, roots, train_tokens = int(sums[0]) + len(survey.sliced), sums[1 : 1 + samples].astype(np.float64), int(size.sum())
    cut_n = np.zeros((1 + samples, len(survey.sliced)), np.int64)
    for r in sampled.where("cut_h != X''").select("cut_h", "cut_n").toLocalIterator():
        h = np.frombuffer(r.cut_h, "<u8")
        cut_n[:, np.searchsorted(survey.sliced, h)] += np.frombuffer(r.cut_n, "<i8").reshape(1 + samples, len(h))
    (d0, theta0), rng = PARENT, np.random.default_rng(11)
    sliced_own = np.zeros((samples, len(survey.sliced)))
    for s in range(samples):
        got = draw_tables(rng, cut_n[1 + s], np.full(len(survey.sliced), 1 / (vocabulary + 1)), np.full(len(survey.sliced), roots[s]), d0, theta0)
        sliced_own[s] = cut_n[1 + s] - d0 * got
        roots[s] += got.sum()
    known = spark.sparkContext.broadcast(Totals(size, tables, tables.sum(axis=1), roots, vocabulary, survey.sliced, cut_n[0], sliced_own))

    def scores(table: pa.Table, state: pa.Table) -> pa.Table:
        totals, own = known.value, shared.value
        items, who = _items(table, k), _joined(table.column("who"), "<u2")
        per_row = np.array([len(x.as_buffer()) // 2 for x in table.column("who")], np.int64)
        count = np.bincount(items.pair, weights=items.n * (who & 1), minlength=len(items.word)).astype(np.int64)
        per_word = np.bincount(items.word, weights=count, minlength=len(items.vocabulary)).astype(np.int64)
        entry, learned = np.flatnonzero(count), np.flatnonzero(per_word)
        cut = _sliced_at(own, items.vocabulary)
        own_part, seated = np.zeros((samples, len(per_word))), np.zeros((samples, len(count)))
        multi = entry[count[entry] > 1]
        t = np.zeros(len(count), np.int64)
        t[entry] = 1
        kept, roots_here = (_joined(state.column(c), "<u4").reshape(samples, -1) if state.num_rows else np.zeros((samples, 0), np.int64) for c in ("multi", "tables"))
        for s in range(samples):
            t[multi] = kept[s]
            seated[s, entry] = count[entry] - CHILD[0] * t[entry]
            own_part[s, learned] = np.bincount(items.word, weights=t, minlength=len(per_word))[learned] - d0 * roots_here[s]
        if len(own.sliced):
            own_part = np.where(cut >= 0, totals.sliced_own[:, np.maximum(cut, 0)], own_part)
            per_word = np.where(cut >= 0, totals.sliced_count[np.maximum(cut, 0)], per_word)
        size, tables = np.zeros(k + len(items.rare)), np.zeros((samples, k + len(items.rare)))
        size[:k], tables[:, :k] = totals.size, totals.tables
        for x, n in zip(state.column("rare"), state.column("rare_n")):
            if x.is_valid and len(x.as_buffer()):
                found = np.frombuffer(n.as_buffer(), "<u4").reshape(1 + samples, -1)
                at = k + np.searchsorted(items.rare, np.frombuffer(x.as_buffer(), "<u8"))
                size[at], tables[:, at] = found[0], found[1:]
        every, p1, log = replace(totals, size=size, tables=tables), totals.parent(own_part), np.zeros(len(count))
        for lo in range(0, len(count), PAIRS_AT_ONCE):
            some = slice(lo, lo + PAIRS_AT_ONCE)
            log[some] = every.log10(seated[:, some], p1[:, items.word[some]], items.context[some])
        base, seen = np.log10(per_word + 0.5)[items.word], (per_word > 0)[items.word]
        del seated, t, count, entry, multi, size, tables, every
        batches, place = np.unique(table.column("batch").to_numpy(), return_inverse=True)
        key = np.repeat(place.astype(np.int64) << 16, per_row)
        key |= who >> 1
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key, pair, n = key[first], items.pair[order], items.n[order].astype(np.float64)
        del order
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        values = ((key & 0xFFFF, "<u2"), (total(log[pair] * n), "<f8"), (total(base[pair] * n), "<f8"), (total(seen[pair] * n), "<u4"), (total(n), "<u4"))
        ids, at = np.unique(key >> 16, return_index=True)
        ids, at = batches[ids], np.append(at, len(first))
        keys = table.filter(pa.compute.greater(pa.compute.binary_length(table.column("keys")), 0))
        none = [b""] * keys.num_rows
        columns = {"batch": ids.tolist() + keys.column("batch").to_pylist()}
        for name, (x, kind) in zip(("who", "score", "base", "known", "size"), values):
            columns[name] = [np.asarray(x[a:b]).astype(kind).tobytes() for a, b in zip(at[:-1], at[1:])] + none
        columns["keys"] = [b""] * len(ids) + keys.column("keys").to_pylist()
        return pa.table([pa.array(v, pa.int64() if c == "batch" else pa.binary()) for c, v in columns.items()], names=list(columns))

    kinds = "batch long, who binary, score binary, base binary, known binary, size binary, keys binary"
    state = ["bucket", "multi", "tables", "rare", "rare_n"]
    brought = sampled.where("part IS NOT NULL").groupBy("part").applyInArrow(rare_sums, "bucket int, multi binary, tables binary, rare binary, rare_n binary")
    states_of = sampled.where("part IS NULL").select(*state).union(brought) if survey.rare_size else sampled.where("part IS NULL").select(*state)
    scored = by_bucket(_dealt(docs, shared, True)).groupBy("bucket").cogroup(by_bucket(states_of).groupBy("bucket")).applyInArrow(scores, kinds)

    def per_key(table: pa.Table) -> pa.Table:
        keys, who = _joined(table.column("keys"), "<i8"), _joined(table.column("who"), "<u2")
        out = {"key": pa.array(keys, pa.int64())}
        for c, kind in (("score", "<f8"), ("base", "<f8"), ("known", "<u4"), ("size", "<u4")):
            out[c] = pa.array(np.bincount(who, weights=_joined(table.column(c), kind), minlength=len(keys)))
        return pa.table(out)

    per_doc = scored.groupBy("batch").applyInArrow(per_key, "key long, score double, base double, known double, size double")
    per_doc = per_doc.groupBy("key").agg(*(F.avg(c).alias(c) for c in ("score", "base", "known", "size")))
    log_all = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))
    return docs.select("key", *names).join(per_doc, "key").select(
        *(F.col(x).alias(c) for x, c in names.items()), F.col("size").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("size") * F.lit(log_all)).alias("base_score"), "score",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_fold("doc_id", 5) == 1).withColumn("train", ~F.col("held_out"))
    return score_corpus(docs, carry=("doc_id", "held_out"))
