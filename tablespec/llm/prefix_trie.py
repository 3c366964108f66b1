"""The trie of all prefixes of conversations, whose shared turns a trainer computes once.

A turn's id is the first 16 bytes of SHA-256 over its role's length, role and text, so
a conversation is a byte key of fixed-width ids, and only depths aligned to ids are
nodes. Conversations are ranged by key and number, so that a task holds a stretch of
them in order and builds an adaptive radix tree over it. Nodes inside a stretch are
whole there. Those on the path of its first or its last key may go on in neighbouring
stretches, however many conversations share them; their partial rows, one path for each
end of a stretch, are joined in key order by one pass with a stack as deep as a
conversation. No task sees more than its stretch, and copies of one conversation lie
in as many stretches as they need.

A conversation is one row of 16-byte ids and lengths, without texts, while it is built.
Turns are ordered by turn, null first; ties by role, then by id. Null roles and texts
are empty; rows with a null conversation take no part; repeated turns count as turns.
Tables without rows give no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm.radix_tree import RadixTree
from tablespec.llm.shared import written

WIDTH = 16
PIECE_IDS = 2000  # numbers of conversations in one row of an open node's list
HEAD_MOST, FAMILY = 8, 5

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: open nodes: place in key order, own and parent's key, counts of their whole children only, and the numbers that end there
_LOCAL = _NODE + ", open boolean, part long, seq long, node_key binary, parent_key binary, last_bytes long, ends string"
_NAMES = [f.split()[0] for f in _LOCAL.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]] for f in _LOCAL.split(", ")]


def turn_ids(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, id and bytes of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(whole, 1, 2 * WIDTH)).alias("id"), F.octet_length(text).cast("long").alias("bytes")
    )


def sequences(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its turns in order, as (id, bytes)."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "id", "bytes")
    listed = turn_ids(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def shared_heads(convs: DataFrame) -> DataFrame:
    """Each conversation with the first h turns of its family's first in place of its own; h is drawn from its number.

    A family is five consecutive numbers from a multiple of five on, negative ones too."""
    bases = convs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEAD_MOST).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_MOST + 1)).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    joined = convs.join(bases, F.col("_base") == F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "left")
    return joined.select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", 1, h), own)).alias("turns"))


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a stretch of conversations that come ordered by key and number."""
    tree, keys, numbers, lengths = RadixTree(), [], [], []
    for batch in batches:
        for conv, key, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            tree.add(key, len(keys))
            keys.append(key)
            numbers.append(conv)
            lengths.append(sizes)
    if not keys:
        return
    first, last, part = keys[0], keys[-1], TaskContext.get().partitionId()
    rec_of: list[int] = []  # the deepest record of each tree node
    depth, parent, ends, size, hashed = [], [], [], [], {}  # of each record; the hash of an open one's path
    for node, up, before, upto in tree.walk():
        above, key = rec_of[up] if up >= 0 else -1, keys[node.some]
        for d in range(before // WIDTH + (up >= 0), upto // WIDTH + 1):
            at = d * WIDTH
            if above < 0:
                hashed[0] = hashlib.sha256()
            elif above in hashed and (first.startswith(key[:at]) or last.startswith(key[:at])):
                hashed[len(depth)] = hashed[above].copy()
                hashed[len(depth)].update(key[at - WIDTH : at])
            parent.append(above)
            above = len(depth)
            depth.append(d)
            size.append(lengths[node.some][d - 1] if d else 0)
            ends.append([numbers[v] for v in node.values] if at == upto else [])
        rec_of.append(above)
    n = len(depth)
    least: list[int | None] = [None] * n
    convs, kids, leaves, saved = ([0] * n for _ in range(4))
    for i in range(n - 1, -1, -1):
        convs[i] += len(ends[i])
        if ends[i] and (least[i] is None or ends[i][0] < least[i]):
            least[i] = ends[i][0]
        up = parent[i]
        if i not in hashed:
            leaves[i] = leaves[i] or 1
            saved[i] += (convs[i] - 1) * size[i]
        if up >= 0:
            convs[up] += convs[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            if i not in hashed:
                kids[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    rows, seq = [], 0
    for i in range(n):
        up = parent[i]
        parent_key = hashed[up].digest() if up in hashed else None
        if i not in hashed:
            rows.append((least[i], depth[i], None if parent_key else least[up], convs[i], kids[i], leaves[i], saved[i], _digest(ends[i]), False, part, None, None, parent_key, None, None))
        else:
            # further pieces of the list of ends add nothing else
            for k in range(0, max(1, len(ends[i])), PIECE_IDS):
                counts = (convs[i], kids[i], leaves[i], saved[i]) if not k else (0, 0, 0, 0)
                text = ",".join(map(str, ends[i][k : k + PIECE_IDS]))
                rows.append((least[i], depth[i], None, *counts, None, True, part, seq, hashed[i].digest(), parent_key, size[i], text))
                seq += 1
        if len(rows) >= 5000:
            yield _batch(rows, _NAMES, _TYPES)
            rows = []
    if rows:
        yield _batch(rows, _NAMES, _TYPES)


def _batch(rows: list, names: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Open:
    """An open node while the pass is on its path."""

    def __init__(self, r: dict):
        self.key, self.parent_key, self.depth, self.bytes = r["node_key"], r["parent_key"], r["depth"], r["last_bytes"]
        self.least, self.convs, self.kids, self.leaves, self.saved = r["conv_id"], 0, 0, 0, 0
        self.digest, self.ended = hashlib.sha256(), False

    def take(self, r: dict) -> None:
        self.least = min(self.least, r["conv_id"])
        self.convs, self.kids, self.leaves, self.saved = self.convs + r["n_convs"], self.kids + r["n_children"], self.leaves + r["n_leaves"], self.saved + r["saved_tokens"]
        if r["ends"]:
            self.digest.update(("," * self.ended + r["ends"]).encode())
            self.ended = True

    def close(self, above: _Open | None) -> tuple:
        leaves, saved = self.leaves or 1, self.saved + (self.convs - 1) * self.bytes
        if above:
            above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved
        return self.least, self.depth, None, self.convs, self.kids, leaves, saved, self.digest.hexdigest(), self.key, self.parent_key


_JOINED = _NODE + ", node_key binary, parent_key binary"


def _join_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the partial rows of open nodes, which come in key order, and adds up their subtrees."""
    path: list[_Open] = []
    names = [f.split()[0] for f in _JOINED.split(", ")]
    types = [dict(zip(_NAMES, _TYPES))[c] for c in names]
    done: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if d < len(path) and path[d].key != r["node_key"]:
                while len(path) > d:
                    node = path.pop()
                    done.append(node.close(path[-1]))
            if d == len(path):
                path.append(_Open(r))
            path[d].take(r)
        if len(done) >= 5000:
            yield _batch(done, names, types)
            done = []
    while path:
        node = path.pop()
        done.append(node.close(path[-1] if path else None))
    if done:
        yield _batch(done, names, types)


def trie_nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): each with its least conversation, depth, parent, counts,
    the bytes that sharing its subtree saves, and a hash of the conversations that end there."""
    flat = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    flat = written(flat)
    local = written(flat.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_stretch, _LOCAL))
    one = local.where("open").repartition(1).sortWithinPartitions("part", "seq")
    joined = written(one.mapInArrow(_join_open, _JOINED))
    columns = [f.split()[0] for f in _NODE.split(", ")]
    inner = local.where("NOT open AND parent_key IS NULL").select(*columns)
    # children of open nodes learn their parent's least conversation
    hung = local.where("NOT open AND parent_key IS NOT NULL").select(*columns, "parent_key").unionByName(joined.select(*columns, "parent_key"))
    above = joined.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    return inner.unionByName(hung.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent")).select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(shared_heads(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 of the decimal number, bit by bit: each character enters with eight shifts
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda h, x: xor(xor(h, x) >> 1, 3988292384 * (xor(h, x) & 1))), 4294967295)"

ORACLE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM (
    SELECT c.conv_id, t.role, t.text, t.pos, 0 AS own FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, t.role, t.text, t.pos, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h)),
chain AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS path, 0::BIGINT AS bytes FROM convs
  UNION ALL
  SELECT r.conv_id, r.d, sha256(c.path || octet_length(encode(r.role)) || ':' || r.role || r.text), octet_length(encode(r.text))
  FROM chain c JOIN rebuilt r ON r.conv_id = c.conv_id AND r.d = c.d + 1),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM chain GROUP BY d, path),
member AS (SELECT c.conv_id AS m, n.* FROM chain c JOIN node n ON n.d = c.d AND n.path = c.path),
ends AS (
  SELECT d, path, sha256(string_agg(m::VARCHAR, ',' ORDER BY m)) AS sha FROM member
  WHERE (m, d) IN (SELECT (conv_id, max(d)) FROM chain GROUP BY conv_id) GROUP BY d, path),
below AS (SELECT DISTINCT a.d AS d, a.path AS path, b.d AS e, b.path AS sub, b.n_convs, b.bytes FROM member a JOIN member b ON a.m = b.m AND b.d >= a.d),
parent AS (SELECT DISTINCT b.d, b.path, a.conv_id AS parent_conv_id FROM member a JOIN member b ON a.m = b.m AND a.d = b.d - 1),
kids AS (SELECT d, path, count(*) FILTER (e = d + 1) AS n_children FROM below GROUP BY d, path),
sums AS (SELECT b.d, b.path, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved, count(*) FILTER (k.n_children = 0) AS leaves FROM below b JOIN kids k ON k.d = b.e AND k.path = b.sub GROUP BY b.d, b.path)
SELECT n.conv_id, n.d AS depth, p.parent_conv_id, n.n_convs, k.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM node n JOIN kids k USING (d, path) JOIN sums s USING (d, path) LEFT JOIN parent p USING (d, path) LEFT JOIN ends e USING (d, path)
"""
