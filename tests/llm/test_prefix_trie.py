import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablespec.llm import prefix_trie as T
from tablespec.llm.radix_tree import RadixTree, common
from tests.oracles import agrees

COLUMNS = "conv_id long, turn long, role string, text string, key string, id string, part string, depth string, ends string, turns string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *("trap",) * 6) for r in rows], COLUMNS)


def plain(rows):
    """The nodes by the contract's words, from all prefixes of all rebuilt conversations."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns[conv].append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = defaultdict(int)
    for x in members:
        if x:
            kids[x[:-1]] += 1
    out = []
    for x, m in members.items():
        below = [y for y in members if y[: len(x)] == x]
        ends = sorted(c for c in m if built[c] == x)
        saved = sum((len(members[y]) - 1) * len(y[-1][1].encode()) for y in below if y)
        out.append((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), kids[x], sum(not kids[y] for y in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def nodes(spark, rows, parts=None):
    convs = T.shared_heads(T.sequences(frame(spark, rows)))
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return found(T.trie_nodes(convs))
    finally:
        if parts:
            spark.conf.unset("spark.sql.shuffle.partitions")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def conversations(seed, n, words=2, most=12):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"][t % 2 :][:1] + [None]), f"{r.randrange(words)}é" * r.randrange(3)) for c in r.sample(range(-3, 3 * n), n) for t in range(r.randint(1, most))]
    return rows


@pytest.mark.parametrize("seed, words, parts", [(1, 1, 1), (2, 2, 7), (3, 3, 12)])
def test_nodes_equal_those_of_all_prefixes(spark, seed, words, parts):
    rows = conversations(seed, 60, words)
    assert nodes(spark, rows, parts) == plain(rows)


def test_nulls_ties_repeats_and_one_deep_conversation(spark):
    rows = [(5, None, None, None), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 1, "user", None), (5, 1, "user", None), (6, 1, "x", "y"), (None, 1, "user", "a"), (7, 3, "user", "漢字"), (-4, 1, "user", "z"), (-5, 1, "user", "b")]
    rows += [(100, t, "user", f"turn {t % 7}") for t in range(300)] + [(103, t, "user", f"turn {t % 7}") for t in range(150)]
    assert nodes(spark, rows) == plain(rows)
    assert nodes(spark, rows, 9) == plain(rows)


def test_a_third_of_all_conversations_alike(spark, monkeypatch):
    """Copies of one conversation over many stretches, and lists of ends in many pieces."""
    monkeypatch.setattr(T, "PIECE_IDS", 3)
    rows = [(5 * c, t, "user", f"same {t}") for c in range(80) for t in range(10)] + conversations(4, 40)
    assert nodes(spark, rows, 16) == plain(rows)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(0, 1, "ab", "c"), (5, 1, "a", "bc"), (10, 1, "1:a", "b"), (15, 1, "", "1:ab")]
    assert nodes(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert nodes(spark, []) == []


def test_query_equals_its_oracle(spark):
    agrees(T.op13_prefix_trie(spark, "/root/testdata/sf0.001"), T.ORACLE, "/root/testdata/sf0.001")
    agrees(T.op13_prefix_trie(spark, "/root/testdata/sf0.01"), T.ORACLE, "/root/testdata/sf0.01")


def test_tree_holds_all_keys_in_order_and_grows_its_nodes():
    r = random.Random(7)
    keys = [bytes([a, b]) for a in range(256) for b in range(0, 256, 37)] + [bytes(r.choices(b"ab", k=r.randint(0, 30))) for _ in range(500)]
    tree = RadixTree()
    for k in keys:
        tree.add(k, k)
    assert type(tree.root.kids).__name__ == "Full"
    walked = [v for node, *_ in tree.walk() for v in node.values]
    assert walked == sorted(keys)
    kinds = {(type(n.kids).__name__, getattr(n.kids, "size", 0)) for n, *_ in tree.walk()}
    assert {("Few", 4), ("Few", 16), ("Full", 0)} <= kinds
    for node, parent, before, upto in tree.walk():
        assert node.some.startswith(node.some[:before]) and len(node.some) >= upto
    assert common(b"abcd", b"abxd") == 2 and common(b"ab", b"abc") == 2 and common(b"", b"a") == 0


def test_each_layout_is_reached():
    for n, kind in ((4, ("Few", 4)), (5, ("Few", 16)), (17, ("Indexed", 0)), (49, ("Full", 0))):
        tree = RadixTree()
        for b in random.Random(n).sample(range(256), n):
            tree.add(bytes([b, 1]), b)
        kids = tree.root.kids
        assert (type(kids).__name__, getattr(kids, "size", 0)) == kind and len(kids) == n
        assert [b for b, _ in kids] == sorted(b for b, _ in kids) and all(kids.get(b).values == [b] for b, _ in kids)
