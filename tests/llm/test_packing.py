import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablespec.llm import packing as P
from tests.llm.common import awkward, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(tokenizer):
    import pyarrow as pa

    r = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "a", "don't", "B", "1", "22", "!", "é", "—", " ", "ñ", "漢", P.ByteBpe.__name__, "<|endoftext|>", "😀", "_", "'S", "\r\n", " ", "x", "٣"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [x for _, x, *_ in awkward()]
    for lo, hi, ids, rows in P.public_byte_bpe().ids(pa.array(texts)):
        for i in range(lo, hi):
            assert ids[rows[i - lo] : rows[i - lo + 1]].tolist() == tokenizer.encode(texts[i] or "", add_special_tokens=False).ids


def test_long_pieces_that_differ_in_structure_only(tokenizer):
    """Words that agree under any sum of powers modulo 2**64."""
    import pyarrow as pa

    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [x for n in (1024, 2048, 4096) for x in (a[:n], a[:n].translate(str.maketrans("ab", "ba")))]
    for lo, hi, ids, rows in P.public_byte_bpe().ids(pa.array(texts)):
        for i in range(lo, hi):
            assert ids[rows[i - lo] : rows[i - lo + 1]].tolist() == tokenizer.encode(texts[i], add_special_tokens=False).ids


def test_long_texts_split_alike(tokenizer, monkeypatch):
    import pyarrow as pa

    from tablespec.llm import bpe

    monkeypatch.setattr(bpe, "LONG_TEXT", 7)
    long = "It's  a   test of\n\nlong texts' 12é " * 40
    ((_, _, ids, _),) = P.public_byte_bpe().ids(pa.array([long]))
    assert ids.tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(spark, tokenizer):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 6]
    got = P.pack_documents(frame(spark, rows).repartition(2), P.public_byte_bpe, with_ids=True).collect()
    texts, docs, windows = {r[0]: r[1] for r in rows}, defaultdict(list), defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) <= 1024 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        docs[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        pieces.sort(key=lambda p: p.start)
        assert [i for p in pieces for i in p.ids] == [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert all(p.doc_tokens == sum(q.length for q in pieces) for p in pieces)
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].sequence_tokens <= 1024


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 500)
    where, offset, filled = P.best_fit_decreasing(lengths)
    room, want = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [c for c in room if c >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(1024 - n)
            want += 1
    assert len(filled) == want and sorted(1024 - filled) == sorted(room)


def test_repeats_groups_and_no_rows(spark):
    df = frame(spark, awkward())
    got = P.pack_documents(df, P.public_byte_bpe, group_docs=3)
    assert got.selectExpr("sum(length)").first()[0] == P.pack_documents(df, P.public_byte_bpe).selectExpr("sum(length)").first()[0]
    assert P.pack_documents(df.limit(0), P.public_byte_bpe).count() == 0


def test_little_padding(spark):
    got = P.op8_packing(spark, "/root/testdata/sf0.01")
    filled = got.select("sequence_id", "sequence_tokens").distinct().selectExpr("sum(sequence_tokens) / (1024 * count(*)) AS f").first().f
    assert filled > 0.98
