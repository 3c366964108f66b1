import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablespec.llm import alignment as A
from tablespec.llm.minimal_hash import MinimalHash
from tests.llm.common import awkward, frame


@pytest.fixture(scope="module")
def plain():
    """A text's tokens by the tokenizers themselves, links and groups by comparing all ranges; None for texts without tokens."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    units = A.public_units()

    def ranges(ids, lengths):
        ends = np.cumsum([len(lengths[i]) for i in ids]).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends))

    def align(text):
        if not text:
            return None
        a, b = ranges(tok.encode(" " + text, add_special_tokens=False).ids, units.a_bytes), ranges(sp.encode(text), units.b_bytes)
        if any(b"".join(held[i] for i, *_ in x) != (" " + text).encode() for x, held in ((a, units.a_bytes), (b, units.b_bytes))):
            return None
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        return len(a), len(b), groups, [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]

    return align


BITS = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "a", "don't", "B", "1", "22", "!", "é", "—", " ", "ñ", "漢", "<|endoftext|>", "<s>", "😀", "_", "'S", "\r\n", "word", "x", "٣", ".", "...", "the ", "ing", ";\r", "\x1c", "▁", "　", "0.5", ",", "\x00"]


def random_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def digest(found, docs):
    """The expected columns of each text from its plain alignment."""
    counts = Counter(p for x in found for p in set(x[3] if x else ()))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for d, x in zip(docs, found):
        if not x:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n = [counts[p] for p in x[3]]
        out.append((d, x[0], x[1], len(x[2]), len(n), sum(c == best[a] for (a, _), c in zip(x[3], n)), sum(n), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(spark):
    some = [r for r in awkward() if len(r[1] or "") < 3000]
    return some + [(1000 + k, t, "en", "a") for k, t in enumerate(random_texts(200, 9))] + [(None, "twice", "en", "a")] * 2


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_documents_equal_a_plain_alignment(spark, plain):
    docs = rows(spark)
    want = digest([plain(r[1]) for r in docs], [r[0] for r in docs])
    assert got(A.align_documents(frame(spark, docs).repartition(3))) == want


def test_several_sets_of_bins_and_small_trees_give_the_same(spark, plain, monkeypatch):
    docs = rows(spark)
    df = frame(spark, docs).repartition(12)
    want = got(A.align_documents(df))
    monkeypatch.setattr(A, "FAN", 2)
    assert got(A.align_documents(df, lookup_pairs=150)) == want


def test_units_join_to_the_tokenizers_tokens(plain):
    import pyarrow as pa

    units, texts = A.public_units(), random_texts(1500) + ["x" * 3000, "漢" * 500, "a\tb \tc\n\n  d", " ", "\n", "'s"]
    assert units.fine is not units.coarse
    for lo, hi, slots, off in units.slots(pa.array(texts)):
        for k in range(lo, hi):
            some, want = slots[off[k - lo] : off[k - lo + 1]], plain(texts[k])
            if want is None:
                assert not len(some) or not units.good[some].all()
            else:
                assert units.good[some].all() and ";".join(units.texts[x] for x in some.tolist()) == ";".join(want[2])


def test_a_full_cache_gives_the_same(monkeypatch):
    import pyarrow as pa

    texts = random_texts(300, 3)

    def shown(units):
        return [[units.texts[s] for s in slots[a:b].tolist()] for _, _, slots, off in units.slots(pa.array(texts)) for a, b in zip(off, off[1:])]

    wide = A.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = shown(wide)
    monkeypatch.setattr(A, "CACHE_UNITS", 20)
    monkeypatch.setattr(A.words, "CHUNK_BYTES", 100)
    narrow = A.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert shown(narrow) == want and shown(narrow) == want
    assert len(narrow.seen) - len(narrow.seen.new) <= 20


def test_long_texts_in_slices(spark, plain, monkeypatch):
    monkeypatch.setattr(A, "SLICE_UNITS", 5)
    units = A.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    text = "It's  a   test of\n\nlong texts' 12 " * 5
    assert [u for some in units.units(text) for u in some] == units.fine.findall(" " + text)


def test_pair_counts_are_of_documents(spark, plain):
    docs = rows(spark)
    counts = Counter(p for r in docs if (x := plain(r[1])) for p in set(x[3]))
    found = A.listed_pairs(A.pair_counts(frame(spark, docs).repartition(9)), A.public_units().b_ids)
    assert {(r.a, r.b): r.n_docs for r in found.collect()} == dict(counts)


def test_units_known_from_other_documents_may_hold_larger_ids(spark):
    """A worker's units also come from earlier documents; ids beyond those counted are no error."""
    A.align_documents(frame(spark, awkward())).count()
    docs = [(1, "a", "en", "a")]
    assert [r.n_links for r in A.align_documents(frame(spark, docs).coalesce(1)).collect()] == [1]


def test_no_rows_and_groups(spark):
    df = frame(spark, awkward())
    assert A.align_documents(df.limit(0)).count() == 0
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in A.align_documents(df.where("doc_id > 3"), with_groups=True).collect() if r.n_a)


def test_minimal_hash_is_a_bijection():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        found = MinimalHash.from_bytes(*MinimalHash.build(keys).to_bytes())
        assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        MinimalHash.build(np.array([5, 5]))
