import hashlib
import random

import numpy as np

from tablespec.llm import edit_sketch as E
from tests.llm.common import awkward, frame, text


def plain_steps(codes, walks, begin=0):
    """The walk bit by bit: at each step a shared bit of step and class says whether to go on."""
    bits = np.unpackbits(E._random(E.STEPS * E.KINDS // 64, "walk").view(np.uint8)).reshape(E.KINDS, E.STEPS)
    step, out = begin, [begin]
    for k in E._kinds(codes).tolist():
        while not bits[k, step % E.STEPS]:
            step += 1
        step += 1
        out.append(step)
    return out


def test_steps_equal_a_walk_bit_by_bit():
    walks = E.shared_walks()
    for t in ("", "a", text(1, 200), "é漢字😀 " * 50, "aaaa" * 300):
        codes = E._codes(t)
        assert walks.steps(E._kinds(codes)).tolist() == plain_steps(codes, walks)
        assert walks.steps(E._kinds(codes), 777).tolist() == plain_steps(codes, walks, 777)


def test_samples_are_even_and_shared():
    walks = E.Walks(4096)
    for length in (1, 10, 1000, 50_000):
        at = walks.sampled(length)
        assert at.min() >= 0 and at.max() < length
        if length > 10:
            assert abs(at.mean() / length - 0.5) < 0.03 and abs(np.mean(at < length / 4) - 0.25) < 0.03
    assert np.mean(walks.sampled(10_000) == walks.sampled(9_000)) > 0.87


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    walks, out = E.shared_walks(), {}

    def fingerprint(t):
        codes = E._codes(t)
        return walks.fingerprint(codes, np.array(plain_steps(codes, walks)))

    for r, after in zip(rows, rows[1:] + rows[:1]):
        a, b = r[1] or "", after[1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        p, e, n = fingerprint(a), fingerprint(edited), fingerprint(b)
        out[r[0]] = (len(a), hashlib.sha256(edited.encode()).hexdigest(), p.tobytes().hex(), e.tobytes().hex(), E.likeness(p, e), E.likeness(p, n))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_documents_equal_plain_ones(spark):
    rows, seen = [], set()
    for r in awkward():
        if r[0] not in seen and len(r[1] or "") < 6000:
            rows.append(r)
            seen.add(r[0])
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r[0]: tuple(r)[1:] for r in E.fingerprint_documents(frame(spark, rows)).select(*COLUMNS).collect()}
        finally:
            spark.conf.unset("spark.sql.shuffle.partitions")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == expected(rows)


def test_repeats_one_row_and_no_rows(spark):
    df = frame(spark, awkward())
    assert E.fingerprint_documents(df).count() == len(awkward())
    assert E.fingerprint_documents(df.limit(0)).count() == 0
    one = E.fingerprint_documents(df.where("doc_id = 8")).first()
    assert one.near_next == 1.0 and one.n_chars > 0
    repeats = E.fingerprint_documents(df.where("doc_id = 6")).collect()
    assert len(repeats) == 2 and all(r.near_next == 1.0 for r in repeats)


def test_likeness_follows_edits():
    walks, r = E.shared_walks(), random.Random(4)
    base = text(9, 600)
    whole = E._Text(base, walks)

    def changed(n):
        words = base.split(" ")
        for k in r.sample(range(len(words)), n):
            words[k] = r.choice(["x", "longer", "of", words[k] + "y"])
        return E.likeness(whole.print, E._Text(" ".join(words), walks).print)

    few, some, many = (np.mean([changed(n) for _ in range(8)]) for n in (2, 20, 300))
    assert few > 0.8 and few > some > many and many < 0.5
    other = E.likeness(whole.print, E._Text(text(10, 600), walks).print)
    half = E.likeness(whole.print, whole.edited_by(E._Text(text(10, 600), walks))[1])
    assert other < 0.25 and 0.4 < half < 0.75


def test_near_copies_equal_all_pairs(spark):
    r = random.Random(2)
    bases = [text(40 + k, 200) for k in range(6)]
    texts = []
    for k, b in enumerate(bases):
        for _ in range(5):
            words = b.split(" ")
            words[r.randrange(len(words))] = r.choice(["new", "other"])
            texts.append(" ".join(words))
    texts += bases + bases[:2] + ["", None, "short", text(90, 50)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    walks = E.shared_walks()
    prints = [E._Text(t, walks).print for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if E.likeness(prints[a], prints[b]) >= E.NEAR:
                    label[b] = label[a] = min(label[a], label[b])
    got = {x.doc_id: x.class_id for x in E.near_copies(frame(spark, rows)).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(texts) - 20
    assert E.near_copies(frame(spark, []), ).count() == 0
