import numpy as np
import pyarrow as pa

from tablespec.llm import language as L
from tablespec.llm import words
from tests.llm.common import awkward, frame, text


def sample():
    return [(i, text(i, 30), "en", "a") for i in range(60)] + [(100 + i, text(i, 30).translate(str.maketrans("aeiou", "éàüöï")), "xx", "a") for i in range(60)]


def test_predicts_held_out_and_unseen_words(spark):
    docs = frame(spark, sample())
    model = L.train(docs.where("doc_id % 3 <> 1"))
    new = frame(spark, [*sample(), (500, "wasinthat onewordat", "xx", "a"), (501, "wàsïnthàt önéwördàt", "en", "a")])
    got = {r.doc_id: r for r in L.predict(new, model, carry=("doc_id",)).collect()}
    assert all(got[i].lang_pred == "en" and got[100 + i].lang_pred == "xx" for i in range(60))
    assert got[500].lang_pred == "en" and got[501].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_every_language_is_learned(spark):
    """Ninety languages, most of them small beside one large one, each with its own vocabulary."""
    own = lambda k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in "alpha beta gamma delta omega".split()]
    rows = [(1000 * k + i, " ".join(own(k)[(i + j) % 5] for j in range(12)), f"l{k:02}", "a") for k in range(90) for i in range(60 if k == 0 else 3)]
    docs = frame(spark, rows)
    model = L.train(docs)
    got = L.predict(docs, model, carry=("lang",)).where("lang <> lang_pred").count()
    assert len(model.langs) == 90 and got == 0


def test_equals_plain_sums(spark):
    """Scores of a chunk, word by word with dictionaries."""
    import math

    docs = sample()
    model = L.train(frame(spark, docs))
    words_of = lambda x: "".join(c if c.isalpha() else " " for c in x.lower()).split()
    grams_of = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    count = {0: {}, 1: {}}
    for _, x, lang, _ in docs:
        for w in words_of(x):
            for kind, item in [(0, w), *((1, (n, g)) for n in range(1, 6) for g in grams_of(w, n))]:
                count[kind].setdefault(item, {}).setdefault(lang, 0)
                count[kind][item][lang] += 1
    count = {k: {i: c for i, c in t.items() if sum(c.values()) >= 2} for k, t in count.items()}
    total = {(k, x): sum(c.get(x, 0) for c in t.values()) for k, t in count.items() for x in ("en", "xx")}
    log = lambda k, item, x: math.log((count[k][item].get(x, 0) + 0.5) / (total[k, x] + 0.5 * len(count[k])))
    asked = "the wasinthat onewordat — zzz « thé » q"
    want = []
    for x in ("en", "xx"):
        s = 0
        for w in words_of(asked):
            if w in count[0]:
                s += log(0, w, x)
                continue
            for n in range(5, 0, -1):
                hits = [log(1, (n, g), x) for g in grams_of(w, n) if (n, g) in count[1]]
                if hits:
                    s += sum(hits) / len(hits)
                    break
        want.append(s)
    (c,) = words.chunks(pa.array([asked]), separators=L._NOT_LETTER, marks=False)
    assert np.allclose(model.sums(c)[0], want, rtol=1e-4)


def test_no_letters_is_und(spark):
    model = L.train(frame(spark, sample()))
    rows = [(1, None, None, "a"), (2, "", "en", "a"), (3, "12 34 !!", "en", "a"), (4, "漢字", "en", "a"), (5, "a", "en", "a")]
    got = {r.doc_id: r.lang_pred for r in L.predict(frame(spark, rows), model, carry=("doc_id",)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und" and got[5] != "und"


def test_awkward_rows_and_nothing_learned(spark):
    docs = frame(spark, awkward())
    assert L.predict(docs, L.train(docs)).count() == len(awkward())
    empty = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.limit(0), empty).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
