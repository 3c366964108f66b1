"""Documents that are awkward in every way, and helpers."""

import random

WORDS = "the of and to in that is was for on with as his they at be this have from or one had by word but not what all were".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, rid string, size string, score string, component_id string, bucket string, n string, host string, train string, id string, y string, f string, x string, k string, shard string, text_hash string, l string, found string, value string, w string, u string, h string"
TRAP = ("trap",) * 22


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "."]) for _ in range(n))


def awkward():
    """(doc_id, text, lang, source): nulls, empties, repeats, ties, a very long text, copies."""
    base = text(1, 120).split()
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (4, "one two", "en", "a"), (5, "One  two", "fr", "a"), (6, text(2, 30), "en", "b"), (6, text(2, 30), "en", "b")]
    rows += [(7, " ".join(base), "en", "a"), (8, " ".join(base[:60] + ["changed"] + base[61:]), "fr", None), (9, " ".join(base), "en", "b"), (None, text(3, 40), "en", "a"), (None, text(3, 40), None, "a")]
    rows += [(10, text(4, 30000), "en", "a"), (11, "é漢字😀 " * 30, "fr", "b"), (12, "x" * 5000, "en", "a"), (13, "<|endoftext|> a b don't  \n\n 12", "en", "b")]
    rows += [(20 + i, text(100 + i, 5 + 7 * i), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(25)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *TRAP) for r in rows], COLUMNS)


def table(spark, rows, tmp_path, name="documents"):
    """The rows as a table of a data folder; returns the folder."""
    frame(spark, rows).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
