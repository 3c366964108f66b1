"""Text: token classes and dictionaries, an inverted index, credentials and pattern catalogues."""

from __future__ import annotations

import unicodedata
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablespec.operators.constraints import union_all

#: fixed values: token classes in the order in which they are tried
TOKEN_CLASSES = (
    ("url", r"https?://[^\s<>\"']+"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("hyphen", r"\p{L}+(?:-\p{L}+)+"),
    ("number", r"\d+(?:\.\d+)?"),
    ("word", r"\p{L}+"),
)
ANY_TOKEN = "|".join(f"(?:{p})" for _, p in TOKEN_CLASSES)

DEALT = 16  # a power of two: parts over which an index deals the postings of a term
INDEXED = 16 << 20  # characters of text whose terms an index brings to one partition
SEEN, OFTEN, OFTEN_MOST = 1000, 64, 1000  # documents that steer which terms are dealt, the share that holds one, such terms at most

#: fixed values: words that name a credential
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "passphrase")
#: fixed values: shapes of tokens that look like credentials or personal data
TOKEN_SHAPES = (("hex40", r"\b[0-9a-f]{40}\b"), ("card16", r"\b[0-9]{16}\b"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, token, class): each token once, by the first class that matches it whole."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANY_TOKEN), F.lit(0))).alias("position", "token"))
    return found.withColumn("class", _class_of(F.col("token")))


def _class_of(t: Column) -> Column:
    # a mark tells the class of what the pattern found, without a second match
    kind = F.when(F.contains(t, F.lit("://")), "url").when(F.contains(t, F.lit("@")), "email").when(F.contains(t, F.lit("-")), "hyphen").when((F.substring(t, 1, 1) >= "0") & (F.substring(t, 1, 1) <= "9"), "number")
    return kind.otherwise("word")


def _accented(last: int = 0x1F00) -> tuple[str, str]:
    """Latin letters with accents below a code point, and their base letters, by canonical decomposition; then the
    marks that stand after a letter, which have none."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, last) if unicodedata.name(chr(c), "").startswith("LATIN ")]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def unaccent(text: Column) -> Column:
    """Letters without their accents, whether in one character or as marks of their own."""
    return F.translate(text, *_accented())


def text_terms(docs: DataFrame, key: str, text: str, stop_words: DataFrame | None = None, synonyms: DataFrame | None = None, stem: Column | None = None, classes: tuple[str, ...] = ("word", "number", "hyphen"), chains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, term, position) after lower case, hyphen parts and the dictionary chain of the token's
    class: unaccent, stop words (word), synonyms (word, term) and a stem expression over ``term``.

    chains names the steps of each class; without it every class takes all given dictionaries."""
    steps = chains if chains is not None else {c: ("stop", "synonyms", "stem") for c in classes}
    takes = lambda step: F.col("class").isin(*[c for c in classes if step in steps.get(c, ())])
    rows = tokens(docs, key, text).where(F.col("class").isin(*classes))
    parts = F.when(F.col("class") == "hyphen", F.concat(F.array("token"), F.split("token", "-"))).otherwise(F.array("token"))
    terms = rows.select(key, "position", "class", F.explode(parts).alias("term")).withColumn("term", F.lower("term"))
    if any("unaccent" in c for c in steps.values()):
        terms = terms.withColumn("term", F.when(takes("unaccent"), unaccent(F.col("term"))).otherwise(F.col("term")))
    if stop_words is not None:
        terms = terms.join(stop_words.select(F.col("word").alias("_stop")), (F.col("term") == F.col("_stop")) & takes("stop"), "left_anti")
    if synonyms is not None:
        other = synonyms.select(F.col("word").alias("_from"), F.col("term").alias("_to"))
        terms = terms.join(other, (F.col("term") == F.col("_from")) & takes("synonyms"), "left").withColumn("term", F.coalesce("_to", "term")).drop("_from", "_to")
    if stem is not None:
        terms = terms.withColumn("term", F.when(takes("stem"), stem).otherwise(F.col("term")))
    return terms.select(key, "term", "position")


def _listed(terms: DataFrame, *by: str) -> DataFrame:
    return terms.groupBy(*by).agg(F.array_sort(F.collect_set("position")).alias("positions")).withColumn("n", F.size("positions"))


def text_vector(docs: DataFrame, key: str, text: str, *chain, **named) -> DataFrame:
    """(key, term, positions, n): the terms of text_terms with all their positions."""
    return _listed(text_terms(docs, key, text, *chain, **named), key, "term")


def text_listed(docs: DataFrame, key: str, text: str, classes: tuple[str, ...] = ("word", "number", "hyphen"), positions: bool = True) -> DataFrame:
    """(key, term, n, positions unless left out): the terms that text_terms gives without dictionaries, brought together inside
    each row of docs by sorting its own tokens, so that nothing is shuffled or grouped; each row of a key gives rows of its own."""
    at = lambda t, i: F.struct(F.lower(t).alias("term"), i.alias("position")) if positions else F.lower(t)
    of = lambda x: x.term if positions else x
    # a part that comes twice in one token stands at one position
    parts = lambda t, i: F.array_distinct(F.transform(F.concat(F.array(t), F.split(t, "-")), lambda p: at(p, i)))
    words = F.regexp_extract_all(F.col(text), F.lit(ANY_TOKEN), F.lit(0))
    each = lambda t, i: F.when(~_class_of(t).isin(*classes), F.array()).when(_class_of(t) == "hyphen", parts(t, i)).otherwise(F.array(at(t, i)))
    if "hyphen" in classes:
        spots = F.flatten(F.transform(words, each))
    elif positions:
        numbered = F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("position")))
        spots = F.transform(F.filter(numbered, lambda x: _class_of(x.token).isin(*classes)), lambda x: at(x.token, x.position))
    else:
        spots = F.transform(F.filter(words, lambda t: _class_of(t).isin(*classes)), lambda t: at(t, None))
    rows = docs.select(key, F.sort_array(spots).alias("_a")).where(F.size("_a") > 0)
    a = F.col("_a")
    begins = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | (of(F.get(a, i - 1)) != of(F.get(a, i - 2))))
    # a run ends before the next begins, or with all
    n = lambda b, j: F.coalesce(F.get("_b", j + 1), F.size(a) + 1) - b
    listed = lambda b, j: [F.transform(F.slice(a, b, n(b, j)), lambda x: x.position).alias("positions")] if positions else []
    runs = F.transform("_b", lambda b, j: F.struct(of(F.get(a, b - 1)).alias("term"), n(b, j).alias("n"), *listed(b, j)))
    return rows.select(key, "_a", begins.alias("_b")).select(key, F.explode(runs).alias("_l")).select(key, "_l.*")


def text_index(terms: DataFrame, key: str, positions: bool = True, parts: int | None = None, often: Collection[str] = ()) -> DataFrame:
    """(term, key, n, positions, df): postings of the terms of text_terms or text_listed, with document frequencies;
    without positions only their number n is shuffled.

    Postings stay rows, so no list of a term's documents is ever built, and those of the terms in ``often`` lie in DEALT
    parts; any terms in it give the same rows, index_shape names those worth it. Postings are shuffled once, over ``parts``
    partitions if given, and counted where they lie; only the counts of dealt terms, read from the same shuffle, come
    to them. Terms of text_listed come to the shuffle as one row for each document."""
    # the part is told by the row, so it is worked out again behind the shuffle
    part = F.when(F.col("term").isin(*often), F.xxhash64(key).bitwiseAND(F.lit(DEALT - 1).cast("long"))).otherwise(-1) if often else F.lit(-1).cast("long")
    dealt = terms.where("term IS NOT NULL").repartition(*([parts] if parts else []), F.col("term"), *([part] if often else [])).withColumn("_part", part)
    by = ["term", *(["_part"] if often else [])]
    if "position" in terms.columns:
        postings = _listed(dealt, *by, key)
    elif positions:
        postings = dealt.groupBy(*by, key).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")).withColumn("n", F.size("positions"))
    else:
        postings = dealt.groupBy(*by, key).agg(F.sum("n").alias("n"))
    out = postings.withColumn("df", F.count("*").over(Window.partitionBy(*by)))
    if often:
        # n asks for the same columns as the postings do and keeps the test behind the shuffle, so that both share it
        whole = postings.where(F.when(F.col("n") > 0, F.col("_part")) >= 0).groupBy(F.col("term").alias("_term")).agg(F.count("*").alias("_df"))
        out = out.join(F.broadcast(whole), F.col("term") == F.col("_term"), "left").withColumn("df", F.coalesce("_df", "df"))
    return out.select("term", key, "n", *(["positions"] if positions else []), "df")


def index_shape(docs: DataFrame, key: str, text: str, classes: tuple[str, ...]) -> tuple[int | None, list[str]]:
    """(parts, often) for text_index: partitions that follow the length of the texts, none for short ones, which Spark deals as
    it does; the OFTEN_MOST most frequent terms of some documents that one in OFTEN of them holds."""
    chars, rows = docs.agg(F.sum(F.length(text)), F.count("*")).first()
    parts = (chars or 0) // INDEXED
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(max(1, rows // SEEN))) == 0).limit(2 * SEEN)
    held = text_listed(some, key, text, classes, positions=False).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= max(2, min(rows, SEEN) // OFTEN))
    often = [r.term for r in held.orderBy(F.desc("df"), "term").limit(OFTEN_MOST).collect()]
    return (parts if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None), often


def text_match(index: DataFrame, key: str, all_of: list[str] = [], any_of: list[str] = [], none_of: list[str] = [], phrase: list[str] = [], top: int | None = None) -> DataFrame:  # noqa: B006
    """(key, score): documents with all, any and none of the terms and the phrase, by total frequency.

    The index is text_index's or text_vector's, one row for each term of a document; only rows of the terms asked for
    are read or, of a lazy index, made, and they meet once for each document."""
    wanted = sorted({*all_of, *any_of, *phrase})
    hits = index.where(F.col("term").isin(*wanted, *none_of))
    has = lambda t: F.bool_or(F.col("term") == t)
    starts = lambda i: F.transform("positions", lambda p: p - i)
    need = sorted({*all_of, *phrase})
    tests = [*(has(t).alias(f"_n{i}") for i, t in enumerate(need)), *(F.first(F.when(F.col("term") == t, starts(i)), True).alias(f"_p{i}") for i, t in enumerate(phrase))]
    grouped = hits.groupBy(key).agg(F.sum(F.when(F.col("term").isin(*wanted), F.col("n"))).alias("score"), *tests, F.bool_or(F.col("term").isin(*any_of) if any_of else F.lit(True)).alias("_any"), F.bool_or(F.col("term").isin(*none_of) if none_of else F.lit(False)).alias("_none"))
    keep = F.col("_any") & ~F.col("_none")
    for i in range(len(need)):
        keep = keep & F.col(f"_n{i}")
    if phrase:
        keep = keep & (F.size(reduce(F.array_intersect, (F.col(f"_p{i}") for i in range(len(phrase))))) > 0)
    out = grouped.where(keep).select(key, "score")
    return out.orderBy(F.desc("score"), key).limit(top) if top else out


def secret_scan(df: DataFrame, key: str, text_cols: list[str]) -> DataFrame:
    """(key, column_name, rule, found): quoted literals beside credential words, unless the value holds
    ``{{``, and tokens of the listed shapes."""
    literal = rf"(?i)\b(?:{'|'.join(SECRET_WORDS)})\b[\"']?\s*[:=]?\s*[\"']([^\"']+)[\"']"
    parts = []
    for c in text_cols:
        named = df.select(key, F.lit(c).alias("column_name"), F.lit("named literal").alias("rule"), F.explode(F.regexp_extract_all(F.col(c), F.lit(literal), F.lit(1))).alias("found"))
        parts.append(named.where(~F.contains("found", F.lit("{{"))))
        parts += [df.select(key, F.lit(c).alias("column_name"), F.lit(name).alias("rule"), F.explode(F.regexp_extract_all(F.col(c), F.lit(shape), F.lit(0))).alias("found")) for name, shape in TOKEN_SHAPES]
    return union_all(parts)


def pattern_catalogue(df: DataFrame, key: str, text_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(construct, advice, documents, matches) for (construct, pattern, advice) rules, in one scan."""
    counts = F.array(*(F.struct(F.lit(n).alias("construct"), F.lit(a).alias("advice"), F.regexp_count(F.col(text_col), F.lit(p)).alias("n")) for n, p, a in rules))
    rows = df.select(F.explode(counts).alias("r")).select("r.*")
    return rows.groupBy("construct", "advice").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").cast("long").alias("matches"))


def collated_distinct(df: DataFrame, cols: list[str], collation: str = "UNICODE_CI") -> DataFrame:
    """(cols, rows): groups that are equal under a collation, shown by their least spelling."""
    keyed = df.withColumns({f"_k{i}": F.collate(c, collation) for i, c in enumerate(cols)})
    return keyed.groupBy(*(f"_k{i}" for i in range(len(cols)))).agg(F.count("*").alias("rows"), *(F.min(c).alias(c) for c in cols)).select(*cols, "rows")


def collated_join(left: DataFrame, right: DataFrame, on: tuple[str, str], collation: str = "UNICODE_CI") -> DataFrame:
    """Rows whose columns are equal under a collation."""
    return left.join(right, F.collate(on[0], collation) == F.collate(on[1], collation))
