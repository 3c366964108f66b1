"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans. Each candidate value is hashed, and over the whole
corpus the distinct repositories and owners that hold it are counted. A value of
at most MAX_OWNERS owners and MAX_REPOS repositories is taken as a live
credential, a wider one as a copied example. Spans of the base kinds are always
reported and only labelled by this; a ``generic`` candidate (a run of GENERIC
characters with upper case, lower case and a digit, clear of base spans) is
reported only where it looks live.

Positions come without a per-match search: the texts between matches and the
matches alternate, so a running sum of their lengths gives starts in code points.
Texts never leave the scan; only spans are shuffled, and counts are taken per
(value, owner) before they meet. Null and empty texts have no spans. A null owner
or repository counts as one. Repeated rows each keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablespec.llm.shared import written

#: fixed values: kind, pattern, group of the value, least length of the value, in reporting order
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    ("generic", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 0, 20),
)
MAX_OWNERS = 1
MAX_REPOS = 5


def _matches(text: Column, nth: int) -> Column:
    """Array of (kind number, order, code points before and in the match, value), empty without a match."""
    kind, pattern, group, _ = KINDS[nth]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value")),
        lambda x, i: F.struct(F.lit(nth).alias("kind"), i.alias("nth"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("size"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:bigint,size:bigint,value:string>>"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has rid and the id and carried columns of each document; spans has
    rid, kind, kind_no, start, end, value_hash, owners, repos, live."""
    names = {f"_in{k}": c for k, c in enumerate((id_col, *carry))}
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(text_col).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), *(F.col(c).alias(k) for k, c in names.items()))
    scanned = written(base.select(F.monotonically_increasing_id().alias("rid"), "owner", "repo", *names, F.concat(*(_matches(text, n) for n in range(len(KINDS)))).alias("found")))
    so_far = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = scanned.select("rid", "owner", "repo", F.inline("found")).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    generic = F.col("kind") == len(KINDS) - 1
    spans = spans.where((F.length("value") >= least) & (~generic | F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")))
    order = Window.partitionBy("rid").orderBy("start", "kind")
    before = F.max(F.when(~generic, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(~generic, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = ~generic | (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True))
    spans = written(spans.withColumn("clear", clear).where("clear").select("rid", "owner", "repo", "kind", "start", "end", F.xxhash64("value").alias("value_hash")))
    held = spans.select("value_hash", "owner", "repo").distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    spread = held.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = spans.join(spread, "value_hash").withColumn("live", live).where(F.col("live") | ~generic)
    kind = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind") + 1)
    rows = scanned.select("rid", *(F.col(k).alias(c) for k, c in names.items()))
    return rows, judged.select("rid", kind.alias("kind"), F.col("kind").alias("kind_no"), "start", "end", "value_hash", "owners", "repos", "live")


def _joined(spans: Column, keep) -> Column:
    part = F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(part, ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.count_if(F.col("kind_no") == k)
    per_doc = spans.groupBy("rid").agg(
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(4)), F.count_if("live").alias("n_live"),
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("all"),
    )
    none = per_doc.schema["all"].dataType
    joined = rows.join(per_doc, "rid", "left").withColumn("all", F.coalesce("all", F.array().cast(none)))
    return joined.select(
        "doc_id", *(F.coalesce(f"n_{KINDS[k][0]}", F.lit(0)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(3)),
        F.sha2(_joined(F.col("all"), lambda s: s["kind_no"] < 3), 256).alias("base_sha256"), _joined(F.col("all"), lambda s: F.lit(True)).alias("spans"),
        F.coalesce("n_generic", F.lit(0)).cast("long").alias("n_generic"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


_SQL_KINDS = (
    (0, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (1, r"AKIA[A-Z0-9]+", 0, 16), (2, r"[0-9a-f]+", 0, 32), (3, r"[A-Za-z0-9_-]+", 0, 20),
)
_SQL_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, source, {k} AS kind, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(v) AS v, unnest(string_split_regex(text, '{p}')[:len(m)]) AS g FROM (SELECT doc_id, source, text, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS v FROM d)"
    for k, p, g, _ in _SQL_KINDS
)
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
f AS ({_SQL_FOUND}),
e AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM f),
s AS (SELECT doc_id, source, kind, v, e - length(m) AS b, e FROM e WHERE length(v) >= [8, 16, 32, 20][kind + 1] AND (kind < 3 OR regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]'))),
c AS (SELECT * FROM s WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind < 3 AND o.b < s.e AND o.e > s.b)),
n AS (SELECT v, count(DISTINCT coalesce(source, '')) <= 1 AND count(DISTINCT doc_id) <= 5 AS live FROM c GROUP BY v),
j AS (SELECT c.*, n.live, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || b || ':' || e AS t FROM c JOIN n USING (v) WHERE kind < 3 OR n.live),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_generic, count(*) FILTER (live) AS n_live,
  string_agg(t, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY b, kind) AS spans FROM j GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_generic, 0) AS n_generic, coalesce(n_live, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""
