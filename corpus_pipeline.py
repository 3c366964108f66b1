"""From raw documents to packed training windows, in five stages.

Each stage takes all rows its predecessor kept and returns the columns of
documents; the last returns pieces of packed windows. ``run`` writes each stage to
the shared folder and reads it again.

quality rules   documents that fail the rules go, and lines common on their host
jaccard join    of each near-duplicate group (5-word shingles, 0.8) the document
                with the most distinct shingles stays, ties to the least id
secret scan     live-looking credentials are replaced by a placeholder
mixing          a document stays as many times as the mix takes it, in whole copies
packing         best-fit decreasing into windows of 1024 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespec.llm.jaccard import jaccard_groups
from tablespec.llm.mixing import mix_sources, whole_copies
from tablespec.llm.packing import pack_documents, public_byte_bpe
from tablespec.llm.quality_rules import clean_documents
from tablespec.llm.secrets import scan_secrets
from tablespec.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80
PLACEHOLDER = "[secret]"


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and a key; decisions are made without the texts and joined by it.

    Rows equal in id and text share a key, and so share what is decided."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_k"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted of lines of their own, and removes common lines."""
    return clean_documents(docs.select(*COLUMNS))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; of texts without words one per id."""
    docs = _keyed(docs)
    groups = written(jaccard_groups(docs, id_col="_k", shingle_words=NEAR_WORDS, percent=NEAR_PERCENT))
    order = F.struct((-F.col("n_shingles")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k")
    # equal sets first, so that a large group of copies is reduced where its rows lie
    best = groups.join(docs.select("_k", "doc_id").distinct(), "_k").groupBy("component_id", "group_key").agg(F.min(order).alias("b")).groupBy("component_id").agg(F.min("b").alias("b"))
    found = docs.join(best.select("b._k").distinct(), "_k", "left_semi")
    repeated = groups.groupBy("_k").count().where("count > 1").join(best.select("b._k"), "_k", "left_semi")
    return (found if repeated.isEmpty() else found.dropDuplicates(["_k"])).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials; widely copied example values stay as they are."""
    docs = _keyed(docs)
    rows, spans = scan_secrets(docs, id_col="_k")
    live = spans.where("live").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = rows.join(live, "rid").groupBy("_k").agg(F.first("cuts").alias("cuts"))
    # a cut that begins inside an earlier one only extends it
    text = F.aggregate(
        "cuts", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, c: F.struct(
            F.when(c["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (c["start"] - acc["at"]).cast("int")), F.lit(PLACEHOLDER))).otherwise(acc["out"]).alias("out"),
            F.greatest(c["end"], acc["at"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))),
    )
    masked = docs.join(cuts, "_k", "left").withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(text))
    return masked.withColumn("n_chars", F.when(F.col("cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole copies of each document, so that a source's words stay within its largest one of the mix.

    Rows equal in id, text and source count as one document."""
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).alias("_k"))
    mixed = mix_sources(docs, id_col="_k", carry=("source",)).groupBy("_k").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    taken = whole_copies(mixed, "_k").where("times > 0")
    return docs.join(taken, "_k").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows, with their place and checksum."""
    return pack_documents(docs.select(*COLUMNS), public_byte_bpe)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: the join's components, and the tokenizer of the last stage, have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; once they are stored, shared.drop_written frees the folders in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
