"""Mixing sources to target weights with Sainte-Lague apportionment.

Sizes are word counts. Sources in code point order (null last) take the weights
5, 2, 1 in turn and share all words; a target stops at MAX_EPOCHS times its
source's size and the excess is shared again by weight. Whole epochs of a source
are taken as they are. What remains is allotted in blocks of BLOCK words: seats
go to sources, and within a source to its shards, by highest quotients
w / (2 s - 1). A shard orders its documents by a seeded hash, cuts that line of
words into blocks, and takes its quota of them at even steps from a seeded start.
The same rows give the same mix in any order and on any number of machines.

Null and empty texts have size 0 and take 0; a null source is one source; repeated
rows count as often as they come; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablespec.llm.shared import written

BLOCK = 32
SHARD_WORDS = 1 << 18
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
COPY = 1 << 30
WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts: Column) -> Column:
    """60 bits of an md5 over the seed and the parts; null counts as empty."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sainte_lague(df: DataFrame, within: list[str], key: list[str], weight: str, seats: str, cap: str, out: str) -> DataFrame:
    """Adds the seats each row gets of its group's, by highest quotients weight / (2 s - 1).

    A row's count lies near its share of the seats: rounding the shares misplaces at
    most half a seat a row, which the divisor spreads in proportion. So only seats in
    that range compete one by one; those below are sure. The sums of a group are
    aggregates, and its seats are ranked over many range partitions, so a group may
    have any number of rows.
    """
    by = within or ["_all"]
    rows = df if within else df.withColumn("_all", F.lit(0))
    sums = rows.groupBy(*by).agg(F.sum(weight).alias("_weight"), F.count("*").alias("_rows"))
    part = F.col(weight) / F.nullif("_weight", F.lit(0.0))
    share = F.coalesce(F.col(seats) * part, F.lit(0.0))
    slack = F.lit(2) + F.ceil(F.coalesce(part, F.lit(0.0)) * F.col("_rows") / 2)
    ranged = rows.join(sums, by).withColumn("_lo", F.least(F.greatest(F.floor(share) - slack, F.lit(0)), F.col(cap))).withColumn("_hi", F.least(F.ceil(share) + slack, F.col(cap))).drop("_weight", "_rows")
    sure = ranged.groupBy(*by).agg(F.sum("_lo").alias("_sure"))
    open_rows = ranged.join(sure, by).withColumn("_left", F.col(seats) - F.col("_sure")).where((F.col("_hi") > F.col("_lo")) & (F.col(weight) > 0))
    seat = open_rows.withColumn("_s", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi")))).withColumn("_q", F.col(weight) / (2 * F.col("_s") - 1))
    place = [F.col("_q").desc(), *(F.col(k).asc_nulls_last() for k in key), F.col("_s").asc()]
    dealt = written(seat.select(*by, *key, "_left", "_q", "_s").repartitionByRange(*by, *place).withColumn("_p", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by, "_p").agg(F.count("*").alias("_n")).select(*by, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    rank = F.col("_o") + F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*place))
    won = dealt.join(offsets, [*by, "_p"]).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).groupBy(*by, *key).agg(F.count("*").alias("_won"))
    return ranged.join(won, [*by, *key], "left").withColumn(out, F.col("_lo") + F.coalesce("_won", F.lit(0))).drop("_lo", "_hi", "_won", "_all")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (src, source, source_size): weight, target, epochs and the remainder's seats."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_n") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    most = MAX_EPOCHS * F.col("source_size")
    fill = everything.orderBy(most / F.col("weight"), "_n")
    room = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = most * F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)) <= room * F.col("weight")
    filled = weighed.withColumn("_full", full)
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)
    open_room = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("_full"), most)).over(everything), F.lit(0))
    target = F.when(F.col("_full"), most.cast("double")).otherwise(F.col("weight") * (open_room / open_weight))
    aimed = filled.withColumn("target", target)
    epochs = F.coalesce(F.least(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(MAX_EPOCHS)), F.lit(0))
    rest = aimed.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    rest = rest.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)).withColumn("all_seats", F.floor(F.sum("rest").over(everything) / BLOCK + 0.5))
    return sainte_lague(rest, [], ["_n"], "rest", "all_seats", "blocks", "seats").select("src", "source_size", "target", "epochs", "seats")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, size, source_size, target, taken; carry adds input columns."""
    names = {f"_in{k}": c for k, c in enumerate((id_col, *carry))}
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = written(docs.select(*(F.col(c).alias(k) for k, c in names.items()), F.col(source_col).cast("string").alias("source"), size.alias("size")))
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sized = sized.withColumn("src", src).withColumn("k", seeded(F.col("_in0")))
    plan = written(source_targets(sized.groupBy("src", "source").agg(F.sum("size").alias("source_size")))).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
    placed = sized.join(plan, "src").withColumn("shard", F.pmod(F.col("k"), F.col("shards")))
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats")).withColumn("shard_blocks", F.ceil(F.col("shard_size") / BLOCK))
    quota = sainte_lague(shards.withColumn("w", F.col("shard_size").cast("double")), ["src"], ["shard"], "w", "seats", "shard_blocks", "quota").select("src", "shard", "shard_blocks", "quota")
    line = Window.partitionBy("src", "shard").orderBy("k", "_in0", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.join(quota, ["src", "shard"]).withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.withColumn("first", F.pmod(seeded(F.col("src"), F.col("shard")), F.greatest("shard_blocks", F.lit(1))))

    def chosen(block: Column) -> Column:
        return F.coalesce(F.floor((block * F.col("quota") + F.col("first")) / F.nullif("shard_blocks", F.lit(0))), F.lit(0))

    def upto(x: Column) -> Column:
        block = F.floor(x / BLOCK)
        return BLOCK * chosen(block) + (x - BLOCK * block) * (chosen(block + 1) - chosen(block))

    taken = F.col("epochs") * F.col("size") + upto(F.col("end")) - upto(F.col("begin"))
    return laid.select(*(F.col(k).alias(c) for k, c in names.items()), "size", "source_size", "target", taken.cast("long").alias("taken"))


def whole_copies(mixed: DataFrame, id_col: str) -> DataFrame:
    """Id and times, the whole copies to take, for rows (id, source, size, taken) with ids of their own.

    Shares taken / size are summed along each source in order of size, then of the
    seed; a copy falls where the sum passes a half. So each row gets its share rounded
    up or down, and as the sum is never off by more than half a copy and sizes only
    ascend, a source's words stay within its largest row of those taken. Rows of size
    0 have one copy."""
    share = F.coalesce(F.round(F.col("taken") * F.lit(float(COPY)) / F.nullif("size", F.lit(0))).cast("long"), F.lit(COPY).cast("long"))
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    rows = mixed.select(F.col(id_col).alias("id"), src.alias("src"), "size", seeded(F.col(id_col), F.lit("copy")).alias("k"), share.alias("share"))
    ranged = written(rows.repartitionByRange("src", "size", "k", "id").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("src", "part").agg(F.sum("share").alias("all")).select("src", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))
    line = Window.partitionBy("src", "part").orderBy("size", "k", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("offset") + F.col("running") + F.lit(COPY // 2)
    times = F.shiftright(end, 30) - F.shiftright(end - F.col("share"), 30)
    return ranged.withColumn("running", F.sum("share").over(line)).join(offsets, ["src", "part"]).select(F.col("id").alias(id_col), times.cast("int").alias("times"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
s2 AS (SELECT *, [5, 2, 1][((n - 1) % 3 + 1)::INT] AS weight FROM s1),
s3 AS (SELECT *, 3 * source_size * sum(weight) OVER (ORDER BY 3 * source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full FROM s2),
s4 AS (SELECT *, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE weight * ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0))::DOUBLE / (sum(weight) FILTER (NOT is_full) OVER ())) END AS target FROM s3),
s5 AS (SELECT *, coalesce(least(floor(target / nullif(source_size, 0)), 3), 0)::BIGINT AS epochs FROM s4),
s6 AS (SELECT *, greatest(target - epochs * source_size, 0.0) AS rest, ceil(source_size / 32.0)::BIGINT AS blocks FROM s5),
s7 AS (SELECT *, floor(sum(rest) OVER () / 32.0 + 0.5)::BIGINT AS all_seats FROM s6),
seat AS (SELECT n, all_seats, unnest(range(1, blocks + 1)) AS t, rest FROM s7 WHERE rest > 0),
won AS (SELECT n, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY rest / (2 * t - 1) DESC, n, t) AS r FROM seat) WHERE r <= all_seats GROUP BY n),
p AS (SELECT s7.*, coalesce(won.seats, 0) AS seats, greatest(ceil(source_size / 262144.0), 1)::BIGINT AS shards FROM s7 LEFT JOIN won USING (n)),
x AS (SELECT d.doc_id, d.size, d.k, d.src, p.source_size, p.target, p.epochs, p.seats, d.k % p.shards AS shard FROM d JOIN p USING (src)),
sh AS (SELECT src, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats, ceil(sum(size) / 32.0)::BIGINT AS nb FROM x GROUP BY ALL),
shseat AS (SELECT src, shard, seats, shard_size, unnest(range(1, nb + 1)) AS t FROM sh),
shwon AS (SELECT src, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shard_size::DOUBLE / (2 * t - 1) DESC, shard, t) AS r FROM shseat) WHERE r <= seats GROUP BY ALL),
q AS (SELECT sh.src, sh.shard, sh.nb, coalesce(quota, 0) AS quota, ('0x' || substr(md5('mix-1:' || sh.src || ':' || sh.shard), 1, 15))::BIGINT % greatest(nb, 1) AS f FROM sh LEFT JOIN shwon ON sh.src = shwon.src AND sh.shard = shwon.shard),
l AS (SELECT x.*, q.nb, q.quota, q.f, (sum(size) OVER (PARTITION BY x.src, x.shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM x JOIN q ON x.src = q.src AND x.shard = q.shard),
b AS (SELECT *, e // 32 AS eb, (e - size) // 32 AS bb FROM l),
c AS (SELECT *, coalesce((eb * quota + f) // nullif(nb, 0), 0) AS e0, coalesce(((eb + 1) * quota + f) // nullif(nb, 0), 0) AS e1, coalesce((bb * quota + f) // nullif(nb, 0), 0) AS b0, coalesce(((bb + 1) * quota + f) // nullif(nb, 0), 0) AS b1 FROM b)
SELECT doc_id, size, source_size, target, (epochs * size + 32 * e0 + (e - 32 * eb) * (e1 - e0) - 32 * b0 - (e - size - 32 * bb) * (b1 - b0))::BIGINT AS taken FROM c
"""
