"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources in code point order (null last) weigh WEIGHTS, repeating. Their targets share TOTAL times all
words in proportion to the weights; a target stops at EPOCHS times its source's size, and what it leaves
goes to the others by weight until none is above. A source is then taken whole floor(target / size)
times, and the rest as a fractional repetition: its documents in the order of a seeded hash until the
rest is used up; the last of them is taken in part, so that the sum is the rounded target.

Null text, like an empty one, has size 0 and nothing of it is taken; null is a source of its own. Rows
that repeat id, source and size share one decision. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm._common import WORD, documents, ranked, small, written

WEIGHTS, TOTAL, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: The seeded hash has 32 bits; its upper 16 choose a bucket, and only one bucket of a source is sorted.
BUCKET_BITS = 16


def words_in(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: str, id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")


def fill(sources: DataFrame, weights: tuple[int, ...], total: float, epochs: int) -> DataFrame:
    """sources (source, source_size) with target: least(cap, level * weight), by water-filling."""
    rank = ranked(sources, "_rank", "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = written(rank.withColumn("_w", weight.cast("long")).withColumn("_cap", epochs * F.col("source_size")), "sources")
    whole = s.agg(F.sum("source_size"), F.sum("_w")).first()
    words, capped, open_weight, n_capped, level = total * (whole[0] or 0), 0, whole[1] or 0, 0, 0.0
    while open_weight:
        level = (words - capped) / open_weight
        over = F.col("_cap") < level * F.col("_w")
        n, capped, rest = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0))).first()
        if n == n_capped:
            break
        n_capped, open_weight = n, rest
    return s.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """sizes: _id, source, size, _u. Returns for each source its target, whole repetitions and last
    bucket, and for the documents of that bucket the words of their fractional repetition."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = fill(sources, weights, total, epochs)
    n = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("_whole", n.cast("long")).withColumn("_rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size"))
    bucket = F.shiftright(F.col("_u"), 32 - BUCKET_BITS)
    sums = sizes.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    to = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket"))
    crossed = sums.withColumn("_to", to).alias("b").join(t.alias("t"), F.expr("b.source <=> t.source")).where("_to >= _rest and _rest > 0")
    last = crossed.groupBy(F.col("b.source").alias("_src")).agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("_sum")).alias("_from"))).alias("_last"))
    t = written(t.join(last, F.expr("source <=> _src"), "left").select("source", "source_size", "target", "_whole", "_rest", "_last._bucket", "_last._from"), "mix-plan")
    edge = sizes.join(small(t, 128).withColumnRenamed("source", "_src"), F.expr("source <=> _src")).where(bucket == F.col("_bucket"))
    order = Window.partitionBy("source").orderBy("_u", F.col("_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_from") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    cut = edge.withColumn("_part", part).groupBy("source", "_id", "size").agg(F.max("_part").alias("_part"))
    return t, written(cut, "mix-cut")


def taken(rows: DataFrame, t: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (_id, source, size, _u and any others) with source_size, target, _whole and _extra."""
    t, cut = small(t, 128).withColumnRenamed("source", "_src"), small(cut, 96).toDF("_csrc", "_cid", "_csize", "_part")
    out = rows.join(t, F.expr("source <=> _src")).join(cut, F.expr("source <=> _csrc and _id <=> _cid and size = _csize"), "left")
    bucket = F.shiftright(F.col("_u"), 32 - BUCKET_BITS)
    extra = F.when(F.col("_bucket").isNull() | (bucket > F.col("_bucket")), 0).when(bucket < F.col("_bucket"), F.col("size")).otherwise(F.coalesce("_part", F.lit(0)))
    return out.withColumn("_extra", extra.cast("long")).drop("_src", "_rest", "_bucket", "_from", "_csrc", "_cid", "_csize", "_part")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), _draw(seed, id_col).alias("_u"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """For each row of docs: its id, size, source_size, target (its source's) and taken."""
    sizes = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    out = taken(sizes, *plan(sizes))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as they are taken; a repetition in part has the
    first words of the text. Rows without words come once for each whole repetition."""
    sizes = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    t, cut = plan(sizes)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), _draw(seed, id_col).alias("_u"))
    words = F.concat(F.array_repeat("size", F.col("_whole").cast("int")), F.when(F.col("_extra") > 0, F.array("_extra")).otherwise(F.array().cast("array<bigint>")))
    copies = taken(rows, t, cut).select("_row", "size", F.explode(words).alias("_n"))
    text = F.col(f"_row.`{text_col}`")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("_n").cast("int")), "")
    return copies.select(*[(F.when(F.col("_n") < F.col("size"), head).otherwise(text) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(documents(spark, sf_dir).select("doc_id", "text", "source"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS wt FROM s),
r AS (SELECT *, sum(2 * source_size) OVER o AS c, sum(wt) OVER o AS cw, lead(2.0::DOUBLE * source_size / wt) OVER (ORDER BY 2.0::DOUBLE * source_size / wt, source) AS nxt
    FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / wt, source ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t, sum(wt)::DOUBLE AS tw, min(2.0::DOUBLE * source_size / wt) AS lo FROM w),
lv AS (SELECT min(level) AS level FROM (
    SELECT t / tw AS level FROM tot WHERE t / tw <= lo
    UNION ALL SELECT (t - c::DOUBLE) / (tw - cw::DOUBLE) FROM r, tot WHERE nxt IS NOT NULL AND tw > cw
        AND (t - c::DOUBLE) / (tw - cw::DOUBLE) BETWEEN 2.0::DOUBLE * source_size / wt AND nxt)),
g AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, level * wt) AS target FROM w, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - b)) AS taken FROM x
"""
