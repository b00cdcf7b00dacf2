"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two bits for each row's text hash and keeps those that two rows or more have set. Pass 2
tests every row: one that finds either of its bits unrepeated has no equal and passes straight through;
only the others are shuffled and compared by the SHA-256 of the normalised text.

Texts are equal when they are identical after each run of white space became one space. Null counts as
empty; empty texts equal each other. Of equal texts the row with the smallest id stays (null ids come
last); of rows that also share the id, exactly one. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._common import SPACE, documents, small, text_of, written

#: Groups of more ids than this are joined by broadcast, so that no task gets all rows of one.
BITS_PER_ROW, HOT_IDS = 16, 1000


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(text_col), 256))


def _bits(digest: Column, words: int) -> list[tuple[Column, Column]]:
    """(word of 64 bits, bit in it) of the filter, twice."""
    hashes = F.xxhash64(digest), F.xxhash64(digest, F.lit(7))
    return [(F.pmod(h, F.lit(words)), F.shiftrightunsigned(h, 58).cast("int")) for h in hashes]


def repeated_bits(digests: DataFrame) -> tuple[DataFrame, int]:
    """Pass 1. digests has a column _sha. Returns the filter of bits set at least twice as rows
    (word, bits), and its size in words."""
    words = max(1024, 1 << (digests.count() * BITS_PER_ROW // 64).bit_length())
    at = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(F.col("_sha"), words)]))
    hit = digests.select(at.alias("at")).groupBy("at.word", "at.bit").count().where("count > 1")
    bits = hit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return written(bits, "repeated-bits"), words


def with_repeat_flag(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """Pass 2. rows (with _sha) and a column _maybe: whether both of its bits are repeated."""
    bits = small(bits, 64)
    (w1, b1), (w2, b2) = _bits(F.col("_sha"), words)
    first, second = bits.select(F.col("word").alias("_w1"), F.col("bits").alias("_f1")), bits.select(F.col("word").alias("_w2"), F.col("bits").alias("_f2"))
    rows = rows.withColumns({"_w1": w1, "_b1": b1, "_w2": w2, "_b2": b2}).join(first, "_w1", "left").join(second, "_w2", "left")
    on = [F.coalesce(F.getbit(f"_f{i}", F.col(f"_b{i}")), F.lit(0)) == 1 for i in (1, 2)]
    return rows.withColumn("_maybe", on[0] & on[1]).drop("_w1", "_b1", "_f1", "_w2", "_b2", "_f2")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, keep_id, group_size, kept, text_sha256."""
    thin = written(docs.select(F.col(id_col).alias("_id"), _digest(text_col).alias("_sha")), "digests")
    flagged = with_repeat_flag(thin, *repeated_bits(thin))
    alone = flagged.where("not _maybe").select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    rows = written(flagged.where("_maybe").groupBy("_sha", "_id").agg(F.count("*").alias("n")), "repeated")
    groups = written(rows.groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("_ids")), "groups")
    hot, cold = small(groups.where(F.col("_ids") > HOT_IDS), 64), groups.where(F.col("_ids") <= HOT_IDS)
    apart = rows.join(small(hot.select("_sha"), 32), "_sha", "left_anti").join(cold, "_sha")
    copies = rows.join(hot, "_sha").union(apart).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    met = copies.select("_id", "_sha", "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"))
    return alone.union(met).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns. Only possibly repeated rows are shuffled."""
    thin = written(docs.select(F.col(id_col).alias("_id"), _digest(text_col).alias("_sha")), "digests")
    bits, words = repeated_bits(thin)
    keep = with_repeat_flag(thin, bits, words).where("_maybe").groupBy("_sha").agg(F.min("_id").alias("_keep"))
    rows = with_repeat_flag(docs.select(F.struct("*").alias("_row"), _digest(text_col).alias("_sha")), bits, words)
    # by text and id, so that the copies of one text are dealt to many tasks
    found = rows.where("_maybe").withColumn("_id", F.col(f"_row.`{id_col}`")).alias("r")
    met = found.join(keep.alias("k"), (F.col("r._sha") == F.col("k._sha")) & F.col("_id").eqNullSafe(F.col("_keep"))).select("r._sha", "_row")
    one = met.groupBy("_sha").agg(F.first("_row").alias("_row"))
    return rows.where("not _maybe").select("_row").union(one.select("_row")).select("_row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
