"""What the operators share: shared-folder tables, size-checked broadcasts, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.sources.tables import new_path, written

#: A table is broadcast only when its measured size stays below this; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
LAST_ID = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes: texts may be long, and a default batch has 10,000 of them.
    Plans are run after a function has returned, so the session keeps the setting; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted rows stay within limit bytes, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def id_key(id_col: str = "doc_id") -> Column:
    """Order key of an id: null comes after every other id."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


#: A range of ids holds about so many characters of text, and there are at most MAX_RANGES of them.
RANGE_CHARS, MAX_RANGES = 8 << 20, 20_000


def id_marks(rows: DataFrame, key: str, text: str) -> list[int]:
    """Ascending keys that deal rows to len + 1 ranges of like numbers of rows. A key that fills several ranges is
    repeated: its rows are dealt among these by their text's hash (see in_range)."""
    chars = rows.agg(F.sum(F.length(text))).first()[0] or 0
    n = min(MAX_RANGES, chars // RANGE_CHARS + 1)
    if n < 2:
        return []
    return rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] or []


def tie_of(text: str) -> Column:
    """Orders rows with equal keys: 63 bits of the text's hash."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def ranked(df: DataFrame, name: str, by: str) -> DataFrame:
    """df with `name`: 0-based rank by `by` (nulls last), without one task that sees all rows.

    Rows are dealt by range; each range is numbered by itself and shifted by the rows of the ranges
    before it. The table of ranges has one row for each shuffle partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(by).asc_nulls_last()
    t = written(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return t.withColumn(name, own).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
