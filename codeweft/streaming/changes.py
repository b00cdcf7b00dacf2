"""The incremental analysis per micro-batch of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators import incremental
from codeweft.sources.tables import written

VERSIONS = "project_id string, path string, language string, size_bytes long, scan_ord int, content binary, version long, deleted boolean"


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each file, without those that it deletes."""
    n = F.row_number().over(Window.partitionBy("project_id", "path").orderBy(F.col("version").desc()))
    return versions.withColumn("_n", n).where("_n = 1 and not coalesce(deleted, false)").drop("_n", "version", "deleted")


def follow(versions: DataFrame, store: str, index: str, checkpoint: str, settings: str = "") -> StreamingQuery:
    """Append each micro-batch of VERSIONS to store (once, by batch id), and bring the index up to date with the
    newest versions. A batch that is run again replaces its own part of store and changes nothing else."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        every = spark.read.schema(VERSIONS).parquet(store).drop("batch")
        files = written(latest(every).withColumn("sha256", F.sha2("content", 256)), "files")
        incremental.run(spark, files, index, settings)

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
