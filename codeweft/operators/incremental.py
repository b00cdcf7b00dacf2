"""Incremental analysis: parse what changed, resolve everything, write what differs.

An index is a folder of snapshots (files, nodes, edges) and a table `current` that names the one in force.
`current` is cleared before anything is written and saved last: a run that dies leaves no index, and the next
one is a full run. An incremental run's graph equals a full run's.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import extract as X

CURRENT = "snapshot string, settings string, nodes long, edges long"


def file_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path and change (added, modified, unchanged, deleted) of two tables of project_id, path, sha256."""
    key = ["project_id", "path"]
    both = previous.select(*key, F.col("sha256").alias("_old")).join(current.select(*key, F.col("sha256").alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return both.select(*key, change.alias("change"))


def chunk_plan(previous: DataFrame, current: DataFrame) -> DataFrame:
    """chunk_id and action of two tables of chunk_id, content_hash, payload_hash: embed new or changed contents,
    update where only the payload differs, reuse equal ones, delete those that are gone."""
    old = previous.select("chunk_id", F.col("content_hash").alias("_c"), F.col("payload_hash").alias("_p"), F.lit(True).alias("_old"))
    both = old.join(current.withColumn("_new", F.lit(True)), "chunk_id", "full")
    action = (
        F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull() | ~F.col("_c").eqNullSafe(F.col("content_hash")), "embed")
        .when(~F.col("_p").eqNullSafe(F.col("payload_hash")), "update").otherwise("reuse")
    )
    return both.select("chunk_id", action.alias("action"))


def status(job: Column, result: Column) -> Column:
    """Status of a project by its job's state and whether it has a result."""
    return F.when(job.isin("queued", "running", "failed"), job).when(result.isNotNull(), "ready").otherwise("not_analyzed")


@dataclass
class Analysis:
    mode: str
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    changes: dict[str, int]


def _current(spark: SparkSession, index: str) -> tuple | None:
    try:
        rows = spark.read.schema(CURRENT).parquet(f"{index}/current").limit(2).collect()
    except AnalysisException:
        return None
    return tuple(rows[0]) if len(rows) == 1 else None


def _trusted(spark: SparkSession, index: str, settings: str) -> str | None:
    """The snapshot in force, if it was made under the same settings and its tables have the counts it tells."""
    found = _current(spark, index)
    if not found or found[1] != settings:
        return None
    try:
        counts = tuple(spark.read.parquet(f"{found[0]}/{t}").count() for t in ("nodes", "edges"))
    except AnalysisException:
        return None
    return found[0] if counts == found[2:] else None


def _counts(df: DataFrame, col: str, prefix: str) -> dict[str, int]:
    return {f"{prefix}_{r[0]}": r["count"] for r in df.groupBy(col).count().collect()}


def _set_current(spark: SparkSession, index: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, CURRENT).coalesce(1).write.mode("overwrite").parquet(f"{index}/current")


def run(spark: SparkSession, files: DataFrame, index: str, settings: str = "", force_full: bool = False) -> Analysis:
    """Bring the index up to date with files (sources.tree.files). A file that can't be parsed is kept as a
    failure with its hash, and tried again only when its content changes."""
    old = None if force_full else _trusted(spark, index, settings)
    snapshot = f"{index}/snapshot-{uuid.uuid4().hex}"
    before = spark.read.parquet(f"{old}/files") if old else spark.createDataFrame([], X.ANALYSED)
    changes = file_changes(before, files)
    todo = files.join(changes.where("change in ('added', 'modified')"), ["project_id", "path"], "left_semi")
    kept = before.drop("scan_ord").join(files.select("project_id", "path", "sha256", "scan_ord"), ["project_id", "path", "sha256"])
    _set_current(spark, index, [])
    kept.select(*before.columns).unionByName(X.analysed(todo)).write.parquet(f"{snapshot}/files")
    now = spark.read.schema(before.schema).parquet(f"{snapshot}/files")
    nodes, edges = X.table(now, "entities"), X.edges(now, X.resolved(now))
    for name, df in (("nodes", nodes), ("edges", edges)):
        own = [c for c in df.columns if c not in ("scan_ord", "ord")]
        df.withColumn("fingerprint", X.fingerprint(*sorted(own))).write.parquet(f"{snapshot}/{name}")
    nodes, edges = (spark.read.parquet(f"{snapshot}/{t}") for t in ("nodes", "edges"))
    counted = _counts(changes, "change", "files")
    for name, df in (("nodes", nodes), ("edges", edges)):
        past = spark.read.parquet(f"{old}/{name}") if old else df.limit(0)
        counted |= _counts(X.diff(past, df, ["id"]), "action", name)
    _set_current(spark, index, [(snapshot, settings, nodes.count(), edges.count())])
    return Analysis("incremental" if old else "full", nodes, edges, now, counted)
