"""A vector store as tables: points (chunk_id, embedding_model, project_id, payload columns, embedding).

A point is one chunk under one model. Writes give a new table from the old one by keyed joins; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.embedding import EmbeddingProvider, checked, embedded

KEY = ["embedding_model", "chunk_id"]
PAYLOAD = ("project_id", "file_path", "language", "entity_id", "entity_type", "name", "qualified_name", "start_line", "end_line", "text", "part", "part_count")
MAX_TEXT, MAX_K = 2000, 50


def point_id(model: Column, chunk_id: Column) -> Column:
    """The same for the same chunk and model."""
    h = F.sha2(F.concat(model, F.lit("\n"), chunk_id), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def payload(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks as the store keeps them, without vectors. The chunk's id becomes chunk_id."""
    return chunks.select(F.col("id").alias("chunk_id"), F.lit(model).alias("embedding_model"), *[c for c in PAYLOAD if c in chunks.columns])


def points(chunks: DataFrame, by: EmbeddingProvider, text: str = "embedding_text") -> DataFrame:
    """Chunks with vectors of a provider, ready for upsert. text: the column that is embedded."""
    rows = embedded(chunks, text, by)
    return rows.select(F.col("id").alias("chunk_id"), F.lit(by.name).alias("embedding_model"), *[c for c in PAYLOAD if c in chunks.columns], "embedding")


def upsert(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """new over old by chunk and model. A vector of another dimension is an error."""
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new.withColumn("embedding", checked(F.col("embedding"), dimension)))


def refresh(old: DataFrame, current: DataFrame) -> DataFrame:
    """Payload columns as in current (as payload() gives them), vectors as they are; other points stay."""
    own = [c for c in current.columns if c not in KEY]
    fresh = current.select(*KEY, F.struct(*own).alias("_new"))
    joined = old.join(fresh, KEY, "left")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c)
    return joined.select(*[value(c) for c in old.columns])


def delete_stale(old: DataFrame, current: DataFrame, project_id: str | None = None) -> DataFrame:
    """Without points whose chunk is not in current (column chunk_id); of one project where it is given."""
    stale = old.join(current.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return delete_chunks(old, stale if project_id is None else stale.where(F.col("project_id") == project_id))


def delete_chunks(old: DataFrame, chunks: DataFrame) -> DataFrame:
    return old.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def delete_project(old: DataFrame, project_id: str) -> DataFrame:
    return old.where(~F.col("project_id").eqNullSafe(project_id))


def count(store: DataFrame) -> DataFrame:
    """Points of each project and model."""
    return store.groupBy("project_id", "embedding_model").agg(F.count("*").alias("points"))


def chunk_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("entity_type").agg(F.count("*").alias("chunks"))


def matching(equal: dict | None = None, any_of: dict[str, Iterable] | None = None, none_of: dict[str, Iterable] | None = None) -> Column:
    """A filter: all columns of `equal` have their value, those of `any_of` one of theirs, those of `none_of` none of
    theirs (a null passes there). An empty list in any_of matches nothing."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        out = out & (F.col(c) == v)
    for c, vs in (any_of or {}).items():
        out = out & F.col(c).isin(list(vs))
    for c, vs in (none_of or {}).items():
        out = out & ~F.coalesce(F.col(c).isin(list(vs)), F.lit(False))
    return out


def checked_search(text: str, k: int) -> tuple[str, int]:
    """A search's text and size, or ValueError."""
    if not isinstance(text, str) or not text.strip() or len(text) > MAX_TEXT:
        raise ValueError(f"a query has 1 to {MAX_TEXT} characters")
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    return text, k
