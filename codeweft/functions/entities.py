"""Names, ids and languages of source entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File suffix to language.
LANGUAGES = {"py": "python", "pyi": "python", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}


def language_of(path: Column) -> Column:
    """Language by the last suffix in any case; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_binary(content: Column) -> Column:
    """Whether the first 8192 bytes have a zero."""
    return F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))


def occurrence_ids(df: DataFrame, base: str, order: list[str], out: str = "id") -> DataFrame:
    """df with out: base, and #2, #3 ... from its second occurrence on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), n.cast("string"))))
