"""Chunks of source files, and what an index keeps of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import chunker

CHUNK = "project_id string, file_path string, language string, id string, entity_id string, entity_type string, name string, qualified_name string, start_line int, end_line int, text string, part int, part_count int"
PAYLOAD = ("id", "project_id", "file_path", "language", "entity_id", "entity_type", "name", "qualified_name", "start_line", "end_line", "text", "part", "part_count")


def _chunk(most: int, overlap: int):
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for c in chunker.chunks(bytes(r.content), list(r.entities), most, overlap):
                    e = c["entity"]
                    rows.append((r.project_id, r.path, r.language, f"{e['id']}|{c['part']}", e["id"], e["entity_type"], e["name"], e["qualified_name"], c["start_line"], c["end_line"], c["text"], c["part"], c["part_count"]))
            yield pd.DataFrame(rows, columns=names)

    return run


def chunks(files: DataFrame, analysed: DataFrame, most: int = chunker.MAX_CHARS, overlap: int = chunker.OVERLAP) -> DataFrame:
    """One row for each part of each unit. files: project_id, path, content; analysed: operators.extract.analysed. Files
    without entities, and files that are null, give none."""
    if most < 1 or not 0 <= overlap < most:
        raise ValueError("most must be at least 1, and overlap from 0 to below it")
    own = analysed.where("size(entities) > 0").select("project_id", "path", "language", "entities")
    rows = files.where("content is not null").select("project_id", "path", "content").join(own, ["project_id", "path"])
    return rows.select("project_id", "path", "language", "content", "entities").mapInPandas(_chunk(most, overlap), CHUNK)


def embedding_text() -> Column:
    """What is embedded of a chunk: a line of what it is, its path, and its text."""
    label = F.when(F.col("entity_type") == "file", "module code").otherwise(F.col("entity_type"))
    part = F.when(F.col("part_count") > 1, F.concat(F.lit(" (part "), F.col("part").cast("string"), F.lit("/"), F.col("part_count").cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.col("language"), F.lit(" "), label, F.lit(" "), F.col("qualified_name"), part, F.lit("\nfile: "), F.col("file_path"), F.lit("\n\n"), F.col("text"))


def content_hash(model: str) -> Column:
    """Changes when what is embedded, or the model, does."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), embedding_text()), 256)


def payload() -> Column:
    """The chunk's own fields as JSON."""
    return F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"})


def by_type(chunks_: DataFrame) -> DataFrame:
    return chunks_.groupBy("entity_type").agg(F.count("*").alias("n"))


def windows(lines: DataFrame, key: str, most: int, overlap: int) -> DataFrame:
    """(key, part, first_line, last_line): greedy windows of whole lines. lines: key and an array of lines."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def cut(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: [{"first": a + 1, "last": b} for a, b in chunker.windows([] if x is None else list(x), most, overlap)])

    made = lines.select(key, F.posexplode(cut(F.transform("lines", lambda x: F.length(x) + 1))))
    return made.select(key, (F.col("pos") + 1).alias("part"), F.col("col.first").alias("first_line"), F.col("col.last").alias("last_line"))
