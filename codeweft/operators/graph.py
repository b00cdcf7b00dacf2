"""Reads of a property graph: nodes (id, entity_type, name, qualified_name, file_path, start_line, parent_id)
and edges (id, type, source_id, target_id, line)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.sources.tables import written

ENTITY_TYPES = ("file", "class", "interface", "function", "method")
EDGE_TYPES = ("CALLS", "CONTAINS", "DEPENDS_ON", "IMPLEMENTS", "IMPORTS", "INHERITS", "USES")
IMPACT_TYPES = ("CALLS", "DEPENDS_ON", "IMPLEMENTS", "IMPORTS", "INHERITS", "USES")
MAX_DEPTH = 5


def checked_types(types: Iterable[str] | None) -> list[str]:
    """Known edge types, sorted. None stands for all."""
    if isinstance(types, str):
        raise ValueError("types must be a list")
    out = sorted(set(EDGE_TYPES if types is None else types))
    if not out or set(out) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types: {out}")
    return out


def checked_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    return depth


def oriented(edges: DataFrame, types: Iterable[str] | None, direction: str) -> DataFrame:
    """Edges with columns here, there: outgoing edges lead from source to target, incoming ones back."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError("direction must be outgoing or incoming")
    here, there = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    return edges.where(F.col("type").isin(checked_types(types))).withColumn("here", F.col(here)).withColumn("there", F.col(there))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def structure_rank() -> Column:
    t = F.col("entity_type")
    return F.when(t == "file", 0).when(t.isin("class", "interface"), 1).when(t == "function", 2).otherwise(3)


def page(nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes, coarse structure first. Ask for one more to learn whether there are more."""
    return nodes.orderBy(structure_rank(), "file_path", "start_line", "id").limit(limit)


def induced(edges: DataFrame, ids: DataFrame, limit: int, types: Iterable[str] | None = None) -> DataFrame:
    """Edges with both ends in ids (column id)."""
    inside = edges.where(F.col("type").isin(checked_types(types)))
    for end in ("source_id", "target_id"):
        inside = inside.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return inside.orderBy("type", "source_id", "target_id", "id").limit(limit)


def search(nodes: DataFrame, text: str, limit: int, entity_types: Iterable[str] | None = None, partial: bool = False) -> DataFrame:
    """Nodes by id, qualified name, name and (if partial) part of the name in any case, in this order."""
    if not text.strip() or len(text) > 500:
        raise ValueError("text must have 1 to 500 characters")
    rank = F.when(F.col("id") == text, 0).when(F.col("qualified_name") == text, 1).when(F.col("name") == text, 2)
    if partial:
        rank = rank.when(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("qualified_name"), F.lit(text.lower())), 3)
    found = nodes.withColumn("rank", rank).where("rank is not null")
    if entity_types is not None:
        found = found.where(F.col("entity_type").isin(list(entity_types)))
    return found.orderBy("rank", "file_path", "start_line", "id").limit(limit)


def related(nodes: DataFrame, edges: DataFrame, entity_id: str, types: Iterable[str] | None, direction: str, limit: int, entity_types: Iterable[str] | None = None) -> DataFrame:
    """One hop: the other ends, with the edge."""
    hop = oriented(edges, types, direction).where(F.col("here") == entity_id).select("type", "line", F.col("id").alias("edge_id"), F.col("there").alias("id"))
    out = hop.join(nodes, "id")
    if entity_types is not None:
        out = out.where(F.col("entity_type").isin(list(entity_types)))
    return out.orderBy("type", "file_path", "start_line", "id", "edge_id").limit(limit)


def neighbors(nodes: DataFrame, edges: DataFrame, entity_id: str, limit: int) -> DataFrame:
    """Outgoing, then incoming, each up to limit; a loop appears in both."""
    sides = [related(nodes, edges, entity_id, None, d, limit).withColumn("direction", F.lit(d)) for d in ("outgoing", "incoming")]
    return sides[0].unionByName(sides[1])


def reachable(edges: DataFrame, starts: DataFrame, types: Iterable[str] | None, direction: str, depth: int) -> DataFrame:
    """(start, id, depth): what each start (column id) reaches, with the least depth, without itself.

    Breadth first for all starts at once; the edges are oriented and written once, every level is a written table, so a
    level is one join and one anti join whatever the depth."""
    hop = written(oriented(edges, types, direction).select("here", "there").distinct(), "hops")
    front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    seen = front
    for level in range(1, checked_depth(depth) + 1):
        new = front.join(hop, F.col("id") == F.col("here")).select("start", F.col("there").alias("id")).distinct()
        front = written(new.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(level)), "frontier")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, source: str, target: str, depth: int, limit: int, types: Iterable[str] | None = None, directed: bool = True) -> DataFrame:
    """The first `limit` shortest paths from source to target: `path` (node ids) and `edge_ids`, one row for each choice
    of parallel edges; one path of length 0 where both are equal. Undirected walks take each edge both ways.

    Paths are ordered by node, then edge, step by step, so the first `limit` to each node of a level hold all that can
    lead to the first `limit` at the target: no level keeps more than that for a node."""
    spark = edges.sparkSession
    one = spark.createDataFrame([([source], [])], "path array<string>, edge_ids array<string>")
    if source == target:
        return one
    hop = oriented(edges, types, "outgoing").select("here", "there", F.col("id").alias("edge"))
    if not directed:
        hop = hop.union(hop.where("here <> there").select("there", "here", "edge"))
    hop = written(hop, "hops")
    front = one.select(*one.columns, F.lit(source).alias("id"), F.array(F.lit(source)).alias("steps"))
    seen = spark.createDataFrame([(source,)], "id string")
    for _ in range(checked_depth(depth)):
        step = front.join(hop, F.col("id") == F.col("here")).join(seen.select(F.col("id").alias("there")), "there", "left_anti")
        grown = step.select(
            F.concat("path", F.array("there")).alias("path"), F.concat("edge_ids", F.array("edge")).alias("edge_ids"), F.col("there").alias("id"), F.concat("steps", F.array("there", "edge")).alias("steps")
        )
        front = written(grown.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("steps"))).where(F.col("_n") <= limit).drop("_n"), "paths")
        done = front.where(F.col("id") == target)
        if done.limit(1).count():
            return done.orderBy("steps").limit(limit).select("path", "edge_ids")
        seen = written(seen.union(front.select("id")).distinct(), "seen")
    return front.where("false").select("path", "edge_ids")


def contained(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    return reachable(edges, starts, ["CONTAINS"], "outgoing", depth)


def impact(nodes: DataFrame, edges: DataFrame, entity_id: str, depth: int = 3, limit: int = 300, types: Iterable[str] = IMPACT_TYPES, read_limit: int | None = None) -> DataFrame:
    """What may change with an entity: reverse reachability over references from it and all it contains, each source
    once at its least depth with the edge that found it first, in walking order; `truncated` tells whether there are
    more than limit.

    The walk takes what it begins with by depth, path, line and id, then what it finds in the order found; of each it
    takes the incoming edges by type, path, line and id. read_limit bounds the contained entities, and the edges read
    of each entity, as a bounded reader would; without it all count. Only limit + 1 rows of a level are numbered."""
    begin = nodes.where(F.col("id") == entity_id).select("id")
    inside = contained(edges, begin).select("id", "depth").join(nodes.select("id", "file_path", "start_line"), "id")
    if read_limit is not None:
        inside = inside.orderBy("depth", "file_path", "start_line", "id").limit(read_limit)
    inside = inside.unionByName(nodes.where(F.col("id") == entity_id).select("id", F.lit(0).alias("depth"), "file_path", "start_line"))
    front = written(inside.select("id", F.struct("depth", "file_path", "start_line", "id").alias("pos")), "impact-start")
    seen, out = front.select("id"), None
    back = oriented(edges, types, "incoming").select(F.col("id").alias("edge"), "type", "line", "here", "there").join(nodes.select(F.col("id").alias("there"), "file_path"), "there")
    if read_limit is not None:
        n = F.row_number().over(Window.partitionBy("here").orderBy("type", "file_path", "line", "there", "edge"))
        back = back.withColumn("n", n).where(F.col("n") <= read_limit).drop("n")
    back = written(back, "impact-edges")
    for level in range(1, checked_depth(depth) + 1):
        walk = ["pos", "type", "file_path", "line", "edge"]
        found = front.select(F.col("id").alias("via"), "pos").join(back, F.col("via") == F.col("here")).join(seen.select(F.col("id").alias("there")), "there", "left_anti")
        first = found.groupBy("there").agg(F.min(F.struct(*walk, "via")).alias("w")).select("there", "w.*").orderBy(*walk).limit(limit + 1)
        front = written(first.select(F.col("there").alias("id"), "via", "type", F.row_number().over(Window.orderBy(*walk)).alias("pos"), F.lit(level).alias("depth")), "impact")
        seen = seen.union(front.select("id"))
        out = front if out is None else out.unionByName(front)
    more = out.count() > limit  # limit + 1 rows of each level at most
    return out.orderBy("depth", "pos").limit(limit).select("id", "depth", "via", "type", F.lit(more).alias("truncated"))
