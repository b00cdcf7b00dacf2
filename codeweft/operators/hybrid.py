"""Vector hits expanded in the graph: seeds, one-hop questions about them, numbered sources.

Hits are top-k rows, seeds and neighbours are capped by the feature, so what is joined to the edges is small
and the edges are read once; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.sources.tables import written

MAX_SEEDS, MAX_NEIGHBORS, MAX_ENTITIES = 5, 5, 40
_CONTAINER = ("container", "CONTAINS", "in", 1)
_MEMBERS = ("members", "CONTAINS", "out", None)
_CALLERS = ("callers", "CALLS", "in", None)
_PARENTS, _SUBCLASSES = ("parents", "INHERITS", "out", None), ("subclasses", "INHERITS", "in", None)
_CALLABLE = (_CONTAINER, ("callees", "CALLS", "out", None), _CALLERS)
#: What is asked about a seed of each type, in order; (relation, edge type, direction, own limit).
STRATEGY = {
    "method": _CALLABLE,
    "function": _CALLABLE,
    "class": (_CONTAINER, _MEMBERS, _PARENTS, _SUBCLASSES, ("interfaces", "IMPLEMENTS", "out", None), _CALLERS),
    "interface": (_CONTAINER, _MEMBERS, _PARENTS, _SUBCLASSES, ("implementations", "IMPLEMENTS", "in", None)),
    "file": (_MEMBERS, ("dependencies", "DEPENDS_ON", "out", None), ("dependents", "DEPENDS_ON", "in", None)),
}


def ranked_hits(hits: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, entity_id, score) with hit_rank: best score first, then chunk id."""
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def seeds(hits: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """query_id, entity_id, seed_rank, chunk_ids: distinct entities by their best hit, the first max_seeds."""
    best = ranked_hits(hits).groupBy("query_id", "entity_id").agg(F.min("hit_rank").alias("_hit"), F.array_sort(F.collect_list(F.struct("hit_rank", "chunk_id"))).alias("_c"))
    out = best.withColumn("seed_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_hit")))
    return out.where(F.col("seed_rank") <= max_seeds).select("query_id", "entity_id", "seed_rank", F.col("_c.chunk_id").alias("chunk_ids"))


def _strategy(spark: SparkSession) -> DataFrame:
    rows = [(kind, k, relation, edge, way, own) for kind, asks in STRATEGY.items() for k, (relation, edge, way, own) in enumerate(asks)]
    return F.broadcast(spark.createDataFrame(rows, "entity_type string, expansion int, relation string, type string, way string, own_limit int"))


def expand(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, max_neighbors: int = MAX_NEIGHBORS) -> DataFrame:
    """Neighbours of the seeds: query_id, seed_rank, seed_id, expansion, relation, edge_id, entity_id, ord. Each
    question keeps its first max_neighbors by path, line and id. Seeds missing in the graph give no rows."""
    asked = seeds_.join(nodes.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").join(_strategy(seeds_.sparkSession), "entity_type")
    asked = asked.select("query_id", "seed_rank", F.col("entity_id").alias("seed_id"), "expansion", "relation", "type", "way", "own_limit")
    e = edges.select(F.col("id").alias("edge_id"), "type", "source_id", "target_id")
    out = asked.where("way = 'out'").join(e.withColumnsRenamed({"source_id": "seed_id", "target_id": "entity_id"}), ["type", "seed_id"])
    into = asked.where("way = 'in'").join(e.withColumnsRenamed({"target_id": "seed_id", "source_id": "entity_id"}), ["type", "seed_id"])
    found = out.unionByName(into).join(nodes.select(F.col("id").alias("entity_id"), "file_path", "start_line"), "entity_id")
    n = F.row_number().over(Window.partitionBy("query_id", "seed_id", "expansion").orderBy("file_path", "start_line", "entity_id"))
    kept = found.withColumn("ord", n).where(F.col("ord") <= F.coalesce("own_limit", F.lit(max_neighbors)))
    return kept.select("query_id", "seed_rank", "seed_id", "expansion", "relation", "edge_id", "entity_id", "ord")


def context_entities(seeds_: DataFrame, expanded: DataFrame, max_entities: int = MAX_ENTITIES) -> DataFrame:
    """query_id, entity_id, position: seeds first, then neighbours in order, each once, the first max_entities."""
    every = seeds_.select("query_id", "entity_id", F.struct(F.lit(0).alias("a"), "seed_rank", F.lit(0).alias("b"), F.lit(0).alias("c")).alias("at")).unionByName(
        expanded.select("query_id", "entity_id", F.struct(F.lit(1).alias("a"), "seed_rank", F.col("expansion").alias("b"), F.col("ord").alias("c")).alias("at"))
    )
    once = every.groupBy("query_id", "entity_id").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "entity_id"))
    return once.withColumn("position", n).where(F.col("position") <= max_entities).select("query_id", "entity_id", "position")


def sources(hits: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbered sources of each query: chunks by rank, then entities whose place no chunk cites.

    hits also has file_path, start_line and end_line; a place (path, lines) is listed once, at its first mention.
    """
    place = ["file_path", "start_line", "end_line"]
    chunks = ranked_hits(hits).select("query_id", F.lit("vector").alias("origin"), "entity_id", *place, F.struct(F.lit(0).alias("a"), F.col("hit_rank").alias("b")).alias("at"))
    own = entities.join(nodes.select(F.col("id").alias("entity_id"), *place), "entity_id").join(hits.select("query_id", "entity_id").distinct(), ["query_id", "entity_id"], "left_anti")
    graph = own.select("query_id", F.lit("graph").alias("origin"), "entity_id", *place, F.struct(F.lit(1).alias("a"), F.col("position").alias("b")).alias("at"))
    first = chunks.unionByName(graph).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", *place).orderBy("at"))).where("_n = 1")
    return first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "number", "origin", "entity_id", *place)


#: How far settings may go.
RANGES = {"top_k": (1, 50), "max_seeds": (1, 20), "max_neighbors": (1, 50), "max_entities": (1, 200), "path_seeds": (0, 5), "path_depth": (1, 5)}


def checked_settings(**settings: int) -> dict[str, int]:
    """Settings within their ranges, or ValueError."""
    for name, value in settings.items():
        low, high = RANGES[name]
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return settings


def own_hits(hits: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """(hits of the project, dropped hits by query): ids begin with the project's."""
    own = F.startswith(F.col("entity_id"), F.lit(project_id + ":"))
    return hits.where(own), hits.where(~F.coalesce(own, F.lit(False))).groupBy("query_id").agg(F.count("*").alias("dropped"))


def connect(seeds_: DataFrame, nodes: DataFrame, edges: DataFrame, expanded: DataFrame, path_seeds: int = 3, depth: int = 3) -> DataFrame:
    """One shortest path between each two of a query's first seeds: query_id, a, b, path, edge_ids.

    All pairs of all queries walk together, forward and back; a forward path is preferred where both ways have
    the same length or not: back is taken only where no forward path exists. A path is kept when it has more than one
    edge, or an edge that expand() did not find. Each level keeps one path for each (query, pair, way, node): the
    first by its steps."""
    checked_settings(path_seeds=path_seeds, path_depth=depth)
    known = seeds_.join(nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").where(F.col("seed_rank") <= path_seeds)
    x, y = known.select("query_id", F.col("entity_id").alias("a"), F.col("seed_rank").alias("i")), known.select("query_id", F.col("entity_id").alias("b"), F.col("seed_rank").alias("j"))
    pairs = written(x.join(y, "query_id").where("i < j"), "seed-pairs")
    ways = pairs.select("query_id", "a", "b", F.lit(0).alias("way"), F.col("a").alias("start"), F.col("b").alias("goal")).unionByName(
        pairs.select("query_id", "a", "b", F.lit(1).alias("way"), F.col("b").alias("start"), F.col("a").alias("goal"))
    )
    hop = written(edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), F.col("id").alias("edge")), "hops")
    key = ["query_id", "a", "b", "way"]
    front = ways.select(*key, "goal", F.col("start").alias("id"), F.array("start").alias("steps"), F.array().cast("array<string>").alias("edge_ids"), F.array("start").alias("path"))
    seen, done = front.select(*key, "id"), None
    for _ in range(depth):
        step = front.join(hop, F.col("id") == F.col("here")).select(
            *key, "goal", F.col("there").alias("id"), F.concat("steps", F.array("there", "edge")).alias("steps"), F.concat("edge_ids", F.array("edge")).alias("edge_ids"), F.concat("path", F.array("there")).alias("path")
        )
        new = step.join(seen, [*key, "id"], "left_anti").groupBy(*key, "goal", "id").agg(F.min(F.struct("steps", "edge_ids", "path")).alias("p"))
        front = written(new.select(*key, "goal", "id", "p.*"), "seed-paths")
        at_goal = front.where("id = goal")
        done = at_goal if done is None else done.unionByName(at_goal)
        seen = seen.unionByName(front.select(*key, "id"))
        # a way that has arrived walks no further
        front = front.join(at_goal.select(*key), key, "left_anti")
    best = done.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy("way"))).where("_n = 1")
    old = expanded.groupBy("query_id").agg(F.collect_set("edge_id").alias("_old"))
    fresh = (F.size("edge_ids") > 1) | ~F.exists("edge_ids", lambda e: F.array_contains(F.coalesce("_old", F.array().cast("array<string>")), e))
    return best.join(old, "query_id", "left").where(fresh).select("query_id", "a", "b", "path", "edge_ids")


def status(seeds_: DataFrame, nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """query_id, status, seeds, missing, expanded: complete where the graph has all seeds of the query, partial where
    it lacks some, unavailable where it has none."""
    here = nodes.select(F.col("id").alias("entity_id"), F.lit(1).alias("_in"))
    n = seeds_.join(here, "entity_id", "left").groupBy("query_id").agg(F.count("*").alias("seeds"), F.count_if(F.col("_in").isNull()).alias("missing"))
    found = expanded.groupBy("query_id").agg(F.count("*").alias("expanded"))
    how = F.when(F.col("missing") == 0, "complete").when(F.col("missing") < F.col("seeds"), "partial").otherwise("unavailable")
    return n.join(found, "query_id", "left").select("query_id", how.alias("status"), "seeds", "missing", F.coalesce("expanded", F.lit(0)).alias("expanded"))


def outline(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, outline): a readable line for each entity of a context, in order."""
    rows = entities.join(nodes.select(F.col("id").alias("entity_id"), "entity_type", "qualified_name", "file_path", "start_line"), "entity_id")
    line = F.concat(F.col("position").cast("string"), F.lit(". "), "entity_type", F.lit(" "), "qualified_name", F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    return lists.select("query_id", F.array_join(F.col("_l.line"), "\n").alias("outline"))


def build_context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, max_seeds: int = MAX_SEEDS, max_neighbors: int = MAX_NEIGHBORS, max_entities: int = MAX_ENTITIES, path_seeds: int = 3, path_depth: int = 3) -> dict[str, DataFrame]:
    """All of a context, for many questions at once: seeds, expanded, paths, entities, status."""
    checked_settings(max_seeds=max_seeds, max_neighbors=max_neighbors, max_entities=max_entities, path_seeds=path_seeds, path_depth=path_depth)
    s = written(seeds(hits, max_seeds), "seeds")
    x = written(expand(s, nodes, edges, max_neighbors), "expanded")
    return {"seeds": s, "expanded": x, "paths": connect(s, nodes, edges, x, path_seeds, path_depth), "entities": context_entities(s, x, max_entities), "status": status(s, nodes, x)}
