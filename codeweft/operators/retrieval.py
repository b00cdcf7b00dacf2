"""Questions about one project's graph: checked arguments, whole pages with a truncated flag, and "nothing found" told
apart from "no such entity".

Answers are at most MAX_LIMIT rows, so what is counted on the driver is bounded; the walks are those of graph.py.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators import graph as G
from codeweft.sources.tables import written

#: Limits of questions.
DEFAULT_LIMIT, MAX_LIMIT, DEFAULT_DEPTH, PATH_DEPTH, PATH_LIMIT, MAX_PATHS = 50, 200, 3, 4, 5, 20
MAX_ID, DISPLAY_NODES, MAX_DISPLAY_NODES, DISPLAY_EDGES, ANALYSIS_NODES, ANALYSIS_EDGES = 4096, 150, 500, 2000, 5000, 20000


class InvalidQuery(ValueError):
    """An argument that no project could answer."""


class NotFound(LookupError):
    """A project or entity that is not there."""


def checked_number(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise InvalidQuery(f"{name} must be a whole number from {low} to {high}")
    return value


def checked_project(project_id: str) -> str:
    if not isinstance(project_id, str) or not re.fullmatch(r"[0-9a-f]{32}", project_id):
        raise InvalidQuery("a project id has 32 hexadecimal digits")
    return project_id


class Retrieval:
    """Reads of one project. nodes and edges may hold many projects (column project_id); with project_id None they
    are taken as one project's own."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, project_id: str | None = None):
        self.project_id = project_id if project_id is None else checked_project(project_id)
        self.nodes, self.edges = (df if project_id is None else df.where(F.col("project_id") == project_id) for df in (nodes, edges))

    def _id(self, entity_id: str) -> str:
        if not isinstance(entity_id, str) or not entity_id.strip() or len(entity_id) > MAX_ID:
            raise InvalidQuery(f"an entity id has 1 to {MAX_ID} characters")
        if self.project_id is not None and not entity_id.startswith(self.project_id + ":"):
            raise InvalidQuery("the entity belongs to another project")
        return entity_id

    def _page(self, rows: DataFrame, limit: int, order: list[str], entity_id: str | None = None) -> DataFrame:
        """The first limit of at most limit + 1 rows, with `truncated`. Only an empty page asks whether the entity is there."""
        kept = written(rows, "page")
        n = kept.count()
        if n == 0 and entity_id is not None:
            self.entity(entity_id)
        return kept.orderBy(*order).limit(limit).withColumn("truncated", F.lit(n > limit))

    def exists(self) -> bool:
        return not self.nodes.limit(1).isEmpty()

    def entity(self, entity_id: str) -> DataFrame:
        """The entity's row; NotFound where there is none."""
        row = self.nodes.where(F.col("id") == self._id(entity_id)).limit(1)
        if row.isEmpty():
            raise NotFound(f"no entity {entity_id}" if self.exists() else "no such project")
        return row

    def related(self, entity_id: str, types: Iterable[str] | None, direction: str, limit: int = DEFAULT_LIMIT, entity_types: Iterable[str] | None = None) -> DataFrame:
        """One hop with its edge; see graph.related."""
        checked_number("limit", limit, 1, MAX_LIMIT)
        unknown = set(entity_types or ()) - set(G.ENTITY_TYPES)
        if unknown:
            raise InvalidQuery(f"unknown entity types: {sorted(unknown)}")
        rows = G.related(self.nodes, self.edges, self._id(entity_id), types, direction, limit + 1, entity_types)
        return self._page(rows, limit, ["type", "file_path", "start_line", "id", "edge_id"], entity_id)

    def callers(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["CALLS"], "incoming", limit)

    def callees(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["CALLS"], "outgoing", limit)

    def imports(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["IMPORTS"], "outgoing", limit)

    def importers(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["IMPORTS"], "incoming", limit)

    def container(self, entity_id: str) -> DataFrame:
        """What contains the entity: one row, or none for a file."""
        return self.related(entity_id, ["CONTAINS"], "incoming", 1)

    def parents(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["INHERITS"], "outgoing", limit)

    def subclasses(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["INHERITS"], "incoming", limit)

    def interfaces(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["IMPLEMENTS"], "outgoing", limit)

    def implementations(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.related(entity_id, ["IMPLEMENTS"], "incoming", limit)

    def neighbors(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Both directions, limit for each; `truncated` is told of each direction."""
        sides = [G.related(self.nodes, self.edges, self._id(entity_id), None, d, checked_number("limit", limit, 1, MAX_LIMIT) + 1) for d in ("outgoing", "incoming")]
        order = ["type", "file_path", "start_line", "id", "edge_id"]
        out = [self._page(side, limit, order).withColumn("direction", F.lit(d)) for side, d in zip(sides, ("outgoing", "incoming"))]
        both = out[0].unionByName(out[1])
        if both.isEmpty():
            self.entity(entity_id)
        return both

    def reach(self, entity_id: str, types: Iterable[str], direction: str = "outgoing", depth: int = 1, limit: int = DEFAULT_LIMIT, entity_types: Iterable[str] | None = None) -> DataFrame:
        """Depth 1 keeps the edge (`type`, `line`); a deeper walk has the least `depth` of each entity only."""
        if G.checked_depth(depth) == 1:
            return self.related(entity_id, types, direction, limit, entity_types).withColumn("depth", F.lit(1))
        checked_number("limit", limit, 1, MAX_LIMIT)
        start = self.nodes.where(F.col("id") == self._id(entity_id)).select("id")
        rows = G.reachable(self.edges, start, types, direction, depth).select("id", "depth").join(self.nodes, "id")
        if entity_types is not None:
            rows = rows.where(F.col("entity_type").isin(list(entity_types)))
        order = ["depth", "file_path", "start_line", "id"]
        return self._page(rows.orderBy(*order).limit(limit + 1), limit, order, entity_id)

    def contained(self, entity_id: str, depth: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.reach(entity_id, ["CONTAINS"], "outgoing", depth, limit)

    def dependencies(self, entity_id: str, depth: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.reach(entity_id, ["DEPENDS_ON"], "outgoing", depth, limit)

    def dependents(self, entity_id: str, depth: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.reach(entity_id, ["DEPENDS_ON"], "incoming", depth, limit)

    def paths(self, source: str, target: str, depth: int = PATH_DEPTH, limit: int = PATH_LIMIT, types: Iterable[str] | None = None, directed: bool = True) -> DataFrame:
        """All shortest paths, one for each choice of parallel edges. Both ends must be there when there is none."""
        checked_number("limit", limit, 1, MAX_PATHS)
        found = G.shortest_paths(self.edges, self._id(source), self._id(target), depth, limit, types, directed)
        if found.isEmpty() or source == target:
            self.entity(source), self.entity(target)
        return found

    def find(self, text: str, limit: int = DEFAULT_LIMIT, entity_types: Iterable[str] | None = None) -> DataFrame:
        """Exact matches first; parts of names only where exact ones leave room."""
        checked_number("limit", limit, 1, MAX_LIMIT)
        exact = written(G.search(self.nodes, text, limit + 1, entity_types), "found")
        order = ["rank", "file_path", "start_line", "id"]
        if exact.count() > limit:
            return self._page(exact, limit, order)
        part = G.search(self.nodes.join(exact.select("id"), "id", "left_anti"), text, limit + 1, entity_types, partial=True)
        return self._page(exact.unionByName(part).orderBy(*order).limit(limit + 1), limit, order)

    def context(self, entity_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """The entity, its container and its neighbours, each once in this order: columns of nodes, `place` (0 entity,
        1 container, 2 outgoing, 3 incoming) and `truncated`."""
        cols = [F.col(c) for c in self.nodes.columns]
        own = self.entity(entity_id).select(*cols, F.lit(0).alias("place"), F.lit(False).alias("truncated"))
        above = self.container(entity_id).select(*cols, F.lit(1).alias("place"), F.lit(False).alias("truncated"))
        around = self.neighbors(entity_id, limit).select(*cols, F.when(F.col("direction") == "outgoing", 2).otherwise(3).alias("place"), "truncated")
        every = own.unionByName(above).unionByName(around)
        first = every.groupBy("id").agg(F.min("place").alias("place"), F.max("truncated").alias("truncated"))
        return first.join(self.nodes, "id").orderBy("place", "file_path", "start_line", "id")

    def project_graph(self, limit: int = DISPLAY_NODES, edge_limit: int = DISPLAY_EDGES, max_nodes: int = MAX_DISPLAY_NODES) -> tuple[DataFrame, DataFrame, bool]:
        """(nodes, edges, truncated): the first nodes, coarse structure first, and the edges among them; truncated where
        either was cut. NotFound for an empty project."""
        checked_number("limit", limit, 1, max_nodes)
        nodes = written(G.page(self.nodes, limit + 1), "graph-nodes")
        n = nodes.count()
        if n == 0:
            raise NotFound("no such project")
        kept = G.page(nodes, limit)
        edges = written(G.induced(self.edges, kept, edge_limit + 1), "graph-edges")
        order = ["type", "source_id", "target_id", "id"]
        return kept, edges.orderBy(*order).limit(edge_limit), n > limit or edges.count() > edge_limit

    def analysis_graph(self) -> tuple[DataFrame, DataFrame, bool]:
        return self.project_graph(ANALYSIS_NODES, ANALYSIS_EDGES, ANALYSIS_NODES)

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        if not self.exists():
            raise NotFound("no such project")
        return G.counts(self.nodes, "entity_type"), G.counts(self.edges, "type")


def without_types(edges: DataFrame, hidden: Iterable[str]) -> DataFrame:
    """Edges but for those of hidden types."""
    return edges.where(~F.col("type").isin(list(hidden))) if list(hidden) else edges


def closed_neighborhood(nodes: DataFrame, edges: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame]:
    """The entity with all that an edge links it to, and those edges."""
    touching = edges.where((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))
    ids = touching.select(F.col("source_id").alias("id")).union(touching.select("target_id")).union(nodes.where(F.col("id") == entity_id).select("id")).distinct()
    return nodes.join(ids, "id", "left_semi"), touching


def languages(nodes: DataFrame) -> DataFrame:
    """Files by language, most first."""
    return G.counts(nodes.where("entity_type = 'file'"), "language").orderBy(F.desc("n"), "language")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, project_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ids (column id) and the edges at them; other projects keep theirs."""
    own = ids.select("id").distinct()
    if project_id is not None:
        own = own.join(nodes.where(F.col("project_id") == project_id).select("id"), "id", "left_semi")
    for end in ("source_id", "target_id"):
        edges = edges.join(own.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(own, "id", "left_anti"), edges


def delete_edges(edges: DataFrame, ids: DataFrame, project_id: str | None = None) -> DataFrame:
    own = ids.select("id").distinct()
    gone = edges if project_id is None else edges.where(F.col("project_id") == project_id)
    return edges.join(gone.join(own, "id", "left_semi").select("id"), "id", "left_anti")


def delete_project(tables: list[DataFrame], project_id: str) -> list[DataFrame]:
    """Every table without the project's rows. Rows without a project stay."""
    return [df.where(~F.col("project_id").eqNullSafe(checked_project(project_id))) for df in tables]
