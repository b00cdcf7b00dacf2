"""Dependency and architecture analytics over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.sources.tables import written

FILE_TYPES, REFERENCE_TYPES = ("DEPENDS_ON", "IMPORTS"), ("CALLS", "IMPLEMENTS", "INHERITS", "USES")


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_path, target_path, types): distinct pairs of files, without loops, with their edge types sorted."""
    files = nodes.where("entity_type = 'file'").select("id", "file_path")
    pairs = edges.where(F.col("type").isin(*FILE_TYPES) & (F.col("source_id") != F.col("target_id"))).groupBy("source_id", "target_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    out = pairs.join(files.toDF("source_id", "source_path"), "source_id").join(files.toDF("target_id", "target_path"), "target_id")
    return out.select("source_path", "target_path", "types")


def file_hubs(pairs: DataFrame, limit: int = 10) -> DataFrame:
    return pairs.groupBy(F.col("target_path").alias("file_path")).agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "file_path").limit(limit)


def entity_hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Entities by distinct sources that refer to them; references to oneself count."""
    incoming = edges.where(F.col("type").isin(*REFERENCE_TYPES)).groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("references"))
    return incoming.join(nodes.where("entity_type <> 'file'"), "id").orderBy(F.desc("references"), "file_path", "start_line", "id").limit(limit).select("id", "references", "file_path", "start_line")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    targets = edges.where(F.col("type").isin(*REFERENCE_TYPES)).select(F.col("target_id").alias("id"))
    return nodes.where("entity_type <> 'file'").join(targets, "id", "left_anti")


def without_dependents(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    return nodes.where("entity_type = 'file'").join(pairs.select(F.col("target_path").alias("file_path")), "file_path", "left_anti").select("file_path")


def entry_points(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files on which none depends but which depend on some."""
    return without_dependents(nodes, pairs).join(pairs.select(F.col("source_path").alias("file_path")), "file_path", "left_semi")


def components(pairs: DataFrame) -> DataFrame:
    """(file_path, component): strongly connected components of two files or more, named by their least path.

    Each round, within the components still open, every file gets the least file that reaches it and the least
    that it reaches; files where both agree form a component and leave."""
    arcs = written(pairs.select(F.col("source_path").alias("a"), F.col("target_path").alias("b")).distinct(), "arcs")
    out = None
    while arcs.limit(1).count():
        names = arcs.select(F.col("a").alias("v")).union(arcs.select("b")).distinct()
        label = {}
        for way, (x, y) in {"f": ("a", "b"), "r": ("b", "a")}.items():
            now = written(names.select("v", F.col("v").alias("least")), "scc")
            while True:
                told = arcs.join(now.withColumnRenamed("v", x), x).groupBy(F.col(y).alias("v")).agg(F.min("least").alias("near"))
                after = written(now.join(told, "v", "left").select("v", F.least("least", F.coalesce("near", "least")).alias("new"), "least"), "scc")
                moved = after.where("new < least").limit(1).count()
                now = after.select("v", F.col("new").alias("least"))
                if not moved:
                    break
            label[way] = now
        both = written(label["f"].withColumnRenamed("least", "from").join(label["r"].withColumnRenamed("least", "to"), "v"), "scc-labels")
        done = both.where("from = to").select(F.col("v").alias("file_path"), F.col("from").alias("component"))
        out = done if out is None else out.union(done)
        open_ = both.where("from <> to")
        arcs = written(arcs.join(open_.toDF("a", "fa", "ta"), "a").join(open_.toDF("b", "fb", "tb"), "b").where("fa = fb and ta = tb").select("a", "b"), "arcs")
    if out is None:
        return pairs.select(F.col("source_path").alias("file_path"), F.col("source_path").alias("component")).where("false")
    size = out.groupBy("component").agg(F.count("*").alias("size"))
    return out.join(size.where("size > 1"), "component").select("file_path", "component")


def cycles(pairs: DataFrame, limit: int = 50) -> DataFrame:
    """(length, cycle): for each file its shortest cycle, least path first, each once; cycles as text with ' > '."""
    member = components(pairs)
    inside = pairs.join(member.toDF("source_path", "c1"), "source_path").join(member.toDF("target_path", "c2"), "target_path").where("c1 = c2")
    arcs = written(inside.select(F.col("source_path").alias("a"), F.col("target_path").alias("b")).distinct(), "cycle-arcs")
    front = arcs.select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a").alias("path"))
    found = None
    while True:
        closed = written(front.where("at = start").groupBy("start").agg(F.min("path").alias("path")), "closed")
        found = closed if found is None else found.union(closed)
        grown = front.join(closed.select("start"), "start", "left_anti").where(~F.array_contains("path", F.col("at")))
        # of the ways to a file only the least can be part of the least shortest cycle
        grown = grown.groupBy("start", "at").agg(F.min("path").alias("path")).join(arcs, F.col("at") == F.col("a"))
        front = written(grown.select("start", F.col("b").alias("at"), F.concat("path", F.array("a")).alias("path")), "cycle-paths")
        if not front.limit(1).count():
            break
    least = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", least, F.size("path")), F.slice("path", 1, least - 1))
    return found.select(turned.alias("cycle")).distinct().select(F.size("cycle").alias("length"), F.array_join("cycle", " > ").alias("cycle")).orderBy("length", "cycle").limit(limit)


def module_of(path: str = "file_path"):
    return F.split(F.col(path), "/")[0]


def files_per_module(nodes: DataFrame) -> DataFrame:
    return nodes.where("entity_type = 'file'").groupBy(module_of().alias("module")).agg(F.count("*").alias("files"))


def module_dependencies(pairs: DataFrame) -> DataFrame:
    cross = pairs.select(module_of("source_path").alias("source_module"), module_of("target_path").alias("target_module")).where("source_module <> target_module")
    return cross.groupBy("source_module", "target_module").agg(F.count("*").alias("pairs"))


def largest_types(nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """Classes and interfaces by the methods they contain."""
    methods = edges.where("type = 'CONTAINS'").join(nodes.where("entity_type = 'method'").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    n = methods.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("methods"))
    return n.join(nodes, "id").orderBy(F.desc("methods"), "file_path", "start_line", "id").limit(limit).select("id", "methods")


def first_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (source, type, target): the first in order, which has to leave no ties."""
    rank = F.row_number().over(Window.partitionBy("source_id", "type", "target_id").orderBy(*order))
    return edges.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def derived_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_path, target_path, line): files whose entities refer to another file's, with the first evidence."""
    where = nodes.select("id", "file_path")
    refs = edges.where(F.col("type").isin(*REFERENCE_TYPES)).join(where.toDF("source_id", "source_path"), "source_id").join(where.toDF("target_id", "target_path"), "target_id")
    return refs.where("source_path <> target_path").groupBy("source_path", "target_path").agg(F.min("line").alias("line"))
