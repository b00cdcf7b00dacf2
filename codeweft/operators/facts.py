"""What can be said of a project's architecture, as numbered sentences that answers cite.

Each fact is one row, made by one bounded aggregate; the rows are numbered by a small window at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators import analytics as A
from codeweft.operators import graph as G
from codeweft.sources.tables import written

LISTED = 8


def plural(n: Column, noun: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {many or noun + 's'}"))


def listing(items: Column, listed: int = LISTED) -> Column:
    """`a, b and c`; beyond `listed` items `a, b and 5 more`."""
    n = F.size(items)
    all_of = F.when(n == 1, F.element_at(items, 1)).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))
    return F.when(n == 0, "").when(n <= listed, all_of).otherwise(F.concat(F.array_join(F.slice(items, 1, listed), ", "), F.lit(" and "), (n - listed).cast("string"), F.lit(" more")))


def _list_fact(ord_: int, rows: DataFrame, item: Column, order: list, lead: str, listed: int = LISTED) -> DataFrame:
    """One sentence from rows, none from no rows. All items are counted; only the first listed + 1 are sorted out."""
    first = rows.select(item.alias("_item"), *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [F.asc(f"_o{k}") for k in range(len(order))]
    top = first.orderBy(*keys).limit(listed)
    agg = top.agg(F.array_sort(F.collect_list(F.struct(*[f"_o{k}" for k in range(len(order))], "_item"))).alias("_l"))
    n = rows.agg(F.count("*").alias("_n"))
    text = F.when(F.col("_n") <= listed, listing(F.col("_l._item"), listed)).otherwise(
        F.concat(F.array_join(F.col("_l._item"), ", "), F.lit(" and "), (F.col("_n") - listed).cast("string"), F.lit(" more"))
    )
    # two tables of one row each
    return n.withColumn("_k", F.lit(1)).join(agg.withColumn("_k", F.lit(1)), "_k").where("_n > 0").select(F.lit(ord_).alias("ord"), F.concat(F.lit(lead), text, F.lit(".")).alias("fact"))


def facts(nodes: DataFrame, edges: DataFrame, truncated: bool = False, cycles: DataFrame | None = None) -> DataFrame:
    """(number, fact), from 1, in a fixed order; no rows for an empty graph. cycles: as analytics.cycles gives them,
    else they are found here. A project cut off at its limits says so in its second fact."""
    pairs = written(A.file_dependencies(nodes, edges), "pairs")
    size = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("entity_type") == "file").alias("f")).where("n > 0")
    out = [size.select(F.lit(1).alias("ord"), F.concat(F.lit("The project has "), plural(F.col("f"), "file"), F.lit(" and "), plural(F.col("n") - F.col("f"), "definition"), F.lit(".")).alias("fact"))]
    if truncated:
        out.append(size.select(F.lit(2).alias("ord"), F.lit("The project is larger than what was read, so counts are lower bounds.").alias("fact")))
    counted = lambda name, n, noun: F.concat(F.col(name), F.lit(" ("), plural(F.col(n), noun), F.lit(")"))
    modules = A.files_per_module(nodes)
    out.append(_list_fact(3, modules, counted("module", "files", "file"), [-F.col("files"), F.col("module")], "Files by directory: "))
    between = A.module_dependencies(pairs)
    out.append(_list_fact(4, between, F.concat("source_module", F.lit(" on "), "target_module"), [-F.col("pairs"), F.col("source_module"), F.col("target_module")], "Directories that depend on others: "))
    total = pairs.agg(F.count("*").alias("p"))
    out.append(total.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k").select(F.lit(5).alias("ord"), F.concat(F.lit("There are "), F.col("p").cast("string"), F.lit(" dependencies between files.")).alias("fact")))
    hubs = A.file_hubs(pairs, LISTED)
    out.append(_list_fact(6, hubs, counted("file_path", "dependents", "dependent"), [-F.col("dependents"), F.col("file_path")], "Files that most others depend on: "))
    used = A.entity_hubs(nodes, edges, LISTED).join(nodes.select("id", "qualified_name"), "id")
    out.append(_list_fact(7, used, counted("qualified_name", "references", "referrer"), [-F.col("references"), F.col("id")], "Most referenced definitions: "))
    out.append(_list_fact(8, A.entry_points(nodes, pairs), F.col("file_path"), [F.col("file_path")], "Possible entry points: "))
    methods = A.largest_types(nodes, edges, LISTED).join(nodes.select("id", "qualified_name"), "id")
    out.append(_list_fact(9, methods, counted("qualified_name", "methods", "method"), [-F.col("methods"), F.col("id")], "Largest types: "))
    kinds = G.counts(edges, "type")
    out.append(_list_fact(10, kinds, F.concat(F.col("n").cast("string"), F.lit(" "), F.col("type")), [-F.col("n"), F.col("type")], "Relationships: "))
    loops = A.cycles(pairs) if cycles is None else cycles
    found = loops.agg(F.count("*").alias("c"), F.min(F.struct("length", "cycle")).alias("first"))
    text = F.when(F.col("c") == 0, "No file depends on itself through others.").otherwise(F.concat(F.lit("There are cycles among files: "), plural(F.col("c"), "cycle"), F.lit(", the shortest "), F.col("first.cycle"), F.lit(".")))
    out.append(found.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k").select(F.lit(11).alias("ord"), text.alias("fact")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select(F.row_number().over(Window.orderBy("ord")).alias("number"), "fact")  # at most 11 rows


def dependency_report(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> tuple[DataFrame, bool]:
    """The first pairs of files that depend on each other, and whether there are more."""
    pairs = A.file_dependencies(nodes, edges).orderBy("source_path", "target_path").limit(limit + 1)
    return pairs.limit(limit), pairs.count() > limit
