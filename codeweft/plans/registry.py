"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import analytics as A
from codeweft.operators import chunks as C
from codeweft.operators import extract as X
from codeweft.operators import graph as G
from codeweft.operators import hybrid as H
from codeweft.operators import incremental as I
from codeweft.operators import vectors as V
from codeweft.plans.starschema import graph, oracle
from codeweft.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "impact_analysis"


def _query(sql: str = "", over_graph: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql) if over_graph else sql
        return f

    return add


def _on_graph(sql: str = ""):
    """A query given as f(nodes, edges)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*graph(spark, sf_dir))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        return _query(sql)(run)

    return add


RANK = "CASE WHEN entity_type = 'file' THEN 0 WHEN entity_type IN ('class', 'interface') THEN 1 WHEN entity_type = 'function' THEN 2 ELSE 3 END"
PAIRS = """p AS (SELECT s.file_path AS source_path, t.file_path AS target_path, string_agg(DISTINCT type, ',' ORDER BY type) AS types
    FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE type IN ('DEPENDS_ON', 'IMPORTS') AND source_id <> target_id GROUP BY 1, 2)"""
REFS = "('CALLS', 'IMPLEMENTS', 'INHERITS', 'USES')"


@_on_graph("q AS (SELECT entity_type, count(*) AS n FROM nodes GROUP BY 1) SELECT * FROM q")
def graph_stats_nodes(nodes, edges):
    return G.counts(nodes, "entity_type")


@_on_graph("q AS (SELECT type, count(*) AS n FROM edges GROUP BY 1) SELECT * FROM q")
def graph_stats_edges(nodes, edges):
    return G.counts(edges, "type")


@_on_graph("q AS (SELECT * FROM nodes WHERE id = 'class:7') SELECT * FROM q")
def graph_entity(nodes, edges):
    return nodes.where("id = 'class:7'")


@_on_graph("""q AS (SELECT *, CASE WHEN id = 'ALGERIA' THEN 0 WHEN qualified_name = 'ALGERIA' THEN 1 WHEN name = 'ALGERIA' THEN 2
    WHEN contains(lower(name), 'a') OR contains(lower(qualified_name), 'a') THEN 3 END AS rank FROM nodes WHERE entity_type IN ('file', 'interface'))
    SELECT id, rank FROM q WHERE rank IS NOT NULL ORDER BY rank, file_path, start_line, id LIMIT 50""")
def graph_search_ranked(nodes, edges):
    found = G.search(nodes, "ALGERIA", 50, ["file", "interface"]).unionByName(nodes.withColumn("rank", F.lit(None).cast("int")).where("false"))
    part = G.search(nodes.join(found.select("id"), "id", "left_anti"), "a", 50, ["file", "interface"], partial=True)
    return found.unionByName(part).orderBy("rank", "file_path", "start_line", "id").limit(50).select("id", "rank")


@_on_graph(f"q AS (SELECT id, entity_type, file_path, start_line FROM nodes ORDER BY {RANK}, file_path, start_line, id LIMIT 151) SELECT * FROM q")
def graph_page_nodes(nodes, edges):
    return G.page(nodes, 151).select("id", "entity_type", "file_path", "start_line")


@_on_graph(f"""q AS (SELECT id FROM nodes ORDER BY {RANK}, file_path, start_line, id LIMIT 500)
    SELECT e.id, e.type, e.source_id, e.target_id, coalesce(e.line, 0) AS line FROM edges e WHERE source_id IN (FROM q) AND target_id IN (FROM q) ORDER BY type, source_id, target_id, id LIMIT 2000""")
def graph_page_edges(nodes, edges):
    return G.induced(edges, G.page(nodes, 500), 2000).withColumn("line", F.coalesce("line", F.lit(0)))


_RELATED = """q AS (SELECT n.id, e.type, e.line, n.file_path FROM edges e JOIN nodes n ON n.id = e.{there} WHERE e.{here} = '{id}' AND e.type IN ({types})
    ORDER BY e.type, n.file_path, n.start_line, n.id, e.id LIMIT 50) SELECT * FROM q"""


@_on_graph(_RELATED.format(here="target_id", there="source_id", id="interface:3", types="'CALLS'"))
def graph_callers(nodes, edges):
    return G.related(nodes, edges, "interface:3", ["CALLS"], "incoming", 50).select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="source_id", there="target_id", id="method:7", types="'CALLS', 'USES'"))
def graph_callees(nodes, edges):
    return G.related(nodes, edges, "method:7", ["CALLS", "USES"], "outgoing", 50).select("id", "type", "line", "file_path")


@_on_graph("""o AS (SELECT n.id, e.type, 'outgoing' AS direction FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = 'class:7' ORDER BY e.type, n.file_path, n.start_line, n.id, e.id LIMIT 50),
    i AS (SELECT n.id, e.type, 'incoming' AS direction FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = 'class:7' ORDER BY e.type, n.file_path, n.start_line, n.id, e.id LIMIT 50)
    SELECT * FROM o UNION ALL SELECT * FROM i""")
def graph_neighbors(nodes, edges):
    return G.neighbors(nodes, edges, "class:7", 50).select("id", "type", "direction")


_REACH = """r(id, depth) AS (SELECT '{id}', 0 UNION SELECT e.{there}, r.depth + 1 FROM r JOIN edges e ON e.{here} = r.id WHERE r.depth < {depth} AND e.type IN ({types}))
    SELECT id, min(depth)::INT AS depth FROM r WHERE id <> '{id}' GROUP BY id"""


@_on_graph(_REACH.format(id="file:3", here="source_id", there="target_id", depth=2, types="'CONTAINS'"))
def graph_contained(nodes, edges):
    return G.contained(edges, nodes.where("id = 'file:3'"), 2).select("id", "depth")


@_on_graph(_REACH.format(id="file:3", here="source_id", there="target_id", depth=3, types="'IMPORTS', 'DEPENDS_ON'"))
def graph_reachable_d3(nodes, edges):
    return G.reachable(edges, nodes.where("id = 'file:3'"), ["IMPORTS", "DEPENDS_ON"], "outgoing", 3).select("id", "depth")


@_on_graph("""w(path, edge_ids, steps, id, n) AS (SELECT ['file:3'], []::VARCHAR[], ['file:3'], 'file:3', 0 UNION ALL
      SELECT list_append(path, target_id), list_append(edge_ids, e.id), list_concat(steps, [target_id, e.id]), target_id, n + 1 FROM w JOIN edges e ON source_id = w.id AND e.type IN ('IMPORTS', 'DEPENDS_ON')
      WHERE n < 4 AND w.id <> 'file:8' AND NOT list_contains(path, target_id)),
    d AS (SELECT * FROM w WHERE w.id = 'file:8')
    SELECT array_to_string(path, ' > ') AS path, array_to_string(edge_ids, ' > ') AS edge_ids FROM d WHERE n = (SELECT min(n) FROM d) ORDER BY steps LIMIT 20""")
def graph_shortest_paths(nodes, edges):
    """One row for each choice of parallel edges."""
    found = G.shortest_paths(edges, "file:3", "file:8", 4, 20, ["IMPORTS", "DEPENDS_ON"])
    return found.select(F.array_join("path", " > ").alias("path"), F.array_join("edge_ids", " > ").alias("edge_ids"))


def _impact_sql(entity_id: str, depth: int, types: str, limit: int = 300) -> str:
    """The walk by levels: see graph.impact."""
    sql = f"""c(id, depth) AS (SELECT '{entity_id}', 0 UNION SELECT e.target_id, c.depth + 1 FROM c JOIN edges e ON e.source_id = c.id WHERE e.type = 'CONTAINS' AND c.depth < 5),
    s0 AS (SELECT id, row_number() OVER (ORDER BY min(depth), any_value(file_path), any_value(start_line), id) AS pos FROM c JOIN nodes USING (id) GROUP BY id), seen0 AS (SELECT id FROM s0)"""
    for d in range(1, depth + 1):
        sql += f""", f{d} AS (SELECT e.source_id AS id, s.id AS via, e.type, s.pos, n.file_path, e.line, e.id AS edge, row_number() OVER (PARTITION BY e.source_id ORDER BY s.pos, e.type, n.file_path, e.line, e.id) AS rn
        FROM s{d - 1} s JOIN edges e ON e.target_id = s.id JOIN nodes n ON n.id = e.source_id WHERE e.type IN ({types}) AND e.source_id NOT IN (FROM seen{d - 1})),
    s{d} AS (SELECT id, via, type, row_number() OVER (ORDER BY pos, type, file_path, line, edge) AS pos FROM f{d} WHERE rn = 1), seen{d} AS (FROM seen{d - 1} UNION SELECT id FROM s{d})"""
    every = " UNION ALL ".join(f"SELECT id, {d} AS depth, via, type, pos FROM s{d}" for d in range(1, depth + 1))
    return sql + f", r AS ({every}), t AS (SELECT * FROM r ORDER BY depth, pos LIMIT {limit})"


_REFERENCES, _BETWEEN_FILES = "'CALLS', 'DEPENDS_ON', 'IMPLEMENTS', 'IMPORTS', 'INHERITS', 'USES'", "'IMPORTS', 'DEPENDS_ON'"
_ROWS = "SELECT id, depth, via, type, (SELECT count(*) > 300 FROM r) AS truncated FROM t"


@_on_graph(_impact_sql("file:3", 3, _BETWEEN_FILES) + " SELECT depth, count(*) AS entities FROM t GROUP BY 1")
def impact_by_depth(nodes, edges):
    return G.impact(nodes, edges, "file:3", types=["IMPORTS", "DEPENDS_ON"]).groupBy("depth").agg(F.count("*").alias("entities"))


@_on_graph(_impact_sql("file:3", 3, _REFERENCES) + " " + _ROWS)
def impact_analysis(nodes, edges):
    return G.impact(nodes, edges, "file:3")


@_on_graph(_impact_sql("file:3", 3, _BETWEEN_FILES) + " " + _ROWS)
def impact_files(nodes, edges):
    """Files alone: several levels."""
    return G.impact(nodes, edges, "file:3", types=["IMPORTS", "DEPENDS_ON"])


@_on_graph(f"{PAIRS} SELECT * FROM p")
def deps_pairs(nodes, edges):
    return A.file_dependencies(nodes, edges)


@_on_graph(f"{PAIRS} SELECT target_path AS file_path, count(*) AS dependents FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def deps_file_hubs(nodes, edges):
    return A.file_hubs(A.file_dependencies(nodes, edges))


@_on_graph(f'q AS (SELECT target_id AS id, count(DISTINCT source_id) AS "references" FROM edges WHERE type IN {REFS} GROUP BY 1) SELECT id, "references", file_path, start_line FROM q JOIN nodes USING (id) ORDER BY 2 DESC, file_path, start_line, id LIMIT 10')
def deps_entity_hubs(nodes, edges):
    return A.entity_hubs(nodes, edges)


@_on_graph(f"q AS (SELECT DISTINCT target_id FROM edges WHERE type IN {REFS}) SELECT id, entity_type FROM nodes WHERE entity_type <> 'file' AND id NOT IN (FROM q)")
def deps_unreferenced(nodes, edges):
    return A.unreferenced(nodes, edges).select("id", "entity_type")


@_on_graph(f"{PAIRS} SELECT file_path FROM nodes WHERE entity_type = 'file' AND file_path NOT IN (SELECT target_path FROM p)")
def deps_no_dependents(nodes, edges):
    return A.without_dependents(nodes, A.file_dependencies(nodes, edges))


@_on_graph(f"{PAIRS} SELECT file_path FROM nodes WHERE entity_type = 'file' AND file_path NOT IN (SELECT target_path FROM p) AND file_path IN (SELECT source_path FROM p)")
def deps_entry_points(nodes, edges):
    return A.entry_points(nodes, A.file_dependencies(nodes, edges))


@_on_graph(f"""{PAIRS}, r(a, b) AS (SELECT source_path, target_path FROM p UNION SELECT r.a, p.target_path FROM r JOIN p ON p.source_path = r.b),
    m AS (SELECT x.a, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT a AS file_path, component FROM m""")
def deps_scc(nodes, edges):
    return A.components(A.file_dependencies(nodes, edges))


@_on_graph(f"""{PAIRS}, w(start, here, path) AS (SELECT source_path, target_path, [source_path] FROM p
        UNION ALL SELECT start, p.target_path, list_append(path, here) FROM w JOIN p ON p.source_path = here WHERE here <> start AND NOT list_contains(path, here) AND len(path) < 7),
    c AS (SELECT path, row_number() OVER (PARTITION BY start ORDER BY len(path), path) AS rn FROM w WHERE here = start),
    t AS (SELECT DISTINCT len(path) AS length, list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS cycle FROM c WHERE rn = 1)
    SELECT length::INT AS length, array_to_string(cycle, ' > ') AS cycle FROM t ORDER BY 1, 2 LIMIT 50""")
def deps_cycles(nodes, edges):
    return A.cycles(A.file_dependencies(nodes, edges))


@_on_graph("q AS (SELECT split_part(file_path, '/', 1) AS module, count(*) AS files FROM nodes WHERE entity_type = 'file' GROUP BY 1) SELECT * FROM q")
def facts_modules(nodes, edges):
    return A.files_per_module(nodes)


@_on_graph(f"{PAIRS} SELECT split_part(source_path, '/', 1) AS source_module, split_part(target_path, '/', 1) AS target_module, count(*) AS pairs FROM p WHERE split_part(source_path, '/', 1) <> split_part(target_path, '/', 1) GROUP BY 1, 2")
def facts_module_deps(nodes, edges):
    return A.module_dependencies(A.file_dependencies(nodes, edges))


@_on_graph("""q AS (SELECT e.source_id AS id, count(*) AS methods FROM edges e JOIN nodes m ON m.id = e.target_id WHERE e.type = 'CONTAINS' AND m.entity_type = 'method' GROUP BY 1)
    SELECT id, methods FROM q JOIN nodes USING (id) ORDER BY methods DESC, file_path, start_line, id LIMIT 8""")
def facts_largest_classes(nodes, edges):
    return A.largest_types(nodes, edges)


@_on_graph("q AS (SELECT language, entity_type, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT * FROM q")
def facts_totals(nodes, edges):
    return nodes.groupBy("language", "entity_type").agg(F.count("*").alias("n"))


@_on_graph(f"""q AS (SELECT s.file_path AS source_path, t.file_path AS target_path, min(line) AS line FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id
    WHERE type IN {REFS} AND s.file_path <> t.file_path GROUP BY 1, 2) SELECT * FROM q""")
def depends_on_derived(nodes, edges):
    return A.derived_dependencies(nodes, edges)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES = "(SELECT 'CALLS' AS type, 'o' || l_orderkey AS source_id, 's' || l_suppkey AS target_id, l_linenumber AS line, l_partkey AS part FROM lineitem)"


@_query(f"SELECT source_id, type, target_id, line, part FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY line) AS rn FROM {_LINES}) WHERE rn = 1", False)
def first_edge_dedup(spark, sf_dir):
    """Lines of one number are taken in the order of the file."""
    place = ("_metadata.file_path AS _file", "_metadata.row_index AS _row")
    e = _table(spark, sf_dir, "lineitem").selectExpr("'CALLS' AS type", "'o' || l_orderkey AS source_id", "'s' || l_suppkey AS target_id", "l_linenumber AS line", "l_partkey AS part", *place)
    return A.first_edges(e, ["line", "_file", "_row"]).select("source_id", "type", "target_id", "line", "part")


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN base ELSE base || '#' || n END AS id FROM (SELECT *, 'o' || l_orderkey || ':' || l_returnflag AS base,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem)""", False)
def occurrence_ids(spark, sf_dir):
    from codeweft.functions.entities import occurrence_ids as numbered

    t = _table(spark, sf_dir, "lineitem").selectExpr("*", "'o' || l_orderkey || ':' || l_returnflag AS base")
    return numbered(t, "base", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "id")


_SCORE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_TOP = f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_SCORE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 {{where}}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s {{having}}) SELECT query_id, vec_id, label, round(score, 6) AS score FROM r WHERE rn <= {{k}}"""


def _queries(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@_query(_TOP.format(where="", having="", k=10), False)
def vec_topk(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return V.top_k(v, _queries(v), 10)


@_query(_TOP.format(where="AND e.label IN (1, 3)", having="", k=5), False)
def vec_topk_filtered(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return V.top_k(v.where("label in (1, 3)"), _queries(v), 5)


@_query(_TOP.format(where="", having="WHERE score >= 0.2", k=50), False)
def vec_threshold(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return V.top_k(v, _queries(v), 50, 0.2)


_VERSION = "SELECT l_{k}key || '|' || l_linenumber AS path, CAST(max(l_quantity) AS INT) AS hash FROM lineitem GROUP BY 1"


@_query(
    f"""WITH a AS ({_VERSION.format(k="part")}), b AS ({_VERSION.format(k="supp")})
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS change
    FROM a FULL JOIN b ON a.path = b.path""",
    False,
)
def change_detect(spark, sf_dir):
    """Lines by their part against lines by their supplier."""
    lines = _table(spark, sf_dir, "lineitem")
    return V.changes(*(spark.sql(_VERSION.format(k=k).replace("FROM lineitem", "FROM {lines}"), lines=lines) for k in ("part", "supp")), "path")


@_query("""SELECT c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier ANTI JOIN customer ON s_suppkey = c_custkey""", False)
def upsert_nodes(spark, sf_dir):
    """Customers, with suppliers put over those of the same key."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return V.upsert(c, _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS c_custkey", "s_name AS c_name", "s_acctbal AS c_acctbal"), "c_custkey")


@_query(r"""SELECT doc_id, sha256('model-1' || chr(10) || 'file: ' || source || chr(10) || text) AS content_hash FROM documents""", False)
def chunk_hash(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.concat(F.lit("model-1\nfile: "), "source", F.lit("\n"), "text"), 256).alias("content_hash"))


@_query("""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: length(l) + 1) AS n FROM documents),
    w(doc_id, part, s, e, n) AS (SELECT doc_id, 0, 0, 0, n FROM d UNION ALL SELECT doc_id, part + 1, ns, ns + greatest(1, coalesce(list_position(list_transform(range(1, len(n) - ns + 2), lambda k: list_sum(n[ns:ns + k - 1]) > 2000), true) - 1, len(n) - ns + 1)) - 1, n
        FROM (SELECT *, CASE WHEN part = 0 THEN 1 ELSE greatest(e + 1 - 3, s + 1) END AS ns FROM w WHERE part = 0 OR e < len(n)))
    SELECT doc_id, part, s AS first_line, e AS last_line FROM w WHERE part > 0""", False)
def chunk_windows(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return C.windows(d, "doc_id", 2000, 3)


@_query(r"""WITH a AS (SELECT conv_id, turn, 'see [' || (turn % 4) || ', ' || (turn + 1) || '] and [99] in ' || text AS answer FROM conversations),
    n AS (SELECT conv_id, turn, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda m: list_transform(regexp_split_to_array(m, '\s*,\s*'), lambda x: x::INT))))) AS n FROM a)
    SELECT conv_id || ':' || turn AS answer_id, array_to_string(list_filter(n, lambda x: x >= 1 AND x <= 5), ',') AS cited, array_to_string(list_filter(n, lambda x: x < 1 OR x > 5), ',') AS unknown FROM n""", False)
def cite_check(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").selectExpr("conv_id || ':' || turn AS answer_id", "'see [' || (turn % 4) || ', ' || (turn + 1) || '] and [99] in ' || text AS answer")
    return V.citations(c, "answer_id", "answer", 5)


@_query(r"""SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM conversations""", False)
def prompt_escape(spark, sf_dir):
    from codeweft.functions.prompts import escaped

    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", escaped(F.col("text")).alias("escaped"))


@_query(f"""WITH s AS (SELECT q.vec_id AS query_id, q.label AS want, e.vec_id, e.label, {_SCORE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s),
    x AS (SELECT DISTINCT vec_id AS query_id, unnest([label, (label + 1) % 10]) AS item FROM embeddings WHERE vec_id % 20 = 0)
    SELECT x.query_id, round(avg(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM x LEFT JOIN (SELECT DISTINCT query_id, label FROM r WHERE rn <= 5) h ON h.query_id = x.query_id AND h.label = x.item GROUP BY 1""", False)
def eval_recall(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    found = V.top_k(v, _queries(v), 5).select("query_id", F.col("label").alias("item"), F.lit(1).alias("rank"))
    expected = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("item"))
    return V.recall_at(expected, found, 5)


# Source trees: each customer is a project of one class, each of its orders a file that uses it.


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.lit("class Customer:\n    def pay(self):\n        return 1\n")
    own = F.lit("from models import Customer\n\n\ndef settle(c: Customer):\n    return c.pay()\n")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project_id"), F.lit("models.py").alias("path"), model.alias("text"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("project_id"), F.concat(F.lit("o"), "o_orderkey", F.lit(".py")).alias("path"), own.alias("text"))
    every = customers.unionByName(orders).withColumn("content", F.encode("text", "utf-8"))
    return every.select("project_id", "path", F.lit("python").alias("language"), F.lit(0).alias("scan_ord"), F.sha2("content", 256).alias("sha256"), "content")


_ORDERS = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS project_id, 'o' || o_orderkey || '.py' AS path FROM orders), c AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id FROM customer)"


@_query(
    f"""WITH {_ORDERS}, e AS (
    SELECT project_id, project_id || ':' || path AS id, 'file' AS entity_type, CAST(NULL AS VARCHAR) AS parent_id, 1 AS start_line, 5 AS end_line FROM o
    UNION ALL SELECT project_id, project_id || ':' || path || ':settle', 'function', project_id || ':' || path, 4, 5 FROM o
    UNION ALL SELECT project_id, project_id || ':models.py', 'file', NULL, 1, 3 FROM c
    UNION ALL SELECT project_id, project_id || ':models.py:Customer', 'class', project_id || ':models.py', 1, 3 FROM c
    UNION ALL SELECT project_id, project_id || ':models.py:Customer.pay', 'method', project_id || ':models.py:Customer', 2, 3 FROM c) SELECT * FROM e""",
    False,
)
def source_entities(spark, sf_dir):
    """Entities that parsing every file gives."""
    return X.table(X.analysed(_source_files(spark, sf_dir)), "entities").select("project_id", "id", "entity_type", "parent_id", "start_line", "end_line")


@_query(
    f"""WITH {_ORDERS}, m AS (SELECT project_id, path, project_id || ':' || path AS f, project_id || ':models.py' AS t FROM o JOIN c USING (project_id)), e AS (
    SELECT project_id, 'IMPORTS' AS type, f AS source_id, t AS target_id, 1 AS line FROM m
    UNION ALL SELECT project_id, 'USES', f || ':settle', t || ':Customer', 4 FROM m UNION ALL SELECT project_id, 'CALLS', f || ':settle', t || ':Customer.pay', 5 FROM m
    UNION ALL SELECT project_id, 'DEPENDS_ON', f, t, 4 FROM m UNION ALL SELECT project_id, 'CONTAINS', project_id || ':' || path, project_id || ':' || path || ':settle', NULL FROM o
    UNION ALL SELECT project_id, 'CONTAINS', project_id || ':models.py', project_id || ':models.py:Customer', NULL FROM c
    UNION ALL SELECT project_id, 'CONTAINS', project_id || ':models.py:Customer', project_id || ':models.py:Customer.pay', NULL FROM c) SELECT * FROM e""",
    False,
)
def source_edges(spark, sf_dir):
    """The typed graph that resolution gives in every project."""
    files = written(X.analysed(_source_files(spark, sf_dir)), "analysed")
    return X.edges(files, written(X.resolved(files), "resolved")).select("project_id", "type", "source_id", "target_id", "line")


@_query(
    f"""WITH {_ORDERS}, u AS (
    SELECT project_id, project_id || ':' || path AS entity_id, 'file' AS entity_type, path AS file_path, path AS qualified_name, 1 AS start_line, 5 AS end_line,
      'from models import Customer' || chr(10) || chr(10) || chr(10) || 'def settle(c: Customer):' || chr(10) || '    ...' AS text FROM o
    UNION ALL SELECT project_id, project_id || ':' || path || ':settle', 'function', path, 'settle', 4, 5, 'def settle(c: Customer):' || chr(10) || '    return c.pay()' FROM o
    UNION ALL SELECT project_id, project_id || ':models.py:Customer', 'class', 'models.py', 'Customer', 1, 3, 'class Customer:' || chr(10) || '    def pay(self):' || chr(10) || '        ...' FROM c
    UNION ALL SELECT project_id, project_id || ':models.py:Customer.pay', 'method', 'models.py', 'Customer.pay', 2, 3, '    def pay(self):' || chr(10) || '        return 1' FROM c)
    SELECT project_id, entity_id || '|1' AS id, entity_type, start_line, end_line,
      sha256('model-1' || chr(10) || 'python ' || CASE WHEN entity_type = 'file' THEN 'module code' ELSE entity_type END || ' ' || qualified_name || chr(10) || 'file: ' || file_path || chr(10) || chr(10) || text) AS content_hash FROM u""",
    False,
)
def source_chunks(spark, sf_dir):
    """Chunks of every file, with the hash of what is embedded of them."""
    files = _source_files(spark, sf_dir)
    return C.chunks(files, X.analysed(files)).select("project_id", "id", "entity_type", "start_line", "end_line", C.content_hash("model-1").alias("content_hash"))


# Hybrid retrieval: three fixed lists of hits over the graph.

_HITS = "(1, 'a', 'class:1', 0.9), (1, 'b', 'interface:2', 0.8), (1, 'c', 'class:1', 0.95), (2, 'd', 'file:3', 0.7), (2, 'e', 'function:5', 0.7), (3, 'f', 'method:7', 0.6), (3, 'g', 'nothing', 0.9)"
_SEEDS = f"""h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (VALUES {_HITS}) AS v(query_id, chunk_id, entity_id, score)),
    s AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS seed_rank FROM h GROUP BY 1, 2)"""
_ASKS = ", ".join(
    f"('{kind}', {k}, '{relation}', '{edge}', '{way}', {own or H.MAX_NEIGHBORS})" for kind, asks in H.STRATEGY.items() for k, (relation, edge, way, own) in enumerate(asks)
)
_EXPANDED = f"""{_SEEDS}, q AS (SELECT s.query_id, s.seed_rank, s.entity_id AS seed_id, k AS expansion, relation, a.type, way, n FROM s JOIN nodes ON id = s.entity_id
      JOIN (VALUES {_ASKS}) AS a(kind, k, relation, type, way, n) ON kind = entity_type),
    x AS (SELECT q.*, e.id AS edge_id, t.id AS entity_id, row_number() OVER (PARTITION BY query_id, seed_id, expansion ORDER BY t.file_path, t.start_line, t.id) AS ord
      FROM q JOIN edges e ON e.type = q.type AND seed_id = CASE way WHEN 'out' THEN source_id ELSE target_id END
      JOIN nodes t ON t.id = CASE way WHEN 'out' THEN target_id ELSE source_id END),
    k AS (SELECT query_id, seed_rank, seed_id, expansion, relation, edge_id, entity_id, ord FROM x WHERE ord <= n)"""


def _hits(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_HITS} AS v(query_id, chunk_id, entity_id, score)")


@_query(f"{_EXPANDED} SELECT * FROM k")
def hybrid_expand(spark, sf_dir):
    """Neighbours of the hits' entities, by the questions of their types."""
    return H.expand(H.seeds(_hits(spark)), *graph(spark, sf_dir))


@_query(
    f"""{_EXPANDED}, u AS (SELECT query_id, entity_id, 0 AS a, seed_rank AS b, 0 AS c, 0 AS d FROM s UNION ALL SELECT query_id, entity_id, 1, seed_rank, expansion, ord FROM k),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY a, b, c, d) AS m FROM u)
    SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY a, b, c, d, entity_id) AS position FROM f WHERE m = 1"""
)
def hybrid_context(spark, sf_dir):
    """Entities of each query's context in order."""
    seeds = H.seeds(_hits(spark))
    return H.context_entities(seeds, H.expand(seeds, *graph(spark, sf_dir)))


# Incremental: lines by their part against lines by their supplier.

_CHUNKS = "SELECT l_{k}key || '|' || l_linenumber AS chunk_id, CAST(max(l_quantity) AS INT) AS content_hash, CAST(min(l_quantity) AS INT) AS payload_hash FROM lineitem GROUP BY 1"


@_query(
    f"""WITH p AS ({_CHUNKS.format(k="part")}), c AS ({_CHUNKS.format(k="supp")})
    SELECT coalesce(p.chunk_id, c.chunk_id) AS chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'delete' WHEN p.chunk_id IS NULL OR p.content_hash <> c.content_hash THEN 'embed'
      WHEN p.payload_hash <> c.payload_hash THEN 'update' ELSE 'reuse' END AS action FROM p FULL JOIN c ON p.chunk_id = c.chunk_id""",
    False,
)
def chunk_plan(spark, sf_dir):
    """What to do with each chunk between two versions."""
    lines = _table(spark, sf_dir, "lineitem")
    old, new = (spark.sql(_CHUNKS.format(k=k).replace("FROM lineitem", "FROM {lines}"), lines=lines) for k in ("part", "supp"))
    return I.chunk_plan(old, new)


@_query(
    f"""WITH p AS ({_CHUNKS.format(k="part")}), c AS ({_CHUNKS.format(k="supp")})
    SELECT coalesce(p.chunk_id, c.chunk_id) AS id, CASE WHEN p.chunk_id IS NULL THEN 'insert' WHEN c.chunk_id IS NULL THEN 'delete'
      WHEN p.content_hash <> c.content_hash OR p.payload_hash <> c.payload_hash THEN 'update' ELSE 'keep' END AS action FROM p FULL JOIN c ON p.chunk_id = c.chunk_id""",
    False,
)
def graph_diff(spark, sf_dir):
    """Changes between two versions of a table, by fingerprint."""
    lines = _table(spark, sf_dir, "lineitem")
    old, new = (
        spark.sql(_CHUNKS.format(k=k).replace("FROM lineitem", "FROM {lines}"), lines=lines).select(F.col("chunk_id").alias("id"), X.fingerprint("content_hash", "payload_hash").alias("fingerprint"))
        for k in ("part", "supp")
    )
    return X.diff(old, new, ["id"])
