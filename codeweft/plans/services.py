"""Queries of retrieval, stores, embeddings, facts, contexts and answers over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions import embedding as E
from codeweft.operators import answers as W
from codeweft.operators import facts as K
from codeweft.operators import hybrid as H
from codeweft.operators import retrieval as R
from codeweft.operators import store as S
from codeweft.plans.registry import _EXPANDED, _RELATED, PAIRS, _hits, _on_graph, _query, _table
from codeweft.plans.starschema import graph


@_on_graph(_RELATED.format(here="target_id", there="source_id", id="method:7", types="'CONTAINS'"))
def graph_container(nodes, edges):
    return R.Retrieval(nodes, edges).container("method:7").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="source_id", there="target_id", id="class:13", types="'INHERITS'"))
def graph_parents(nodes, edges):
    return R.Retrieval(nodes, edges).parents("class:13").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="target_id", there="source_id", id="class:4", types="'INHERITS'"))
def graph_subclasses(nodes, edges):
    return R.Retrieval(nodes, edges).subclasses("class:4").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="source_id", there="target_id", id="class:7", types="'IMPLEMENTS'"))
def graph_interfaces(nodes, edges):
    return R.Retrieval(nodes, edges).interfaces("class:7").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="target_id", there="source_id", id="interface:3", types="'IMPLEMENTS'"))
def graph_implementations(nodes, edges):
    return R.Retrieval(nodes, edges).implementations("interface:3").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="target_id", there="source_id", id="file:3", types="'IMPORTS'"))
def graph_importers(nodes, edges):
    return R.Retrieval(nodes, edges).importers("file:3").select("id", "type", "line", "file_path")


@_on_graph(_RELATED.format(here="source_id", there="target_id", id="file:3", types="'IMPORTS'"))
def graph_imports(nodes, edges):
    return R.Retrieval(nodes, edges).imports("file:3").select("id", "type", "line", "file_path")


@_on_graph("""c AS (SELECT 'class:7' AS id, 0 AS place UNION ALL SELECT source_id, 1 FROM edges WHERE type = 'CONTAINS' AND target_id = 'class:7'
    UNION ALL (SELECT n.id, 2 FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = 'class:7' ORDER BY e.type, n.file_path, n.start_line, n.id, e.id LIMIT 50)
    UNION ALL (SELECT n.id, 3 FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = 'class:7' ORDER BY e.type, n.file_path, n.start_line, n.id, e.id LIMIT 50))
    SELECT id, min(place) AS place FROM c GROUP BY 1""")
def graph_entity_context(nodes, edges):
    """The entity, its container, its neighbours: each once."""
    return R.Retrieval(nodes, edges).context("class:7").select("id", "place")


@_on_graph("""f AS (SELECT entity_type, start_line, id, file_path FROM nodes),
    r(id, depth) AS (SELECT 'file:3', 0 UNION SELECT e.target_id, r.depth + 1 FROM r JOIN edges e ON e.source_id = r.id WHERE r.depth < 2 AND e.type = 'DEPENDS_ON'),
    m AS (SELECT id, min(depth)::INT AS depth FROM r WHERE id <> 'file:3' GROUP BY id)
    SELECT id, depth, (SELECT count(*) > 50 FROM m) AS truncated FROM m JOIN f USING (id) ORDER BY depth, file_path, start_line, id LIMIT 50""")
def graph_dependencies_d2(nodes, edges):
    return R.Retrieval(nodes, edges).dependencies("file:3", 2).select("id", "depth", "truncated")


@_on_graph("""q AS (SELECT source_id AS id FROM edges WHERE target_id = 'interface:2' UNION SELECT target_id FROM edges WHERE source_id = 'interface:2' UNION SELECT 'interface:2') SELECT id, entity_type FROM nodes JOIN q USING (id)""")
def client_neighborhood(nodes, edges):
    return R.closed_neighborhood(nodes, edges, "interface:2")[0].select("id", "entity_type")


@_on_graph("q AS (SELECT type, count(*) AS n FROM edges WHERE type NOT IN ('CALLS', 'USES') GROUP BY 1) SELECT * FROM q")
def client_hidden_types(nodes, edges):
    return R.without_types(edges, ["CALLS", "USES"]).groupBy("type").agg(F.count("*").alias("n"))


@_on_graph("q AS (SELECT language, count(*) AS n FROM nodes WHERE entity_type = 'file' GROUP BY 1) SELECT * FROM q ORDER BY n DESC, language")
def client_languages(nodes, edges):
    return R.languages(nodes)


@_on_graph("""g AS (SELECT id FROM nodes WHERE entity_type = 'class' AND start_line % 5 = 0)
    SELECT type, count(*) AS n FROM edges WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g) GROUP BY 1""")
def graph_delete_nodes(nodes, edges):
    """Edges left after a fifth of the classes has gone."""
    return R.delete_nodes(nodes, edges, nodes.where("entity_type = 'class' and start_line % 5 = 0"))[1].groupBy("type").agg(F.count("*").alias("n"))


@_on_graph("q AS (SELECT type, count(*) AS n FROM edges WHERE NOT (type = 'USES' AND line = 1) GROUP BY 1) SELECT * FROM q")
def graph_delete_edges(nodes, edges):
    return R.delete_edges(edges, edges.where("type = 'USES' and line = 1")).groupBy("type").agg(F.count("*").alias("n"))


@_on_graph(f"""{PAIRS} SELECT source_path, target_path, types, (SELECT count(*) > 40 FROM p) AS truncated FROM p ORDER BY 1, 2 LIMIT 40""")
def deps_report(nodes, edges):
    """The first forty pairs, and whether there are more."""
    pairs, more = K.dependency_report(nodes, edges, 40)
    return pairs.withColumn("truncated", F.lit(more))


def _plural(n: str, noun: str) -> str:
    return f"({n})::VARCHAR || CASE WHEN ({n}) = 1 THEN ' {noun}' ELSE ' {noun}s' END"


def _listed(ord_: int, lead: str, rows: str, order: str, item: str) -> str:
    """A fact that lists items of a query: see facts.listing."""
    return f"""SELECT {ord_} AS ord, '{lead}' || CASE WHEN n > 8 THEN array_to_string(l[1:8], ', ') || ' and ' || (n - 8) || ' more' WHEN n = 1 THEN l[1] ELSE array_to_string(l[1:n - 1], ', ') || ' and ' || l[n] END || '.' AS fact
        FROM (SELECT count(*) AS n, list({item} ORDER BY {order}) AS l FROM ({rows})) WHERE n > 0"""


_FACTS = " UNION ALL ".join([
    f"SELECT 1 AS ord, 'The project has ' || {_plural('f', 'file')} || ' and ' || {_plural('n - f', 'definition')} || '.' AS fact FROM (SELECT count(*) AS n, count(*) FILTER (entity_type = 'file') AS f FROM nodes)",
    "SELECT 2, 'The project is larger than what was read, so counts are lower bounds.'",
    _listed(3, "Files by directory: ", "SELECT split_part(file_path, '/', 1) AS module, count(*) AS files FROM nodes WHERE entity_type = 'file' GROUP BY 1", "files DESC, module", "module || ' (' || " + _plural("files", "file") + " || ')'"),
    _listed(4, "Directories that depend on others: ", "SELECT split_part(source_path, '/', 1) AS s, split_part(target_path, '/', 1) AS t, count(*) AS k FROM p WHERE split_part(source_path, '/', 1) <> split_part(target_path, '/', 1) GROUP BY 1, 2", "k DESC, s, t", "s || ' on ' || t"),
    "SELECT 5, 'There are ' || count(*) || ' dependencies between files.' FROM p",
    _listed(6, "Files that most others depend on: ", "SELECT target_path AS f, count(*) AS k FROM p GROUP BY 1 ORDER BY k DESC, f LIMIT 8", "k DESC, f", "f || ' (' || " + _plural("k", "dependent") + " || ')'"),
    _listed(7, "Most referenced definitions: ", "SELECT n.id, n.qualified_name AS q, k FROM (SELECT target_id, count(DISTINCT source_id) AS k FROM edges WHERE type IN ('CALLS', 'IMPLEMENTS', 'INHERITS', 'USES') GROUP BY 1) JOIN nodes n ON n.id = target_id WHERE n.entity_type <> 'file' ORDER BY k DESC, n.file_path, n.start_line, n.id LIMIT 8", "k DESC, id", "q || ' (' || " + _plural("k", "referrer") + " || ')'"),
    _listed(8, "Possible entry points: ", "SELECT DISTINCT source_path AS f FROM p WHERE source_path NOT IN (SELECT target_path FROM p)", "f", "f"),
    _listed(9, "Largest types: ", "SELECT c.id, c.qualified_name AS q, count(*) AS k FROM edges e JOIN nodes m ON m.id = e.target_id AND m.entity_type = 'method' JOIN nodes c ON c.id = e.source_id WHERE e.type = 'CONTAINS' GROUP BY 1, 2, c.file_path, c.start_line ORDER BY k DESC, c.file_path, c.start_line, c.id LIMIT 8", "k DESC, id", "q || ' (' || " + _plural("k", "method") + " || ')'"),
    _listed(10, "Relationships: ", "SELECT type, count(*) AS k FROM edges GROUP BY 1", "k DESC, type", "k || ' ' || type"),
])


@_on_graph(f"{PAIRS}, f AS ({_FACTS}) SELECT row_number() OVER (ORDER BY ord) AS number, fact FROM f")
def facts_numbered(nodes, edges):
    """All facts but that on cycles, which deps_cycles checks, of a project that was cut off."""
    none = nodes.sparkSession.createDataFrame([], "length int, cycle string")
    return K.facts(nodes, edges, truncated=True, cycles=none).where("not contains(fact, 'depends on itself')")


# Embeddings and the store

_CODE = "('0x' || substr(md5(w), 1, 7))::INT"
_HASHED = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents),
    v AS (SELECT doc_id, ({_CODE} >> 1) % 64 AS i, sum(CASE WHEN {_CODE} & 1 = 0 THEN 1 ELSE -1 END) AS x FROM w GROUP BY 1, 2)"""


@_query(f"WITH {_HASHED}, n AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1) SELECT doc_id, i::INT AS dimension, round(x / l, 6) AS value FROM v JOIN n USING (doc_id) WHERE l > 0 AND x <> 0", False)
def embed_documents(spark, sf_dir):
    """Every whole text through the built-in provider; its numbers that are not 0."""
    rows = E.embedded(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", E.provider("hashed-words-64"))
    return rows.select("doc_id", F.posexplode("embedding").alias("dimension", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_STORE = "SELECT 'e' || vec_id AS chunk_id, 'model-1' AS embedding_model, 'p' || (vec_id % 3) AS project_id, label::VARCHAR AS entity_type, embedding FROM embeddings"


def _points(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return v.selectExpr("concat('e', vec_id) AS chunk_id", "'model-1' AS embedding_model", "concat('p', vec_id % 3) AS project_id", "cast(label AS string) AS entity_type", "cast(embedding AS array<double>) AS embedding", "vec_id")


@_query(f"""WITH o AS ({_STORE} WHERE vec_id % 4 <> 0), n AS (SELECT * REPLACE ('new' AS entity_type) FROM ({_STORE} WHERE vec_id % 2 = 0)), u AS (SELECT * FROM o ANTI JOIN n USING (embedding_model, chunk_id) UNION ALL SELECT * FROM n)
    SELECT project_id, entity_type, count(*) AS points, round(sum(embedding[1]::DOUBLE), 4) AS first_sum FROM u GROUP BY 1, 2""", False)
def store_upsert(spark, sf_dir):
    """Half of the points written over three quarters of them."""
    p = _points(spark, sf_dir)
    new = p.where("vec_id % 2 = 0").withColumn("entity_type", F.lit("new")).drop("vec_id")
    width = p.select(F.size("embedding").alias("n")).first()["n"]
    out = S.upsert(p.where("vec_id % 4 <> 0").drop("vec_id"), new, width)
    return out.groupBy("project_id", "entity_type").agg(F.count("*").alias("points"), F.round(F.sum(F.col("embedding")[0]), 4).alias("first_sum"))


@_query(f"SELECT chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'moved' ELSE label::VARCHAR END AS entity_type, round(embedding[1]::DOUBLE, 6) AS first FROM (SELECT 'e' || vec_id AS chunk_id, * FROM embeddings)", False)
def store_refresh(spark, sf_dir):
    """A new payload for a fifth of the points; vectors stay."""
    p = _points(spark, sf_dir)
    now = p.where("vec_id % 5 = 0").select("chunk_id", "embedding_model", "project_id", F.lit("moved").alias("entity_type"))
    return S.refresh(p.drop("vec_id"), now).select("chunk_id", "entity_type", F.round(F.col("embedding")[0], 6).alias("first"))


@_query("SELECT 'p' || (vec_id % 3) AS project_id, 'model-1' AS embedding_model, count(*) AS points FROM embeddings WHERE vec_id % 3 <> 1 OR vec_id % 7 = 0 GROUP BY 1", False)
def store_delete_stale(spark, sf_dir):
    """One project keeps a seventh of its chunks; the others keep theirs."""
    p = _points(spark, sf_dir)
    return S.count(S.delete_stale(p, p.where("vec_id % 7 = 0"), "p1"))


@_query("SELECT entity_type, count(*) AS chunks FROM (SELECT label::VARCHAR AS entity_type, vec_id FROM embeddings) WHERE entity_type IN ('1', '2', '3') AND vec_id % 3 = 2 AND entity_type NOT IN ('2') GROUP BY 1", False)
def store_filter(spark, sf_dir):
    p = _points(spark, sf_dir)
    return S.chunk_types(p.where(S.matching({"project_id": "p2"}, {"entity_type": ["1", "2", "3"]}, {"entity_type": ["2"]})))


# Contexts and answers


@_query(f"""{_EXPANDED}, e0 AS (SELECT s.*, (SELECT count(*) FROM nodes WHERE id = s.entity_id) AS here FROM s)
    SELECT query_id, CASE WHEN count(*) FILTER (here = 0) = 0 THEN 'complete' WHEN count(*) FILTER (here = 1) > 0 THEN 'partial' ELSE 'unavailable' END AS status, count(*) AS seeds, count(*) FILTER (here = 0) AS missing,
      (SELECT count(*) FROM k WHERE k.query_id = e0.query_id) AS expanded FROM e0 GROUP BY query_id""")
def hybrid_status(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    seeds = H.seeds(_hits(spark))
    return H.status(seeds, nodes, H.expand(seeds, nodes, edges))


@_query(f"""{_EXPANDED}, n1 AS (SELECT s.* FROM s WHERE seed_rank <= 3 AND entity_id IN (SELECT id FROM nodes)), pr AS (SELECT x.query_id, x.entity_id AS a, y.entity_id AS b FROM n1 x JOIN n1 y ON x.query_id = y.query_id AND x.seed_rank < y.seed_rank),
    g(query_id, a, b, way, goal, id, steps, edge_ids, path, n) AS (SELECT query_id, a, b, 0, b, a, [a], []::VARCHAR[], [a], 0 FROM pr UNION ALL SELECT query_id, a, b, 1, a, b, [b], []::VARCHAR[], [b], 0 FROM pr
      UNION ALL SELECT query_id, a, b, way, goal, e.target_id, list_concat(steps, [e.target_id, e.id]), list_append(edge_ids, e.id), list_append(path, e.target_id), n + 1
        FROM g JOIN edges e ON e.source_id = g.id WHERE n < 3 AND g.id <> goal AND NOT list_contains(path, e.target_id)),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id, a, b ORDER BY way, n, steps) AS rn FROM g WHERE g.id = goal)
    SELECT query_id, a, b, array_to_string(path, ' > ') AS path, array_to_string(edge_ids, ' > ') AS edge_ids FROM z WHERE rn = 1 AND (n > 1 OR edge_ids[1] NOT IN (SELECT edge_id FROM k WHERE k.query_id = z.query_id))""")
def hybrid_paths(spark, sf_dir):
    """One shortest path between each two seeds, forward before back."""
    nodes, edges = graph(spark, sf_dir)
    seeds = H.seeds(_hits(spark))
    found = H.connect(seeds, nodes, edges, H.expand(seeds, nodes, edges))
    return found.select("query_id", "a", "b", F.array_join("path", " > ").alias("path"), F.array_join("edge_ids", " > ").alias("edge_ids"))


@_query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace('see [1, 2] and [9], [0] ', '[1, 2]', '<1, 2>') ELSE 'see <3> and [x] ' END || text AS linked FROM conversations WHERE NOT contains(coalesce(text, '['), '[')""", False)
def cite_links(spark, sf_dir):
    """Brackets all of whose numbers are known become links. Texts with brackets of their own are left to tests."""
    c = _table(spark, sf_dir, "conversations").where("not contains(coalesce(text, '['), '[')")
    made = F.concat(F.when(F.col("turn") % 2 == 0, "see [1, 2] and [9], [0] ").otherwise("see [3] and [x] "), "text")
    return c.select("conv_id", "turn", W.linked(made, 5).alias("linked"))


@_on_graph("""q AS (SELECT 'file:' || n_nationkey || '::x' AS item FROM nation UNION ALL SELECT file_path || '::' || qualified_name FROM nodes WHERE entity_type = 'class') SELECT item FROM q WHERE item LIKE 'file:%'""")
def eval_missing_labels(nodes, edges):
    """Expected items that the graph lacks."""
    files = nodes.where("entity_type = 'file'").select(F.concat("id", F.lit("::x")).alias("item"))
    return W.missing_labels(files.union(nodes.where("entity_type = 'class'").select(F.concat_ws("::", "file_path", "qualified_name"))), nodes)


@_query("""SELECT conv_id || ':' || turn AS answer_id, CASE WHEN turn % 3 = 0 THEN '2' ELSE '' END AS cited, CASE WHEN turn % 3 = 1 THEN '7' ELSE '' END AS unknown,
    CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'unknown sources: 7' ELSE 'the context was not enough' END AS warnings FROM conversations""", False)
def answer_warnings(spark, sf_dir):
    """Answers that cite a known source, an unknown one, or say that they can't answer."""
    c = _table(spark, sf_dir, "conversations").selectExpr("conv_id || ':' || turn AS answer_id", f"case turn % 3 when 0 then 'so it is [2]' when 1 then 'see [7]' else '{W.INSUFFICIENT}' end AS answer")
    return W.assembled(c, "answer_id", "answer", 5).select("answer_id", "cited", "unknown", F.array_join("warnings", "; ").alias("warnings"))


# Java, JavaScript and TypeScript: each customer's name makes a class of each language.

_TEXTS = {
    "java": "package shop;\n\npublic class C{k} extends Base implements Pays {{\n  C{k}() {{}}\n  int pay(int n) {{ return n; }}\n}}\nclass Base {{}}\ninterface Pays {{ int pay(int n); }}\n",
    "javascript": "class Base {{ }}\nexport class C{k} extends Base {{\n  pay(n) {{ return n; }}\n}}\nconst settle = (n) => n;\n",
    "typescript": "interface Pays {{ pay(n: number): number; }}\nexport class C{k} implements Pays {{\n  pay(n: number): number {{ return n; }}\n}}\n",
}
_OWN = {
    "java": [("class", "C{k}", 3, 6), ("method", "C{k}.C{k}", 4, 4), ("method", "C{k}.pay", 5, 5), ("class", "Base", 7, 7), ("interface", "Pays", 8, 8), ("method", "Pays.pay", 8, 8)],
    "javascript": [("class", "Base", 1, 1), ("class", "C{k}", 2, 4), ("method", "C{k}.pay", 3, 3), ("function", "settle", 5, 5)],
    "typescript": [("interface", "Pays", 1, 1), ("method", "Pays.pay", 1, 1), ("class", "C{k}", 2, 4), ("method", "C{k}.pay", 3, 3)],
}


def _brace_files(spark, sf_dir):
    made = None
    for language, text in _TEXTS.items():
        name = F.concat(F.lit("c"), "c_custkey", F.lit({"java": ".java", "javascript": ".js", "typescript": ".ts"}[language]))
        source = F.replace(F.lit(text.replace("{{", "{").replace("}}", "}")), F.lit("{k}"), F.col("c_custkey").cast("string"))
        part = _table(spark, sf_dir, "customer").select(F.lit("p").alias("project_id"), name.alias("path"), F.lit(language).alias("language"), F.encode(source, "utf-8").alias("content"))
        made = part if made is None else made.unionByName(part)
    return made.withColumn("scan_ord", F.lit(0)).withColumn("sha256", F.sha2("content", 256))


_BRACES = " UNION ALL ".join(
    f"SELECT '{language}' AS language, '{kind}' AS entity_type, replace('{name}', '{{k}}', c_custkey::VARCHAR) AS qualified_name, {a} AS start_line, {b} AS end_line, 'p:c' || c_custkey || '{end}' AS file_id FROM customer"
    for (language, own), end in zip(_OWN.items(), (".java", ".js", ".ts"))
    for kind, name, a, b in own
)


@_query(f"SELECT language, entity_type, qualified_name, start_line, end_line, file_id || ':' || qualified_name AS id FROM ({_BRACES})", False)
def source_entities_braces(spark, sf_dir):
    """Definitions in Java, JavaScript and TypeScript files."""
    from codeweft.operators import extract as X

    found = X.table(X.analysed(_brace_files(spark, sf_dir)), "entities").where("entity_type <> 'file'")
    return found.select("language", "entity_type", "qualified_name", "start_line", "end_line", "id")
