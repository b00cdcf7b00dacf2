"""A property graph over the test tables: nations are files, customers classes, suppliers interfaces,
orders methods and parts functions; lines of orders are the evidence of calls, uses and imports; keys that of heritage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
SELECT 'file:' || n_nationkey AS id, 'file' AS entity_type, n_name AS name, r_name || '/' || n_name AS qualified_name, r_name || '/' || n_name AS file_path,
  CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'java' ELSE 'typescript' END AS language, 1 AS start_line, CAST(NULL AS STRING) AS parent_id
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'class:' || c_custkey, 'class', c_name, c_name, r_name || '/' || n_name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'java' ELSE 'typescript' END, CAST(c_custkey AS INT), 'file:' || n_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'interface:' || s_suppkey, 'interface', s_name, s_name, r_name || '/' || n_name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'java' ELSE 'typescript' END, CAST(s_suppkey AS INT), 'file:' || n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'function:' || p_partkey, 'function', p_name, p_name, r_name || '/' || n_name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'java' ELSE 'typescript' END, CAST(p_partkey AS INT), 'file:' || n_nationkey
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'method:' || o_orderkey, 'method', 'order' || o_orderkey, c_name || '.order' || o_orderkey, r_name || '/' || n_name,
  CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'java' ELSE 'typescript' END, CAST(o_orderkey AS INT), 'class:' || c_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: Files that depend on each other: customers' nation to suppliers' nation, by a sparse choice of lines.
_FILES = """SELECT '{type}' AS type, 'file:' || c_nationkey AS source_id, 'file:' || s_nationkey AS target_id, CAST(MIN(l_linenumber) AS INT) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity = 50 AND l_discount = 0.1 {more} AND c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey"""

EDGES = f"""
SELECT type || ':' || source_id || '->' || target_id AS id, type, source_id, target_id, line FROM (
SELECT 'CONTAINS' AS type, parent_id AS source_id, id AS target_id, CAST(NULL AS INT) AS line FROM nodes WHERE parent_id IS NOT NULL
UNION ALL SELECT 'CALLS', 'method:' || l_orderkey, 'interface:' || l_suppkey, CAST(MIN(l_linenumber) AS INT) FROM lineitem GROUP BY l_orderkey, l_suppkey
UNION ALL SELECT 'USES', 'method:' || l_orderkey, 'function:' || l_partkey, CAST(MIN(l_linenumber) AS INT) FROM lineitem WHERE l_quantity >= 40 GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'INHERITS', 'class:' || c_custkey, 'class:' || CAST(floor(c_custkey / 3.0) AS INT), 1 FROM customer WHERE c_custkey >= 3 AND c_custkey % 3 = 1
UNION ALL SELECT 'IMPLEMENTS', 'class:' || c_custkey, 'interface:' || s_suppkey, 2 FROM customer JOIN supplier ON c_custkey % 40 = s_suppkey
UNION ALL {_FILES.format(type="IMPORTS", more="")}
UNION ALL {_FILES.format(type="DEPENDS_ON", more="AND l_tax >= 0.06")}
)"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    body = NODES
    args = {f"{t}_t": df for t, df in tables.items()}
    for t in TABLES:
        body = body.replace(f"FROM {t} ", f"FROM {{{t}_t}} {t} ").replace(f"JOIN {t} ", f"JOIN {{{t}_t}} {t} ")
    nodes = spark.sql(body, **{k: v for k, v in args.items() if f"{{{k}}}" in body})
    edges = EDGES.replace("FROM nodes ", "FROM {nodes} ")
    for t in TABLES:
        edges = edges.replace(f"FROM {t} ", f"FROM {{{t}_t}} {t} ").replace(f"JOIN {t} ", f"JOIN {{{t}_t}} {t} ")
    return nodes, spark.sql(edges, nodes=nodes, **{k: v for k, v in args.items() if f"{{{k}}}" in edges})


def oracle(query: str) -> str:
    """query over nodes and edges, as DuckDB SQL over the tables."""
    return f"WITH RECURSIVE nodes AS ({NODES.replace('AS STRING', 'AS VARCHAR')}), edges AS ({EDGES}), {query.strip()}"
