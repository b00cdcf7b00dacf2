"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from codeweft.plans import registry, services  # noqa: E402, F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(records):
    return sorted(tuple(str(v) for v in r) for r in records)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.SQL[name]})").fetchall()
    assert rows(got.select(*cols).collect()) == rows(want)


def test_first_edges_of_equal_lines_are_those_first_in_the_file(spark, tmp_path):
    """Files of several tasks, the larger ones (which Spark reads first) last by name."""
    sf = str(tmp_path)
    os.mkdir(f"{sf}/lineitem.parquet")
    c = duckdb.connect()
    for i in range(6):
        c.execute(f"""copy (select 1 + k % 50 as l_orderkey, 1::BIGINT as l_suppkey, 1::INT as l_linenumber, 1000 * (6 - {i}) + (k * 7) % 1000 as l_partkey from range({1000 * (i + 1)}) t(k))
            to '{sf}/lineitem.parquet/part-{i}.parquet' (format parquet, row_group_size 2048)""")
    c.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet/*.parquet'")
    got = registry.QUERIES["first_edge_dedup"](spark, sf)
    assert rows(got.collect()) == rows(c.execute(f"select {', '.join(got.columns)} from ({registry.SQL['first_edge_dedup']})").fetchall())


@pytest.mark.parametrize("threshold", [None, 0.2])
def test_top_k_equals_all_scores_in_order(spark, monkeypatch, threshold):
    """Ties, near ties, many blocks, and vectors that are null, short, or of null, NaN and large entries."""
    import numpy as np
    from pyspark.sql import functions as F

    from codeweft.operators import vectors as V

    r = np.random.default_rng(1)
    data = [[float(x) for x in v] for v in r.integers(-2, 3, (300, 6)).astype("f4") / np.float32(3)]
    data += [[float(np.nextafter(np.float32(x), np.float32(1))) for x in v] for v in data[:60]]
    data += [None, [1.0, 0.5], [0.5, None, 0.5, 0.5, 0.5, 0.5], [float("nan")] * 6, [3e38] * 6, []]
    v = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(data)], "vec_id long, label int, embedding array<float>").repartition(3)
    q = v.where("vec_id % 20 = 0 or vec_id >= 360").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for name, value in (("QUERY_ROWS", 7), ("VECTOR_ROWS", 16), ("HELD_BYTES", 2000), ("BLOCK_BYTES", 1500)):
        monkeypatch.setattr(V, name, value)
    got = V.top_k(v, q, 4, threshold)
    assert "MapInArrow" in got._jdf.queryExecution().sparkPlan().toString()
    s = v.crossJoin(q).select("query_id", "vec_id", "label", V.dot(F.col("embedding"), F.col("query")).alias("score"))
    s = s if threshold is None else s.where(F.col("score") >= threshold)
    rank = F.row_number().over(V.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    want = s.withColumn("n", rank).where("n <= 4").select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))
    assert rows(got.collect()) == rows(want.collect())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['codeweft.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
