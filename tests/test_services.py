"""Retrieval, the vector store, embeddings, answers: errors, nulls, empty tables and ties."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import embedding as E
from codeweft.operators import answers as W
from codeweft.operators import graph as G
from codeweft.operators import hybrid as H
from codeweft.operators import retrieval as R
from codeweft.operators import store as S

P = "0" * 32
NODE = "project_id string, id string, entity_type string, name string, qualified_name string, file_path string, start_line int"
EDGE = "project_id string, id string, type string, source_id string, target_id string, line int"


@pytest.fixture(scope="module")
def tables(spark):
    nodes = [(P, f"{P}:{n}", t, n, n, "a.py", k) for k, (n, t) in enumerate([("f", "file"), ("A", "class"), ("B", "class"), ("A.m", "method")])]
    arcs = [("CONTAINS", "f", "A"), ("CONTAINS", "f", "B"), ("CONTAINS", "A", "A.m"), ("INHERITS", "B", "A"), ("CALLS", "A.m", "B"), ("USES", "A.m", "B")]
    edges = [(P, f"{t}:{a}->{b}", t, f"{P}:{a}", f"{P}:{b}", 1) for t, a, b in arcs]
    other = ("1" * 32, "1" * 32 + ":f", "file", "f", "f", "f", 1)
    return spark.createDataFrame([*nodes, other], NODE), spark.createDataFrame(edges, EDGE)


def test_questions(tables):
    r = R.Retrieval(*tables, P)
    assert [x["id"] for x in r.subclasses(f"{P}:A").collect()] == [f"{P}:B"]
    assert r.container(f"{P}:A.m").first()["id"] == f"{P}:A"
    assert r.parents(f"{P}:f").count() == 0  # there, but without parents
    assert r.related(f"{P}:f", ["CONTAINS"], "outgoing", 1).first()["truncated"]
    assert [(x["id"].split(":")[1], x["place"]) for x in r.context(f"{P}:A").collect()] == [("A", 0), ("f", 1), ("A.m", 2), ("B", 3)]
    nodes, edges, more = r.project_graph(3)
    assert nodes.count() == 3 and more and edges.count() == 3
    with pytest.raises(R.NotFound):
        r.callers(f"{P}:nothing")
    for wrong in (lambda: r.callers("x:A"), lambda: r.callers(f"{P}:A", 0), lambda: r.callers(f"{P}:A", True), lambda: R.Retrieval(*tables, "p"), lambda: r.related(f"{P}:A", ["KNOWS"], "outgoing")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(R.NotFound):
        R.Retrieval(*tables, "2" * 32).project_graph()


def test_paths_take_each_parallel_edge(tables):
    found = G.shortest_paths(tables[1], f"{P}:A.m", f"{P}:B", 3, 5).collect()
    assert [p["edge_ids"] for p in found] == [["CALLS:A.m->B"], ["USES:A.m->B"]]
    assert len(G.shortest_paths(tables[1], f"{P}:A.m", f"{P}:B", 3, 1).collect()) == 1


def test_deletes(tables):
    nodes, edges = R.delete_nodes(*tables, tables[0].where("name = 'B'"), P)
    assert nodes.count() == 4 and {e["type"] for e in edges.collect()} == {"CONTAINS"}
    assert [t.count() for t in R.delete_project(list(tables), P)] == [1, 0]


def test_seeds_are_connected_once(spark, tables):
    seeds = spark.createDataFrame([(1, f"{P}:A.m", 1, ["a"]), (1, f"{P}:f", 2, ["b"]), (1, "gone", 3, ["c"])], "query_id int, entity_id string, seed_rank int, chunk_ids array<string>")
    none = spark.createDataFrame([], "query_id int, edge_id string")
    # no way from A.m to f, so the way back is taken
    assert H.connect(seeds, *tables, none).first()["edge_ids"] == ["CONTAINS:f->A", "CONTAINS:A->A.m"]
    assert H.status(seeds, tables[0], none).first()["status"] == "partial"
    with pytest.raises(ValueError):
        H.checked_settings(max_seeds=21)


def brute(text, d):
    import hashlib
    import re

    v = [0.0] * d
    for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        h = int(hashlib.md5(w.encode()).hexdigest()[:7], 16)
        v[(h >> 1) % d] += 1 if h % 2 == 0 else -1
    n = sum(x * x for x in v) ** 0.5
    return [x / n if n else 0.0 for x in v]


def test_embeddings(spark):
    texts = [None, "", "one two two", "a b c d " * 500, "ä ß é"]
    rows = E.embedded(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", E.HashedWords(8)).orderBy("i").collect()
    for r, t in zip(rows, texts):
        assert r["embedding"] == pytest.approx(brute(t, 8))
    with pytest.raises(ValueError):
        E.provider("none")


def test_store(spark):
    point = "chunk_id string, embedding_model string, project_id string, entity_type string, embedding array<double>"
    old = spark.createDataFrame([("a", "m", P, "class", [1.0]), ("b", "m", P, None, [0.5]), ("c", "m", None, "file", [0.1])], point)
    with pytest.raises(Exception, match="finite numbers"):
        S.upsert(old, spark.createDataFrame([("a", "m", P, "x", [1.0, 2.0])], point), 1).collect()
    now = spark.createDataFrame([("b", "m", P, "method")], "chunk_id string, embedding_model string, project_id string, entity_type string")
    assert {(r["chunk_id"], r["entity_type"]) for r in S.refresh(old, now).collect()} == {("a", "class"), ("b", "method"), ("c", "file")}
    assert {r["chunk_id"] for r in S.delete_stale(old, now, P).collect()} == {"b", "c"}
    assert {r["chunk_id"] for r in S.delete_project(old, P).collect()} == {"c"}
    assert {r["chunk_id"] for r in old.where(S.matching(none_of={"entity_type": ["file"]})).collect()} == {"a", "b"}
    assert old.where(S.matching(any_of={"entity_type": []})).count() == 0
    for text, k in ((" ", 1), ("x" * 2001, 1), ("x", 51), ("x", True)):
        with pytest.raises(ValueError):
            S.checked_search(text, k)


def test_answers(spark):
    text = spark.createDataFrame([("[1] [2, 9] [x] a[3][4", "q"), (None, "n"), ("[99999999999]", "big")], "t string, k string")
    assert [r[0] for r in text.select(W.linked(F.col("t"), 5)).collect()] == ["<1> [2, 9] [x] a<3>[4", "", "[99999999999]"]
    out = W.assembled(text.where("k = 'n'"), "k", "t", 5).first()
    assert (out["cited"], out["unknown"], out["warnings"]) == ("", "", [])
    facts = spark.createDataFrame([(1, "It has 2 files."), (2, "b uses a.")], "number int, fact string")
    told = W.summarised(facts, W.provider("extractive")).first()
    assert told["cited"] == "1,2" and told["unknown"] == "" and not told["warnings"]
    assert W.summarised(facts.limit(0), W.provider("extractive")).count() == 0
