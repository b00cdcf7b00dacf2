"""Scanning, extraction and resolution on a small shop service."""

import zipfile

import pytest

from codeweft.operators import extract as X
from codeweft.sources import tree

SHOP = {
    "shop/__init__.py": "from .models import Item\n",
    "shop/models.py": "class Base:\n    def save(self):\n        return 1\n\n\nclass Item(Base):\n    def price(self):\n        self.save()\n        return helper()\n\n\ndef helper():\n    return 2\n",
    "shop/_internal.py": "import os\nfrom shop import Item\nfrom . import models as m\n\n\ndef make(it: Item) -> 'Item':\n    it.price()\n    m.helper()\n    os.getcwd()\n    x = Item()\n    return x.save()\n",
    "shop/empty.py": "",
    "broken.py": "def f(:\n",
    "web/app.min.js": "x",
    "web/app.js": "let x = 1",
    "node_modules/a.py": "x = 1",
    "data.py": b"a\0b",
    "README.md": "text",
}


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in SHOP.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


@pytest.fixture(scope="module")
def analysed(spark, shop):
    return X.analysed(tree.files(tree.scan(spark, str(shop), "p"))).cache()


@pytest.fixture(scope="module")
def resolved(analysed):
    from codeweft.sources.tables import written

    return written(X.resolved(analysed), "resolved")


def test_scan_keeps_package_files_and_order(spark, shop):
    got = tree.scan(spark, str(shop), "p").orderBy("scan_ord").collect()
    assert [r.path for r in got if r.admitted] == ["broken.py", "shop/__init__.py", "shop/_internal.py", "shop/empty.py", "shop/models.py", "web/app.js"]
    assert not any(r.path.startswith("node_modules") for r in got)
    assert all(r.content is None for r in got if not r.admitted)


def test_zip_gives_the_same_files(spark, shop, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for path, text in SHOP.items():
            z.writestr(f"top/{path}", text)
    kept = ["path", "size_bytes", "scan_ord", "admitted", "content"]
    a, b = (tree.scan(spark, str(p), "p").select(*kept).collect() for p in (shop, tmp_path / "a.zip"))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_zip_root_beside_a_folder_that_is_not_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("app/a.py", "x = 1")
        z.writestr("node_modules/b.py", "x = 1")
    assert [r.path for r in tree.scan(spark, str(tmp_path / "b.zip"), "p").collect()] == ["app/a.py"]


@pytest.mark.parametrize("name", ["../x.py", "/x.py", "c:\\x.py", "a/../../x.py", "", "./"])
def test_unsafe_members(name):
    with pytest.raises(tree.UnsafePath):
        tree.member_path(name)


def test_entities(analysed):
    got = {r.id: (r.entity_type, r.parent_id, r.start_line, r.end_line) for r in X.table(analysed, "entities").where("file_path = 'shop/models.py'").collect()}
    f = "p:shop/models.py"
    assert got == {
        f: ("file", None, 1, 13), f"{f}:Base": ("class", f, 1, 3), f"{f}:Base.save": ("method", f"{f}:Base", 2, 3), f"{f}:Item": ("class", f, 6, 9),
        f"{f}:Item.price": ("method", f"{f}:Item", 7, 9), f"{f}:helper": ("function", f, 12, 13),
    }
    assert {r.path: r.reason.split(":")[0] for r in X.parse_failures(analysed).collect()} == {"broken.py": "SyntaxError"}


def test_edges(analysed, resolved):
    got = {(r.type, r.source_id.removeprefix("p:"), r.target_id.removeprefix("p:")) for r in X.edges(analysed, resolved).collect() if r.type != "CONTAINS"}
    m, i = "shop/models.py", "shop/_internal.py"
    assert got == {
        ("IMPORTS", "shop/__init__.py", m), ("IMPORTS", i, "shop/__init__.py"), ("IMPORTS", i, m), ("INHERITS", f"{m}:Item", f"{m}:Base"),
        ("CALLS", f"{m}:Item.price", f"{m}:Base.save"), ("CALLS", f"{m}:Item.price", f"{m}:helper"), ("USES", f"{i}:make", f"{m}:Item"),
        ("CALLS", f"{i}:make", f"{m}:Item.price"), ("CALLS", f"{i}:make", f"{m}:helper"), ("CALLS", f"{i}:make", f"{m}:Item"),
        ("CALLS", f"{i}:make", f"{m}:Base.save"), ("DEPENDS_ON", i, m),
    }


def test_unresolved(resolved):
    got = {(r.type, r.target_name, r.reason) for r in X.unresolved(resolved).collect()}
    assert got == {("IMPORTS", "os", "external"), ("CALLS", "os.getcwd", "external")}
    assert {r.type: r.n for r in X.relationship_counts(resolved).collect()} == {"IMPORTS": 3, "INHERITS": 1, "CALLS": 6, "USES": 1}
    assert {r.reason: r.n for r in X.unresolved_counts(resolved).collect()} == {"external": 2}


def test_rules_of_resolution(spark):
    """Conflicting types, multiple inheritance, own type, super, re-exports, wildcards, roots, self edges, reasons."""
    texts = {
        "a.py": "class A:\n    def f(self):\n        pass\n\n\nclass B:\n    def f(self):\n        pass\n\n    def only(self):\n        pass\n\n\nclass C(A, B):\n    def g(self, other: 'C'):\n        self.f()\n        super().only()\n        super().gone()\n        self.gone()\n\n\ndef g():\n    x = A()\n    x = B()\n    x.f()\n    g()\n    self.f()\n    g.more()\n",
        "pkg/__init__.py": "from .inner import Thing as Public\nfrom .wild import *\n", "pkg/inner.py": "class Thing:\n    part: 'Part'\n\n\nclass Part:\n    def turn(self):\n        pass\n", "pkg/wild.py": "def starred():\n    pass\n",
        "use.py": "import pkg\nimport pkg.inner\nfrom pkg import Public, starred, missing\nimport nowhere.deep\n\n\ndef run():\n    t = Public()\n    t.part.turn()\n    starred()\n    pkg.inner.Part()\n    pkg.Public()\n    missing()\n    nowhere.deep.f()\n    t.part.none()\n    undefined()\n    undefined.f()\n",
        "one/m.py": "def f():\n    pass\n", "one/app.py": "import m\nm.f()\n", "x/deep/m.py": "", "x/m.py": "", "x/deep/app.py": "import m\n", "cycle.py": "from cycle import y as z, z as y\ny()\n", "Own.py": "class Own(Own):\n    pass\n",
    }
    rows = [("p", p, "python", k, "", bytearray(t.encode())) for k, (p, t) in enumerate(texts.items())]
    found = X.resolved(X.analysed(spark.createDataFrame(rows, "project_id string, path string, language string, scan_ord int, sha256 string, content binary"))).collect()
    edges = {(r.type, r.source_id[2:], r.target_id[2:]) for r in found if r.reason is None}
    assert edges == {
        ("INHERITS", "a.py:C", "a.py:A"), ("INHERITS", "a.py:C", "a.py:B"), ("CALLS", "a.py:C.g", "a.py:A.f"), ("CALLS", "a.py:C.g", "a.py:B.only"), ("USES", "a.py:C.g", "a.py:C"),
        ("CALLS", "a.py:g", "a.py:A"), ("CALLS", "a.py:g", "a.py:B"), ("CALLS", "a.py:g", "a.py:g"),
        ("IMPORTS", "pkg/__init__.py", "pkg/inner.py"), ("IMPORTS", "pkg/__init__.py", "pkg/wild.py"), ("IMPORTS", "use.py", "pkg/__init__.py"), ("IMPORTS", "use.py", "pkg/inner.py"),
        ("CALLS", "use.py:run", "pkg/inner.py:Thing"), ("CALLS", "use.py:run", "pkg/inner.py:Part.turn"), ("CALLS", "use.py:run", "pkg/wild.py:starred"), ("CALLS", "use.py:run", "pkg/inner.py:Part"),
        ("IMPORTS", "one/app.py", "one/m.py"), ("CALLS", "one/app.py", "one/m.py:f"), ("USES", "pkg/inner.py:Thing", "pkg/inner.py:Part"),
    }
    assert {(r.type, r.source_id[2:], r.target_id, r.reason) for r in found if r.reason} == {
        ("CALLS", "a.py:C.g", "<super>.gone", "not_found"), ("CALLS", "a.py:C.g", "<self>.gone", "not_found"), ("CALLS", "a.py:g", "x.f", "unknown_receiver"), ("CALLS", "a.py:g", "<self>.f", "not_found"), ("CALLS", "a.py:g", "g.more", "not_found"),
        ("IMPORTS", "use.py", "nowhere.deep", "external"), ("CALLS", "use.py:run", "missing", "not_found"), ("CALLS", "use.py:run", "nowhere.deep.f", "external"), ("CALLS", "use.py:run", "t.part.none", "not_found"),
        ("CALLS", "use.py:run", "undefined", "not_found"), ("CALLS", "use.py:run", "undefined.f", "unknown_receiver"), ("IMPORTS", "x/deep/app.py", "m", "ambiguous"), ("CALLS", "cycle.py", "y", "not_found"), ("INHERITS", "Own.py:Own", "Own", "not_found"),
    }


def test_no_table_is_broadcast_by_the_size_of_its_files(spark):
    from codeweft.operators import resolve

    entities = spark.createDataFrame([("p", "a.py", "p:a.py", "file", "a", None)], "project_id string, file_path string, id string, entity_type string, name string, parent_id string")
    imports = spark.createDataFrame([("p", "a.py", "b", None, "b", 0)], "project_id string, file_path string, module string, name string, alias string, ord long")
    names = resolve.Names(entities, imports)
    for kept in (names.aliases, names.index, names.wildcards):
        plan = kept.join(entities, "project_id")._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_diff(spark):
    old, new = (spark.createDataFrame(rows, "id string, fingerprint string") for rows in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "1"), ("c", "2"), ("d", "1")]))
    assert {tuple(r) for r in X.diff(old, new, ["id"]).collect()} == {("a", "delete"), ("b", "keep"), ("c", "update"), ("d", "insert")}


def test_incremental_equals_full(spark, tmp_path):
    from codeweft.operators import incremental as I

    def files(texts):
        for path, text in texts.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(text)
        return tree.files(tree.scan(spark, str(root), "p"))

    def graph(a):
        return [sorted(map(str, df.drop("scan_ord", "ord").select(sorted(set(df.columns) - {"scan_ord", "ord"})).collect())) for df in (a.nodes, a.edges)]

    root, index = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()
    first = I.run(spark, files({k: v for k, v in SHOP.items() if isinstance(v, str)}), index, "s")
    assert first.mode == "full" and first.changes["files_added"] == 6
    (root / "shop/empty.py").unlink()
    again = I.run(spark, files({"shop/models.py": SHOP["shop/models.py"] + "\n\ndef more():\n    return helper()\n"}), index, "s")
    assert again.mode == "incremental"
    assert {k: v for k, v in again.changes.items() if k.startswith("files")} == {"files_modified": 1, "files_deleted": 1, "files_unchanged": 4}
    assert again.changes["nodes_insert"] == 1 and again.changes["nodes_delete"] == 1
    assert graph(again) == graph(I.run(spark, files({}), str(tmp_path / "other"), "s"))


def test_chunk_plan(spark):
    from codeweft.operators.incremental import chunk_plan

    s = "chunk_id string, content_hash string, payload_hash string"
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", "1"), ("d", "1", "1")], s)
    new = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "2", "1"), ("e", "1", "1")], s)
    assert {tuple(r) for r in chunk_plan(old, new).collect()} == {("a", "reuse"), ("b", "update"), ("c", "embed"), ("d", "delete"), ("e", "embed")}


def test_micro_batches_follow_versions(spark, tmp_path, monkeypatch):
    """Versions in, entities out; resolution has tests of its own."""
    from codeweft.streaming import changes

    monkeypatch.setattr(X, "resolved", lambda files: spark.createDataFrame([], f"project_id string, {X.EDGE}"))

    def add(version, path, text, deleted=False):
        row = ("p", path, "python", 1, version, bytearray(text.encode()), version, deleted)
        spark.createDataFrame([row], changes.VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(changes.VERSIONS).parquet(str(tmp_path / "in"))
        q = changes.follow(stream, *(str(tmp_path / x) for x in ("store", "index", "checkpoint")))
        q.awaitTermination()
        snapshot = spark.read.parquet(str(tmp_path / "index/current")).first()[0]
        return {r.id for r in spark.read.parquet(f"{snapshot}/nodes").collect()}

    assert add(1, "a.py", "def f(): pass") == {"p:a.py", "p:a.py:f"}
    assert add(2, "b.py", "") == {"p:a.py", "p:a.py:f", "p:b.py"}
    assert add(3, "a.py", "def g(): pass") == {"p:a.py", "p:a.py:g", "p:b.py"}
    assert add(4, "b.py", "", True) == {"p:a.py", "p:a.py:g"}


def test_hybrid_context_and_prompt(spark):
    from pyspark.sql import functions as F

    from codeweft.functions import prompts as P
    from codeweft.operators import hybrid as H

    nodes = spark.createDataFrame(
        [("f", "file", "a.py", 1, 9), ("c", "class", "a.py", 1, 8), ("m", "method", "a.py", 2, 3), ("n", "method", "a.py", 4, 5)], "id string, entity_type string, file_path string, start_line int, end_line int"
    )
    edges = spark.createDataFrame([("1", "CONTAINS", "f", "c"), ("2", "CONTAINS", "c", "m"), ("3", "CONTAINS", "c", "n"), ("4", "CALLS", "n", "m")], "id string, type string, source_id string, target_id string")
    hits = spark.createDataFrame([(1, "m|1", "m", 0.9, "a.py", 2, 3), (1, "m|2", "m", 0.9, "a.py", 3, 3), (1, "gone|1", "gone", 0.5, "z.py", 1, 1)], "query_id int, chunk_id string, entity_id string, score double, file_path string, start_line int, end_line int")
    seeds = H.seeds(hits)
    assert [(r.entity_id, r.chunk_ids) for r in seeds.orderBy("seed_rank").collect()] == [("m", ["m|1", "m|2"]), ("gone", ["gone|1"])]
    found = H.expand(seeds, nodes, edges)
    assert {(r.relation, r.entity_id, r.edge_id) for r in found.collect()} == {("container", "c", "2"), ("callers", "n", "4")}
    context = H.context_entities(seeds, found)
    assert [r.entity_id for r in context.orderBy("position").collect()] == ["m", "gone", "c", "n"]
    listed = H.sources(hits, context, nodes).orderBy("number")
    assert [(r.number, r.origin, r.entity_id) for r in listed.collect()] == [(1, "vector", "m"), (2, "vector", "m"), (3, "vector", "gone"), (4, "graph", "c"), (5, "graph", "n")]
    line = P.source_line(*(F.col(c) for c in ("number", "file_path", "start_line", "end_line", "origin")))
    lines = listed.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = lines.select(P.prompt([P.section("sources", F.col("lines")), P.section("paths", F.array())], F.lit("complete"), F.lit("a < b?"))).first()[0]
    assert "[1] a.py:2-3 (vector)" in text and "a &lt; b?" in text and "<paths>" not in text
