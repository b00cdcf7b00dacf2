"""Chunks on small files, windows against a plain loop, impact in walking order."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.functions import chunker
from codeweft.operators import chunks as C
from codeweft.operators import graph as G


def entity(i, kind, name, parent, first, last):
    return {"id": i, "entity_type": kind, "name": name, "parent_id": parent, "start_line": first, "end_line": last, "qualified_name": name}


SOURCE = b"""import os\r


@wraps
class Shop(Base):
    size = 1

    @property
    def open(self):
        def inner():
            return 1
        return inner

    def ping(self): return 1


def far(
    a,
):
    return a
"""
ENTITIES = [
    entity("f", "file", "shop.py", None, 1, 19), entity("s", "class", "Shop", "f", 4, 14), entity("o", "method", "open", "s", 8, 12), entity("i", "function", "inner", "o", 10, 11),
    entity("p", "method", "ping", "s", 14, 14), entity("far", "function", "far", "f", 17, 20),
]


def test_units_are_shown_short_where_they_have_chunks():
    got = {c["entity"]["id"]: (c["start_line"], c["end_line"], c["text"]) for c in chunker.chunks(SOURCE, ENTITIES)}
    assert got["f"] == (1, 18, "import os\n\n\n@wraps\nclass Shop(Base):\n    ...\n\n\ndef far(\n    ...")
    assert got["s"] == (4, 14, "@wraps\nclass Shop(Base):\n    size = 1\n\n    @property\n    def open(self):\n        ...\n\n    def ping(self): return 1")
    assert got["o"][:2] == (8, 12) and "inner" in got["o"][2] and set(got) == {"f", "s", "o", "far"}


def test_files_without_code_of_their_own():
    only = [entity("f", "file", "a.py", None, 1, 3), entity("g", "function", "g", "f", 1, 2)]
    assert [c["entity"]["id"] for c in chunker.chunks(b"def g():\n    return 1\n", only)] == ["g"]
    assert not list(chunker.chunks(b"", [entity("f", "file", "a.py", None, 1, 1)])) and not list(chunker.chunks(b" \n\n", only[:1]))


def test_long_lines_and_parts():
    text = b"x" * 25 + b"\n" + b"\n".join(b"line %d" % k for k in range(9))
    got = list(chunker.chunks(text, [entity("f", "file", "a.py", None, 1, 10)], 30, 1))
    assert got[0]["text"] == "x" * 25 and {c["part_count"] for c in got} == {len(got)} and [c["part"] for c in got] == list(range(1, len(got) + 1))
    assert all(b["start_line"] == a["end_line"] for a, b in zip(got[1:], got[2:])) and all(len(c["text"]) <= 30 for c in got)
    assert [c["start_line"] for c in chunker.chunks(b"y" * 70, [entity("f", "file", "a.py", None, 1, 1)], 30, 0)] == [1, 1, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40), st.integers(1, 25), st.integers(0, 5))
def test_windows_equal_a_plain_loop(sizes, most, overlap):
    want, start = [], 0
    while start < len(sizes):
        end = start + 1
        while end < len(sizes) and sum(sizes[start : end + 1]) <= most:
            end += 1
        want.append((start, end))
        start = len(sizes) if end == len(sizes) else max(end - overlap, start + 1)
    assert chunker.windows(sizes, most, overlap) == want


def test_chunk_table(spark):
    from codeweft.operators import extract as X

    schema = "project_id string, path string, language string, scan_ord int, sha256 string, content binary"
    files = spark.createDataFrame([("p", "shop.py", "python", 0, "", bytearray(SOURCE)), ("p", "no.js", "javascript", 1, "", bytearray(b"x")), ("p", "gone.py", "python", 2, "", None)], schema)
    made = C.chunks(files, X.analysed(files)).withColumn("embedded", C.embedding_text()).withColumn("payload", C.payload())
    got = {r.entity_id: r for r in made.collect()}
    assert got["p:shop.py"].embedded.startswith("python module code shop.py\nfile: shop.py\n\nimport os") and got["p:shop.py:Shop"].id == "p:shop.py:Shop|1"
    assert '"part_count":1' in got["p:shop.py:Shop"].payload and {r.entity_type: r.n for r in C.by_type(made).collect()} == {"file": 1, "class": 1, "method": 1, "function": 1}
    with pytest.raises(ValueError):
        C.chunks(files, files, 0)


def test_impact_walks_in_source_order(spark):
    nodes = spark.createDataFrame([("f", "a.py", 1), ("c", "a.py", 1), ("m:9", "a.py", 2), ("m:1", "a.py", 5), ("x", "x.py", 1), ("y", "y.py", 1), ("z", "z.py", 1)], "id string, file_path string, start_line int")
    rows = [("CONTAINS", "c", "m:9"), ("CONTAINS", "c", "m:1"), ("CALLS", "x", "m:9"), ("USES", "x", "m:1"), ("CALLS", "y", "x"), ("CALLS", "z", "y"), ("CALLS", "x", "x"), ("CALLS", "c", "z")]
    edges = spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b, 1) for t, a, b in rows], "id string, type string, source_id string, target_id string, line int")
    got = [tuple(r) for r in G.impact(nodes, edges, "c").collect()]
    assert got == [("x", 1, "m:9", "CALLS", False), ("y", 2, "x", "CALLS", False), ("z", 3, "y", "CALLS", False)]
    assert [tuple(r) for r in G.impact(nodes, edges, "c", limit=2).collect()] == [("x", 1, "m:9", "CALLS", True), ("y", 2, "x", "CALLS", True)]
    assert [r.via for r in G.impact(nodes, edges, "c", depth=1, read_limit=1).collect()] == ["m:9"]
