"""SentencePiece encoding against the library, its folds against each other and against all paths."""

import zlib

import numpy as np
import pytest

from codeweft.llm import piece_lattice

TEXTS = ["", " ", "  two  blanks ", "a▁b ▁ c", "日本語 текст", "x" * 300, "=" * 500 + "\n\n\t", "é" * 70 + "the the", "aB3$" * 40, None, " nbsp　", "ab\x00c", "🙂🙂 ok", "the" * 90, "the" * 90, "word " * 300]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=piece_lattice.model_file())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k % 12, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, row string")


@pytest.mark.parametrize("limit", [piece_lattice.TABLE_BYTES, 1500])
def test_ids_equal_the_librarys(docs, library, limit):
    """With all units in the table, and with only the frequent ones."""
    model = piece_lattice.model_file()
    coded = piece_lattice.decode(piece_lattice.encode(docs, model, limit=limit), model).collect()
    assert len(coded) == len(TEXTS)
    for r in coded:
        assert r.piece_ids == library.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
    told = sorted((r.doc_id, r.n_pieces, r.ids_crc32, r.round_trip) for r in piece_lattice.digests(docs, model, limit=limit).collect())
    ids = [(k % 12, library.encode(t or ""), "▁" not in (t or "")) for k, t in enumerate(TEXTS)]
    assert told == sorted((k, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()), same) for k, x, same in ids)


def test_empty_table_and_clashing_columns(docs):
    model = piece_lattice.model_file()
    assert piece_lattice.encode(docs.where("false"), model).count() == 0 and piece_lattice.digests(docs.where("false"), model).count() == 0
    once = piece_lattice.encode(docs, model)
    assert once.columns == [*docs.columns, "piece_ids"] and piece_lattice.encode(once, model).columns == once.columns


def test_long_units_take_the_same_path(library):
    own = piece_lattice.pieces_of(piece_lattice.model_file())
    for t in filter(None, TEXTS):
        assert own.path("▁" + t.replace(" ", "▁")) == library.encode(t)


def test_unigram_fold(spark, monkeypatch):
    """The largest sum of scores over all ways to cut a unit; the native fold and the linear one."""
    pieces = [("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.2, 1), ("abc", -2.3, 1), ("c", -1.0, 1), ("bc", -1.2, 1), ("<unk>", 0.0, 2)]
    own = piece_lattice.Pieces(pieces, False)
    monkeypatch.setattr(piece_lattice, "pieces_of", lambda model: own)
    score = {p: s for p, s, k in pieces if k == 1}

    def best(unit):
        ways = [[(0.0, [])]] + [[] for _ in unit]
        for e in range(1, len(unit) + 1):
            for s in range(e):
                p = unit[s:e]
                if p in score or e - s == 1:
                    ways[e] += [(x + score.get(p, own.floor), [*ids, own.id_of.get(p, own.unknown)]) for x, ids in ways[s]]
        return max(ways[-1])[1]

    words = ["abc", "abcab", "ccab", "bxa", "a", "x", "abcabcabc"]
    got = {r.unit: r.ids for r in piece_lattice.lattice(spark.createDataFrame([(w, 1) for w in words], "unit string, n long"), b"").collect()}
    assert got == {w: best(w) for w in words} == {w: own.path(w) for w in words}


def test_table_comes_to_the_driver_in_parts(spark, monkeypatch):
    """Hashed, sorted and packed on executors, and never collected whole."""
    model = piece_lattice.model_file()
    want = {f"unit {k}": [k % 32000] * (k % 300 if k % 500 == 0 else k % 4) for k in range(3000)}
    coded = spark.createDataFrame([(u, 1 + len(x), x) for u, x in want.items()], "unit string, n long, ids array<int>")
    monkeypatch.setattr(piece_lattice, "PART_BYTES", 10_000)
    monkeypatch.setattr(type(coded), "toArrow", lambda self: pytest.fail("collected whole"))
    sent = []
    monkeypatch.setattr(piece_lattice, "Table", lambda parts, kind, make=piece_lattice.Table: make((sent.append(sum(map(len, p))) or p for p in parts), kind))
    table, least = piece_lattice.unit_table(coded, model)
    assert least == 0 and len(sent) >= 5 and max(sent) < 30_000 and (table.first[1:] >= table.first[:-1]).all() and table.flat.dtype == np.uint16
    at = table.find([u.encode() for u in want])
    assert [table.flat[a : a + n].tolist() for a, n in zip(table.starts[at].tolist(), table.sizes[at].tolist(), strict=True)] == list(want.values())
    assert (table.find([b"unit", b"unit 3000"]) == -1).all()
