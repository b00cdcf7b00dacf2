"""Packed ids: chunks against whole texts, files read by document and block, tables against the tokenizers library."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import _common, packed_ids

pytest.importorskip("tokenizers")
TEXTS = [
    "", " ", "  a  b ", "a b  c", "x<|endoftext|> y <|endoftext|>", "日本 语　x", "\n\n foo\t\tbar \n", "can't  we'll", "é \x1c z", "‘q’ – “z”", "it's 'sound' !'s x'1 1's a1b2 _c d're'vem'é 'llama",
    "a\x00b\x7fc 1.5e-3 é1 1é é's 'é", "xx\n\n", "\t\tif x==1:\n\t\treturn", "a b", "a'", "'s", "  's",
]


@lru_cache(maxsize=1)
def encoder():
    return packed_ids.ChunkEncoder(packed_ids.vocabulary_file())


def whole(text):
    return encoder().tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(st.sampled_from(list("ab'stlre1 2\n\t.,!_é語 <|>  ")), max_size=30)), min_size=1, max_size=12))
def test_chunks_are_encoded_like_whole_texts(texts):
    raw = [t.encode() for t in texts]
    ids, n = encoder().encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 300), min_size=1, max_size=20), st.integers(1, 64))
def test_file_reads_documents_and_blocks_alone(bits, counts, block):
    ids = np.arange(sum(counts), dtype=np.uint32) * 7 % (1 << bits)
    data, read = packed_ids.packed_file(bits, 3, 4, np.arange(len(counts)) * 2, np.array(counts), ids, block), []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    file, to = packed_ids.PackedFile(part), np.cumsum(counts)
    assert (file.range, file.sequence, file.ids) == (3, 4, len(ids))
    for k, n in enumerate(counts):
        (own,) = file.document(2 * k)
        assert (own == ids[to[k] - n : to[k]]).all() and file.document(2 * k + 1) == []
    for k in range(file.blocks):
        read.clear()
        assert (file.block(k) == ids[k * block : (k + 1) * block]).all() and sum(read) <= 16 + (block * bits + 7) // 8


def test_ranges_split_a_key_that_fills_several():
    keys, ties = np.array([1, 5, 5, 5, 5, 9, 12]), np.array([0, 0, 1 << 61, 1 << 62, (1 << 63) - 1, 3, 4])
    assert packed_ids._ranges(keys, ties, np.array([2, 5, 5, 5, 10])).tolist() == [0, 1, 1, 2, 3, 4, 5]


def test_files_of_many_ranges(spark, monkeypatch):
    """Ranges and files of a few ids, a third of the rows with one id, odd white space: all against the library."""
    monkeypatch.setattr(_common, "RANGE_CHARS", 700)
    monkeypatch.setattr(packed_ids, "FILE_IDS", 150)
    rows = [(7 if k % 3 == 0 else 2000 - k, f"{TEXTS[k % len(TEXTS)]} text {k} {'word ' * (k % 40)}") for k in range(1200)]
    path = packed_ids.new_path(spark, "packed-many")
    packed_ids.write_packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, packed_ids.vocabulary_file())
    got = sorted(packed_ids.read_packed(spark, path).collect(), key=lambda r: r.start)
    ids = [(i, [*whole(t), 2]) for i, t in rows]
    want = sorted((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert packed_ids.index_of(spark, path).where("least = 7 and largest = 7").select("range").distinct().count() > 1
    assert [x.tolist() for x in packed_ids.read_document(spark, path, 1999)] == [next(x for i, x in ids if i == 1999)]


def test_null_repeated_and_missing_rows(spark):
    rows = [(3, None), (None, "no id"), (9, "TWICE"), (9, "TWICE"), (None, ""), (1, "x " * 5000)]
    docs, path = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string"), packed_ids.new_path(spark, "packed-test")
    packed_ids.write_packed(docs, path, packed_ids.vocabulary_file())
    got = sorted(packed_ids.read_packed(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 3, 9, 9, None, None]
    assert [x.tolist() for x in packed_ids.read_document(spark, path, 9)] == [[*whole("TWICE"), 2]] * 2
    assert sorted(x.tolist() for x in packed_ids.read_document(spark, path, None)) == sorted([[2], [*whole("no id"), 2]])
    assert packed_ids.read_document(spark, path, 4) == []
    path = packed_ids.new_path(spark, "packed-empty")
    packed_ids.write_packed(docs.where("false"), path, packed_ids.vocabulary_file())
    assert packed_ids.read_packed(spark, path).count() == 0 and packed_ids.read_document(spark, path, 1) == []
