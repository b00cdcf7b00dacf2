"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark.

A word goes when a window that covers it also starts in a document with a smaller id; windows are judged
on the input. The windows to remove are merged into maximal intervals, and the kept words are joined.

Most windows occur once. To shuffle only the others, each window picks an anchor: the smallest hash of
the ANCHOR-word runs inside it. Equal windows pick equal anchors, so a window whose anchor is found in
one document only has no equal elsewhere. Anchors (about one for 13 words) are counted first; then every
window with a shared anchor is counted by two independent hashes, of 64 and 32 bits: Rabin-Karp over two
independent 64-bit hashes of each word's bytes.

Null and empty texts have no words; texts shorter than a window keep all. Null ids come after all
others. Rows with equal ids are not smaller than each other, and each is judged by its own text; rows
that repeat both are judged alike. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._common import BROADCAST_BYTES, bounded_batches, documents, id_key, text_of, written
from codeweft.llm._rolling import WORD_BASES, Words, rolling, signed, slices

WINDOW, ANCHOR = 50, 25


def _slid_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values, by doubling."""
    done, out = 1, h
    while done * 2 <= k:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (k - done)], out[k - done :]) if k > done else out


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window of one document, from its words' second hashes."""
    return _slid_min(rolling(hashes, anchor, WORD_BASES[1]), window - anchor + 1)


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets)
                (_, hashes), out, rows = words.hashes(), [], []
                for r in range(j - i):
                    own = hashes[words.first[r] : words.first[r + 1]]
                    if len(own) >= window:
                        out.append(np.unique(_anchors(own, window, anchor)))
                        rows.append(np.full(len(out[-1]), i + r))
                if out:
                    at = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out))), pa.array(keys[at]), pa.array(marks[at])], ["anchor", "key", "mark"])

    return run


def _window_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets)
                (first, second), out = words.hashes(), []
                for r in range(j - i):
                    own = second[words.first[r] : words.first[r + 1]]
                    if len(own) < window:
                        continue
                    shared = np.asarray(lists[i + r].values, dtype=np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(_anchors(own, window, anchor), shared))
                    if len(at):
                        out.append((rolling(first[words.first[r] : words.first[r + 1]], window, WORD_BASES[0])[at], rolling(own, window, WORD_BASES[1])[at], np.full(len(at), i + r), at))
                if out:
                    h1, h2, rows, at = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(keys[rows]), pa.array(marks[rows]), pa.array(at.astype(np.int32))], ["h1", "h2", "key", "mark", "at"])

    return run


def _is_in(df: DataFrame, ids: DataFrame, yes: bool) -> DataFrame | None:
    """df (key, mark) filtered by a broadcast list of rows, or None where that is too long to broadcast."""
    if ids.count() * 48 > BROADCAST_BYTES:
        return None
    return df.join(F.broadcast(ids), ["key", "mark"], "left_semi" if yes else "left_anti")


def repeated_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, unique: bool = False) -> DataFrame:
    """rows: key, mark, text; unique: no two with one key and mark. For each row with windows to remove: key, mark and the sorted starts."""
    anchors = written(rows.mapInArrow(_anchor_rows(window, anchor), "anchor long, key long, mark long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("anchor")
    lists = written(anchors.join(shared, "anchor").groupBy("key", "mark").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    near = _is_in(rows, lists.select("key", "mark"), True)
    near = rows if near is None else near
    near = (near if unique else near.dropDuplicates(["key", "mark"])).join(lists, ["key", "mark"])
    found = near.select("key", "mark", "text", "anchors").mapInArrow(_window_rows(window, anchor), "h1 long, h2 int, key long, mark long, at int")
    found = written(found, "windows")
    first = found.groupBy("h1", "h2").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    return found.join(first, ["h1", "h2"]).where("key > lo").groupBy("key", "mark").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def _kept(window: int, with_starts: bool, with_text: bool):
    """Rows (id, text[, starts]) to (id, n_words, n_removed, kept_sha256, intervals[, kept])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                n_words, n_removed, sha, spans, texts = [], [], [], [], []
                for r in range(j - i):
                    a, b = words.first[r], words.first[r + 1]
                    starts = np.asarray(batch.column(2)[i + r].values, dtype=np.int64) if with_starts else ()
                    cover = np.zeros(b - a + 1, dtype=np.int64)
                    if len(starts):
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + window, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    edges = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                    body = _joined(data, words.starts[a:b][stay], words.ends[a:b][stay])
                    n_words.append(int(b - a))
                    n_removed.append(int(b - a - stay.sum()))
                    sha.append(hashlib.sha256(body).hexdigest())
                    texts.append(body.decode("utf-8", "replace") if with_text else "")
                cols = [batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
                names = ["id", "n_words", "n_removed", "kept_sha256", "intervals"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts)] * with_text, names + ["kept"] * with_text)

    return run


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words data[starts[k]:ends[k]], joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    to = np.cumsum(size)
    index = np.arange(to[-1]) + np.repeat(starts - (to - size), size)
    out = data[np.minimum(index, len(data) - 1)]
    out[to - 1] = 32
    return out[:-1].tobytes()


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """For each row of docs: id, n_words, n_removed, kept_sha256, the removed intervals (first word, end
    exclusive) and, on request, the kept words."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    repeated = docs.groupBy(id_key(id_col).alias("key")).count().where("count > 1").limit(1).count()
    mark = F.xxhash64(text_of(text_col)) if repeated else F.lit(0).cast("long")  # tells rows with one id apart
    rows = docs.select(id_key(id_col).alias("key"), mark.alias("mark"), text_of(text_col).alias("text"), F.col(id_col).alias("id"))
    starts = written(repeated_windows(rows.select("key", "mark", "text"), window, anchor, not repeated), "starts")
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, intervals array<struct<begin: long, end: long>>" + ", kept string" * with_text
    ids = starts.select("key", "mark")
    hit, rest = _is_in(rows, ids, True), _is_in(rows, ids, False)
    some = (rows if hit is None else hit).join(starts, ["key", "mark"])
    none = rows.join(ids, ["key", "mark"], "left_anti") if rest is None else rest
    out = none.select("id", "text").mapInArrow(_kept(window, False, with_text), schema).union(some.select("id", "text", "starts").mapInArrow(_kept(window, True, with_text), schema))
    return out.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
bad AS (SELECT doc_id, i FROM h JOIN f USING (h) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM bad),
n AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
o AS (SELECT d.doc_id, len(w) AS n, CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END AS kept FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""
