"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents link when 100 * |A & B| >= 80 * |A | B| for their sets of distinct five-word shingles (words
lower-cased A-Z; fewer words: the whole sequence). The join is exact:

1. Rows with equal sets form one class, known by its size and 128 bits, two sums over its shingles' hashes; only
   classes go on, each under a number of its own. Words are hashed by their bytes, shingles by 64 bits.
2. A set's shingles are ordered by (how common, hash). Two sets that link share one of their first
   n - ceil(0.8 n) + 1, and s more of them when s more are taken. Commonness comes from one document of SAMPLE,
   into a table of fixed size; any order is exact, this one keeps shingles of many documents out of the first.
3. The first shingles go once, packed, to the task that has their hash. Shingles held by up to BLOCK classes give
   pairs there, whose overlap counts are added up; pairs below the bound that their sizes demand are discarded.
   Shingles held by more link their classes to one of them, as nothing grows with the square of a block; but not
   classes with so few of them that every link must also show in a shingle of a smaller block. The result splits
   classes into candidate groups.
4. A group's sets are gathered once and multiplied: row by row, one row gives the overlaps with all sets of
   the group. Rows are needed only for sets outside the group's largest component, so a thousand near copies
   cost a few rows. Groups above GROUP_SHINGLES are cut into chunks, and every pair of chunks is multiplied.
5. Links' connected components give each document the smallest id that it reaches.

Null and empty texts have no shingles and link with nothing, not with each other. Null ids come after all
others. Rows that repeat an id are documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._common import LAST_ID, bounded_batches, documents, id_key, small, text_of, written
from codeweft.llm._rolling import WORD_BASES, Words, mixed, rolling, signed, slices
from codeweft.llm.components import connected

RUN, PERCENT, BLOCK, GROUP_SHINGLES, SLOTS = 5, 80, 64, 4_000_000, 1 << 24
#: One document of SAMPLE tells how common shingles are; one shingle of SPARE is added to the first ones.
SAMPLE, SPARE = 8, 40
#: The table of SLOTS is counted in so many parts; a task has about so many first shingles, and emits so many rows at once.
SLOT_PARTS, POSTINGS, ROWS = 256, 1 << 20, 1 << 17
#: Told apart from the first sum of a set's hashes.
SECOND = 0x5851F42D4C957F2D


def shingle_sets(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, lower=True)
    hashes, _ = words.hashes()
    every = rolling(hashes, run, WORD_BASES[0])
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= run:
            yield np.unique(every[a : b - run + 1])
        elif b > a:
            yield rolling(hashes[a:b], int(b - a), WORD_BASES[1]) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def dealt(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each part, with its values of every column as packed bytes."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    at, first = np.unique(part[order], return_index=True)
    arrays = [pa.array(at.astype(np.int32))]
    for c in columns:
        ends = (np.r_[first, len(part)] * c.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(c[order])]))
    return pa.RecordBatch.from_arrays(arrays, ["part", *names])


def _sampled(run: int):
    """Of each shingle 39 bits: the slot and 15 more."""
    size = SLOTS // SLOT_PARTS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                every = np.concatenate(list(shingle_sets(data, offsets, run)))
                slot = every & np.uint64(SLOTS - 1)
                rest = (slot % np.uint64(size)) << np.uint64(15) | every >> np.uint64(49)
                yield dealt(slot // np.uint64(size), [rest.astype(np.uint32)], ["rest"])

    return deal


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table's levels in each part, compressed."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, rest in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(part, []).append(np.frombuffer(rest.as_py(), dtype=np.uint32))
    for part, pieces in held.items():
        shingles, n = np.unique(np.concatenate(pieces), return_counts=True)
        levels = np.zeros(SLOTS // SLOT_PARTS, dtype=np.uint8)
        np.maximum.at(levels, shingles[n > 1] >> np.uint32(15), np.log2(n[n > 1]).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())], ["part", "levels"])


def commonness(rows: DataFrame, run: int = RUN) -> np.ndarray:
    """For each slot 0, or log2 of the most that a shingle of it was met in the sample. SLOTS bytes, whatever the corpus."""
    size, out = SLOTS // SLOT_PARTS, np.zeros(SLOTS, dtype=np.uint8)
    sample = rows.where(F.pmod(F.xxhash64("key", "mark"), F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(_sampled(run), "part int, rest binary").repartition("part").mapInArrow(_count, "part int, levels binary")
    for r in found.toArrow().to_pylist():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["levels"]), dtype=np.uint8)
    return out


def spare(n: int, percent: int) -> int:
    """How many shingles more than one the first ones of two linked sets share at least, if the smaller has n. It grows with n."""
    return min(n // SPARE, -(-percent * n // 100) - 1) if n else 0


def _least(n: str, percent: int) -> str:
    """SQL: ceil(percent * n / 100)."""
    return f"(({percent} * {n} + 99) div 100)"


def _spare(n: str, percent: int) -> str:
    return f"least({n} div {SPARE}, {_least(n, percent)} - 1)"


def _prefixes(levels, run: int, percent: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                n, ids, more, lists = [], [], [], []
                for own in shingle_sets(data, offsets, run):
                    n.append(len(own))
                    ids.append(np.uint64(np.add.reduce(mixed(own + np.uint64(len(own))))))
                    more.append(np.uint64(np.add.reduce(mixed(own ^ np.uint64(SECOND)))))
                    first = len(own) - -(-percent * len(own) // 100) + 1 + spare(len(own), percent) if len(own) else 0
                    order = np.lexsort((own, level[(own & np.uint64(SLOTS - 1)).astype(np.int64)]))[:first]
                    lists.append(own[order])
                ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(lists))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(signed(np.array(ids, dtype=np.uint64))), pa.array(signed(np.array(more, dtype=np.uint64))), flat], ["key", "mark", "n", "sum1", "sum2", "prefix"])

    return run_


def _postings(parts: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            w = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if len(w):
                times = lists.value_lengths().to_numpy(zero_copy_only=False)
                cid, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in (0, 1))
                yield dealt((w >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16), [w, cid, n], ["w", "cid", "n"])

    return deal


def _blocks(percent: int):
    """Of all first shingles of some parts: a pair of classes for each that up to BLOCK classes hold (many is false), and
    each with a class that holds it (as a and b) if more do."""

    def rows(many: bool, a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), ROWS):
            own = [x[i : i + ROWS] for x in (a, b, n1, n2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), many)), *map(pa.array, own)], ["many", "a", "b", "n1", "n2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for c, kind in enumerate((np.uint64, np.int64, np.int64)):
                held[c] += [np.frombuffer(x.as_py(), dtype=kind) for x in batch.column(c + 1)]
        if not held[0]:
            return
        w, cid, n = map(np.concatenate, held)
        held.clear()
        order = np.argsort(w, kind="stable")
        w, cid, n = w[order], cid[order], n[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        size = np.diff(np.r_[first, len(w)])
        large = np.repeat(size > BLOCK, size)
        yield from rows(True, signed(w[large]), cid[large], n[large], n[large])
        for k in np.unique(size[(size > 1) & (size <= BLOCK)]):
            i, j = np.triu_indices(k, 1)
            starts, step = first[size == k], max(1, ROWS // len(i))
            for s in range(0, len(starts), step):
                x, y = ((starts[s : s + step, None] + side).ravel() for side in (i, j))
                fit = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[fit], y[fit]
                x, y = np.where(cid[x] < cid[y], x, y), np.where(cid[x] < cid[y], y, x)
                yield from rows(False, cid[x], cid[y], n[x], n[y])

    return run


def _packed_sets(run: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(3)):
                sets = [x.tobytes() for x in shingle_sets(data, offsets, run)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(sets, pa.binary())], ["cid", "root", "chunks", "packed"])

    return pack


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the link graph of sets. One step multiplies one row with all sets."""
    k, sizes = len(sets), np.array([len(x) for x in sets])
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label, done, out = np.arange(k), np.zeros(k, dtype=bool), []
    row = np.zeros(len(every), dtype=np.int32)
    queue = int(np.argsort(sizes, kind="stable")[k // 2])
    while True:
        own = flat[starts[queue] : starts[queue] + sizes[queue]]
        row[own] = 1
        overlap = np.add.reduceat(row[flat], starts)
        row[own] = 0
        done[queue] = True
        hit = (100 * overlap >= percent * (sizes + sizes[queue] - overlap)) & (label != label[queue])
        for b in np.flatnonzero(hit):
            if label[b] != label[queue]:
                out.append((queue, int(b)))
                label[label == label[b]] = label[queue]
        largest = np.bincount(label, minlength=k).argmax()
        todo = np.flatnonzero(~done & (label != largest))
        if not len(todo):
            return out
        queue = int(todo[0])


def _multiply(percent: int):
    """Rows sorted by (root, lo, hi, cid): one list of sets after the other. Rows that repeat an id and text give a set twice."""

    def emit(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = links(sets, percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            for root, lo, hi, cid, packed in zip(*(batch.column(c) for c in range(5)), strict=True):
                this = (root.as_py(), lo.as_py(), hi.as_py())
                if this != group and ids:
                    yield emit(ids, sets)
                    ids, sets = [], []
                group = this
                if ids and ids[-1] == cid.as_py():
                    continue
                ids.append(cid.as_py())
                sets.append(np.frombuffer(packed.as_py(), dtype=np.uint64))
        if ids:
            yield emit(ids, sets)

    return run


def _candidates(classes: DataFrame, percent: int, shingles: int) -> DataFrame:
    """Edges a, b that hold each candidate group together. shingles: of all classes."""
    parts = min(1 << 16, shingles * (100 - percent + 100 // SPARE) // 100 // POSTINGS + 1)
    usual = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = classes.select("cid", "n", "prefix").mapInArrow(_postings(max(parts, usual)), "part int, w binary, cid binary, n binary")
    dealt_out = dealt_out.repartition(parts, "part") if parts > usual else dealt_out.repartition("part")
    found = dealt_out.mapInArrow(_blocks(percent), "many boolean, a long, b long, n1 long, n2 long")
    found = written(found.groupBy("many", "a", "b", "n1", "n2").agg(F.count("*").alias("both")), "found")
    many = found.where("many").select(F.col("a").alias("w"), F.col("b").alias("cid"), "n1")
    large = written(many.groupBy("cid").agg(F.first("n1").alias("n"), F.count("*").alias("large")), "large")
    pairs = found.where("not many").join(large.select(F.col("cid").alias("a"), F.col("large").alias("l1")), "a", "left").join(large.select(F.col("cid").alias("b"), F.col("large").alias("l2")), "b", "left")
    rest = lambda n: f"{_least(n, percent)} - 1 - {_spare(n, percent)}"  # noqa: E731 (shingles that are not among the first)
    most = f"both + least(coalesce(l1, 0), coalesce(l2, 0)) + greatest({rest('n1')}, {rest('n2')})"
    close = pairs.where(f"({100 + percent}) * ({most}) >= {percent} * (n1 + n2)").select("a", "b")
    # the smaller of two linked sets has ceil(0.8 n) shingles or more, if the larger has n
    needed = large.where(f"large > {_spare(_least('n', percent), percent)}").select("cid")
    many = many.join(needed, "cid").select("w", "cid")
    hubs = many.groupBy("w").agg(F.min("cid").alias("hub"))
    return close.union(many.join(hubs, "w").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: _key (its id, LAST_ID for null), _mark (text hash), n_shingles, root (smallest _key reachable), root_mark.

    root and root_mark are the least (_key, _mark) of the row's component, and so name one text of that component
    even where ids repeat or are null."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(id_key(id_col).alias("key"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(commonness(rows, run))
    made = rows.mapInArrow(_prefixes(levels, run, percent), "key long, mark long, n long, sum1 long, sum2 long, prefix array<long>")
    made = written(made.withColumn("cid", F.monotonically_increasing_id()), "prefixes")
    first = F.min(F.struct("key", "mark", "cid")).alias("least")
    classes = made.where("n > 0").groupBy("sum1", "sum2", "n").agg(first)
    classes = written(classes.select("sum1", "sum2", "n", "least.cid", F.struct("least.key", "least.mark").alias("rep")), "classes")
    copies = made.where("n > 0").select("sum1", "sum2", "n", "cid").join(classes.withColumnRenamed("cid", "kept"), ["sum1", "sum2", "n"]).where("cid <> kept").select("cid")
    unique = made.where("n > 0").join(small(written(copies, "copies"), 64), "cid", "left_anti")
    groups = connected(_candidates(unique, percent, classes.agg(F.sum("n")).first()[0] or 0))
    member = classes.select("cid", "n", "rep").join(groups, groups.node == classes.cid).drop("node")
    chunks = F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("chunks")
    member = written(member.join(member.groupBy("root").agg(chunks), "root").select("cid", "root", "chunks", "rep.key", "rep.mark"), "members")
    wanted = member.groupBy("key", "mark").agg(F.min(F.struct("cid", "root", "chunks")).alias("of"))
    wanted = small(wanted.select("key", "mark", "of.*"), 96)
    sets = rows.join(wanted, ["key", "mark"]).select("cid", "root", "chunks", "text").mapInArrow(_packed_sets(run), "cid long, root long, chunks int, packed binary")
    own = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("cid"), "chunks")).otherwise(0)
    other = F.when(F.col("chunks") > 1, F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own"))).otherwise(F.array(F.lit(0)))
    work = sets.withColumn("own", own.cast("int")).select("cid", "root", "own", F.explode(other).alias("other"), "packed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = work.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cid", "packed")
    work = work.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "cid")
    found = connected(work.mapInArrow(_multiply(percent), "a long, b long"))
    roots = classes.select("cid", "rep").join(found, found.node == classes.cid).select("cid", F.coalesce("root", "cid").alias("root"), "rep")
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    of = roots.join(least, "root").select("cid", "least")
    alone = classes.join(of, "cid", "left").select("sum1", "sum2", "n", F.coalesce("least", "rep").alias("least"))
    out = made.select("key", "mark", "n", "sum1", "sum2").join(alone, ["sum1", "sum2", "n"], "left")
    root = F.when(F.col("n") > 0, F.col("least")).otherwise(F.struct("key", "mark"))
    return out.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), F.col("n").alias("n_shingles"), root.getField("key").alias("root"), root.getField("mark").alias("root_mark"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id (ties by text hash), and all without
    shingles. Of rows that share that id and text all but one go too. Rows of other components stay, whatever their ids."""
    found = written(jaccard_components(docs, id_col, text_col).where("n_shingles > 0"), "components")
    stays = (F.col("_key") == F.col("root")) & (F.col("_mark") == F.col("root_mark"))
    gone = found.where(~stays).select("_key", "_mark").distinct()
    again = found.where(stays).groupBy("_key", "_mark").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = docs.select(F.struct("*").alias("_row"), id_key(id_col).alias("_key"), F.xxhash64(text_of(text_col)).alias("_mark"))
    rows = rows.join(small(gone, 64), ["_key", "_mark"], "left_anti").join(small(again, 64), ["_key", "_mark"], "left")
    once = rows.where("_n is null").select("_row")
    many = rows.where("_n is not null").groupBy("_key", "_mark").agg(F.first("_row").alias("_row")).select("_row")
    return once.union(many).select("_row.*")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return out.select(real("_key").alias("doc_id"), "n_shingles", real("root").alias("component_id"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
rare AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
q AS (SELECT e.doc_id, e.s FROM e JOIN rare USING (s)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM q a JOIN q b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
