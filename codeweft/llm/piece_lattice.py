"""SentencePiece encoding and decoding over a relational lattice of pieces.

Texts are cut between two characters that no piece has side by side (so before blanks, around digits, and around
characters without a piece): no piece crosses such a cut, so a text's ids are those of its units in a row. Each
distinct unit of the corpus is encoded once, relationally:

1. units: the distinct units with their counts (listed batch by batch, grouped by Spark).
2. edges: explode a unit's substrings, as long as the longest piece at most, and equi-join them to the piece table
   (broadcast: as long as the vocabulary). Characters without a piece become byte pieces.
3. group the edges by unit. Units are already dealt by unit, so this moves nothing.
4. fold each unit's edges with Spark's aggregate(). Unigram models: Viterbi, the path with the largest sum of scores.
   BPE models: the library's pieces are not those of the largest sum, so the fold takes, from all boundaries between
   characters, again and again the edge with the best score (leftmost of equals) that spans two present neighbours, and
   removes the boundary inside it, until none is left; the path is the edges between the boundaries that remain. Units
   above FOLD_CHARS characters (boundaries are bits of a long) are folded by the same rule in a worker, in linear space.

The ids of the most frequent units go back to the texts by a broadcast of at most TABLE_BYTES bytes, whatever the
corpus. Where that does not hold all units, the ids of the others, which are rare, are joined by unit and grouped by
row, and texts are joined to them by row.

Decoding joins pieces and bytes, and takes back the leading blank; only the blank's own sign U+2581 in a text comes
back as a blank. Null counts as empty; an empty text has no ids. Repeated rows are encoded alike; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._common import bounded_batches, documents, text_of, written
from codeweft.llm._rolling import byte_hashes, gathered, numbered, signed, slices

BLANK = "▁"
#: Bytes of the table of units that is broadcast, longest unit of the native fold, bytes of text handled at once,
#: units of a task whose edges are grouped in memory (some 1 kB each), bytes of the table that reach the driver at once.
TABLE_BYTES, FOLD_CHARS, RUN_BYTES, GROUPS, PART_BYTES = 96 << 20, 60, 1 << 20, 100_000, 4 << 20
TOP_BIT = np.uint64(1 << 63)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = (4, at) if key & 7 == 5 else (8, at) if key & 7 == 1 else _varint(data, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """Pieces (text, score, kind) of a model file by id, and whether it is a BPE model. Kinds: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""
    pieces, bpe = [], False
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0, f.get(3, 1)))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
    return pieces, bpe


class Pieces:
    """A model's pieces, and the cuts that no piece crosses."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool):
        self.bpe = bpe
        self.rows = [(p, k, s) for k, (p, s, kind) in enumerate(pieces) if kind in (1, 4)]
        self.id_of, self.score = {p: k for p, k, _ in self.rows}, [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)
        self.floor = min(self.score, default=0.0) - 10.0
        self.parts = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(BLANK, " ").encode() if kind in (1, 4) else b"" for p, _, kind in pieces]

    # The tables below are made where they are used: in workers, not on the driver.

    @cached_property
    def decoding(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, where each begins and how many it has."""
        sizes = np.array([len(p) for p in self.parts], np.int64)
        return np.frombuffer(b"".join(self.parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    @cached_property
    def number(self) -> np.ndarray:
        """A number for each code point that some piece has, 0 for the others."""
        chars = sorted({c for p, _, _ in self.rows for c in p})
        out = np.zeros(0x110000, np.int32)
        out[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        return out

    @cached_property
    def beside(self) -> np.ndarray:
        """Whether some piece has two numbers side by side."""
        n = int(self.number.max()) + 1
        out = np.zeros((n, n), dtype=bool)
        for p, _, _ in self.rows:
            k = self.number[[ord(c) for c in p]]
            out[k[:-1], k[1:]] = True
        return out

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, cuts, first unit of each text and the end) of some whole texts, each led by a blank unless empty."""
        size = np.diff(offsets)
        lead = (size > 0).astype(np.int64)
        begins = offsets[:-1] + np.cumsum(lead) - lead
        text = np.insert(data, offsets[:-1][lead > 0], 32)
        codes = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, np.uint32(ord(BLANK)), codes)
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[np.append(begins, len(text))]
        n = self.number[codes]
        cut = np.ones(len(codes) + 1, dtype=bool)
        if len(codes):
            cut[1:-1] = ~self.beside[n[:-1], n[1:]]
        cut[chars] = True
        at = np.flatnonzero(cut) if len(codes) else np.zeros(1, np.int64)
        to = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])
        return np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8), to[at], np.searchsorted(at, chars)

    def path(self, unit: str) -> list[int]:
        """The ids of a long unit: merges by a heap, or Viterbi. What the native folds do."""
        if not self.bpe:
            best, back = [0.0], [0]
            for e in range(1, len(unit) + 1):
                ends = [(best[s] + (self.score[i] if i is not None else self.floor), -s) for s in range(max(0, e - self.longest), e) for i in (self.id_of.get(unit[s:e]),) if i is not None or s == e - 1]
                top, s = max(ends)
                best.append(top)
                back.append(-s)
            cuts, e = [len(unit)], len(unit)
            while e:
                e = back[e]
                cuts.append(e)
            cuts.reverse()
        else:
            import heapq

            follow, before, heap = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1)), []

            def offer(s: int) -> None:
                if s >= 0 and follow[s] < len(unit):
                    i = self.id_of.get(unit[s : follow[follow[s]]])
                    if i is not None:
                        heapq.heappush(heap, (-self.score[i], s, follow[s], follow[follow[s]]))

            for s in range(len(unit)):
                offer(s)
            while heap:
                _, s, m, e = heapq.heappop(heap)
                if follow[s] == m and before[m] == s and follow[m] == e:
                    follow[s], before[m] = e, -2
                    if e < len(unit):
                        before[e] = s
                    offer(before[s])
                    offer(s)
            cuts = [0]
            while cuts[-1] < len(unit):
                cuts.append(follow[cuts[-1]])
        found = [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [i for p in found for i in ([self.id_of[p]] if p in self.id_of else self.fallback(p))]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, how many of each) of the texts whose ids follow each other, with their leading blanks."""
        data, starts, sizes = self.decoding
        size = sizes[ids]
        to = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return gathered(data, starts[ids], size), np.diff(to)


_known: dict[int, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """One for each worker process and model."""
    key = zlib.crc32(model)
    if key not in _known:
        _known[key] = Pieces(*read_model(model))
    return _known[key]


class Table:
    """Ids of units, found by the 128 bits of their bytes' hash. parts: rows of table_parts, in order of the first 64."""

    def __init__(self, parts: Iterable, kind: type):
        kinds = (np.uint64, np.uint64, np.int32, kind)
        held: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
        for part in parts:
            for column, k, data in zip(held, kinds, part, strict=True):
                column.append(np.frombuffer(data, k))
        self.flat, size, self.second, self.first = (np.concatenate(held.pop()) for _ in kinds)
        self.sizes = size.astype(np.uint8) if size.max(initial=0) < 256 else size
        self.starts = (np.cumsum(size, dtype=np.int64) - size).astype(np.uint32)

    def find(self, units: list[bytes]) -> np.ndarray:
        """Places of units in the table, -1 for those that it does not have."""
        pairs = byte_hashes(units)
        at = np.searchsorted(self.first, pairs[:, 0])
        out = np.full(len(units), -1, dtype=np.int64)
        for step in range(2):  # two units of a table with equal first hashes are told apart by the second
            near = np.minimum(at + step, len(self.first) - 1)
            if len(self.first):
                same = (self.first[near] == pairs[:, 0]) & (self.second[near] == pairs[:, 1])
                out[same] = near[same]
        return out


def _unit_rows(model: bytes, table=None):
    """Rows (row, text) to distinct units: with their counts, or (with a table) by row those that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), RUN_BYTES):
                body, cuts, first = own.units(data, offsets)
                which, units = numbered(body, cuts) if len(cuts) > 1 else (np.zeros(0, np.int64), [])
                if table is None:
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()).cast(pa.string()), pa.array(np.bincount(which, minlength=len(units)), pa.int64())], ["unit", "n"])
                    continue
                lacking = np.flatnonzero(table.value.find(units)[which] < 0)
                rows = np.searchsorted(first, lacking, side="right") - 1
                pairs = np.unique(np.stack([rows, which[lacking]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + pairs[:, 0])), pa.array([units[k] for k in pairs[:, 1]], pa.binary()).cast(pa.string())], ["row", "unit"])

    return run


def _long_paths(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.path(u) for u in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["unit", "n", "ids"])

    return run


def ranked_pieces(spark: SparkSession, model: bytes) -> DataFrame:
    """The piece table with `rank`: 1 for the best score, one rank for equal scores."""
    rows = pieces_of(model).rows
    rank = {s: k + 1 for k, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
    return spark.createDataFrame([(p, k, rank[s]) for p, k, s in rows], "piece string, piece_id long, rank long")


def edges_of(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """units (unit, n) with the array `edges`: longs of a piece's rank, where it begins and ends (6 bits each) and its
    id + 1 (20 bits), so that they sort by best score, leftmost of equals. A character without a piece has rank and id 0.
    """
    at = units.where(F.length("unit") > 0).select("unit", "n", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    subs = at.select("unit", "n", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, F.length("unit")))).alias("e"))
    subs = subs.withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    found = subs.join(F.broadcast(pieces), "piece", "left").where("piece_id is not null or e = s + 1")
    edge = F.expr("shiftleft(coalesce(rank, 0L), 32) | shiftleft(cast(s as long), 26) | shiftleft(cast(e as long), 20) | coalesce(piece_id + 1, 0L)")
    return found.groupBy("unit", "n").agg(F.collect_list(edge).alias("edges"))


#: Of an edge x, as bits: its ends, and what lies between them.
_BITS = "named_struct('ends', shiftleft(1L, cast(shiftright(x, 26) & 63 as int)) | shiftleft(1L, cast(shiftright(x, 20) & 63 as int)), 'inner', shiftleft(1L, cast(shiftright(x, 20) & 63 as int)) - shiftleft(2L, cast(shiftright(x, 26) & 63 as int)))"
#: Edges over two characters or more, best first.
SPANS = f"transform(filter(sort_array(edges), x -> (shiftright(x, 20) & 63) > (shiftright(x, 26) & 63) + 1), x -> {_BITS})"
#: The boundaries that merging leaves, as bits: 0 and the unit's length among them. An edge whose ends are not both
#: boundaries, or that has none inside, can't come back, so each step keeps only the others.
MERGED = """aggregate(sequence(1, length(unit)), named_struct('cuts', shiftleft(1L, length(unit) + 1) - 1, 'left', spans), (a, step) -> if(size(a.left) = 0, a,
    transform(array(a.cuts & ~coalesce(get(filter(a.left, x -> bit_count(a.cuts & x.inner) = 1), 0).inner, -1L)), cuts -> named_struct('cuts', if(cuts = 0, a.cuts, cuts),
    'left', if(cuts = 0, slice(a.left, 1, 0), filter(a.left, x -> (cuts & x.ends) = x.ends and (cuts & x.inner) <> 0))))[0]), a -> a.cuts)"""


def _viterbi(costs: str) -> str:
    """The boundaries of the path with the largest sum: the least cost of every prefix, and where its last edge begins.
    costs: SQL of an array with the cost of each rank, from 0 for characters without a piece."""
    return f"""aggregate(array_sort(transform(edges, x -> named_struct('e', cast(shiftright(x, 20) & 63 as int), 's', cast(shiftright(x, 26) & 63 as int), 'rank', cast(shiftright(x, 32) as int)))), named_struct('cost', array(0D), 'back', array(0)), (a, x) -> case
    when size(a.cost) = x.e then named_struct('cost', concat(a.cost, array(a.cost[x.s] + {costs}[x.rank])), 'back', concat(a.back, array(x.s)))
    when a.cost[x.s] + {costs}[x.rank] < a.cost[x.e] then named_struct('cost', concat(slice(a.cost, 1, x.e), array(a.cost[x.s] + {costs}[x.rank])), 'back', concat(slice(a.back, 1, x.e), array(x.s)))
    else a end, a -> aggregate(sequence(1, length(unit)), named_struct('e', length(unit), 'cuts', shiftleft(1L, length(unit))), (w, step) -> case
        when w.e = 0 then w else named_struct('e', a.back[w.e], 'cuts', w.cuts | shiftleft(1L, a.back[w.e])) end, w -> w.cuts))"""


#: The edges between neighbouring boundaries, in order: where they begin, and their id + 1. The boundaries are bound to
#: a variable, else the optimiser would put their fold into the lambda and run it for each edge.
CHOSEN = """transform(array(cuts), c -> sort_array(transform(filter(edges, x -> (c & (shiftleft(2L, cast(shiftright(x, 20) & 63 as int)) - shiftleft(1L, cast(shiftright(x, 26) & 63 as int))))
    = (shiftleft(1L, cast(shiftright(x, 26) & 63 as int)) | shiftleft(1L, cast(shiftright(x, 20) & 63 as int)))), x -> shiftleft(shiftright(x, 26) & 63, 20) | (x & 1048575))))[0]"""


@contextmanager
def groups_in_memory(spark: SparkSession, groups: int) -> Iterator[None]:
    """Lets an aggregation into arrays hold so many groups in memory before it sorts, for plans that run inside."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(groups))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lattice(units: DataFrame, model: bytes) -> DataFrame:
    """units (unit, n), distinct, with ids: those of the model's path."""
    own, spark = pieces_of(model), units.sparkSession
    edges = edges_of(units.where(F.length("unit") <= FOLD_CHARS), F.broadcast(ranked_pieces(spark, model)), own.longest)
    if own.bpe:
        short = edges.withColumn("spans", F.expr(SPANS)).withColumn("cuts", F.expr(MERGED))
    else:
        scores = sorted({s for _, _, s in own.rows}, reverse=True)
        short = edges.crossJoin(F.broadcast(spark.createDataFrame([([-own.floor, *(-s for s in scores)],)], "costs array<double>"))).withColumn("cuts", F.expr(_viterbi("costs")))
    short = short.withColumn("chosen", F.expr(CHOSEN))
    byte_ids = f"array({', '.join(str(own.bytes[b]) for b in range(256))})" if own.bytes else ""
    char = "substring(unit, cast(shiftright(x, 20) as int) + 1, 1)"
    raw = f"transform(sequence(1, length(hex({char})), 2), k -> {byte_ids}[cast(conv(substring(hex({char}), k, 2), 16, 10) as int)])" if byte_ids else f"array({own.unknown})"
    own_id = "cast((x & 1048575) - 1 as int)"
    ids = F.expr(f"if(exists(chosen, x -> (x & 1048575) = 0), flatten(transform(chosen, x -> if((x & 1048575) = 0, {raw}, array({own_id})))), transform(chosen, x -> {own_id}))")
    return short.select("unit", "n", ids.alias("ids")).union(units.where(F.length("unit") > FOLD_CHARS).mapInArrow(_long_paths(model), "unit string, n long, ids array<int>"))


def _hashed(kind: type):
    """Rows (unit, ids) to the two hashes, the first such that signed longs sort alike, and the ids' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, lists = byte_hashes(batch.column(0).cast(pa.binary()).to_pylist()), batch.column(1)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(kind))
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))] * flat.itemsize
            ids = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(pairs[:, 0] ^ TOP_BIT)), pa.array(signed(pairs[:, 1].copy())), ids], ["first", "second", "ids"])

    return run


def _packed(kind: type):
    """Each batch's columns as bytes: both hashes, how many ids each unit has, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                ids = batch.column(2).to_pylist()
                sizes = np.array([len(x) for x in ids], np.int32) // np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in ((first ^ TOP_BIT).tobytes(), second.tobytes(), sizes.tobytes(), b"".join(ids))], ["first", "second", "sizes", "ids"])

    return run


def table_parts(coded: DataFrame, kind: type, size: int) -> DataFrame:
    """The rows of Table, hashed, sorted and packed on the executors, in tasks of some PART_BYTES of size in all."""
    rows = coded.select("unit", "ids").mapInArrow(_hashed(kind), "first long, second long, ids binary")
    rows = rows.repartitionByRange(size // PART_BYTES + 1, "first").sortWithinPartitions("first")
    return rows.mapInArrow(_packed(kind), "first binary, second binary, sizes binary, ids binary")


def unit_table(coded: DataFrame, model: bytes, limit: int = TABLE_BYTES) -> tuple[Table, int]:
    """The table of the most frequent units that fit limit bytes, and the count that a unit in it has at least. The
    driver takes one task's part after the other, so that neither its JVM nor Python holds the units themselves."""
    size = F.sum(24 + 2 * F.size("ids"))  # two hashes, a place and a size, and ids of two bytes each
    levels = coded.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(size.alias("size")).orderBy(F.desc("level")).collect()
    total, least = 0, 0
    for r in levels:  # at most 63 rows
        if total + r["size"] > limit:
            least = 2 ** (r["level"] + 1)
            break
        total += r["size"]
    kind = np.uint16 if len(pieces_of(model).score) <= 1 << 16 else np.int32
    return Table(table_parts(coded.where(F.col("n") >= least), kind, total).toLocalIterator(), kind), least


def _assemble(model: bytes, table, digest: bool):
    """Rows (row, text, rare) to ids or, with digest, to what the query tells of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pieces_of(model), table.value
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), RUN_BYTES):
                body, cuts, first = own.units(data, offsets)
                which, units = numbered(body, cuts) if len(cuts) > 1 else (np.zeros(0, np.int64), [])
                at = known.find(units)
                starts, sizes, flat = (known.starts[at].astype(np.int64), known.sizes[at].astype(np.int64), known.flat) if len(known.first) else (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), known.flat)
                if (at < 0).any():
                    rare = {u.encode(): x for r in batch.column(2).slice(i, j - i).to_pylist() for u, x in ((p["unit"], p["ids"]) for p in r or ())}
                    more = [rare[units[k]] for k in np.flatnonzero(at < 0)]
                    sizes[at < 0] = [len(x) for x in more]
                    starts[at < 0] = len(flat) + np.cumsum(sizes[at < 0]) - sizes[at < 0]
                    flat = np.concatenate([flat, *(np.array(x, np.int32) for x in more)])
                ids = gathered(flat, starts[which], sizes[which])
                ends = np.concatenate([[0], np.cumsum(sizes[which])])[first]
                if not digest:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], ["row", "ids"])
                    continue
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                text, size = own.decoded(ids, np.diff(ends))
                to = np.concatenate([[0], np.cumsum(size)])
                same = [text[to[k] + (size[k] > 0) : to[k + 1]].tobytes() == data[offsets[k] : offsets[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["row", "n_pieces", "ids_crc32", "round_trip"])

    return run


def _encoded(docs: DataFrame, model: bytes, text_col: str, keep: list[str], digest: bool, limit: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    units = rows.select(F.lit(0).alias("row"), "text").mapInArrow(_unit_rows(model), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = written(units, "units").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "unit")
    with groups_in_memory(spark, GROUPS):
        coded = written(lattice(units, model), "piece-units")
    made, least = unit_table(coded, model, limit)
    table = spark.sparkContext.broadcast(made)
    del made
    if least:
        rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "piece-rows")
        lacking = rows.select("no", "text").mapInArrow(_unit_rows(model, table), "no long, unit string")
        rare = lacking.join(coded.where(F.col("n") < least), "unit").groupBy("no").agg(F.collect_list(F.struct("unit", "ids")).alias("rare"))
        rows = rows.join(rare, "no", "left").select("row", "text", "rare")
    else:
        rows = rows.select("row", "text", F.lit(None).cast("array<struct<unit:string,ids:array<int>>>").alias("rare"))
    return rows.mapInArrow(_assemble(model, table, digest), f"row {kind}, " + ("n_pieces long, ids_crc32 long, round_trip boolean" if digest else "ids array<int>"))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "piece_ids", keep: list[str] | None = None, limit: int = TABLE_BYTES) -> DataFrame:
    """The columns keep of docs (all, unless named), with out_col: the ids of each whole text. A column of docs with
    that name is replaced."""
    keep = [c for c in keep or docs.columns if c != out_col]
    out = _encoded(docs, model, text_col, keep, False, limit)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("ids").alias(out_col))


def _decode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for batch in batches:
            lists = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            text, size = own.decoded(np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([len(x) for x in lists], np.int64))
            to = np.concatenate([[0], np.cumsum(size)])
            texts = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(to, to[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())], ["row", "decoded"])

    return run


def decode(docs: DataFrame, model: bytes, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """docs with out_col: the text of the ids. A column of docs with that name is replaced."""
    bounded_batches(docs.sparkSession)
    row = docs.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    out = row.mapInArrow(_decode(model), f"row {row.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != out_col], F.col("decoded").alias(out_col))


def model_file(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """For each row: id, n_pieces, the CRC-32 of its ids (little-endian, 32 bits) and whether decoding gives the text back."""
    out = _encoded(docs, model, text_col, [id_col], True, limit)
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), "n_pieces", "ids_crc32", "round_trip")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).select("doc_id", "text"), model_file())
