r"""Token ids in fixed-width bit packing, with block offsets.

A folder has `ids`, the files, and `index`, a Parquet table with one row for each file. A file is

    header     72 bytes, little-endian: magic "BPK2", bits u32, range u64, sequence u64, documents u64, ids u64,
               ids of a block u64, blocks u64, least and largest doc_id i64
    documents  documents x (doc_id i64, first id u64: ids of the file's documents before it)
    blocks     (blocks + 1) x u64: the byte at which each block begins, and the end of the last
    ids        blocks of BLOCK_IDS ids (the last has fewer), each in `bits` bits, the lowest bit first, padded
               to whole bytes

and one b"\n" that no reader relies on. `bits` is the least that holds the vocabulary (16 for 50,257 ids).
`PackedFile` reads a document, a block or any run of ids from the header, the offsets and the blocks that hold
them, by positional reads; numpy unpacks a block in one go. The index (file, range, sequence, first id of the
whole folder, documents, ids, least and largest doc_id) tells in which files a document is. Files hold whole
documents, about FILE_IDS ids, and follow ascending doc_id through ranges and sequences. They are written and
read by Spark's own sources, so any store that Spark reaches will do, and a lost task is written again by
another; the index checks each file's length against its header.

Null text counts as empty and has the end id only. Null ids come last, as LAST_ID in the files. Rows with
equal ids follow each other, ordered by a hash of their text, and may be dealt to several ranges, so that no task
gets more than its share. Rows equal in both are written each. An empty table gives an empty folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm._common import LAST_ID, bounded_batches, documents, id_key, id_marks, new_path, small, text_of, tie_of, written
from codeweft.llm._rolling import _SPACE, gathered, numbered, slices

MAGIC, HEADER = b"BPK2", "<4sIQQQQQQqq"
HEADER_BYTES = struct.calcsize(HEADER)
FILE_IDS, BLOCK_IDS = 1 << 22, 1 << 14
#: Chunks that a worker keeps, and bytes of text that it encodes at once.
CACHE_CHUNKS, RUN_BYTES = 400_000, 4 << 20
END_ID = 2
#: First bytes of white space that the tokenizer knows beside the characters at which texts are cut into chunks.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: That white space: U+001C to U+001F, U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_OTHER_SPACE = {chr(c).encode() for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n of a block's packed ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n, offset=start * bits // 8).astype(np.uint32)
    low = start * bits // 8
    raw = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[low : ((start + n) * bits + 7) // 8], bitorder="little")
    own = raw[start * bits - 8 * low :][: n * bits].reshape(n, bits).astype(np.uint32)
    return (own << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


#: ASCII characters by kind: 0 white space, 1 letter, 2 digit, 3 apostrophe, 4 other, 9 a byte beyond ASCII.
_KIND = np.full(256, 9, dtype=np.uint8)
_KIND[:128] = 4
_KIND[[32, *range(9, 14)]], _KIND[39] = 0, 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
#: Neighbouring kinds between which the tokenizer's pattern always ends a word, whatever stands around them.
_APART = np.zeros((10, 10), dtype=bool)
for _a, _b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (4, 1), (4, 2), (1, 0), (2, 0), (3, 0), (4, 0), (9, 0)):
    _APART[_a, _b] = True


class ChunkEncoder:
    """Ids of texts by the tokenizer, which sees each chunk once while it is known. Chunks end where the tokenizer's
    pattern ends a word whatever stands around: before white space, and between ASCII letters, digits and other
    characters (but not after an apostrophe, which may begin an ending). So a text's ids are those of its chunks in
    a row. Texts with other kinds of white space, or with an added token's text, go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each token; a byte-level token has one character for each byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.known: dict[bytes, int] = {}
        self.sizes, self.starts, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many of each). Chunks that end in another character than white space are encoded
        as one text, where each begins with white space of its own or after a line feed; its ids are told apart by
        their bytes."""
        own = [bool(_SPACE[c[0]]) + 2 * bool(_SPACE[c[-1]]) for c in chunks]
        spaced, bare, blank = ([c for c, k in zip(chunks, own, strict=True) if k == kind] for kind in (1, 0, 3))
        ids, sizes = [], []
        for many, gap in ((spaced, b""), (bare, b"\n")):
            if many:
                got = np.array(self.tokenizer.encode(gap.join(many).decode(), add_special_tokens=False).ids, dtype=np.uint32)
                width = np.array([len(c) for c in many], np.int64)
                begins = np.cumsum(width + len(gap)) - width - len(gap)
                at = np.cumsum(self.width[got]) - self.width[got]
                which = np.searchsorted(begins, at, side="right") - 1
                real = at < (begins + width)[which]
                ids.append(got[real])
                sizes.append(np.bincount(which[real], minlength=len(many)))
        more = [x.ids for x in self.tokenizer.encode_batch([c.decode() for c in blank], add_special_tokens=False)]
        chunks[:] = spaced + bare + blank
        return np.concatenate([*ids, *(np.array(x, np.uint32) for x in more)]), np.concatenate([*sizes, np.array([len(x) for x in more], np.int64)])

    def add(self, chunks: list[bytes]) -> None:
        ids, sizes = self.ids_of(chunks)
        n = len(self.known)
        while n + len(chunks) > len(self.sizes):
            self.sizes, self.starts = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.sizes[n : n + len(chunks)] = sizes
        self.starts[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def forget(self, n: int, used: int) -> None:
        """Drop all chunks but the first n."""
        while len(self.known) > n:
            self.known.popitem()
        self.used = used

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each) for texts data[offsets[i]:offsets[i + 1]]. The first CACHE_CHUNKS
        chunks stay known, as the frequent ones come early."""
        n, used, texts = len(self.known), self.used, len(offsets) - 1
        odd = odd_texts(data, offsets, self.added)
        kind = _KIND[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[1:-1] = _APART.ravel()[kind[:-1] * np.uint8(10) + kind[1:]]
        begins[offsets] = True
        cuts = np.flatnonzero(begins)
        which, chunks = numbered(data, cuts) if len(cuts) > 1 else (np.zeros(0, np.int64), [])
        fresh = [c for c in chunks if c not in self.known]
        if fresh:
            self.add(fresh)
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[which]
        size = self.sizes[number]
        ids = gathered(self.flat, self.starts[number], size)
        to = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, offsets)]
        if len(self.known) > CACHE_CHUNKS:
            self.forget(n, used)
        if not len(odd):
            return ids, np.diff(to)
        whole = {k: np.array(self.tokenizer.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32) for k in odd}
        parts = [whole[k] if k in whole else ids[to[k] : to[k + 1]] for k in range(texts)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def odd_texts(data: np.ndarray, offsets: np.ndarray, added: list[bytes]) -> np.ndarray:
    """The texts that have white space beside that at which chunks begin, or an added token's text."""
    raw = data.tobytes()
    found = [k for k in np.flatnonzero(_LEAD[data]).tolist() if raw[k : k + (1 if raw[k] < 0x80 else 2 if raw[k] == 0xC2 else 3)] in _OTHER_SPACE]
    for token in added:
        at = raw.find(token)
        while at >= 0:
            found.append(at)
            at = raw.find(token, at + 1)
    at = np.array(found, dtype=np.int64)
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(vocabulary: str) -> ChunkEncoder:
    """One for each worker process and vocabulary; workers are used for many tasks."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(vocabulary)
    return _encoders[key]


def _ranges(keys: np.ndarray, ties: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The range of each row: keys up to the first mark are in range 0, and so on. A key that is several marks has
    that many ranges, among which its rows are dealt by tie, in order."""
    low, high = np.searchsorted(marks, keys, side="left"), np.searchsorted(marks, keys, side="right")
    return low + ((ties >> 32) * np.maximum(high - low, 1) >> 31)


def _encode(vocabulary: str, end_id: int, bits: int, marks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, edges = _encoder(vocabulary), np.array(marks, dtype=np.int64)
        for batch in batches:
            keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in slices(batch.column(2), RUN_BYTES):
                ids, n = encoder.encode(data, offsets)
                ids, n, docs = np.insert(ids, np.cumsum(n), end_id), n + 1, []
                to = np.cumsum(n)
                docs = [ids[b - k : b] for b, k in zip(to.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(_ranges(keys[i:j], ties[i:j], edges)), pa.array(keys[i:j]), pa.array(ties[i:j]), pa.array(n, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()), pa.array([pack(x, bits) for x in docs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["range", "key", "tie", "n", "crc", "packed"])

    return run


def packed_file(bits: int, rng: int, seq: int, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A file of documents with these keys and numbers of ids."""
    parts = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    table = np.empty((len(keys), 2), dtype="<i8")
    table[:, 0], table[:, 1] = keys, np.cumsum(counts) - counts
    begin = HEADER_BYTES + 16 * len(keys) + 8 * (len(parts) + 1)
    offsets = begin + np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    head = struct.pack(HEADER, MAGIC, bits, rng, seq, len(keys), len(ids), block, len(parts), int(keys.min()), int(keys.max()))
    return b"".join([head, table.tobytes(), offsets.astype("<u8").tobytes(), *parts])


def _files(bits: int):
    """Sorted rows (range, key, n, packed) to files."""

    def made(rng: int, seq: int, docs: list[tuple[int, int]], parts: list[bytes]) -> pa.RecordBatch:
        keys, counts = (np.array(x, dtype=np.int64) for x in zip(*docs, strict=True))
        ids = np.concatenate([unpack(p, bits, 0, int(n)) for p, n in zip(parts, counts, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array([packed_file(bits, rng, seq, keys, counts, ids)], pa.binary())], ["file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, seq, docs, parts, total = -1, 0, [], [], 0
        for batch in batches:
            for r, key, n, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if docs and (r != rng or total + n > FILE_IDS):
                    yield made(rng, seq, docs, parts)
                    seq, docs, parts, total = (seq + 1 if r == rng else 0), [], [], 0
                elif r != rng:
                    seq = 0
                rng = r
                docs.append((key, n))
                parts.append(packed)
                total += n
        if docs:
            yield made(rng, seq, docs, parts)

    return run


class PackedFile:
    """A file through read(position, bytes): only the header, the offsets and the blocks asked for are read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.bits, self.range, self.sequence, self.documents, self.ids, self.block_ids, self.blocks, self.least, self.largest = struct.unpack(HEADER, bytes(read(0, HEADER_BYTES)))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")

    def table(self) -> np.ndarray:
        """(doc_id, first id) of all documents."""
        return np.frombuffer(self.read(HEADER_BYTES, 16 * self.documents), dtype="<i8").reshape(-1, 2)

    def offsets(self, first: int, n: int) -> np.ndarray:
        """The bytes at which blocks first .. first + n - 1 begin, and the end of the last."""
        return np.frombuffer(self.read(HEADER_BYTES + 16 * self.documents + 8 * first, 8 * (n + 1)), dtype="<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        return self.run(k * self.block_ids, min(self.block_ids, self.ids - k * self.block_ids))

    def run(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file."""
        if n <= 0:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        at = self.offsets(first, last - first + 1)
        data = memoryview(self.read(int(at[0]), int(at[-1] - at[0])))
        parts = []
        for k in range(first, last + 1):
            low, high = max(start, k * self.block_ids), min(start + n, (k + 1) * self.block_ids)
            parts.append(unpack(data[at[k - first] - at[0] : at[k - first + 1] - at[0]], self.bits, low - k * self.block_ids, high - low))
        return np.concatenate(parts)

    def document(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this id. Documents are in ascending order, so the table is searched."""
        table = self.table()
        low, high = np.searchsorted(table[:, 0], key, side="left"), np.searchsorted(table[:, 0], key, side="right")
        ends = np.append(table[1:, 1], self.ids)
        return [self.run(int(table[k, 1]), int(ends[k] - table[k, 1])) for k in range(low, high)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            file = PackedFile(lambda at, n, data=data: data[at : at + n])
            table = file.table()
            ids, ends = file.run(0, file.ids).astype("<u4"), np.append(table[1:, 1], file.ids)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(table[:, 1], ends, strict=True)]
            whole = lambda x, n=len(table): pa.array(np.full(n, x, np.int64))
            yield pa.RecordBatch.from_arrays([whole(file.range), whole(file.sequence), pa.array(np.ascontiguousarray(table[:, 0])), pa.array(np.ascontiguousarray(table[:, 1])), pa.array(ends - table[:, 1]), pa.array(crc, pa.int64())], ["range", "seq", "key", "at", "n", "crc"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, length, head in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            file = PackedFile(lambda at, n, head=head: head[at : at + n])
            left = file.ids - max(0, file.blocks - 1) * file.block_ids
            size = HEADER_BYTES + 16 * file.documents + 8 * (file.blocks + 1) + max(0, file.blocks - 1) * ((file.block_ids * file.bits + 7) // 8) + (left * file.bits + 7) // 8
            if length not in (size, size + 1):  # the writer ends a file by a line feed
                raise ValueError(f"{name} has {length} bytes instead of {size}")
            out.append((name, file.range, file.sequence, file.documents, file.ids, file.least, file.largest))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["file", "range", "seq", "documents", "ids", "least", "largest"])


def write_packed(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write them to path in ascending id order, then the index. vocabulary: the tokenizer's JSON."""
    spark = docs.sparkSession
    bounded_batches(spark)
    from tokenizers import Tokenizer

    bits = width(max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1))
    rows = docs.select(id_key(id_col).alias("key"), text_of(text_col).alias("text"))
    marks = id_marks(rows, "key", "text")
    coded = rows.select("key", tie_of("text").alias("tie"), "text").mapInArrow(_encode(vocabulary, end_id, bits, marks), "range long, key long, tie long, n long, crc long, packed binary")
    dealt = coded.repartitionById(len(marks) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "key", "tie", "crc", "n").select("range", "key", "n", "packed")
    files = dealt.mapInArrow(_files(bits), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/ids")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/ids")
    heads = found.select("path", "length", F.substring("content", 1, HEADER_BYTES).alias("head")).mapInArrow(_headers, "file string, range long, seq long, documents long, ids long, least long, largest long")
    heads = written(heads, "packed-heads")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range: at most MAX_RANGES, whatever the corpus
    ranges = heads.groupBy("range").agg(F.sum("ids").alias("n")).select("range", before(Window.orderBy("range")).alias("_r"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads.withColumn("_s", own).join(F.broadcast(ranges), "range").select("file", "range", "seq", (F.col("_r") + F.col("_s")).alias("start"), "documents", "ids", "least", "largest").write.parquet(f"{path}/index")


INDEX = "file string, range long, seq long, start long, documents long, ids long, least long, largest long"


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/ids").select("content")
    rows = files.mapInArrow(_read, "range long, seq long, key long, at long, n long, crc long")
    starts = small(index_of(spark, path).select("range", "seq", F.col("start").alias("_start")), 24)
    out = rows.join(starts, ["range", "seq"])
    return out.select(F.when(F.col("key") < LAST_ID, F.col("key")).alias("doc_id"), (F.col("_start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def open_packed(spark: SparkSession, file: str) -> PackedFile:
    """A file of the index in any of Spark's file systems, for positional reads from the driver."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(at: int, n: int) -> bytes:
        stream = system.open(path)
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    return PackedFile(read)


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents with this id, from the index and the blocks that hold them."""
    key = LAST_ID if doc_id is None else doc_id
    files = index_of(spark, path).where((F.col("least") <= key) & (F.col("largest") >= key)).orderBy("range", "seq").select("file").collect()
    return [ids for f in files for ids in open_packed(spark, f.file).document(key)]


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed-ids")
    write_packed(documents(spark, sf_dir).select("doc_id", "text"), path, vocabulary_file())
    return read_packed(spark, path)
