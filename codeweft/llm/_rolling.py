"""Vectorised words and Rabin-Karp hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    own = _powers.get(base)
    if own is None or len(own) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), base, dtype=_U)
        steps[0] = 1
        own = np.cumprod(steps)
        if n <= 4 * SLICE_BYTES:  # what one very long text needs is not kept
            _powers[base] = own
    return own[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values (modulo 2 ** 64, then mixed). Values must be spread over
    all 64 bits: of small or related values, products of powers of two could cancel."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n))


def coded(body: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The strings body[cuts[i]:cuts[i + 1]] as numbers of the distinct ones."""
    strings = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    return strings.dictionary_encode()


def numbered(body: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each string body[cuts[i]:cuts[i + 1]] among the distinct ones, and these."""
    found = coded(body, cuts)
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def byte_hashes(strings: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each string's bytes, as rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), dtype="<u8").reshape(-1, 2)


class Words:
    """The words of some whole texts. first[i]:first[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        self.inside = inside = ~_SPACE[data]
        before = np.zeros(len(data), dtype=bool)
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cuts = offsets[1:-1]
            before[cuts[cuts < len(data)]] = False
            after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def coded(self) -> pa.DictionaryArray:
        return coded(self.data[self.inside], np.concatenate([[0], np.cumsum(self.ends - self.starts)]))

    def numbers(self) -> np.ndarray:
        """The number of each word among the distinct ones."""
        return self.coded().indices.to_numpy()

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word, over its bytes."""
        found = self.coded()
        pairs, which = byte_hashes(found.dictionary.to_pylist()), found.indices.to_numpy()
        return pairs[which, 0], pairs[which, 1]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + sizes[k]] for all k, one after the other."""
    to = np.cumsum(sizes)
    return flat[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
