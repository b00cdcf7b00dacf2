"""Runs of whole texts of bounded size, for operators that work on Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def text_runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about limit characters; null counts as empty."""
    texts, size, first = [], 0, 0
    for k, x in enumerate(column):
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= limit:
            yield first, texts
            texts, size, first = [], 0, k + 1
    if texts:
        yield first, texts
