"""Chunks of one source file. Plain Python: runs inside Arrow batches.

A unit is a file or an entity with a chunk of its own. The lines of a function or method are all shown; a file or type
shows its definitions that are units by their first lines and "...". Every step is linear in the lines.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

#: Characters of a chunk, lines that neighbouring parts share, lines searched for an entity's name.
MAX_CHARS, OVERLAP, SIGNATURE_LINES = 2000, 3, 5
CALLABLE, TYPES = {"function", "method"}, {"class", "interface"}


def lines_of(content: bytes) -> list[str]:
    """Lines end at line feeds only; one carriage return before it belongs to the ending."""
    return [x[:-1] if x.endswith("\r") else x for x in content.decode("utf-8", "replace").split("\n")]


def signature(lines: list[str], entity: dict) -> int:
    """Number of the line, among an entity's first, that has its name."""
    first = entity["start_line"]
    upto = min(first + SIGNATURE_LINES - 1, entity["end_line"], len(lines))
    return next((n for n in range(first, upto + 1) if entity["name"] in lines[n - 1]), first)


def units(lines: list[str], entities: list[dict]) -> Iterator[tuple[dict, list[tuple[int, int, int]]]]:
    """(entity, definitions shown short as (first, signature, last)). entities: the file, then the others, each after
    its parent. One that ends on its signature, or lies in a callable or in such an entity, is shown there."""
    ends = {e["id"]: signature(lines, e) for e in entities}
    hidden, short, own = set(), {}, []
    for e in entities:
        up = e["parent_id"]
        if up in hidden:
            hidden.add(e["id"])
        elif e["entity_type"] == "file" or e["entity_type"] in TYPES | CALLABLE:
            alone = e["end_line"] > ends[e["id"]]
            if e["entity_type"] == "file" or alone:
                own.append(e)
                if up is not None:
                    short.setdefault(up, []).append((e["start_line"], ends[e["id"]], e["end_line"]))
        if e["entity_type"] in CALLABLE or e["end_line"] <= ends[e["id"]]:
            hidden.add(e["id"])  # what lies in it is shown by it
    for e in own:
        yield e, [] if e["entity_type"] in CALLABLE else short.get(e["id"], [])


def shown(lines: list[str], entity: dict, short: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(number, text) of a unit's lines."""
    whole = entity["entity_type"] == "file"
    at, last = (1, len(lines)) if whole else (entity["start_line"], min(entity["end_line"], len(lines)))
    spans: dict[int, tuple[int, int]] = {}
    for first, kept, end in short:
        before = spans.get(first, (0, 0))
        spans[first] = max(before[0], kept), max(before[1], end)
    out: list[tuple[int, str]] = []
    plain = lambda a, b: [(n, lines[n - 1]) for n in range(a, min(b, last) + 1)]
    for first in sorted(spans):
        if not at <= first <= last:
            continue  # inside a definition that is short itself
        kept, end = spans[first]
        out += plain(at, first - 1) + plain(first, kept)
        if end > kept:
            text = out[-1][1]
            out.append((kept + 1, text[: len(text) - len(text.lstrip())] + "    ..."))
        at = max(kept, end) + 1
    return out + plain(at, last)


def has_module_code(lines: list[str], short: list[tuple[int, int, int]]) -> bool:
    """Whether a line that is not blank lies outside all short definitions."""
    at = 1
    for first, _, end in [*sorted(short), (len(lines) + 1, 0, 0)]:
        if any(lines[n - 1].strip() for n in range(at, first)):
            return True
        at = max(at, end + 1)
    return False


def pieces(numbered: list[tuple[int, str]], most: int) -> list[tuple[int, str]]:
    """Without blank lines at both ends; lines longer than most cut into pieces of the same number."""
    full = [k for k, (_, text) in enumerate(numbered) if text.strip()]
    kept = numbered[full[0] : full[-1] + 1] if full else []
    return [(n, text[a : a + most]) for n, text in kept for a in range(0, max(len(text), 1), most)]


def windows(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of greedy windows of lines with these sizes: as many as fit most, one at least; the next begins
    overlap lines before the end, but after the window's first line."""
    sums, out, start = [0, *accumulate(sizes)], [], 0
    while start < len(sizes):
        end = max(start + 1, bisect_right(sums, sums[start] + most) - 1)
        out.append((start, end))
        start = len(sizes) if end >= len(sizes) else max(end - overlap, start + 1)
    return out


def chunks(content: bytes, entities: list[dict], most: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[dict]:
    """entity, part, part_count, start_line, end_line and text of a file's chunks, in source order."""
    lines = lines_of(content)
    for entity, short in units(lines, entities):
        if entity["entity_type"] == "file" and not has_module_code(lines, short):
            continue
        numbered = pieces(shown(lines, entity, short), most)
        parts = windows([len(text) + 1 for _, text in numbered], most, overlap)
        for k, (a, b) in enumerate(parts, start=1):
            yield {"entity": entity, "part": k, "part_count": len(parts), "start_line": numbered[a][0], "end_line": numbered[b - 1][0], "text": "\n".join(text for _, text in numbered[a:b])}
