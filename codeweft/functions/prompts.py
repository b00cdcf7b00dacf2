"""Text of prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(text: Column, attribute: bool = False) -> Column:
    """text safe in markup; in an attribute quotes too."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if attribute else [])):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def source_line(number: Column, path: Column, start: Column, end: Column, origin: Column) -> Column:
    """One numbered source."""
    lines = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), escaped(path), F.lit(":"), lines, F.lit(" ("), origin, F.lit(")"))


def chunk_element(number: Column, path: Column, name: Column, text: Column) -> Column:
    """A chunk of code as an element; attributes and text are safe."""
    head = F.concat(F.lit('<chunk source="'), number.cast("string"), F.lit('" path="'), escaped(path, True), F.lit('" name="'), escaped(name, True), F.lit('">'))
    return F.concat(head, F.lit("\n"), escaped(text), F.lit("\n</chunk>"))


def section(tag: str, lines: Column) -> Column:
    """Lines of a section between its tags; empty where there are none."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"<{tag}>\n"), F.array_join(lines, "\n"), F.lit(f"\n</{tag}>"))).otherwise(F.lit(""))


def prompt(sections: list[Column], status: Column, question: Column) -> Column:
    """The user text: sections that have lines, how complete the retrieval was, the question, and what to do."""
    body = F.array_join(F.filter(F.array(*sections), lambda s: s != ""), "\n")
    closing = "Answer from the context alone, and cite its sources as [n]."
    return F.concat(F.lit("<context>\n"), body, F.lit("\n</context>\n<retrieval>"), status, F.lit("</retrieval>\n<question>"), escaped(question), F.lit(f"</question>\n{closing}"))
