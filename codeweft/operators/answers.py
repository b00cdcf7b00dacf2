"""From a context to an answer: names, prompts for a provider, citations checked, warnings."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.vectors import CITATION, citations

INSUFFICIENT = "The context does not answer this."


class AnswerProvider(Protocol):
    """A language model, or what stands for one: a column of answers for a column of prompts."""

    name: str

    def answer(self, prompt: Column) -> Column: ...


class Extractive:
    """Needs no model: it repeats the first lines that a prompt numbers as sources, each with its citation."""

    name = "extractive"

    def __init__(self, lines: int = 3):
        self.lines = lines

    def answer(self, prompt: Column) -> Column:
        found = F.slice(F.regexp_extract_all(prompt, F.lit(r"(?m)^(\[\d+\] [^\n]*)$"), F.lit(1)), 1, self.lines)
        cited = F.transform(found, lambda s: F.regexp_replace(s, r"^\[(\d+)\] (.*)$", r"See $2 [$1]."))
        return F.when(F.size(found) > 0, F.array_join(cited, " ")).otherwise(F.lit(INSUFFICIENT))


_PROVIDERS: dict[str, Callable[[], AnswerProvider]] = {"extractive": Extractive}


def register(name: str, make: Callable[[], AnswerProvider]) -> None:
    _PROVIDERS[name] = make


def provider(name: str) -> AnswerProvider:
    if name not in _PROVIDERS:
        raise ValueError(f"no provider {name}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]()


def named(rows: DataFrame, nodes: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """rows with `entity_name`: the entity's qualified name, or what follows the project in its id."""
    names = nodes.select(F.col("id").alias(entity_id), F.col("qualified_name").alias("_name"))
    return rows.join(names, entity_id, "left").withColumn("entity_name", F.coalesce("_name", F.regexp_replace(F.col(entity_id), "^[^:]*:", ""), entity_id)).drop("_name")


def assembled(answers: DataFrame, key: str, text: str, known: int, truncated: Column | None = None, status: Column | None = None) -> DataFrame:
    """answers with `cited`, `unknown` (sorted numbers as text) and `warnings`: unknown citations, an answer that was
    cut off, a context that was not complete, an answer that says the context is not enough. A null text counts as empty."""
    rows = answers.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    told = rows.join(citations(rows, key, "_text", known), key)
    warning = lambda when, what: F.when(when, what)
    warnings = F.array_compact(
        F.array(
            warning(F.col("unknown") != "", F.concat(F.lit("unknown sources: "), "unknown")),
            warning(F.lit(False) if truncated is None else truncated, F.lit("the answer was cut off")),
            warning(F.lit(False) if status is None else status != "complete", F.lit("the context is not complete")),
            warning(F.startswith("_text", F.lit(INSUFFICIENT)), F.lit("the context was not enough")),
        )
    )
    return told.withColumn("warnings", warnings).drop("_text")


def linked(text: Column, known: int) -> Column:
    """text with each bracket of citations as a link `<n>`, where all its numbers are known; others stay as they are."""
    head = "^" + CITATION
    number = lambda p: F.transform(F.split(F.regexp_extract(p, head, 1), r"\s*,\s*"), lambda n: n.try_cast("int"))
    good = lambda p: F.forall(number(p), lambda n: n.isNotNull() & (n >= 1) & (n <= known))
    # cut before each bracket, so a piece begins with at most one citation; what is no citation gives a null number
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?=\[)")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.coalesce(good(p), F.lit(False)), F.regexp_replace(p, head, "<$1>")).otherwise(p)), "")


def summary_prompt(facts: DataFrame) -> DataFrame:
    """(prompt): the numbered facts of a project, in order, and what is asked of them; one row."""
    lines = facts.agg(F.array_sort(F.collect_list(F.struct("number", "fact"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda f: F.concat(F.lit("["), f.number.cast("string"), F.lit("] "), f.fact)), "\n")
    return lines.select(F.concat(F.lit("<facts>\n"), body, F.lit("\n</facts>\nSay in a few sentences how the project is built; cite facts as [n].")).alias("prompt"))


def summarised(facts: DataFrame, by: AnswerProvider) -> DataFrame:
    """(summary, cited, unknown, warnings): a summary from the facts alone. A graph without facts gives no row."""
    n = facts.count()  # at most eleven
    answered = summary_prompt(facts).select(F.lit(1).alias("k"), by.answer(F.col("prompt")).alias("summary"))
    return assembled(answered, "k", "summary", n).drop("k") if n else assembled(answered.limit(0), "k", "summary", 0).drop("k")


def missing_labels(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected items (column item: `path::qualified name` or `path`) that no node has; an evaluation must have none."""
    items = nodes.select(F.when(F.col("entity_type") == "file", F.col("file_path")).otherwise(F.concat_ws("::", "file_path", "qualified_name")).alias("item"))
    return expected.join(items, "item", "left_anti")
