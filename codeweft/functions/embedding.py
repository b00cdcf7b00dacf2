"""Embedding providers: a plug point, and a built-in one of SQL functions.

A provider gives a column of vectors of unit length for a column of texts. The built-in one needs no model: each word
adds +1 or -1 to the dimension that its MD5 chooses. It stays on the JVM, so whole tables are embedded without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


class EmbeddingProvider(Protocol):
    name: str
    dimension: int
    query_prefix: str

    def embed(self, text: Column) -> Column: ...


class HashedWords:
    """Signed feature hashing of lower-case words. A text without words gives the zero vector."""

    query_prefix = ""

    def __init__(self, dimension: int = 64):
        if not 1 <= dimension <= 4096:
            raise ValueError("dimension must be 1 to 4096")
        self.name, self.dimension = f"hashed-words-{dimension}", dimension

    def embed(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
        code = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))
        # dimension and sign as one number: 1 + dimension, negative for half of the words; runs of it are counted in
        # one fold, so the work is that of sorting, and then bounded by the dimension
        at = F.sort_array(F.transform(code, lambda h: F.when(h.bitwiseAND(1) == 0, 1).otherwise(-1) * (1 + F.shiftright(h, 1) % self.dimension)))
        run = lambda a, n: F.struct(a.alias("a"), n.alias("n"))
        start = F.struct(F.array().cast("array<struct<a:int,n:int>>").alias("runs"), F.lit(0).alias("a"), F.lit(0).alias("n"))
        step = lambda s, a: F.when(s.a == a, F.struct(s.runs.alias("runs"), s.a.alias("a"), (s.n + 1).alias("n"))).otherwise(
            F.struct(F.concat(s.runs, F.array(run(s.a, s.n))).alias("runs"), a.alias("a"), F.lit(1).alias("n"))
        )
        runs = F.aggregate(at, start, step, lambda s: F.concat(s.runs, F.array(run(s.a, s.n))))
        every = F.sequence(F.lit(1), F.lit(self.dimension))
        total = lambda runs, i: F.aggregate(F.filter(runs, lambda r: F.abs(r.a) == i), F.lit(0.0), lambda t, r: t + F.signum(r.a.cast("double")) * r.n)
        return unit(once(runs, lambda known: F.transform(every, lambda i: total(known, i))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed a single time however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return once(v, lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


_PROVIDERS: dict[str, Callable[[], EmbeddingProvider]] = {}
_MADE: dict[str, EmbeddingProvider] = {}


def register(name: str, make: Callable[[], EmbeddingProvider]) -> None:
    """Offer a provider by name; it is made at first use and kept."""
    _PROVIDERS[name] = make
    _MADE.pop(name, None)


def provider(name: str) -> EmbeddingProvider:
    if name not in _PROVIDERS:
        raise ValueError(f"no embedding provider {name}; there are {sorted(_PROVIDERS)}")
    if name not in _MADE:
        _MADE[name] = _PROVIDERS[name]()
    return _MADE[name]


register("hashed-words-64", HashedWords)


def embedded(texts: DataFrame, text: str, by: EmbeddingProvider, out: str = "embedding") -> DataFrame:
    """texts with their vectors; a vector of another size, or one that is not finite, is an error."""
    return texts.withColumn(out, by.embed(F.col(text))).withColumn(out, checked(F.col(out), by.dimension))


def embedded_queries(queries: DataFrame, text: str, by: EmbeddingProvider, out: str = "query") -> DataFrame:
    """Queries are embedded with the provider's prefix."""
    return embedded(queries.withColumn(out, F.concat(F.lit(by.query_prefix), F.col(text))), out, by, out)


def checked(v: Column, dimension: int) -> Column:
    fine = lambda v: (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wrong = F.raise_error(F.lit(f"a vector must have {dimension} finite numbers"))
    return once(v, lambda v: F.when(fine(v), v).otherwise(wrong.cast("array<double>")))
