"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

Each run of five words is hashed once; the hash names one of BINS bins, and a bin keeps its least value.
Empty bins are filled by optimal densification: bin j visits other bins along a walk drawn for j alone (a
hashed start and odd stride, so that it comes to every bin) and takes the first filled one's value. A
fingerprint packs BITS low bits of each bin as hexadecimal digits. Likeness is the share of equal bins,
corrected for bins that are equal by chance: (share - 2^-BITS) / (1 - 2^-BITS), not below 0.

A text of fewer words than a run is one run; a text without words (null and empty ones too) has the empty
fingerprint, like only to another empty one. Equal texts have equal fingerprints. An empty table gives an
empty table.

`with_next` pairs each row with the one that follows by id (null ids last, ties by text hash; after the
last the first) in one shuffle: rows are dealt to ranges of ids, and each range's first row is dealt to the
range before it too.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm._common import SPACE, documents, id_key, text_of

RUN, BINS, BITS = 5, 256, 4
#: An entry is a bin (upper 32 bits) and a value (31 bits); a bin's last possible entry stands for an empty one.
MASK, EMPTY = ((BINS - 1) << 32) | 0x7FFFFFFF, 0xFFFFFFFF
#: Steps of a walk that are tried together; the last takes in every bin.
STEPS = (4, 32, BINS)


def _drawn(salt: int) -> list[int]:
    """A seeded number for each bin."""
    r = random.Random(salt)
    return [r.randrange(1 << 16) for _ in range(BINS)]


def _first_filled(steps: int) -> str:
    """SQL: the entry of the first filled bin among the first steps of bin j's walk, or null."""
    start, stride = (f"array({', '.join(str(n % BINS) for n in _drawn(1))})[j]", f"array({', '.join(str(n % BINS | 1) for n in _drawn(2))})[j]")
    return f"try_element_at(filter(transform(sequence(1, {steps}), a -> _s[({start} + a * {stride}) % {BINS}]), y -> (y & {EMPTY}L) <> {EMPTY}L), 1)"


def fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with column `out`: the fingerprint of text."""
    df = df.withColumn("_w", F.array_remove(F.split(text, SPACE), ""))
    ahead = ", ".join(f"_w[i + {k}]" for k in range(1, RUN))
    runs = f"case when size(_w) < {RUN} then array(xxhash64(_w) & {MASK}L) else transform(slice(_w, 1, size(_w) - {RUN - 1}), (x, i) -> xxhash64(x, {ahead}) & {MASK}L) end"
    none = f"array({', '.join(f'{(j << 32) | EMPTY}L' for j in range(BINS))})"
    df = df.withColumn("_n", F.size("_w")).withColumn("_s", F.expr(f"sort_array(concat({runs}, {none}))"))
    # sorted, a bin's first entry is its least
    df = df.withColumn("_s", F.expr("filter(_s, (x, i) -> i = 0 or shiftright(x, 32) <> shiftright(_s[i - 1], 32))"))
    filled = f"if((x & {EMPTY}L) <> {EMPTY}L, x, coalesce({', '.join(_first_filled(n) for n in STEPS)}))"
    digits = f"transform(_s, (x, j) -> substring('0123456789abcdef', cast({filled} & 15 as int) + 1, 1))"
    return df.withColumn(out, F.expr(f"case when _n = 0 then '' else array_join({digits}, '') end")).drop("_w", "_n", "_s")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the runs of two texts, from their fingerprints."""
    equal = F.size(F.filter(F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(both)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """docs (_key, _tie, id, text) with the next row's text, and the window that finds it. The rows with _ghost are copies for the range before."""
    keys = docs.select(id_key(id_col).alias("_key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    bounds = sorted(set(keys.agg(F.percentile_approx("_key", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []))
    ranges = lambda c: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < c))
    firsts = [r[1] for r in sorted(keys.groupBy(ranges(F.col("_key")).alias("_range")).agg(F.min("_key")).collect())]
    place = F.array_position(F.array(*[F.lit(f) for f in firsts] or [F.lit(-1).cast("long")]), F.col("_key"))
    # the ranges that have rows, numbered from 0
    own = F.size(F.filter(F.array(*[F.lit(f) for f in firsts[1:]]).cast("array<bigint>"), lambda f: f <= F.col("_key")))
    rows = docs.select(id_key(id_col).alias("_key"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    ghost = F.when(place > 0, F.array(F.struct(own.alias("r"), F.lit(False).alias("g")), F.struct((F.pmod(own - 1, F.lit(max(1, len(firsts))))).alias("r"), F.lit(True).alias("g"))))
    dealt = rows.withColumn("_at", F.explode(F.coalesce(ghost, F.array(F.struct(own.alias("r"), F.lit(False).alias("g"))))))
    dealt = dealt.select("_key", "_id", "_text", F.xxhash64("_text").alias("_tie"), F.col("_at.r").alias("_range"), F.col("_at.g").alias("_ghost"))
    window = Window.partitionBy("_range").orderBy("_ghost", "_key", "_tie")
    return dealt.withColumn("_next", F.lead("_text").over(window)), window


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint, which replaces one of that name; all others stay."""
    rows = docs.select(F.struct("*").alias("_row"), text_of(text_col).alias("_t"))
    return fingerprint(rows, F.col("_t"), "_f").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "fingerprint"], F.col("_f").alias("fingerprint"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, window = with_next(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    rows = rows.withColumn("n_chars", F.length("_text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("_next", F.lit(1), cut))
    rows = rows.withColumn("_edited", edited)
    rows = fingerprint(rows, F.col("_text"), "fingerprint").drop("_text", "_next")
    rows = rows.withColumn("_near", F.lead("fingerprint").over(window)).where("not _ghost")
    rows = fingerprint(rows, F.col("_edited"), "edited_fingerprint").withColumn("edited_sha256", F.sha2("_edited", 256))
    return rows.select(F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_near").alias("near_next"))
