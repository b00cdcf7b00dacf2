"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded by statistics of its words'
form; a hidden layer, gated attention over the passages (softmax of w . (tanh(V h) * sigmoid(U h))) and a
logistic output on the attention-weighted mean are learned together from document labels by Adam.

Labels come from rows whose crc32(id as text) modulo FOLDS is not 0, at most SAMPLE of them (the least by
a hash of the id) and of these, in that order, as many as have PASSAGES passages together at most; only their
passages' statistics reach the driver. Scores use the text alone, over all
passages of every whole text. A null or empty text is a bag with one empty passage. Labels that are null
do not count; of several for one id the least does. Without any label every score is 0.5. Repeated rows
get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.llm._common import WORD, bounded_batches, documents, text_of
from codeweft.llm._rolling import Words, slices

PASSAGE, FOLDS, SAMPLE, PASSAGES, THRESHOLD, SEED = 64, 5, 4000, 200_000, 0.3, 5
HIDDEN, GATE, ROUNDS, RATE = 12, 8, 250, 0.02
_CLASSES = np.zeros((4, 256), dtype=np.int32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 48:58] = 1  # digits
_CLASSES[2, [ord(c) for c in "#$%&*|~^<>{}[]_=+@/\\!?"]] = 1
_CLASSES[3, [ord(c) for c in ".,;:'\"()-"]] = 1
FEATURES = 13


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, text of each passage) for some whole texts; each text has one passage at least."""
    words, n = Words(data, offsets), len(offsets) - 1
    hashes, count = words.numbers(), np.diff(words.first)
    bags = np.maximum(1, -(-count // PASSAGE))
    of = np.repeat(np.arange(n), bags)
    x = np.zeros((len(of), FEATURES))
    if not len(words.starts):
        return x, of
    text = np.repeat(np.arange(n), count)
    passage = (np.cumsum(bags) - bags)[text] + (np.arange(len(text)) - words.first[text]) // PASSAGE
    size = words.ends - words.starts
    per = []
    for k in range(4):
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(_CLASSES[k][data], out=sums[1:])
        per.append(sums[words.ends] - sums[words.starts])
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])]
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=len(of))
    total = lambda v: np.bincount(passage, weights=v, minlength=len(of))
    letters = size - per[1] - per[2] - per[3]
    num, chars = np.maximum(total(np.ones(len(size))), 1), np.maximum(total(size), 1)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = (total(p) / chars for p in per)
    x[:, 4] = total((per[0] >= 2) & (per[0] * 2 > letters)) / num
    x[:, 5] = total(per[2] > 0) / num
    x[:, 6] = total(letters == 0) / num
    x[:, 7] = distinct / num
    x[:, 8] = total(same) / num
    x[:, 9] = total(size) / num / 10
    x[:, 10] = total(data[words.ends - 1] == 46) / num * 4
    x[:, 11] = total(size > 20) / num
    x[:, 12] = np.log1p(total(np.ones(len(size)))) / 4
    return x, of


class Mil:
    """h = tanh(x W + b); attention a = softmax_bag(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(z . o + c), z = sum a h."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def start(seed: int = SEED) -> Mil:
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 0.4, s)
        return Mil({"m": np.zeros(FEATURES), "s": np.ones(FEATURES), "W": n(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, GATE), "U": n(HIDDEN, GATE), "w": n(GATE), "o": n(HIDDEN), "c": np.zeros(1)})

    def forward(self, x: np.ndarray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p, t = self.p, {}
        t["x"] = (x - p["m"]) / p["s"]
        t["h"] = np.tanh(t["x"] @ p["W"] + p["b"])
        t["v"], t["u"] = np.tanh(t["h"] @ p["V"]), 1 / (1 + np.exp(-t["h"] @ p["U"]))
        e = (t["v"] * t["u"]) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, of, e)
        e = np.exp(e - top[of])
        t["a"] = e / np.bincount(of, weights=e, minlength=n)[of]
        t["z"] = np.zeros((n, HIDDEN))
        np.add.at(t["z"], of, t["a"][:, None] * t["h"])
        t["y"] = 1 / (1 + np.exp(-np.clip(t["z"] @ p["o"] + p["c"], -30, 30)))
        return t

    def score(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return self.forward(x, of, n)["y"]

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, decay: float = 1e-4) -> Mil:
        p, n = self.p, len(y)
        p["m"], p["s"] = x.mean(axis=0), x.std(axis=0) + 1e-3
        names = [k for k in p if k not in "ms"]
        first, second = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
        for step in range(1, rounds + 1):
            t, g = self.forward(x, of, n), {}
            d = (t["y"] - y) / n
            g["o"], g["c"] = t["z"].T @ d, d.sum(keepdims=True)
            dz = (d[:, None] * p["o"])[of]
            da = (dz * t["h"]).sum(axis=1)
            de = t["a"] * (da - np.bincount(of, weights=t["a"] * da, minlength=n)[of])
            dv, du = de[:, None] * p["w"] * t["u"] * (1 - t["v"] ** 2), de[:, None] * p["w"] * t["v"] * t["u"] * (1 - t["u"])
            g["w"], g["V"], g["U"] = (t["v"] * t["u"]).T @ de, t["h"].T @ dv, t["h"].T @ du
            dh = (t["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - t["h"] ** 2)
            g["W"], g["b"] = t["x"].T @ dh, dh.sum(axis=0)
            for k in names:
                g[k] = g[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            x, of = passages(data, offsets)
            ends = np.r_[0, np.cumsum(np.bincount(of, minlength=j - i))] * FEATURES
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = PASSAGES) -> Mil | None:
    """Fit on at most `sample` labelled rows with `most` passages that are not held out."""
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    own = own.select("id", "y", F.xxhash64("id", F.lit(SEED)).alias("draw")).orderBy("draw", "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(own), "id").groupBy("draw", "id").agg(F.min(F.struct("text", "y")).alias("r"))
    size = F.ceil(F.greatest(F.lit(1), F.regexp_count(F.col("r.text"), F.lit(WORD))) / PASSAGE)
    rows = rows.select("draw", "id", "r", size.alias("size"))
    # one row for each of at most `sample` documents
    fits = rows.withColumn("to", F.sum("size").over(Window.orderBy("draw", "id"))).where(F.col("to") <= most)
    got = fits.select("r.y", "r.text").mapInArrow(_encode, "y double, x array<double>").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.y, r.x))
    x = [np.array(r.x).reshape(-1, FEATURES) for r in got]
    return Mil.start().fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(b) for b in x]), np.array([r.y for r in got]))


def _score(model: Mil | None):
    params = model and model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = params and Mil(params)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                y = own.score(*passages(data, offsets), j - i) if own else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(y)], ["id", "score"])

    return run


def score(docs: DataFrame, model: Mil | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: its id, held_out, score and predicted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(_score(model), f"id {dict(docs.dtypes)[id_col]}, score double")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Mil | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    bounded_batches(docs.sparkSession)
    row = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("text"))
    kind = row.schema["row"].dataType.simpleString()
    out = row.mapInArrow(_score(model), f"id {kind}, score double").where(F.col("score") >= threshold)
    return out.select(*[F.col(f"id.`{c}`").alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
