"""Toxicity: logistic regression by FTRL-proximal over hashed words, word pairs and skip-grams.

Each kind of feature has its own range of buckets; a text has a feature or not. The learner keeps a rate per coordinate, and its L1
term leaves few weights that aren't 0, which are broadcast: their number is bounded by the buckets. It sees each row of a bounded
sample of the labelled documents in a fixed order, in one task. Every document is scored on its whole text.

Null and empty texts have the bias alone and score below one half, unless most labelled rows are toxic. Without labelled rows of both
kinds there is no model: every score is the share of toxic rows, 0 if there are none. Repeated rows are scored each by itself; of rows with one labelled id the one with the least features is learnt from. Ids, sources and languages are never features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, label_sample, map_slices, raw_bytes, shared_value
from lumenaudit.llm.decontaminate import words_of
from lumenaudit.llm.hashing import WordCodes, coded, grams

BITS = 21
GAPS = (0, 1, 2)  # single words, pairs, pairs with one word skipped


def held_out() -> Column:
    """Rows that never serve learning: a fifth, by the id's CRC."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def features(texts: list[bytes | None], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the number of the text that has them; repeats within a text are kept."""
    flat, owner = coded(texts, words_of, codes)
    parts = [(f + (k << BITS), o) for k, gap in enumerate(GAPS) for f, o in [grams(flat, owner, gap, BITS)]]
    return np.concatenate([f for f, _ in parts]), np.concatenate([o for _, o in parts])


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2, for features that are present or not. The bias is the last coordinate."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)  # the bias isn't pulled to 0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def fit(rows: list[tuple[np.ndarray, int]], size: int, epochs: int = 8, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the examples ``(feature numbers, label)``, as numbers and values; the bias has number ``size``."""
    model, bias = Ftrl(size, **options), np.array([size])
    for _ in range(epochs):
        for at, label in rows:
            model.learn(np.concatenate([at, bias]), label)
    return model.sparse()


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 10_000, epochs: int = 8, **options) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Weights, and the constant score if there is nothing to learn. At most ``most_labelled`` rows are learnt from: a documented bound."""
    sample = label_sample(labels.where(~held_out()), "toxic", most_labelled)
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return np.zeros(0, np.int64), np.zeros(0), float(bool(counts.get(1)))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    size = len(GAPS) << BITS

    def extract(cols: dict, codes: WordCodes) -> dict:
        f, owner = features(raw_bytes(cols["text"]), codes)
        pairs = np.unique(owner * (size + 1) + f)
        cuts = np.searchsorted(pairs // (size + 1), np.arange(1, len(cols["text"])))
        return {"doc_id": cols["doc_id"], "label": cols["label"], "features": [x.tolist() for x in np.split(pairs % (size + 1), cuts)]}

    every = map_slices(found, extract, "doc_id long, label int, features array<int>", setup=WordCodes)
    examples = every.groupBy("doc_id", "label").agg(F.min("features").alias("features")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_labelled)

    def learn(batches):
        rows = [(np.asarray(f, np.int64), y) for b in batches for f, y in zip((x.values.to_numpy() for x in b.column(1)), b.column(0).to_pylist(), strict=True)]
        at, w = fit(rows, size, epochs, **options)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    got = examples.select("label", "features").coalesce(1).mapInArrow(learn, "at long, w double").toPandas()
    return got["at"].to_numpy(), got["w"].to_numpy(), None


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float | None], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    size = len(GAPS) << BITS

    def table():
        at, w, constant = sent()
        dense = np.zeros(size + 1, np.float32)
        dense[at] = w
        return WordCodes(), dense, constant

    sent = shared_value(docs.sparkSession, model)

    def run(cols: dict, state: tuple) -> dict:
        codes, dense, constant = state
        texts = raw_bytes(cols["text"])
        if constant is not None:
            scores = np.full(len(texts), constant)
        else:
            f, owner = features(texts, codes)
            on = np.flatnonzero(dense[f])
            pairs = np.unique(owner[on] * (size + 1) + f[on])
            sums = np.bincount(pairs // (size + 1), dense[pairs % (size + 1)], len(texts)) + float(dense[size])
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
        return {c: cols[c] for c in keep} | {"score": pa.array(scores, pa.float64())}

    keep, ddl = columns(docs, keep, "score double")
    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), run, ddl, setup=table)


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
