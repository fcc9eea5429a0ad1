"""Quality classifier by importance resampling: documents are drawn in proportion to how likely target text makes their n-grams against raw text.

Two generative models over hashed words and word pairs: the target's, from documents labelled good (a bounded sample of labelled rows), and the raw
one, from the counts of all documents. A document's log weight is the sum of its n-grams' log ratios. Adding Gumbel noise that its id
determines and keeping the largest ``k`` keys draws ``k`` documents without replacement in proportion to the weights. The threshold
key is found exactly, by counts over 16 bits of the keys at a time: no sort of all rows, no more than 65,536 counts at the driver.

Null and empty texts have no n-grams: log weight 0, so only their noise places them. Rows with a null doc_id draw their noise by their text. Ties at the
threshold, which only rows with the same doc_id and text can make (null and empty texts count as the same), are all kept. Without documents labelled good all weights are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, label_sample, map_slices, raw_bytes, shared_value, written
from lumenaudit.llm.hashing import WordCodes, coded, grams

BITS = 16
GAPS = (0, 1)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def buckets(texts: list[bytes | None], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    flat, owner = coded(texts, tokens, codes)
    parts = [grams(flat, owner, gap, BITS) for gap in GAPS]
    return np.concatenate([f for f, _ in parts]), np.concatenate([o for _, o in parts])


def counted(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts. Each task sums its texts first, and sends at most a row per bucket."""

    def count(batches):
        codes, sums = WordCodes(), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                f, _ = buckets(raw_bytes(batch.slice(at, 512).column(0)), codes)
                sums += np.bincount(f, minlength=1 << BITS)
        on = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(sums[on], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability by bucket. The target model is smoothed towards the raw one, so that a bucket that the
    sample lacks counts by how much of it was to be expected there."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    q = (raw + 1e-3) / (raw.sum() + 1e-3 * len(raw))
    p = (target + smoothing * len(raw) / 256 * q) / (target.sum() + smoothing * len(raw) / 256)
    return np.log(p / q)


def gumbel(doc_id: int | None, seed: int, text: bytes | None = None) -> float:
    """Noise of the standard Gumbel distribution, the same for an id wherever it is drawn; without an id, for a text."""
    name = b"None" + (text or b"") if doc_id is None else repr(doc_id).encode()
    u = (xxhash.xxh64_intdigest(name, seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(min(u, 1 - 1e-16))))


def weigh(docs: DataFrame, ratios: np.ndarray, keep: list[str], seed: int = 0) -> DataFrame:
    """``keep`` columns, ``n_grams``, ``log_weight``, ``key`` (with noise) and ``rank_key`` (an integer in the order of ``key``) of every row."""
    sent = shared_value(docs.sparkSession, ratios.astype(np.float64))

    def run(cols: dict, state: tuple) -> dict:
        codes, r = state
        texts = raw_bytes(cols["text"])
        f, owner = buckets(texts, codes)
        w = np.bincount(owner, r[f], len(texts))
        key = w + np.array([gumbel(d, seed, t) for d, t in zip(cols["doc_id"].to_pylist(), texts, strict=True)], float)
        bits = (key + 0.0).view(np.int64)
        rank = np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)
        return {c: cols[c] for c in keep} | {"n_grams": pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()), "log_weight": pa.array(w), "key": pa.array(key), "rank_key": pa.array(rank)}

    keep, ddl = columns(docs, keep, "n_grams long, log_weight double, key double, rank_key long")
    return map_slices(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), run, ddl, setup=lambda: (WordCodes(), sent()))


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The ``k``-th largest value of a column of longs, exactly; None if there are fewer rows or k is 0."""
    value, left, there = 0, k, rows.select(column)
    if k <= 0:
        return None
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift) if shift else F.col(column)
        part = part if shift == 48 else part.bitwiseAND(0xFFFF)
        for r in sorted(there.groupBy(part.alias("part")).count().collect(), key=lambda r: -r.part):
            if left <= r["count"]:
                break
            left -= r["count"]
        else:
            return None
        there = there.where(part == r.part)
        value = value << 16 | r.part
    return value


def resample(docs: DataFrame, labels: DataFrame, keep: list[str], *, share: float | None = None, most_labelled: int = 10_000, seed: int = 0) -> DataFrame:
    """``keep`` columns, ``n_grams``, ``log_weight``, ``key`` and ``kept`` of every row. share: of the documents, by default that of good ones among the labelled."""
    sample = label_sample(labels, "quality", most_labelled)
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if share is None:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    target = counted(docs.join(F.broadcast(sample.where("label = 1")), "doc_id", "left_semi"))
    weighed = written(weigh(docs, log_ratios(target, counted(docs)), keep, seed))
    least = kth_largest(weighed, "rank_key", round(share * weighed.count()))
    return weighed.withColumn("kept", F.lit(False) if least is None else F.col("rank_key") >= F.lit(least)).drop("rank_key")


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), ["doc_id"])
