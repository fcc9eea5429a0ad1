"""Benchmark decontamination: training text is scanned for the word windows of benchmark items.

The benchmark's normalised n-grams (``WIDTH`` words; a shorter item is one window) become a hash set that is broadcast. Documents
are scanned once: rolling 64-bit hashes over word numbers find candidates, each is verified word by word, and the words inside
occurrences are the hits. The broadcast is bounded: a benchmark of more than ``most_bytes`` of text is cut into blocks of items, whose index
is some twenty times their text; documents are scanned for each block, one after another, each block's hits are written, and the hit words of the blocks are united.

Null and empty texts have no words and no hits; an item without words has no window. Hits of a benchmark row without item_id count, but
name no item. Repeated benchmark rows count once, repeated documents each by itself. Other columns of documents pass through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, map_slices, packed, raw_bytes, shared_value, written

WIDTH = 13
#: Upper-case ASCII letters to lower case; other ASCII but letters and digits to blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FILTER_BITS = 22
MADE = "n_words long, hits array<int>, items array<long>"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Windows:
    """The windows of benchmark items, as arrays: the items' words by number in a row, and for each length the sorted hashes and places of the distinct windows of each item.

    A word takes some 150 bytes once, its occurrences 24 bytes each and a filter of ``2 ** FILTER_BITS`` bytes for each length; an item's words are at least as many as its windows."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        words = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.flat = np.concatenate([*words, np.zeros(0, np.int32)])
        self.codes = np.random.default_rng(5).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.names = [name for name, _ in items]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for n in sorted(set(np.minimum(sizes, width).tolist()) - {0}):
            mine = np.flatnonzero(np.minimum(sizes, width) == n)
            counts = sizes[mine] - n + 1
            item = np.repeat(mine, counts)
            at = np.repeat(begins[mine] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * FACTOR + self.codes[self.flat[at + k]]
            order = np.lexsort((at, item, h))
            h, item, at = h[order], item[order], at[order]
            same = np.zeros(len(h), bool)  # a window that repeats within its item
            same[1:] = (h[1:] == h[:-1]) & (item[1:] == item[:-1])
            for k in range(n):
                same[1:] &= self.flat[at[1:] + k] == self.flat[at[:-1] + k]
            self.tables[n] = h[~same], at[~same].astype(np.int64), item[~same].astype(np.int32)
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][h >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, set[int]]]]:
        """Which positions lie inside an occurrence, and each occurrence's start and items. Number 0 is a word of no item."""
        hit, found = np.zeros(len(ids), bool), []
        codes = self.codes[ids] if len(ids) else np.zeros(0, np.uint64)
        h = np.zeros(len(ids), np.uint64)
        for n in range(1, min(max(self.tables, default=0), len(ids)) + 1):
            h = h[: len(ids) - n + 1] * FACTOR + codes[n - 1 :]
            if n not in self.tables:
                continue
            hashes, places, items = self.tables[n]
            maybe = np.flatnonzero(self.filters[n][h >> np.uint64(64 - FILTER_BITS)])
            first, end = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
            maybe, first, end = maybe[end > first], first[end > first], end[end > first]
            for at, a, b in zip(maybe.tolist(), first.tolist(), end.tolist(), strict=True):
                window = ids[at : at + n]
                really = [k for k in range(a, b) if np.array_equal(self.flat[places[k] : places[k] + n], window)]
                if really:
                    hit[at : at + n] = True
                    found.append((at, {self.names[items[k]] for k in really} - {None}))
        return hit, found


def scan_texts(texts: list[bytes | None], windows: Windows) -> list[tuple[int, list[int], list[int]]]:
    """For each text: its number of words, the positions of hit words, the items with occurring windows."""
    get, parts, starts, at = windows.vocabulary.get, [], [], 0
    for t in texts:
        ids = [get(w, 0) for w in words_of(t)]
        parts.append(np.array([*ids, 0], np.int64))  # the 0 keeps windows inside a document
        starts.append(at)
        at += len(ids) + 1
    if not parts:
        return []
    hit, found = windows.hits(np.concatenate(parts))
    items: list[set[int]] = [set() for _ in texts]
    for where, k in zip((np.searchsorted(starts, [x for x, _ in found], side="right") - 1).tolist() if found else [], (i for _, i in found), strict=True):
        items[where] |= k
    return [(len(p) - 1, np.flatnonzero(hit[s : s + len(p)]).tolist(), sorted(i)) for p, s, i in zip(parts, starts, items, strict=True)]


def without(text: bytes, hits: list[int]) -> bytes:
    """The text without its hit words; what lies between adjacent hit words goes too."""
    if not hits:
        return text
    plain, spans, at = text.translate(TABLE), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    out, end, before = [], 0, -2
    for k in hits:
        if k != before + 1:
            out.append(text[end : spans[k][0]])
        end, before = spans[k][1], k
    return b"".join([*out, text[end:]])


def blocks(benchmark: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The benchmark, cut by item into blocks of about ``most_bytes`` of text at most."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / most_bytes))
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, width: int = WIDTH, most_bytes: int = 8 << 20) -> DataFrame:
    """``keep`` columns, ``n_words``, ``hits`` (positions of hit words) and ``items`` of every row."""
    spark = docs.sparkSession
    keep = columns(docs, keep, MADE)[0]

    def block(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
        index = shared_value(spark, Windows([(r[0], r[1].encode()) for r in found.collect()], width))

        def find(cols: dict, windows: Windows) -> dict:
            got = scan_texts(raw_bytes(cols["text"]), windows)
            return {c: cols[c] for c in names} | {"n_words": [g[0] for g in got], "hits": [g[1] for g in got], "items": [g[2] for g in got]}

        return map_slices(rows.select(*dict.fromkeys([*names, "text"])), find, columns(rows, names, MADE)[1], setup=index)

    cut = blocks(benchmark, most_bytes)
    if len(cut) == 1:
        return block(docs, cut[0], keep)
    # each row carries a number of its own through the blocks, as doc_id may repeat
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("__number", F.monotonically_increasing_id())
    rows = written(rows)
    union = None
    for b in cut:  # one index at a time on the driver and the workers; only documents with hits are stored
        part = written(block(rows, b, ["__number"]).where(F.size("hits") > 0).drop("n_words"))
        union = part if union is None else union.unionByName(part)
    joined = union.groupBy("__number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = map_slices(rows, lambda cols: {c: cols[c] for c in ["__number", *keep]} | {"n_words": [len(words_of(t)) for t in raw_bytes(cols["text"])]}, columns(rows, ["__number", *keep], "n_words long")[1])
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<long>"))]
    return counted.join(joined, "__number", "left").select(*keep, "n_words", *none)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """All columns of ``docs`` without contamination: contaminated documents go, or with ``remove="spans"`` the hit words go from every text."""
    got = scan(packed(docs), benchmark, ["__row", "text"], **options)
    if remove == "documents":
        return got.where(~contaminated(F.size("hits"), F.col("n_words"))).select("__row.*")

    def cut(cols: dict) -> dict:
        texts = [None if t is None else without(t, h) for t, h in zip(raw_bytes(cols["text"]), cols["hits"].to_pylist(), strict=True)]
        return {"__row": cols["__row"], "cut": pa.array(texts, pa.binary()).cast(pa.string())}

    rows = map_slices(got.select("__row", "text", "hits"), cut, columns(got, ["__row"], "cut string")[1])
    return rows.select(*(F.col("cut").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return got.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), contaminated(F.size("hits"), F.col("n_words")).alias("contaminated"),
    )


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
