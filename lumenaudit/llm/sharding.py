"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents with equal texts form a group. Groups are the units to place, but for two bounds: light groups travel in a fixed number
of bundles (by a hash of the text, so that equal texts stay together), and a heavy group that no shard has room for, as one may hold a
third of all rows, is cut into pieces by a hash of the document's id. The number of units is thus bounded by
parameters, not by the data; their sums go to the driver, which places each, largest first, in the shard whose residual capacity
has the largest dot product with the unit's vector. Law ``bytes``: sizes of the shards are near equal. Law ``rows``: counts differ by one at most, whatever
the groups; law ``key``: rendezvous hashing of the document's id, so that a further shard only takes rows into itself.

A null text has no bytes and no tokens, its size is the overhead alone; null and empty texts are two groups. Repeated rows (also
with the same doc_id) each get a slot of their own, which of them is not defined. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.llm.common import written

OVERHEAD = 16
SHARDS = 40


def measured(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, size, crc of the text, tokens, and the text's hash (two words; null text has its own)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    space = r"[\x20\x09-\x0D]+"
    words = F.coalesce(F.size(F.filter(F.split("text", space, -1), lambda w: w != "")), F.lit(0))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("tokens"),
        F.xxhash64(text, F.col("text").isNull()).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
    )


def pack(vectors: np.ndarray, shards: int, slack: float = 1.0, group: np.ndarray | None = None) -> np.ndarray:
    """The shard of each unit. vectors: units by dimensions (bytes first). Largest first; each goes where the dot product of its vector
    with the residual capacity is highest, among the shards with room for its bytes, or where most room is left if none has.
    Units of equal ``group`` are placed as one where a shard has room for all of them in each dimension, else one by one."""
    total = vectors.sum(axis=0).astype(float)
    share = np.where(total > 0, total, 1.0)
    unit = vectors / share * shards  # 1: a shard's fair part
    names, item = np.unique(np.arange(len(unit)) if group is None else group, return_inverse=True)
    whole = np.zeros((len(names), vectors.shape[1]))
    np.add.at(whole, item, unit)
    members: list[list[int]] = [[] for _ in names]
    for k, i in enumerate(item.tolist()):
        members[i].append(k)
    order = np.lexsort((np.arange(len(whole)), -whole.max(axis=1))) if len(whole) else []
    left = np.full((shards, vectors.shape[1]), slack)
    out = np.zeros(len(vectors), np.int64)
    for i in order:
        room = (left >= whole[i]).all(axis=1)
        if len(members[i]) > 1 and room.any():
            at = int(np.argmax(np.where(room, left @ whole[i], -np.inf)))
            out[members[i]] = at
            left[at] -= whole[i]
            continue
        for k in members[i]:
            v = unit[k]
            score = left @ v
            room = left[:, 0] >= v[0]
            at = int(np.argmax(np.where(room, score, -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
            out[k] = at
            left[at] -= v
    return out


def assign(docs: DataFrame, shards: int = SHARDS, *, law: str = "bytes", bundles_per_shard: int = 256, light_part: float = 1 / 16) -> DataFrame:
    """``doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard`` of every row."""
    rows = written(measured(docs))  # without texts; the passes below read these few columns
    if law == "bytes":
        placed = _by_vectors(rows, shards, bundles_per_shard, light_part)
        return _slotted(placed, F.lit(None).cast("int"), law)
    if law == "key":
        at = lambda n: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(F.xxhash64(F.col("doc_id"), s).alias("w"), s.alias("s"))))["s"].cast("int")
        placed = rows.withColumns({"unit": F.pmod(F.xxhash64("h1", "doc_id"), F.lit(bundles_per_shard)).cast("int"), "shard": at(shards), "grown": at(shards + 1)})
        return _slotted(placed, F.col("grown"), law)
    if law == "rows":
        units = shards * bundles_per_shard
        # by text and id: numbers go round the shards in turn, so copies of a hot text needn't share a unit
        numbered = _numbered(rows.withColumn("unit", F.pmod(F.xxhash64("h1", "h2", "doc_id"), F.lit(units)).cast("int")), ["unit"], [])
        n = F.col("number")
        return numbered.select("doc_id", "size", "text_crc32", "tokens", F.lit(law).alias("law"), F.pmod(n, F.lit(shards)).cast("int").alias("shard"), F.floor(n / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    raise ValueError(f"no such law: {law}")


def _by_vectors(rows: DataFrame, shards: int, per_shard: int, light_part: float) -> DataFrame:
    spark = rows.sparkSession
    bundles = shards * per_shard
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bound = max(1, int(total / shards * light_part))
    # fewer than shards / light_part groups have more bytes than the bound, of less than twice as many pieces: what is collected and broadcast is bounded
    heavy = groups.where((F.col("bytes") > bound) & (F.col("n") > 1)).select("h1", "h2", F.ceil(F.col("bytes") / bound).cast("int").alias("pieces")).orderBy("h1", "h2").collect()
    starts = bundles + np.cumsum([0, *(r.pieces for r in heavy)])
    named = spark.createDataFrame([(r.h1, r.h2, r.pieces, int(start)) for r, start in zip(heavy, starts[:-1], strict=True)], "h1 long, h2 long, pieces int, start int")
    tagged = rows.join(F.broadcast(named), ["h1", "h2"], "left")
    piece = F.col("start") + F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("pieces"))
    unit = F.when(F.col("pieces").isNotNull(), piece).otherwise(F.pmod(F.col("h1"), F.lit(bundles)))
    tagged = tagged.withColumn("unit", unit.cast("int")).drop("pieces", "start")
    sums = tagged.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("unit").collect()
    units = np.array([r.unit for r in sums], np.int64)
    group = np.where(units < bundles, units, bundles + np.searchsorted(starts, units, side="right"))
    at = pack(np.array([[r.bytes, r.tokens, r.rows] for r in sums], float).reshape(-1, 3), shards, group=group)
    plan = spark.createDataFrame([(r.unit, int(s)) for r, s in zip(sums, at, strict=True)], "unit int, shard int")
    return tagged.join(F.broadcast(plan), "unit")


def _numbered(placed: DataFrame, unit: list[str], within: list[str]) -> DataFrame:
    """``number``: 0, 1, ... gapless ``within`` equal columns. ``unit`` cuts the rows into parts, as many as parameters say, whose counts set their offsets."""
    # A unit may hold copies of one text by the thousand: it is cut once more by id, so that no window holds a hot group.
    cut = placed.withColumn("cut", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(8)).cast("int"))
    keys = [*unit, "cut"]
    counts = cut.groupBy(*within, *keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*within).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy(*within, *keys).orderBy("doc_id")) - 1
    return cut.withColumn("k", number).join(F.broadcast(starts), [*within, *keys]).withColumn("number", F.col("start") + F.col("k")).drop("k", "start", "cut")


def _slotted(placed: DataFrame, grown, law: str) -> DataFrame:
    out = _numbered(placed, ["unit"], ["shard"])
    return out.select("doc_id", "size", "text_crc32", "tokens", F.lit(law).alias("law"), "shard", F.col("number").cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))


def balance(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and tokens of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
