"""The trie of conversations' shared prefixes, rolled up by pointer jumping.

A node is a distinct sequence of first turns, known by a digest; its edge leads to the digest of its sequence without the last turn. Positions in a conversation come from one range
sort of all turns, in which a long conversation spans tasks; digests chain within blocks of 256 turns, and blocks of longer conversations are composed by doubling, so no task follows
a conversation to its end. Leaves and savings go to all ancestors in a logarithmic number of rounds: in round k each node adds what the nodes 2^k below it have gathered, and its
pointer jumps to the pointer of the node it points at. A node leaves the rounds once nothing 2^k below or above it is left, so short conversations cost a few rounds however deep others are.

Turns of one number (also null, which come first) follow the order of their digests, repeated rows each count. A null role or text is an empty one. Rows without a conv_id belong to no
conversation and are left out. Texts of any length are read once, for their digest. Further columns are ignored. A table without conversations has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.llm.common import release, written
from lumenaudit.llm.ordered import join_hot, ranged

#: Conversations of one hundred ids share the first turns of the one with the least id, at most ``MOST_SHARED`` of them.
FAMILY, MOST_SHARED = 100, 5
#: Turns whose digests chain in one task.
BLOCK = 256
#: Characters of ids that are joined before they are hashed.
PIECE = 1 << 16


def _digest(*parts: F.Column) -> F.Column:
    """16 bytes of the parts' SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, family, shared, given, total``: its own first ``shared`` turns give way to ``given`` ones of its family's first conversation; ``total`` turns remain."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("int")
    heads = counts.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("n").alias("n_family"))
    named = counts.withColumns({"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "shared": shared}).join(heads, "family", "left")
    given = F.least("shared", F.coalesce("n_family", F.lit(0))).cast("int")
    return named.select("conv_id", "family", "shared", given.alias("given"), (given + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).cast("long").alias("total"))


NUMBERED = "part int, conv_id long, kind byte, at long, shared int, given int, total long, turn_digest binary, chars long"


def _numbered(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns with their place ``at`` in their conversation, and what ``convs`` says of it.

    Each conversation's row stands before its turns in the sorted stream. Where a conversation begins in an earlier partition, its turns (kind 2) are numbered
    from 0 and its row is unknown; a row of kind 3 for the conversation at either end of a partition says how many turns it has there."""
    heads = convs.select("conv_id", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("chars"), "shared", "given", "total")
    none = [F.lit(0).cast(t).alias(k) for k, t in (("shared", "int"), ("given", "int"), ("total", "long"))]
    both = heads.union(rows.select("conv_id", F.lit(1).cast("byte").alias("kind"), "turn", "turn_digest", "tie", "chars", *none))
    names = [f.split()[0] for f in NUMBERED.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())

    def out(*cols):
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        part, known, seen, conv, first = TaskContext.get().partitionId(), None, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kind, told = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [batch.column(k).to_numpy() for k in (6, 7, 8)]
            at = np.arange(len(ids))
            head = np.maximum.accumulate(np.where(kind == 0, at, -1))
            inside = head >= 0
            if known is None and first is None and inside.any():
                first = (conv if conv is not None else int(ids[0]), seen + int((~inside).sum()))
            place = np.where(inside, at - head - 1, at + seen)
            values = [np.where(inside, x[head], -1 if known is None else known[k]) for k, x in enumerate(told)]
            turn = np.flatnonzero(kind == 1)
            opened = ~inside[turn] if known is None else np.zeros(len(turn), bool)
            yield out(np.full(len(turn), part), ids[turn], np.where(opened, 2, 1), place[turn], *(x[turn] for x in values), batch.column(3).take(pa.array(turn)), batch.column(5).take(pa.array(turn)))
            if inside[-1]:
                known, seen = [int(x[head[-1]]) for x in told], len(ids) - 1 - int(head[-1])
            else:
                seen += len(ids)
            conv = int(ids[-1])
        ends = [] if conv is None else [(conv, seen, *(known or (-1, -1, -1)))]
        if first is not None and first[1]:
            ends.append((*first, -1, -1, -1))
        for c, n, *x in ends:
            yield out([part], [c], [3], [n], *([v] for v in x), [None], [None])

    return ranged(both, "conv_id", "kind", "turn", "turn_digest", "tie").mapInArrow(run, NUMBERED)


def _placed(numbered: DataFrame) -> DataFrame:
    """All turns with their places. The rows that tell a partition's ends are two a partition at most, so they are broadcast."""
    order = Window.partitionBy("conv_id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = numbered.where("kind = 3").select("part", F.lit(2).cast("byte").alias("kind"), F.sum("at").over(before).alias("skip"), *(F.max(c).over(before).alias(f"{c}_") for c in ("shared", "given", "total")), F.col("shared").alias("own"))
    ends = ends.where("own = -1").drop("own")
    told = [F.when(F.col("kind") == 2, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("shared", "given", "total")]
    return numbered.where("kind < 3").join(F.broadcast(ends), ["part", "kind"], "left").select("conv_id", (F.col("at") + F.coalesce("skip", F.lit(0))).alias("at"), *told, "turn_digest", "chars")


def _rebuilt(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, at, total, turn_digest, chars`` of every turn of every rebuilt conversation."""
    own = placed.where("at >= shared").select("conv_id", (F.col("at") - F.col("shared") + F.col("given")).alias("at"), "total", "turn_digest", "chars")
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < MOST_SHARED)).select(F.col("conv_id").alias("family"), "at", "turn_digest", "chars")
    given = heads.join(convs.where("given > 0").select("conv_id", "family", "given", "total"), "family").where("at < given")
    return own.unionByName(given.select("conv_id", "at", "total", "turn_digest", "chars"))


def _chained(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, at, total, chars, node, parent``, digests of the turns from a block's first on; parent is null for a block's first turn."""

    def run(batches):
        block, digest = None, b""
        for batch in batches:
            nodes, parents = [], []
            for conv, at, turn in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if block != (conv, at // BLOCK):
                    block, digest = (conv, at // BLOCK), None
                parents.append(digest)
                digest = hashlib.sha256((digest or b"") + turn).digest()[:16]
                nodes.append(digest)
            cols = [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "at", "total", "chars", "node", "parent"])

    dealt = rebuilt.select("conv_id", "at", "total", "turn_digest", "chars").withColumn("block", F.floor(F.col("at") / BLOCK))
    dealt = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").drop("block")
    return dealt.mapInArrow(run, "conv_id long, at long, total long, chars long, node binary, parent binary")


def _composed(chained: DataFrame) -> DataFrame:
    """Digests from the first turn on: turns of later blocks are composed with the digest of all blocks before theirs."""
    root, long = F.lit(b""), F.col("total") > BLOCK
    block = F.floor(F.col("at") / BLOCK).alias("block")
    short = chained.where(~long).withColumn("parent", F.coalesce("parent", root))
    blocks = chained.where(long & ((F.col("at") % BLOCK == BLOCK - 1) | (F.col("at") == F.col("total") - 1))).select("conv_id", block, F.col("node").alias("own"), F.col("node").alias("upto"))
    most = blocks.agg(F.max("block")).first()[0]
    if most is None:
        return short
    state, span = written(blocks), 1
    while span <= most:  # upto covers the last ``span`` blocks, or all from the first
        before = state.select("conv_id", (F.col("block") + span).alias("block"), F.col("upto").alias("earlier"))
        joined = state.join(before, ["conv_id", "block"], "left").withColumn("upto", F.when(F.col("earlier").isNull(), F.col("upto")).otherwise(_digest(F.col("earlier"), F.col("upto")))).drop("earlier")
        after = written(joined)
        release(state)
        state, span = after, 2 * span
    earlier = state.select("conv_id", (F.col("block") + 1).alias("block"), F.col("upto").alias("earlier"), F.col("own").alias("last_own"))
    last = state.select("conv_id", (F.col("block") + 2).alias("block"), F.col("upto").alias("before_last"))
    before = earlier.join(last, ["conv_id", "block"], "left").withColumn("last_node", F.when(F.col("before_last").isNull(), F.col("last_own")).otherwise(_digest(F.col("before_last"), F.col("last_own"))))
    rows = chained.where(long).withColumn("block", block).join(before.select("conv_id", "block", "earlier", "last_node"), ["conv_id", "block"], "left")
    first = F.col("earlier").isNull()
    node = F.when(first, F.col("node")).otherwise(_digest(F.col("earlier"), F.col("node")))
    parent = F.when(first, F.coalesce("parent", root)).when(F.col("parent").isNull(), F.col("last_node")).otherwise(_digest(F.col("earlier"), F.col("parent")))
    return short.unionByName(rows.select("conv_id", "at", "total", "chars", node.alias("node"), parent.alias("parent")))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the ascending ids of each node of ``ends (node, conv_id)``. Ids are sorted and joined in as many tasks as a node's ids span; only the pieces meet."""

    def joined(batches):
        node, ids, size, first = None, [], 0, None
        for batch in batches:
            out = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or size > PIECE):
                    out.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "first", "piece"), r, strict=True)) for r in out], pieces)
        if ids:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": first, "piece": ",".join(ids)}], pieces)

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and n == node:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    out.append({"node": node, "ends_sha256": state.hexdigest()})
                node, state = n, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist(out, digests)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], digests)

    pieces = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    digests = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    parts = ranged(ends.select("node", "conv_id"), "node", "conv_id").mapInArrow(joined, "node binary, first long, piece string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def roll_up(nodes: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Sums of ``leaves`` and ``saved`` over each node's subtree, from ``nodes (node, parent, depth, leaves, saved)`` of depth 1 and more; the children of each node
    that has any, ``(above, n)``; and the written rows that both read."""
    state = nodes.select("node", "depth", F.col("parent").alias("above"), "leaves", "saved")
    done, stored, step, children = [], [], 1, None
    while children is None or step < deepest:
        pointing = state.where(F.col("depth") > step)
        sums = written(pointing.groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n")))
        children = sums.select("above", "n") if children is None else children
        jump = join_hot(pointing.where(F.col("depth") > 2 * step).select("node", "above"), pointing.select(F.col("node").alias("above"), F.col("above").alias("next")), "above", sums.select("above", "n"))
        after = state.drop("above").join(sums.withColumnRenamed("above", "node"), "node", "left").join(jump.select("node", F.col("next").alias("above")), "node", "left")
        after = written(after.select("node", "depth", "above", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")), (F.col("n").isNotNull() | (F.col("depth") > 2 * step)).alias("on")))
        done.append(after.where("NOT on").select("node", "leaves", "saved"))
        state, step, stored = after.where("on").drop("on"), 2 * step, [*stored, sums, after]
    done.append(state.select("node", "leaves", "saved"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, children, stored


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: ``node`` and ``parent`` (digests in hexadecimal, the root's is empty), ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("turn_digest"), F.length(text).cast("long").alias("chars"))
    rows = written(turns.withColumn("tie", F.monotonically_increasing_id()))
    convs = written(conversations_of(rows))
    numbered = written(_numbered(rows, convs))
    chained = written(_chained(_rebuilt(_placed(numbered), convs)))
    release(rows, numbered)
    turned = written(_composed(chained))
    release(chained)
    nodes = turned.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), (F.min("at") + 1).alias("depth"), F.min("parent").alias("parent"), F.max("chars").alias("chars"))
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    parents = nodes.where("depth > 1").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    marked = written(nodes.join(parents, "node", "left").withColumn("leaves", F.when(F.col("inner"), 0).otherwise(1).cast("long")).drop("inner"))
    release(nodes)
    totals = marked.agg(F.max("depth"), F.sum("leaves"), F.sum("saved"), F.count_if(F.col("depth") == 1)).first()
    least, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    sums, children, _ = roll_up(marked, totals[0] or 1)
    no_ids, root = hashlib.sha256(b"").hexdigest(), F.lit(b"")
    last = turned.where(F.col("at") == F.col("total") - 1).select("node", "conv_id").unionByName(convs.where("total = 0").select(root.alias("node"), "conv_id"))
    ends = written(_end_digests(last))
    above = join_hot(marked.where("depth > 1").select("node", F.col("parent").alias("above")), marked.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id")), "above", children)
    out = marked.drop("leaves", "saved").join(sums, "node").join(children.withColumnRenamed("above", "node"), "node", "left").join(above.drop("above"), "node", "left")
    out = out.select("node", "parent", "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    top = convs.sparkSession.range(1 if n_convs else 0).select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"),
        F.lit(totals[3]).cast("long").alias("n_children"), F.lit(totals[1] or 1).cast("long").alias("n_leaves"), F.lit(totals[2] or 0).cast("long").alias("saved_tokens"),
    )
    out = out.unionByName(top).join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(no_ids)))
    return out.withColumns({"node": F.lower(F.hex("node")), "parent": F.lower(F.hex("parent"))})


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: CRC-32, bit by bit: each byte, then eight shifts (-1).
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), lambda ch: list_concat([ord(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"

SQL = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS d, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, d, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS src, o.pos, o.d, o.chars FROM c JOIN o ON o.conv_id = c.family WHERE o.pos < h UNION ALL SELECT c.conv_id, 1, o.pos, o.d, o.chars FROM c JOIN o USING (conv_id) WHERE o.pos >= h),
p AS (SELECT conv_id, chars, string_agg(d, '') OVER w AS path, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS total FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, pos)),
m AS (SELECT conv_id, path, depth, depth = total AS fin, chars FROM p UNION ALL SELECT c.conv_id, '', 0, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id), 0 FROM c),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE fin), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT path[:-33] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT unnest(list_transform(range(0, n.depth + 1), lambda g: n.path[:32 * g])) AS path, (n_convs - 1) * chars AS saved, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k USING (path)),
s AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY path)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n up ON n.depth > 0 AND up.path = n.path[:-33]
"""
