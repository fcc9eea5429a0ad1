"""Lines that an earlier document has already, found by range-partitioned hashes and returned as a bitmap per document.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at either end and with A-Z in lower case; it counts from 10 code points on. Tasks hash their documents' keys (128 bits). Of
the documents of a task that share a key only the least goes on, the others' lines are dropped for certain; so a line that a third of all documents have brings one entry from
each task's share. Entries are range-partitioned by hash, document and position and streamed in that order: a key's first document owns it, other documents' lines are dropped. A key that spans
partitions is settled by the owners at partitions' ends, two rows a partition. Dropped positions gather by document into compressed bitmaps.

Rows of one ``doc_id`` are one document: they keep each other's lines, each row gets its own bitmap. Rows without an id are one document, after all others. A null or empty text is one empty line.
Texts of any length are worked on whole; repeated rows get equal results. An empty table gives none. Further columns pass through ``drop_lines`` whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_slices, raw_bytes, release, written
from lumenaudit.llm.ordered import ranged

LEAST_CHARS = 10
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = b" \t\n\x0b\x0c\r"
#: Entries that a task holds before it sends them on.
HELD = 400_000
#: kind: 0 a document with its number of lines, 1 a line to settle, 2 a dropped line, 3 the owner of a key at a partition's end.
ENTRY = "kind byte, high long, low long, doc_id long, th long, line int"
_FIELDS = pa.schema([("kind", pa.int8()), ("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32())])


def line_keys(text: bytes) -> list[bytes | None]:
    """Each line's key, None for those of fewer than 10 code points."""
    lines = text.translate(LOWER).split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK)
        n = len(key)
        out.append(key if n >= LEAST_CHARS and (n >= 4 * LEAST_CHARS or key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST_CHARS) else None)
    return out


def _entries(docs: DataFrame) -> DataFrame:
    """A task's documents, the lines of each key's least document among them, and the others' lines as dropped ones."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, known, ths, counts = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_valid().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), []
                digests, owner, line = [], [], []
                for k, text in enumerate(raw_bytes(part.column(2))):
                    keys = line_keys(text or b"")
                    counts.append(len(keys))
                    for j, key in enumerate(keys):
                        if key is not None:
                            digests.append(xxhash.xxh3_128_digest(key))
                            owner.append(k)
                            line.append(j)
                none = pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(counts), np.int8)), none, none, part.column(0), part.column(1), pa.array(counts, pa.int32())], schema=_FIELDS)
                if digests:
                    words, owner = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(owner)
                    held.append((words[:, 0], words[:, 1], ~known[owner], ids[owner], ths[owner], np.array(line, np.int32)))
                    n += len(owner)
                if n > HELD:
                    yield from first_of(held)
                    held, n = [], 0
        if held:
            yield from first_of(held)

    def first_of(held):
        high, low, unnamed, ids, ths, line = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, unnamed, low, high))
        high, low, unnamed, ids, ths, line = (x[order] for x in (high, low, unnamed, ids, ths, line))
        fresh = np.ones(len(high), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(high)), 0))
        later = (ids != ids[first]) | (unnamed != unnamed[first])
        for k in range(0, len(high), 100_000):
            z = slice(k, k + 100_000)
            hashes = [pa.array(x[z], mask=later[z]) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later[z], 2, 1).astype(np.int8)), *hashes, pa.array(ids[z], mask=unnamed[z]), pa.array(ths[z]), pa.array(line[z])], schema=_FIELDS)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, ENTRY)


def _settled(entries: DataFrame) -> DataFrame:
    """Of sorted entries the dropped ones (kind 2); those of a partition's first key, which may have an owner in an earlier partition (kind 1); and the first document of
    the partition's first and last key (kind 3)."""

    def run(batches):
        last, first_key = None, None  # last: (high, low), owner (unnamed, id) of the key at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, ths, line = (batch.column(k).to_numpy() for k in (0, 1, 4, 5))
            unnamed, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(high), bool)
            fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            fresh[0] = last is None or (high[0], low[0]) != last[0]
            if first_key is None:
                first_key = (high[0], low[0])
                yield edge(first_key, bool(unnamed[0]), int(ids[0]))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(high)), -1))
            carried = first < 0
            own_id, own_un = ids[first], unnamed[first]
            if carried.any():
                own_un, own_id = np.where(carried, last[1], own_un), np.where(carried, last[2], own_id)
            open_ = (high == first_key[0]) & (low == first_key[1])
            gone = ((ids != own_id) | (unnamed != own_un)) & ~open_
            for kind, on in ((1, open_), (2, gone)):
                k = np.flatnonzero(on)
                if len(k):
                    hashes = [pa.array(x[k]) if kind == 1 else pa.nulls(len(k), pa.int64()) for x in (high, low)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), *hashes, pa.array(ids[k], mask=unnamed[k]), pa.array(ths[k]), pa.array(line[k])], schema=_FIELDS)
            last = ((high[-1], low[-1]), bool(own_un[-1]), int(own_id[-1]))
        if last is not None and last[0] != first_key:
            yield edge(*last)

    def edge(key, unnamed, doc_id):
        return pa.RecordBatch.from_arrays([pa.array([3], pa.int8()), pa.array([key[0]]), pa.array([key[1]]), pa.array([None if unnamed else doc_id], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32())], schema=_FIELDS)

    rows = entries.where("kind = 1").select("high", "low", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th", "line")
    return ranged(rows, "high", "low", "unnamed", "doc_id", "line").mapInArrow(run, ENTRY)


def compressed(dropped: np.ndarray, n_lines: int) -> bytes:
    """A bit per line, 1 for kept ones, first line first, zlib-compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_lines, n_dropped, keep`` of every distinct row ``(doc_id, text)`` of ``docs``; th is its text's xxhash64, keep a compressed bitmap of its lines."""
    entries = written(_entries(docs.select(F.col("doc_id").cast("long"), "text")))
    settled = written(_settled(entries))
    owners = settled.where("kind = 3").groupBy("high", "low").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("owner"))  # two rows a partition at most
    late = settled.where("kind = 1").join(F.broadcast(owners), ["high", "low"]).where(~F.col("doc_id").eqNullSafe(F.col("owner.doc_id")))
    dropped = entries.where("kind = 2").select("doc_id", "th", "line").union(settled.where("kind = 2").select("doc_id", "th", "line")).union(late.select("doc_id", "th", "line"))
    rows = entries.where("kind = 0").select("doc_id", "th", F.lit(-1).alias("line"), F.col("line").alias("n")).union(dropped.select("doc_id", "th", "line", F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def gather(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            heads = np.flatnonzero(changes(table))
            rest = table.slice(int(heads[-1]))
            if len(heads) > 1:
                yield settle(table.slice(0, int(heads[-1])), heads[:-1])
        if rest is not None:
            yield settle(rest, np.zeros(1, np.int64))

    def changes(table):
        th, line = table.column("th").to_numpy(), table.column("line").to_numpy()
        ids, known = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_valid().to_numpy()
        fresh = np.ones(len(th), bool)
        fresh[1:] = (th[1:] != th[:-1]) | (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
        return fresh & (line < 0)

    def settle(table, heads):
        line, n = table.column("line").to_numpy(), table.column("n").to_numpy()
        keep, counts = [], []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), table.num_rows], strict=True):
            mine = np.unique(line[a:b])
            mine = mine[mine >= 0]
            counts.append(len(mine))
            keep.append(compressed(mine, int(n[a])))
        at = pa.array(heads)
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(at), table.column("th").combine_chunks().take(at), pa.array(n[heads].astype(np.int64)), pa.array(counts, pa.int64()), pa.array(keep, pa.binary())], schema=schema)

    dealt = rows.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "line")
    out = written(dealt.mapInArrow(gather, "doc_id long, th long, n_lines long, n_dropped long, keep binary"))
    release(entries, settled)
    return out


def drop_lines(docs: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """All rows and columns, without the lines that the bitmaps drop. A row of no bitmap keeps its text; a null text stays null."""
    bitmaps = keep_bitmaps(docs) if bitmaps is None else bitmaps
    kind = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = kind.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    lost = bitmaps.where("n_dropped > 0").select(F.col("doc_id").alias("id"), F.col("th").alias("t"), F.col("n_lines").alias("n"), "keep")
    joined = rows.join(lost, rows["doc_id"].eqNullSafe(lost["id"]) & (rows["th"] == lost["t"]), "left").select("text", "keep", "n", "row")

    def cut(cols: dict) -> dict:
        out = []
        for text, keep, n in zip(cols["text"].to_pylist(), cols["keep"].to_pylist(), cols["n"].to_pylist(), strict=True):
            if keep is not None and text is not None:
                text = "\n".join(x for x, on in zip(text.split("\n"), kept_lines(keep, n), strict=True) if on)
            out.append(text)
        return {"text": out, "row": cols["row"]}

    done = map_slices(joined, cut, f"text string, row {joined.schema['row'].dataType.simpleString()}")
    return done.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = keep_bitmaps(docs)
    rows = docs.withColumn("th", F.xxhash64("text"))
    joined = rows.join(bitmaps.withColumnRenamed("doc_id", "id"), rows["doc_id"].eqNullSafe(F.col("id")) & (rows["th"] == bitmaps["th"]))

    def digests(cols: dict) -> dict:
        out = []
        for text, keep, n, dropped in zip(raw_bytes(cols["text"]), cols["keep"].to_pylist(), cols["n_lines"].to_pylist(), cols["n_dropped"].to_pylist(), strict=True):
            text = text or b""
            if dropped:
                text = b"\n".join(x for x, on in zip(text.split(b"\n"), kept_lines(keep, n), strict=True) if on)
            out.append(hashlib.sha256(text).hexdigest())
        return {"doc_id": cols["doc_id"], "n_lines": cols["n_lines"], "n_dropped": cols["n_dropped"], "kept_sha256": out}

    return map_slices(joined.select(rows["doc_id"], "text", "keep", "n_lines", "n_dropped"), digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, coalesce(min(doc_id), -1) AS owner, min(doc_id) IS NULL AS unnamed FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.r, k.n, k.line, o.key IS NOT NULL AND NOT (o.owner = coalesce(k.doc_id, -1) AND o.unnamed = (k.doc_id IS NULL)) AS gone FROM k LEFT JOIN o USING (key)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY r)
SELECT d.doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""
