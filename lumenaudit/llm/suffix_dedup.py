"""Removal of byte strings that an earlier document has too, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A window is a string of ``LENGTH`` bytes inside a document. Each has a key from its own bytes, the least hash of the 20-byte grams in it, so that
equal windows have equal keys, and windows that follow each other mostly share one. Consecutive windows of one key form a segment.

1. Keys of several documents are found with one shuffle of keys (``stars``); others can't repeat across documents.
2. Documents meet their shared keys and emit the segments of these keys. Equal segments fold into one with its least doc_id.
3. Segments are dealt by key, and a task takes some of them at a time as one text with a unique end mark each. Breadth-first backward extension on the text's
   Burrows-Wheeler transform finds the boundaries of common prefixes of 0, 1, 2, ... bytes and stops at ``LENGTH``: suffixes between boundaries share a window. The least
   doc_id of each such group tells which windows an earlier document has. A key of very many different segments is dealt by whole windows instead.
4. The windows to remove go back to their documents, whose texts are cut.

Strings are judged on the input; matches lie within documents. Null and empty texts have no bytes. Texts may be of any length. Rows that repeat a doc_id
don't precede each other. Rows without doc_id have no place in the order: they stay whole and remove nothing.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, free_name, map_slices, raw_bytes, release, written
from lumenaudit.llm.hashing import A, B, C, mixed, signed
from lumenaudit.llm.stars import ENTRY, shared_lists, stars

LENGTH = 50
GRAM = 20  # shorter grams make fewer keys, but more keys that documents share by chance
SPAN = LENGTH - GRAM + 1  # grams in a window
#: Windows in a segment at most; a gram lies in no more windows anyway unless a text repeats itself.
SEGMENT = SPAN
#: Texts that are cut into segments at a time: few enough for the arrays to stay in the processor's cache.
ROWS = 64
#: Symbols in one transform.
PIECE = 1_200_000
#: Different segments of a key beyond which it is dealt by windows.
MANY = 12_000


def segments(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of the texts: number of the text, first window, number of windows, key."""
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    whole = b"".join(t for t in texts if t)
    n = len(whole)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    data = whole + bytes(32)
    x = np.ndarray((n,), "<u8", data, strides=(1,))
    y = np.ndarray((n,), "<u8", data, 8, strides=(1,))
    z = np.ndarray((n,), "<u8", data, GRAM - 8, strides=(1,))
    m = mixed(mixed(x * A + mixed(y * B)) + z * C)[: n - GRAM + 1]
    done = 1
    while done * 2 <= SPAN:  # the least of 2, 4, 8, 16 grams, then of SPAN
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    m = np.minimum(m[: len(m) - (SPAN - done)], m[SPAN - done :])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(m)]
    inside = np.arange(len(m)) + LENGTH <= ends[owner]
    fresh = np.ones(len(m), bool)
    fresh[1:] = (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(fresh)
    run = np.diff(np.append(begin, len(m)))
    if (run > SEGMENT).any():
        again = np.repeat(begin, run)
        fresh |= (np.arange(len(m)) - again) % SEGMENT == 0
        begin = np.flatnonzero(fresh)
        run = np.diff(np.append(begin, len(m)))
    on = inside[begin]
    begin, run = begin[on], run[on]
    return owner[begin], begin - (ends - sizes)[owner[begin]], run, signed(m[begin])


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches):
        keys, ids, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own, _, _, key = segments(raw_bytes(part.column(1)))
                keys.append(key.view(np.uint64))
                ids.append(part.column(0).to_numpy(zero_copy_only=False)[own])
                held += len(key)
                if held > 4_000_000:
                    yield from stars(np.concatenate(keys), np.concatenate(ids))
                    keys, ids, held = [], [], 0
        if held:
            yield from stars(np.concatenate(keys), np.concatenate(ids))

    return docs.select("doc_id", "text").mapInArrow(run, ENTRY)


MEMBER = "doc_id long, th long, pos int, n int, key long, seg long, bytes binary"


def _members(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The segments of shared keys: document, first window, number of windows, key, hash and bytes."""
    keys = shared.groupBy(F.col("member").alias("doc_id")).agg(F.collect_list("sig").alias("keys"))  # no more than a document's own windows
    rows = docs.join(keys.hint("shuffle_hash"), "doc_id").select("doc_id", F.xxhash64("text").alias("th"), "text", "keys")

    def run(cols: dict, seen: set) -> dict:
        texts = raw_bytes(cols["text"])
        own, pos, n, key = segments(texts)
        sets = cols["keys"]
        on = np.zeros(len(own), bool)
        cuts = np.searchsorted(own, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            z = slice(cuts[k], cuts[k + 1])
            on[z] = np.isin(key[z], sets[k].values.to_numpy())
        own, pos, n, key = own[on], pos[on], n[on], key[on]
        cut = [texts[o][p : p + m + LENGTH - 1] for o, p, m in zip(own.tolist(), pos.tolist(), n.tolist(), strict=True)]
        take = pa.array(own)
        hashes = [xxhash.xxh64_intdigest(b) - (1 << 63) for b in cut]
        if len(seen) > 500_000:
            seen.clear()
        for k, h in enumerate(hashes):  # a task sends a segment's bytes once, not with each of its members
            if h in seen:
                cut[k] = None
            else:
                seen.add(h)
        return {
            "doc_id": cols["doc_id"].take(take), "th": cols["th"].take(take), "pos": pa.array(pos, pa.int32()), "n": pa.array(n, pa.int32()), "key": pa.array(key),
            "seg": pa.array(hashes, pa.int64()), "bytes": pa.array(cut, pa.binary()),
        }

    return map_slices(rows, run, MEMBER, rows=ROWS, setup=set)


class Transform:
    """The Burrows-Wheeler transform of texts with a unique end mark each, its suffixes ordered by their first ``depth`` bytes or more. End marks precede all bytes.

    Backward extension only counts symbols before an interval's ends, so for common prefixes of up to ``depth`` bytes the order of suffixes that agree in more doesn't matter."""

    def __init__(self, texts: list[bytes], depth: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.k, self.n = len(texts), int(lengths.sum()) + len(texts)
        flat = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        self.marks = np.cumsum(lengths + 1) - 1
        is_mark = np.zeros(self.n, bool)
        is_mark[self.marks] = True
        used = np.flatnonzero(np.bincount(flat[~is_mark], minlength=256))
        self.sigma = len(used)
        code = np.zeros(256, np.int64)
        code[used] = np.arange(1, self.sigma + 1)
        symbols = code[flat]
        symbols[self.marks] = 0
        self.symbols = symbols
        self.left = left = np.repeat(self.marks, lengths + 1) - np.arange(self.n)  # bytes up to the end mark
        bits = max(1, int(self.sigma).bit_length())
        step = 62 // bits
        padded = np.concatenate([symbols, np.zeros(step, np.int64)])
        key, here = np.zeros(self.n, np.int64), np.ones(self.n, bool)
        for d in range(step):
            key <<= bits
            key |= padded[d : d + self.n] * here
            here &= padded[d : d + self.n] > 0
        order = np.argsort(key)
        longest = min(depth, int(left.max(initial=0)) + 1)
        parts = 3 if self.n < 1 << 20 else 2  # ranks that fit into one key
        shift = 20 if parts == 3 else 31
        while step < longest:
            rank = self._ranks(order, key) + 1
            key = rank.copy()
            for part in range(1, parts):
                far = np.flatnonzero(left >= part * step)
                key <<= shift
                key[far] |= rank[far + part * step]
            order = np.argsort(key)
            step *= parts
        self.sa = order
        last = symbols[np.where(self.sa > 0, self.sa - 1, self.n - 1)]
        start = np.zeros(self.n, bool)
        start[np.concatenate([[0], self.marks[:-1] + 1])] = True
        self.bwt = np.where(start[self.sa], 0, last)  # 0: the text begins here, nothing precedes

    @staticmethod
    def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        sorted_ = key[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
        return rank

    def boundaries(self, least: int) -> np.ndarray:
        """Which suffixes, in order, share fewer than ``least`` bytes with the one before: common prefixes by increasing length."""
        n = self.n
        ok = self.bwt > 0
        by_symbol = np.argsort(np.where(ok, self.bwt, self.sigma + 1).astype(np.int16), kind="stable")[: int(ok.sum())]  # a radix sort
        lf = np.full(n, -1, np.int64)
        lf[by_symbol] = self.k + np.arange(len(by_symbol))  # the end marks come first
        same = np.zeros(len(by_symbol), bool)
        same[1:] = self.bwt[by_symbol[1:]] == self.bwt[by_symbol[:-1]]
        before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
        before[by_symbol[same]] = by_symbol[:-1][same[1:]]
        after[by_symbol[:-1][same[1:]]] = by_symbol[same]
        cut = np.zeros(n + 1, bool)
        cut[: self.k + 1] = True
        cut[n] = True
        counts = np.bincount(self.symbols, minlength=self.sigma + 1)[1:]
        edges = self.k + np.concatenate([[0], np.cumsum(counts)])
        cut[edges] = True
        lb = np.concatenate([np.arange(self.k), edges[:-1]])
        rb = np.concatenate([np.arange(self.k), edges[1:] - 1])
        for _ in range(1, least):
            if not len(lb):
                break
            size = rb - lb + 1
            at = np.repeat(lb - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            own_l, own_r = np.repeat(lb, size), np.repeat(rb, size)
            valid = ok[at]
            new_l = np.sort(lf[at[valid & (before[at] < own_l)]])
            new_r = np.sort(lf[at[valid & (after[at] > own_r)]])
            fresh = ~cut[new_r + 1]
            lb, rb = new_l[fresh], new_r[fresh]
            cut[rb + 1] = True
        return cut[:n]


def earlier(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text: by window, whether a text with a smaller owner has it."""
    found, marks = _earlier(texts, owners, length)
    return [found[a : max(a, b - length + 1)] for a, b in zip(np.concatenate([[0], marks[:-1] + 1]).tolist(), marks.tolist(), strict=True)]


def _earlier(texts: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for all texts in a row, each with its end mark, and the places of these."""
    t = Transform(texts, length)
    group = np.cumsum(t.boundaries(length)) - 1
    owner = np.repeat(owners, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[t.sa]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(owner, starts)[group]
    found = np.zeros(t.n, bool)
    found[t.sa] = (least < owner) & (t.left[t.sa] >= length)
    return found, t.marks


def _judged(parts: DataFrame) -> DataFrame:
    """Segments ``(route, key, seg, first, final, bytes)`` by route, through transforms of bounded size: ``(key, seg, first, flags)`` of those that several documents
    have or that have a window of an earlier document; flags tell the latter. A route of a single segment has nothing to compare and skips the transform."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            route = table.column(0).to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on in the next batch
            if cut:
                yield from settle(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from settle(rest)

    def settle(table):
        route, key, seg, first, final = (table.column(k).to_numpy() for k in range(5))
        fresh = np.concatenate([[True], route[1:] != route[:-1]])
        begin = np.flatnonzero(fresh)
        alone = np.repeat(np.diff(np.append(begin, len(route))) == 1, np.diff(np.append(begin, len(route))))
        once = np.flatnonzero(alone & (first < final))
        if len(once):
            yield emitted(key[once], seg[once], first[once], [None] * len(once))
        several = np.flatnonzero(~alone)
        if not len(several):
            return
        sizes = pc.binary_length(table.column(5).take(pa.array(several))).to_numpy() + 1
        held = np.cumsum(sizes)
        # whole routes go into a transform, up to half a piece or one route
        ends = np.append(np.flatnonzero(fresh[several])[1:], len(several))
        at = 0
        while at < len(several):
            done = held[at - 1] if at else 0
            k = np.searchsorted(held[ends - 1], done + PIECE // 2, side="right") - 1
            stop = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[np.searchsorted(ends, at, side="right")])
            rows = several[at:stop]
            texts = table.column(5).take(pa.array(rows)).to_pylist()
            found, marks = _earlier(texts, first[rows], LENGTH)
            starts = np.concatenate([[0], marks[:-1] + 1])
            hit = np.logical_or.reduceat(found, starts)
            on = np.flatnonzero(hit | (first[rows] < final[rows]))
            raw = found.tobytes()
            flags = [raw[a : b - LENGTH + 1] if h else None for a, b, h in zip(starts[on].tolist(), marks[on].tolist(), hit[on].tolist(), strict=True)]
            yield emitted(key[rows][on], seg[rows][on], first[rows][on], flags)
            at = stop

    def emitted(key, seg, first, flags):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(first), pa.array(flags, pa.binary())], names=["key", "seg", "first", "flags"])

    return parts.repartition("route").sortWithinPartitions("route").select("route", "key", "seg", "first", "final", "bytes").mapInArrow(run, "key long, seg long, first long, flags binary")


def _windows(segs: DataFrame) -> DataFrame:
    """Segments as windows, each with its place in its segment; dealt by the window's own hash."""

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"key": [], "seg": [], "first": [], "at": [], "route": [], "bytes": []}
        for key, seg, first, b in zip(cols["key"].to_pylist(), cols["seg"].to_pylist(), cols["first"].to_pylist(), cols["bytes"].to_pylist(), strict=True):
            for at in range(len(b) - LENGTH + 1):
                w = b[at : at + LENGTH]
                for name, x in zip(out, (key, seg, first, at, xxhash.xxh64_intdigest(w) - (1 << 63), w), strict=True):
                    out[name].append(x)
        return out

    return map_slices(segs.select("key", "seg", "first", "bytes"), run, "key long, seg long, first long, at int, route long, bytes binary")


def _judged_by_windows(segs: DataFrame) -> DataFrame:
    """The same for keys of very many segments. Equal windows fold into one with their least document before they meet."""
    rows = written(_windows(segs))
    folded = written(rows.groupBy("route").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.first("bytes").alias("bytes")).where("least < most"))
    # windows meet in transforms of some thousand different ones, which find the equal ones among them
    routes = max(1, folded.count() // 4_000)
    ends = folded.select(F.pmod("route", F.lit(routes)), "route", F.explode(F.array("least", "most")).alias("first"), "bytes").toDF("route", "key", "first", "bytes").withColumns({"seg": F.col("first"), "final": F.col("first")})
    verdict = _judged(ends).where("flags IS NOT NULL").select(F.col("key").alias("route")).distinct()
    least = folded.select("route", "least").join(verdict, "route")
    flagged = rows.join(least, "route").where("least < first").groupBy("key", "seg", "first").agg(F.collect_set("at").alias("ats"))

    def run(cols: dict) -> dict:
        flags = []
        for ats in cols["ats"].to_pylist():
            f = bytearray(SEGMENT)
            for at in ats:
                f[at] = 1
            flags.append(bytes(f))
        return {c: cols[c] for c in ("key", "seg", "first")} | {"flags": flags}

    some = map_slices(flagged, run, "key long, seg long, first long, flags binary")
    return segs.select("key", "seg", "first", "final").join(some.select("key", "seg", "flags"), ["key", "seg"], "left").where("flags IS NOT NULL OR first < final").select("key", "seg", "first", "flags")


def removals(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, spans)``: for each document with bytes to remove, ranges of windows ``(pos, n, flags)``; without flags all of them go."""
    docs = docs.where(F.col("doc_id").isNotNull())
    shared = written(shared_lists(_keys(docs)).select("sig", "member"))
    members = written(_members(docs, shared))
    release(shared)
    segs = written(members.groupBy("key", "seg").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final"), F.first("bytes", ignorenulls=True).alias("bytes")))
    many = segs.groupBy("key").count().where(F.col("count") > MANY).select("key")
    hot = many.limit(1).count() > 0
    routed = segs.withColumn("route", F.col("key"))
    if hot:
        many = written(many)
        verdicts = written(_judged(routed.join(many, "key", "left_anti")).unionByName(_judged_by_windows(segs.join(many, "key", "left_semi"))))
    else:
        verdicts = written(_judged(routed))
    release(segs)
    hits = members.select("doc_id", "th", "pos", "n", "key", "seg").join(verdicts.hint("shuffle_hash"), ["key", "seg"])
    hits = hits.where((F.col("doc_id") > F.col("first")) | F.col("flags").isNotNull())
    span = F.struct("pos", "n", F.when(F.col("doc_id") > F.col("first"), None).otherwise(F.col("flags")).alias("flags"))
    out = written(hits.groupBy("doc_id", "th").agg(F.collect_list(span).alias("spans")))
    release(members, verdicts)
    return out


def covered(pos: np.ndarray, n: np.ndarray, flags: list[bytes | None]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover: all windows of a range, or the flagged ones."""
    whole = np.array([f is None for f in flags], bool)
    a, b = [pos[whole]], [pos[whole] + n[whole] - 1 + LENGTH]
    for k in np.flatnonzero(~whole).tolist():
        on = pos[k] + np.flatnonzero(np.frombuffer(flags[k], np.uint8)[: n[k]])
        a.append(on)
        b.append(on + LENGTH)
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    starts = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[starts].tolist(), b[np.append(starts[1:], len(a)) - 1].tolist(), strict=True))


def deduplicate(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``removed`` (array of runs ``start, end`` in bytes) and ``kept`` (the remaining bytes) of every row."""
    found = removals(docs.select("doc_id", "text"))
    keep, ddl = columns(docs, keep, "n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    th, own, other, mine = (free_name(docs, n) for n in ("__th", "__id", "__t", "__spans"))
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn(th, F.xxhash64("text"))
    joined = rows.join(found.select(F.col("doc_id").alias(own), F.col("th").alias(other), F.col("spans").alias(mine)).hint("shuffle_hash"), (F.col("doc_id") == F.col(own)) & (F.col(th) == F.col(other)), "left")

    def run(cols: dict) -> dict:
        texts = [t or b"" for t in raw_bytes(cols["text"])]
        spans = cols[mine]
        flat = spans.flatten()
        pos, n, flags = (flat.field(k) for k in range(3))
        pos, n, flags = pos.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64), flags.to_pylist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
        runs = [covered(pos[a:b], n[a:b], flags[a:b]) if a < b else [] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        rest = []
        for t, r in zip(texts, runs, strict=True):
            end, parts = 0, []
            for a, b in r:
                parts.append(t[end:a])
                end = b
            rest.append(b"".join([*parts, t[end:]]))
        return {c: cols[c] for c in keep} | {"n_bytes": [len(t) for t in texts], "removed": [[{"start": a, "end": b} for a, b in r] for r in runs], "kept": rest}

    return map_slices(joined.select(*dict.fromkeys([*keep, "text"]), mine), run, ddl, rows=256)


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    got = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
