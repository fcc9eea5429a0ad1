"""Exact self-join of shingle sets by Jaccard similarity: a size-aware heavy-light join that yields classes and components.

A set is the distinct 5-word shingles of a text (64-bit hashes of them); equal sets form a class, and only classes are joined. All sets share one order: frequent shingles
(``df`` of at least ``heavy_share`` of the documents, found in a pass over all texts) last, else by hash. Of two sets that link at t = 0.8 the larger one has the first ``s`` common elements among its first ``n - ceil(t n) + s``, the smaller one
already among its first ``n - ceil(2 t / (1 + t) n) + s``, its inner prefix. Small sets enumerate all subsets of size 2 of their prefix, which few others have; large sets, and small ones
that a large one may link with, enter inverted lists of their prefix's elements. The boundary minimises the cost of rows written against list
entries scanned, over the sizes of all classes and the mean list length of all texts. Only pairs with an inner entry in a list need a test: lists without one go, and texts of one template
that have more elements of their own than a link allows are never an inner entry of the template's lists.

The lists of near copies mostly agree: all lists with one least class, the hub, fold into a group of distinct classes, so that two classes that share hundreds of
elements meet once and not once for each. Classes with an inner entry meet all of their group, in blocks of some ten thousand where it is long. Each class carries a sketch, the parities of its elements by bucket;
where two sketches differ in more bits than a link allows elements to differ, the pair can't link and is never a row. In the first turns each
class of a block gives the one pair with the nearest class of another component. These pairs are verified on the texts and the links'
components labelled; last, all pairs across components that sketches don't rule out are verified. A class without a pair in a turn has none later and leaves its groups.
Pairs of one component need no test, as results tell components.

Null and empty texts have empty sets and link with nothing; a row of them is a component of its own. Repeated rows are equal sets, also those of one doc_id; rows of one doc_id
with different texts are sets of their own, each with its own class and component. A row with a null doc_id links like any other and so may
join two components, but never names a class or component: these have a null id only where all their rows have. Any length of text works; a task holds the texts of one slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import free_name, raw_bytes, release, shared_value, written
from lumenaudit.llm.graph import components
from lumenaudit.llm.hashing import A, B, mixed, signed, word_hashes
from lumenaudit.llm.stars import ENTRY, shared_lists, stars

WIDTH = 5
#: Buckets of a sketch at least; a power of two, as are all numbers of buckets.
LEAST_BUCKETS = 256
#: Upper-case ASCII letters to lower case; all that parts words to blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8 or more
#: Sets of that many elements are large whatever they cost.
MOST_SMALL = 400
#: Classes of a block, and bytes of their sketches: two blocks meet in one task.
BLOCK = 32_768
BLOCK_BYTES = 16 << 20
#: Entries of a list that meets its hub in all tasks, where lists hold no more than ``HOT_LISTS`` times as many in all.
HOT_LIST = 1_000_000
HOT_LISTS = 10_000
#: Tasks that share a group's rows where they learn how many blocks it has.
SALTS = 16


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        h = mixed(h * A + codes[k : len(codes) - n + 1 + k])
    return h


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles, ascending."""
    codes, counts = word_hashes(texts, TABLE)
    whole, out, at = _rolled(codes, WIDTH), [], 0
    for n in counts.tolist():
        h = whole[at : at + n - WIDTH + 1] if n >= WIDTH else _rolled(codes[at : at + n], n) if n else whole[:0]
        h = np.sort(h)
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
        at += n
    return out


def set_hash(s: np.ndarray) -> int:
    """An even number: an entry's last bit tells whether it is an inner one."""
    return (xxhash.xxh64_intdigest(s.tobytes(), len(s)) & ~1) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements by bucket, twice as many buckets as elements or more."""
    buckets = max(LEAST_BUCKETS, 1 << (2 * len(s) - 1).bit_length())
    counts = np.bincount(((s >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many buckets."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - common)


SURVEY = "doc_id long, th long, n int, cls long, sketch binary, token long, count long"


def _survey(docs: DataFrame, heavy_share: float) -> DataFrame:
    """One pass over all texts: class rows, and counts of shingles that are frequent in a task or lie in a fixed 1/256 of the hash range."""

    def run(batches):
        seen, n_docs = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(raw_bytes(part.column(2)))
                n_docs += len(sets)
                seen.append(np.concatenate(sets))
                m, none = len(sets), [None] * len(sets)
                yield _rows(part.column(0), part.column(1), [len(s) for s in sets], [set_hash(s) for s in sets], [sketch(s) for s in sets], none, none)
                if sum(map(len, seen)) > 8_000_000:
                    yield counts(seen, n_docs)
                    seen, n_docs = [], 0
        if seen:
            yield counts(seen, n_docs)

    def counts(seen, n_docs):
        tokens, n = np.unique(np.concatenate(seen), return_counts=True)
        on = (n >= max(3, heavy_share * n_docs)) | (tokens >> np.uint64(56) == 7)
        none = [None] * int(on.sum())
        return _rows(none, none, none, none, none, signed(tokens[on]), n[on])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, SURVEY)


def _rows(*cols):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SURVEY.split(", ")])


def prefix(s: np.ndarray, heavy: np.ndarray, extra: int) -> np.ndarray:
    """The first ``n - ceil(0.8 n) + extra`` elements in the common order."""
    k = len(s) // DENOMINATOR + extra
    if len(heavy):
        at = np.searchsorted(heavy, s)
        late = heavy[np.minimum(at, len(heavy) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:k]


def signatures(s: np.ndarray, heavy: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, subsets of two for small sets and single elements for those that link with a large set, and which of them lie in its inner prefix."""
    n, out, inner = len(s), [], []
    within = n * (DENOMINATOR - NUMERATOR) // (NUMERATOR + DENOMINATOR)
    if n <= boundary and n >= NUMERATOR:
        p = prefix(s, heavy, 2)
        i, j = np.triu_indices(len(p), 1)
        out.append(mixed(p[i] * A + p[j] * B))
        inner.append(j < within + 2)
    if n * DENOMINATOR >= NUMERATOR * (boundary + 1) and n >= NUMERATOR:
        out.append(mixed(prefix(s, heavy, 1)))
        inner.append(np.arange(len(out[-1])) < within + 1)
    return (np.concatenate(out), np.concatenate(inner)) if out else (np.zeros(0, np.uint64), np.zeros(0, bool))


def _entries(docs: DataFrame, heavy: np.ndarray, boundary: int) -> DataFrame:
    """The entries of the inverted lists; a member is its class, plus 1 for an inner entry."""
    sent = shared_value(docs.sparkSession, heavy)

    def run(batches):
        frequent, sigs, classes, held = sent(), [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for s in shingle_sets(raw_bytes(batch.slice(at, 256).column(0))):
                    g, inner = signatures(s, frequent, boundary)
                    if len(g):
                        sigs.append(g)
                        classes.append(set_hash(s) + inner.astype(np.int64))
                        held += len(g)
                if held > 3_000_000:
                    yield from stars(np.concatenate(sigs), np.concatenate(classes))
                    sigs, classes, held = [], [], 0
        if held:
            yield from stars(np.concatenate(sigs), np.concatenate(classes))

    return docs.select("text").mapInArrow(run, ENTRY)


def _groups(lists: DataFrame) -> DataFrame:
    """``(hub, cls, inner)``: the distinct classes of all lists with an inner entry whose least class is the hub, and whether one of their entries is an inner one."""
    even = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    hubs = written(lists.groupBy("sig").agg(F.min(even("pivot")).alias("hub"), F.max(F.col("member").bitwiseAND(F.lit(1))).alias("any"), F.count("*").alias("entries")))
    hot = hubs.where(F.col("entries") >= max(HOT_LIST, (hubs.agg(F.sum("entries")).first()[0] or 0) // HOT_LISTS))
    if hot.limit(1).count():  # at most HOT_LISTS rows
        apart = lists.join(F.broadcast(hot), "sig", "left_anti").join(hubs, "sig")
        met = apart.unionByName(lists.join(F.broadcast(hot), "sig"))
    else:
        met = lists.join(hubs, "sig")
    met = met.where("any = 1").select("hub", even("member").alias("cls"), F.col("member").bitwiseAND(F.lit(1)).alias("inner"))
    out = met.groupBy("hub", "cls").agg((F.max("inner") == 1).alias("inner"))
    out._release = hubs
    return out


def _pairs(groups: DataFrame, classes: DataFrame, labels: DataFrame | None, nearest: bool) -> DataFrame:
    """Distinct pairs ``(a, b)`` of classes of one group and different components, one of them with an inner entry, whose sizes and sketches allow a link: all of them, or for each
    class of a block the nearest one."""
    rows = _cells(groups, classes, labels)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            key = [table.column(k).to_numpy() for k in range(3)]
            fresh = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            cuts = [0, *fresh.tolist()]
            rest = table.slice(cuts[-1])
            yield from settle(table, cuts)
        if rest is not None:
            yield from settle(rest, [0, rest.num_rows])

    def settle(table, cuts):
        found = []
        cls, comp, n = (table.column(k).to_numpy() for k in range(3, 6))
        left, right = (table.column(k).to_numpy(zero_copy_only=False) for k in (6, 7))
        sketches = table.column(8).combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and left[a:b].any():
                i, j = near(comp[a:b], n[a:b].astype(np.int64), sketches[a:b].to_pylist(), left[a:b], right[a:b], nearest)
                found.append((cls[a:b][i], cls[a:b][j]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return rows.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q").mapInArrow(run, "a long, b long").distinct()


def _cells(groups: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of the groups ``(hub, cls, inner, n)`` that span components, with their sketches, by cell: in cell ``(p, q)`` block p of the inner classes meets block q of all."""
    named = groups.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left") if labels is not None else groups.withColumn("component", F.lit(None).cast("long"))
    named = named.withColumn("component", F.coalesce("component", "cls"))
    size = F.greatest(F.lit(32.0), F.col("n") / 2)  # bytes of a sketch at most
    blocks = lambda one: F.ceil(F.greatest(F.sum(F.when(one, F.lit(1.0))) / BLOCK, F.sum(F.when(one, size)) / BLOCK_BYTES)).cast("int")
    spans = named.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y"), blocks(F.col("inner")).alias("ps"), blocks(F.lit(True)).alias("qs"))
    salted = spans.where("x < y AND ps > 0").select("hub", "ps", "qs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a long group meets its row in several tasks
    rows = named.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"]).join(classes.select("cls", "sketch"), "cls")
    rows = rows.withColumn("own_p", F.pmod(F.xxhash64("cls", F.lit(2)), "ps").cast("int")).withColumn("own_q", F.pmod(F.xxhash64("cls"), "qs").cast("int"))
    across = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), F.col("own_q").alias("q")))
    down = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.struct(F.col("own_p").alias("p"), q.alias("q")))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("inner"), F.array_union(across, down)).otherwise(across)))
    left, right = F.col("inner") & (F.col("cell.p") == F.col("own_p")), F.col("cell.q") == F.col("own_q")
    return rows.select("hub", "cell.p", "cell.q", "cls", "component", "n", left.alias("left"), right.alias("right"), "sketch")


def near(comp: np.ndarray, n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components, one of ``left`` and one of ``right``, that sizes and sketches don't rule out. ``nearest``: for each place one with the fewest
    different bits, if any."""
    order = np.argsort(n, kind="stable")
    comp, n, left, right = comp[order], n[order], left[order], right[order]
    widths = np.fromiter((len(sketches[k]) for k in order.tolist()), np.int64, len(order))
    tables, first = {}, {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)  # together, as sizes ascend
        tables[w], first[w] = np.frombuffer(b"".join([sketches[k] for k in order[at].tolist()]), np.uint8).reshape(-1, w), int(at[0])
    double = {w: folded(tables[2 * w]) for w in tables if 2 * w in tables}
    most = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, side="right")
    sides = np.flatnonzero(left), np.flatnonzero(right)
    first_of, second_of = [], []
    best, partner = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
    for k in range(len(n) - 1):
        w = int(widths[k])
        mine = tables[w][k - first[w]]
        for width, table in ((w, tables[w]), (2 * w, double.get(w))):
            if table is None:
                continue
            a, b = max(k + 1, first[width]), min(int(most[k]), first[width] + len(table))
            if a >= b:
                continue
            if left[k] and right[k]:
                at = a + np.flatnonzero(comp[a:b] != comp[k])
            else:
                side = sides[1 if left[k] else 0]
                at = side[np.searchsorted(side, a) : np.searchsorted(side, b)]
                at = at[comp[at] != comp[k]]
            if not len(at):
                continue
            rows = table[at - first[width]] if len(at) < b - a else table[a - first[width] : b - first[width]]
            gap = np.bitwise_count(rows ^ mine).sum(axis=1, dtype=np.int64)
            on = gap * (NUMERATOR + DENOMINATOR) <= (n[at] + n[k]) * (DENOMINATOR - NUMERATOR)
            at, gap = at[on], gap[on]
            if nearest and len(at):
                closer = gap < best[at]
                best[at[closer]], partner[at[closer]] = gap[closer], k
                j = int(np.argmin(gap))
                if gap[j] < best[k]:
                    best[k], partner[k] = gap[j], at[j]
            elif len(at):
                first_of.append(np.full(len(at), k))
                second_of.append(at)
    if nearest:
        k = np.flatnonzero(partner >= 0)
        return order[k], order[partner[k]]
    none = np.zeros(0, np.int64)
    return (order[np.concatenate(first_of)], order[np.concatenate(second_of)]) if first_of else (none, none)


def _verified(pairs: DataFrame, texts: DataFrame, least_shares: int = 8, classes_per_share: int = 4096) -> DataFrame:
    """Those of the written pairs of classes ``(a, b)`` that link. b's text meets the texts of its partners, which are dealt out in shares, each with a copy of it."""
    most = pairs.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    shares = max(least_shares, -(-most // classes_per_share))
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int"))
    partners = dealt.select(F.col("a").alias("cls"), F.col("b").alias("hub"), "share", F.lit(1).alias("role"))
    hubs = dealt.select(F.col("b").alias("cls"), F.col("b").alias("hub"), "share", F.lit(0).alias("role")).distinct()
    rows = partners.union(hubs).join(texts, "cls")

    def run(batches):
        hub, mine = None, None
        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for cls, h, share, role, s in zip(*(part.column(k).to_pylist() for k in range(4)), shingle_sets(raw_bytes(part.column(4))), strict=True):
                    if role == 0:
                        hub, mine = (h, share), s
                    elif hub == (h, share) and linked(s, mine):
                        a.append(cls)
                        b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.select("cls", "hub", "share", "role", "text").repartition("hub", "share").sortWithinPartitions("hub", "share", "role")
    return dealt.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, *, heavy_share: float = 0.001, most_heavy: int = 1_000_000, turns: int = 2) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row; class_id is the least doc_id with the same set."""
    docs = docs.select("doc_id", "text")
    survey = written(_survey(docs, heavy_share))
    members = survey.where("n IS NOT NULL")
    total = members.agg(F.count("*").alias("docs"), F.sum("n").alias("size")).first()
    # at most size / least shingles are as frequent as that: what is broadcast is bounded
    least = max(32, heavy_share * total.docs, (total["size"] or 0) / most_heavy)
    tokens = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("df"))
    heavy = np.sort(np.array([r.token for r in tokens.where(F.col("df") >= least).select("token").collect()], np.int64).view(np.uint64))
    in_range = F.shiftrightunsigned("token", 56) == 7
    mean = tokens.where(in_range).agg(F.avg("df")).first()[0] or 1.0
    named = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("rep")
    classes = written(members.where("n > 0").groupBy("cls").agg(named, F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("cls", "rep.doc_id", "rep.th", "n", "sketch"))
    sizes = classes.groupBy(F.least("n", F.lit(MOST_SMALL + 1)).alias("n")).count().collect()
    boundary = boundary_by_cost(mean, {r.n: r["count"] for r in sizes})
    lists = written(shared_lists(_entries(docs, heavy, boundary)))
    grouped = _groups(lists)
    groups = written(grouped.join(classes.select("cls", "n"), "cls"))
    release(lists, grouped._release)
    labels = links = texts = None
    for turn in range(turns + 1):
        pairs = written(_pairs(groups, classes, labels, nearest=turn < turns))
        if turn < turns:  # components only grow: a class that is near none of another component in this turn is so in no later one
            whole, near_ones = groups, written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
            groups = written(whole.join(near_ones, "cls", "left_semi"))
            if turn == 0:
                needed = classes.join(near_ones, "cls").select("cls", F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
                texts = written(docs.join(needed, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))).select("cls", "text").dropDuplicates(["cls"]))
            release(whole, near_ones)
        if pairs.limit(1).count() == 0:
            release(pairs)
            if turn < turns:  # nothing is near across components, so the last turn would find nothing either
                break
            continue
        more = written(_verified(pairs, texts))
        known = more if links is None else written(links.union(more))
        release(pairs, *([] if links is None else [links, more, labels]))
        links, labels = known, components(known)
    release(groups, texts)
    if labels is None:
        final = classes.select("cls", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    else:
        release(links)
        named = classes.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least_doc = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        final = named.join(least_doc, "component").select("cls", F.col("doc_id").alias("class_id"), "component_id")
    final = written(final)
    release(classes, *([] if labels is None else [labels]))
    rows = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    empty = rows.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    full = rows.where("cls IS NOT NULL").join(final, "cls").select("doc_id", "n_shingles", "class_id", "component_id")
    return full.unionByName(empty)


def boundary_by_cost(mean_list: float, sizes: dict[int, int]) -> int:
    """The largest set that is small, at the least cost over classes by size: a small set of prefix ``p`` writes ``p (p - 1) / 2`` subsets; a large one, and a small one that a
    large one may link with, writes ``p - 1`` elements and scans a list of mean length for each. A scanned entry costs about as much as four written rows, as it may have to be verified."""
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return NUMERATOR
    count, p = np.array([sizes[k] for k in n.tolist()], float), n // DENOMINATOR + 2
    small, large = count * p * (p - 1) / 2, count * (p - 1) * (1 + 4 * (mean_list - 1))
    costs = [small[n <= b].sum() + large[n * DENOMINATOR >= NUMERATOR * (b + 1)].sum() for b in range(NUMERATOR, MOST_SMALL)]
    return NUMERATOR + int(np.argmin(costs))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """All columns of the rows to keep: one of each component, and every row without words.

    Rows count by a number of their own, so ids may be null or repeat: of a component the row with the least doc_id stays, one with a null id only where
    all its rows have null ids (so also where it is alone), and of rows with the same least id one, which isn't defined."""
    number = free_name(docs, "__number")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()))
    got = join(rows.select(F.col(number).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(number), F.col("component_id").alias("component"))
    ranked = got.join(rows.select(number, "doc_id"), number)
    kept = ranked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(number).alias("row"))).alias("first")).select(F.col("first.row").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
