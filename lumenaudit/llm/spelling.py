"""Spelling variants of words, found by anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters' codes, an integer that all anagrams share. Two words one letter apart have keys that differ by one letter's power (added or
removed) or by two letters' powers (exchanged): with one letter's power taken away, an exchange leaves both at the same key, a removal leaves the longer one at the shorter one's key. Keys, not words,
are joined for this: a key meets as many others at most as there are letters, however many anagrams share it. A letter whose removal leads to no other key isn't looked at any more.

Candidates verify their letters' order: a word without the letter at a place is known by digests of what stands before and after it, so words that agree there are one letter apart.
Such a meeting holds a word a letter of the alphabet at most. Each word takes from it the number of its near words and the best of them; pairs are never listed. Forms lead to words at least five times as frequent, so
following them to the root by pointer doubling takes a few rounds.

Words are counted over whole texts, in each task first. A null text has no words; a null doc_id counts as an empty one where letters are deleted. Repeated rows count again, words of any length
take part, ties go to the first in code-point order, an empty table gives no words, and further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import release, written
from lumenaudit.llm.ordered import join_hot, ranged

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many (document, word) pairs loses a letter.
NOISE = 199
#: Latin-1 codes: letters, with A-Z in lower case, and blanks for all else.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
POWER = [c**5 for c in range(256)]
#: Distinct words that a task counts before it sends them on.
HELD = 500_000


def document_words(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document by their number, in Latin-1; every letter of a word is in it, and all else parts words."""
    found = Counter(w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= LEAST_LETTERS)
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for w, n in found.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % NOISE == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        out[w] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of words of at least six letters with at least five occurrences."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, n in document_words(doc_id, text.as_py()).items():
                    held[w] += n
                if len(held) > HELD:
                    yield from counts(held)
                    held = Counter()
        yield from counts(held)

    def counts(held):
        words = [(w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS]
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def anagram_key(word: bytes) -> int:
    return _long(sum(map(POWER.__getitem__, word)))


def _keyed(words: DataFrame) -> DataFrame:
    """``word_id, word, n, anagram, letters``; letters are the word's distinct ones."""

    def run(batches):
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            more = [pa.array([anagram_key(w) for w in words], pa.int64()), pa.array([bytes(sorted(set(w))) for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["word_id", "word", "n", "anagram", "letters"])

    return words.select("word_id", "word", "n").mapInArrow(run, "word_id long, word string, n long, anagram long, letters binary")


def _promising(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anagram keys that differ from another by a letter added, removed or exchanged, ``anagram, letters (whose removal leads there), shorter (another key leads here)``; and ``anagram, n``,
    the words by key."""
    classes = written(keyed.groupBy("anagram", "letters").agg(F.count("*").alias("n")))

    def removed(batches):
        for batch in batches:
            out = [(a, c, _long(a - POWER[c])) for a, letters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in letters]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int16(), pa.int64()))], names=["anagram", "letter", "rest"])

    rests = written(classes.select("anagram", "letters").mapInArrow(removed, "anagram long, letter short, rest long").distinct())
    keys = classes.select(F.col("anagram").alias("rest")).distinct().withColumn("is_key", F.lit(True))
    meeting = rests.groupBy("rest").agg(F.min("anagram").alias("least"), F.max("anagram").alias("most")).join(keys, "rest", "left").where("least <> most OR is_key")
    meeting = written(meeting.select("rest", F.coalesce("is_key", F.lit(False)).alias("is_key")))
    longer = rests.join(meeting.select("rest"), "rest").groupBy("anagram").agg(F.collect_set("letter").alias("letters"))  # a class's distinct letters
    shorter = meeting.where("is_key").select(F.col("rest").alias("anagram"), F.lit(True).alias("shorter"))
    found = longer.join(shorter, "anagram", "full").select("anagram", F.coalesce("letters", F.array().cast("array<short>")).alias("letters"), F.coalesce("shorter", F.lit(False)).alias("shorter"))
    return found, classes.groupBy("anagram").agg(F.sum("n").alias("n"))


def _chain(letters: bytes) -> list[int]:
    """Digests of all beginnings, from the empty one to the whole."""
    out = [0]
    for k in range(len(letters)):
        out.append(xxhash.xxh64_intdigest(letters[k : k + 1], out[-1]))
    return out


def _places(keyed: DataFrame, promising: DataFrame, counts: DataFrame) -> DataFrame:
    """``rest, head, tail, word_id, n, letter, first``: words without one letter, by the anagram key and by the letters before and after it. The letter is -1 for whole words, parted at
    each place. first: the letter isn't that of the place before, so that of several places that leave the same letters one counts."""
    schema = pa.schema([("rest", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("word_id", pa.int64()), ("n", pa.int64()), ("letter", pa.int16()), ("first", pa.bool_())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for word_id, word, n, anagram, letters, shorter in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                w, letters = word.encode("latin-1"), set(letters)
                heads, tails = _chain(w), _chain(w[::-1])[::-1]
                for k, c in enumerate(w):
                    if c in letters:
                        out.append((_long(anagram - POWER[c]), _long(heads[k]), _long(tails[k + 1]), word_id, n, c, k == 0 or w[k - 1] != c))
                if shorter:
                    out.extend((anagram, _long(heads[k]), _long(tails[k]), word_id, n, -1, True) for k in range(len(w) + 1))
                if len(out) > 50_000:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    both = join_hot(keyed.drop("letters"), promising, "anagram", counts).select("word_id", "word", "n", "anagram", "letters", "shorter")
    return both.mapInArrow(run, "rest long, head long, tail long, word_id long, n long, letter short, first boolean")


def _near(places: DataFrame) -> DataFrame:
    """``word_id, n_near, best``: each word's near words, counted, and the one of most occurrences, as ``(n, -word_id)``."""
    member = F.struct("word_id", "n", "letter", "first")
    met = places.groupBy("rest", "head", "tail").agg(F.collect_list(member).alias("all"), F.count("*").alias("m")).where("m > 1")  # a member a letter of the alphabet, and the whole word
    each = met.select(F.explode("all").alias("x"), "all")

    def apart(x, y):  # two letters exchanged, or a letter removed from one of them
        whole = (x.letter == -1) | (y.letter == -1)
        return (x.word_id != y.word_id) & (~whole | (x.first & y.first))

    others = each.select(F.col("x.word_id").alias("word_id"), F.filter("all", lambda y: apart(F.col("x"), y)).alias("others")).where(F.size("others") > 0)
    best = F.array_max(F.transform("others", lambda y: F.struct(y.n.alias("n"), (-y.word_id).alias("least"))))
    return others.select("word_id", F.size("others").cast("long").alias("k"), best.alias("b")).groupBy("word_id").agg(F.sum("k").alias("n_near"), F.max("b").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word_id, root_id`` of words that have a form: a pointer jumps to where the word it points at points, until none moves."""
    stored = written(forms.select("word_id", F.col("form_id").alias("root_id"), F.lit(True).alias("moved")))
    while True:
        state = stored.drop("moved")
        onward = state.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        after = written(state.join(onward, "root_id", "left").select("word_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        release(stored)
        stored = after
        if stored.where("moved").limit(1).count() == 0:
            return stored.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    # ids ascend with words, as partitions hold ranges of them in order
    words = written(ranged(written(count_words(docs)), "word").withColumn("word_id", F.monotonically_increasing_id()))
    keyed = written(_keyed(words))
    promising, counts = _promising(keyed)
    near = written(_near(_places(keyed, written(promising), written(counts))))
    joined = words.join(near, "word_id", "left").withColumn("formed", F.col("best.n") >= TIMES * F.col("n"))
    joined = written(joined.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), -F.col("best.least")).alias("form_id"), F.when(F.col("formed"), F.col("best.n")).alias("form_n")))
    roots = _roots(joined.where("form_id IS NOT NULL"))
    form, root = (words.select(F.col("word_id").alias(f"{c}_id"), F.col("word").alias(c)) for c in ("form", "root"))
    named = joined.where("form_id IS NOT NULL").join(form, "form_id").join(roots, "word_id").join(root, "root_id")
    alone = joined.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return alone.unionByName(named.select("word", "form", "root", "n", "n_near", "form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    return spelling_variants(table(spark, sf_dir, "documents"))


#: CRC-32, bit by bit: each byte of the UTF-8 text, then eight shifts (-1).
_BYTES = "list_transform(range(0, strlen({0})), lambda k: 16 * (strpos('0123456789ABCDEF', hex(encode({0}))[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', hex(encode({0}))[2 * k + 2]) - 1)"
_CRC32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform({_BYTES}, lambda b: list_concat([b::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"

SQL = f"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT doc, w, count(*) AS c, doc || ':' || w AS named FROM t WHERE length(w) >= {LEAST_LETTERS} GROUP BY doc, w),
h AS (SELECT w, c, {_CRC32.format("named")} AS h FROM u),
v AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT} AND length(word) >= {LEAST_LETTERS}),
e AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM e a JOIN e b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.rest = v.word UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.rest = v.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * v.n THEN best END AS form, CASE WHEN best_n >= {TIMES} * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""
