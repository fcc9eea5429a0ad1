"""The prefix trie, spelling variants and line dedup against plain versions, on rows with nulls, ties, repeats and hot keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import line_dedup, prefix_trie, spelling
from lumenaudit.llm.ordered import join_hot


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(family, [])[:h] + t[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends(p).encode()))) for p, m in members.items())


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 140), 205, 206, 207, -7, -100, -130]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None, ""]), r.choice(["hello", "hello there", "über 😀", "", None, "x" * 50]), "clash", 1))
    long = [(r.choice(["a", "b"]), r.choice("pqr") * r.randrange(3)) for _ in range(700)]
    for c, n in ((300, 700), (301, 700), (302, 512), (303, 256), (304, 257), (399, 650)):  # longer than a block, with shared beginnings
        rows += [(c, t, *long[t], "clash", 1) for t in range(n)]
    rows += [(1, None, "user", "first"), (1, None, "user", "also first"), (2, 3, "user", "tie"), (2, 3, "user", "tie"), (2, 3, "x", "tie"), (None, 0, "user", "no conversation")]
    rows = [(*x[:4], "clash", 1) for x in rows]
    r.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string, node string, depth long"


def listed(df):
    return sorted(str((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in df.collect())


def test_prefix_trie(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(5)
    assert listed(prefix_trie.prefix_trie(df)) == plain_trie(rows)


def test_prefix_trie_blocks_partitions_and_hot_conversations(spark, monkeypatch):
    """Blocks of three turns, ids joined two at a time, and a conversation that fills most partitions of the sorted rows."""
    rows = [(c, t, "u", f"{t % 7}", "", 0) for c, n in ((0, 400), (1, 60), (2, 60), (5, 1), (9, 11)) for t in range(n)] + [(k, 0, "u", "0", "", 0) for k in range(1000, 1060)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert listed(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(3))) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_prefix_trie_without_rows_or_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its family's first conversation is absent
    rows = [(turnless, 0, "u", "t", "", 0), (turnless, 1, None, None, "", 0)]
    assert listed(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV))) == plain_trie(rows) == [str((turnless, 0, None, 1, 0, 1, 0, sha(str(turnless).encode())))]


def test_prefix_trie_sql(spark, tmp_path):
    rows = [x for x in conversations(8) if x[0] != 399]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(prefix_trie.SQL)
    got = prefix_trie.query(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# --- spelling variants


def plain_words(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    words = plain_words(docs)
    form, near = {}, {}
    for w, n in words.items():
        found = sorted((-m, x) for x, m in words.items() if one_apart(w, x))
        near[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return sorted(map(str, out))


def word_docs(seed=5):
    r = random.Random(seed)
    parts = ["ther", "in", "on", "aa", "aab", "é", "ÿß", "ed", "And", "×"]
    vocabulary = ["".join(r.choice(parts) for _ in range(r.randrange(2, 6))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaabaa", "Separate", "seperate", "separates", "SEPARATE", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    for w in list(vocabulary[:40]):
        k = r.randrange(len(w))
        vocabulary += [w[:k] + r.choice("aeé") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("xyz") + w[k + 1 :]]
    docs = [(n, " ".join(r.choice(vocabulary[: r.choice([4, 30, 200])]) + r.choice(["", ",", "7", " \n", "Ā", "😀"]) for _ in range(r.randrange(0, 200))), "clash", 1) for n in range(60)]
    docs += [docs[3], docs[3], (None, docs[4][1], None, None), (None, None, None, None), (77, "", None, None), (78, "separate seperate " * 400, None, None)]
    docs.append((79, "chainaa " * 250 + "chainab " * 40 + "chainbb " * 6, None, None))  # a form of a form
    return docs


DOCS = "doc_id long, text string, word string, n long"


def test_spelling_variants(spark):
    docs = word_docs()
    got = spelling.spelling_variants(spark.createDataFrame(docs, DOCS).repartition(4))
    rows = sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in got.collect())
    assert rows == plain_variants(docs)
    assert any(r.form for r in got.collect()) and any(r.form and r.root != r.form for r in got.collect())


def test_spelling_sql(spark, tmp_path):
    docs = word_docs(9)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(spelling.SQL)
    got = spelling.query(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_spelling_of_anagrams_and_of_nothing(spark):
    """Words of one anagram class, all letters of it in many orders, and their neighbours by one letter."""
    r = random.Random(2)
    orders = {"".join(r.sample("abcdefg", 7)) for _ in range(150)}
    words = sorted(orders | {w[:3] + "z" + w[4:] for w in list(orders)[:80]} | {w[1:] for w in list(orders)[:50]} | {w + "a" for w in list(orders)[:50]})
    docs = [(n, " ".join(words * (1 + (n == 0) * 30) if n % 2 else words[::3]), "", 0) for n in range(12)]
    got = spelling.spelling_variants(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(str((x.word, x.form, x.root, x.n, x.n_near, x.form_n)) for x in got) == plain_variants(docs)
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def test_anagram_keys_differ_by_a_letter():
    assert spelling.anagram_key(b"listen") == spelling.anagram_key(b"silent")
    assert spelling.anagram_key(b"listens") - spelling.anagram_key(b"silent") == ord("s") ** 5
    assert spelling.anagram_key(b"listed") - spelling.anagram_key(b"silent") == ord("d") ** 5 - ord("n") ** 5


# --- line dedup


def plain_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    rank = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for doc_id, text, *_ in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)], key=rank) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(map(str, out))


def line_docs(seed=1):
    r = random.Random(seed)
    lines = [f"Line number {k} of the common ones" for k in range(40)] + ["short", "ÄÖÜäöüßÄÖ", "ÄÖÜäöüßÄÖÜ", "  A Padded Line\t", "a padded line", " a padded line", "", "   ", "1234567890", "123456789"]
    docs = [(n, "\n".join(r.choice(lines[: r.choice([3, 50])]) if r.random() < 0.6 else f"own line {r.random()}" for _ in range(r.randrange(1, 30))), "clash", 1, "x") for n in range(0, 200, 2)]
    docs += [docs[5], docs[5], (8, "Line number 1 of the common ones\nline number 1 OF the common ones", "", 0, "y"), (None, "Line number 2 of the common ones\nonly here, twice\nonly here, twice", "", 0, None), (None, "only here, twice", "", 0, None)]
    docs += [(-5, "Line number 39 of the common ones\r", None, None, None), (301, None, None, None, None), (302, "", None, None, None), (303, "\n" * 5, None, None, None), (304, "\n".join(["Line number 3 of the common ones"] * 3000), None, None, None)]
    r.shuffle(docs)
    return docs


LINES = "doc_id long, text string, th string, keep long, row string"


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup(spark, tmp_path, many_partitions):
    """Also with a key that spans partitions of the sorted entries."""
    docs = line_docs()
    spark.createDataFrame(docs, LINES).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(tuple(r)) for r in line_dedup.query(spark, str(tmp_path)).collect()) == plain_lines(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, con.sql(line_dedup.SQL).fetchall())) == plain_lines(docs)


def test_line_dedup_small_shares(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(line_dedup, "HELD", 5)
    docs = [(n, "\n".join(["the one line that everyone has"] * (n % 3 + 1) + [f"a line of two documents {n // 2}"]), "", 0, "") for n in range(400)]
    bitmaps = line_dedup.keep_bitmaps(spark.createDataFrame(docs, LINES).repartition(8))
    got = {r.doc_id: (r.n_lines, r.n_dropped, line_dedup.kept_lines(bytes(r.keep), r.n_lines).tolist()) for r in bitmaps.collect()}
    assert got == {n: (n % 3 + 2, (n > 0) * (n % 3 + 1) + n % 2, [n == 0] * (n % 3 + 1) + [n % 2 == 0]) for n in range(400)}


def test_drop_lines_keeps_other_columns(spark):
    docs = line_docs(4)
    df = spark.createDataFrame(docs, LINES)
    got = line_dedup.drop_lines(df)
    assert got.schema.names == df.schema.names
    want = Counter(plain_lines(docs))
    rows = got.collect()
    assert Counter((r.doc_id, sha((r.text or "").encode())) for r in rows) == Counter((eval(x)[0], eval(x)[3]) for x in want.elements())  # noqa: S307
    assert Counter((r.th, r["keep"], r.row) for r in rows) == Counter(x[2:] for x in docs)
    assert sum(r.text is None for r in rows) == sum(x[1] is None for x in docs)
    assert line_dedup.drop_lines(spark.createDataFrame([], LINES)).collect() == []


def test_join_hot(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 30_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(3, 5)], "k long, v long"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    got, want = join_hot(left, right, "k", counts), left.join(right, "k")
    assert got.count() == want.count() > 20_000 and got.exceptAll(want).count() == 0


# --- columns of users with the names that operators use


@pytest.mark.parametrize("name", ["__known", "__number", "__th", "__id", "__t", "__spans", "__row", "spans", "row", "keep", "th", "base", "component_id", "cls"])
def test_columns_named_like_internal_ones_survive(spark, name):
    from lumenaudit.llm import jaccard_join, pii, suffix_dedup

    texts = ["one two three four five six seven", "one two three four five six seven", "mail bob@mail.example.com now", None, "x" * 120, "x" * 120]
    df = spark.createDataFrame([(n, t, f"mine {n}") for n, t in enumerate(texts)], f"doc_id long, text string, `{name}` string")
    own = {n: f"mine {n}" for n in range(len(texts))}
    masked = pii.mask(df, ["token ="])
    assert {r.doc_id: r[name] for r in masked.collect()} == own and masked.columns == df.columns
    assert {r.doc_id: r[name] for r in line_dedup.drop_lines(df).collect()} == own
    if name not in ("base", "spans"):  # these give way to the operator's own columns, as documented
        assert {r.doc_id: r[name] for r in pii.find(df, ["doc_id", name], ["token ="]).collect()} == own
    assert {r.doc_id: r[name] for r in suffix_dedup.deduplicate(df, ["doc_id", name]).collect()} == own
    if name in ("__number", "component_id", "cls"):
        kept = jaccard_join.keep_one(df)
        assert kept.columns == df.columns and all(r[name] == own[r.doc_id] for r in kept.collect()) and kept.count() == 4
