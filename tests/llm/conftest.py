import json
import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType())])
WORDS = ["alpha", "beta", "gamma", "delta", "über", "niño", "stone", "river", "cloud", "light", "window", "paper", "green", "seven", "moon", "glass", "field", "north"]
ITEM = "one fish two fish red fish blue fish old fish new fish this one has a little star"


def corpus(seed: int = 4) -> list[tuple]:
    """Documents with copies, near copies, shared passages, junk, personal data, nulls, empty texts, ties and repeated rows."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))
    texts: list[str | None] = [say(r.randrange(20, 90)) for _ in range(60)]
    base = say(120).split()
    for _ in range(15):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        texts.append(" ".join(w))
    passage = say(60)
    texts += [say(30) + " " + passage + " " + say(30) for _ in range(6)]
    texts += [texts[3]] * 5 + ["a b c", "a b c", "A b C", "x", "x", "", "", None, None, " \n\t ", "wort " * 80]
    texts += ["#### $$$$ %%%% " * 10, "mail bob@mail.example.com now", "call +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.1", f"{say(10)} {ITEM.upper()} {say(10)}", "fish " + ITEM[8:80], f"{say(400)} {ITEM}", "tiny item"]
    texts.append(say(20_000))  # very long
    rows = [(n, t, "en", f"s{n % 3}", len(t) if t else None, "clash", None) for n, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, texts[7], None, None, None, None, None))
    r.shuffle(rows)
    return rows


def save(spark, folder, docs, labels, benchmark, pages):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def data(spark, tmp_path_factory, rows):
    labels = [(n, int(n % 4 > 0), int(n % 7 == 0)) for n in range(0, 100, 2)] + [(None, 1, 0), (4, None, None), (6, 1, 1)]
    big = "<html>" + "x" * 2000
    pages = [(1, "http://a.example/", big), (2, "http://b.example/\r\nX: y", big), (5, None, big), (None, "http://c.example/", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "", ""), (8, "ü", "é" * 500), (9, "ü", "é" * 500), (9, "ü", "é" * 500), (10, "v", "é" * 499)]
    return save(spark, tmp_path_factory.mktemp("data"), rows, labels, [(1, ITEM), (1, ITEM), (10, "tiny item"), (2, "a b c"), (None, "x"), (3, None), (4, "")], pages)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


def plain(df) -> list[str]:
    return sorted(json.dumps([str(x) for x in r]) for r in df.collect())
