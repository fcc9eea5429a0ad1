"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Each rule is a conjunction of thresholds over statistics of a text. A rule is grown on two thirds of the labelled rows, one
threshold at a time by FOIL's gain, and pruned on the others; the low-quality rows that it covers go, and the next is grown.
The list becomes one ordered Spark ``CASE WHEN``, so that applying it costs no Python and a reader can check it.

Null and empty texts have no words: all statistics are 0 and the base rule rejects them. A table without labelled rows gives an
empty list: only the base rule holds. Repeated rows are judged each by itself; of rows with one labelled id the one with the least statistics is learnt from; other columns pass through ``classify`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, label_sample, map_slices, packed, raw_bytes

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_punct long, n_digits long"
#: Features of the rules: quotients of statistics; a divisor of 0 counts as 1.
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "distinct_share": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "punct_share": ("n_punct", "word_chars"), "digit_share": ("n_digits", "word_chars"), "line_words": ("n_words", "n_lines"),
}
UPPER, DIGITS, PUNCT = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    mark = b"\x01" * width
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            hit[before : before + width] = mark
            hit[at : at + width] = mark
    return hit.count(1)


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS``."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    packed = text.translate(None, SPACE)
    chars = len(packed.decode("utf-8", "replace"))
    gone = lambda drop: len(packed) - len(packed.translate(None, drop))
    return len(words), chars, gone(SYMBOLS), dup, repeated_words(words), len(lines), len(set(words)), gone(UPPER), gone(PUNCT), gone(DIGITS)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the statistics of ``text``, for every row."""
    fields = [f.split()[0] for f in STATS.split(", ")]
    keep, ddl = columns(docs, keep, STATS)

    def stats(cols: dict) -> dict:
        rows = [statistics(t) for t in raw_bytes(cols["text"])]
        made = zip(*rows, strict=True) if rows else [[] for _ in fields]
        return {c: cols[c] for c in keep} | {f: pa.array(x, pa.int64()) for f, x in zip(fields, made, strict=True)}

    return map_slices(docs.select(*dict.fromkeys([*keep, "text"])), stats, ddl)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        f = feature_column(self.feature)
        return f > F.lit(self.value) if self.above else f <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


def feature_column(name: str) -> Column:
    over, under = FEATURES[name]
    top = F.col(over).cast("double")
    return top / F.greatest(F.col(under).cast("double"), F.lit(1.0)) if under else top


def _features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) / (np.maximum(stats[b].astype(float), 1.0) if b else 1.0) for k, (a, b) in FEATURES.items()}


def _covers(rule: list[Test], x: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict, bad: np.ndarray, most_tests: int, cost: float) -> list[Test]:
    rule: list[Test] = []
    on = np.ones(len(bad), bool)
    while len(rule) < most_tests and (on & ~bad).any():
        p0, n0 = int((on & bad).sum()), int((on & ~bad).sum())
        base, best, best_gain = np.log2(p0 / (p0 + cost * n0)) if p0 else 0.0, None, 1e-9
        for name, values in x.items():
            v, b = values[on], bad[on]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.concatenate([[0], np.cumsum(b[order])])
            at = np.flatnonzero(v[1:] != v[:-1]) + 1  # a cut between each two neighbouring values
            if not len(at):
                continue
            for above, p, n in ((False, pos[at], at - pos[at]), (True, pos[-1] - pos[at], len(v) - at - pos[-1] + pos[at])):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + cost * n, 1)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Test(name, above, float(v[at[k] - 1] + v[at[k]]) / 2), float(gain[k])
        if best is None:
            break
        rule.append(best)
        on &= best.holds(x)
    return rule


def learn_rules(stats: dict[str, np.ndarray], label: np.ndarray, *, most_rules: int = 12, most_tests: int = 4, cost: float = 8.0, least_precision: float = 0.97, least_covered: int = 3) -> list[list[Test]]:
    """Rules that mark rows with label 0, in order. A rule counts if, on the rows held back for pruning, it covers ``least_covered``
    low-quality rows and ``least_precision`` of what it covers is of low quality. cost: how many low-quality rows a good row weighs while a rule grows."""
    x, bad = _features(stats), label == 0
    fold = np.arange(len(bad)) % 3 == 2
    open_ = np.ones(len(bad), bool)
    rules: list[list[Test]] = []
    while len(rules) < most_rules:
        grow, prune = open_ & ~fold, open_ & fold
        if not (grow & bad).any() or not (prune & bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_tests, cost)
        px, pb = {k: v[prune] for k, v in x.items()}, bad[prune]
        worth = []
        for k in range(1, len(rule) + 1):
            on = _covers(rule[:k], px, len(pb))
            p, n = int((on & pb).sum()), int((on & ~pb).sum())
            worth.append(((p - n) / max(p + n, 1), p, -k))
        if not worth:
            break
        score, p, k = max(worth)
        if p < least_covered or (score + 1) / 2 < least_precision:
            break
        rules.append(rule[:-k])
        open_ &= ~_covers(rule[:-k], x, len(bad))
    return rules


def verdict_column(rules: list[list[Test]]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that holds, from 1, or null."""
    out = None
    for number, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None)).cast("int")


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 10_000, **options) -> list[list[Test]]:
    """Learn from at most ``most_labelled`` labelled documents (a documented bound of the fit; nothing else is sampled)."""
    sample = label_sample(labels, "quality", most_labelled)
    fields = [f.split()[0] for f in STATS.split(", ")]
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = with_statistics(found, ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min(F.struct(*fields)).alias("least")).select("doc_id", "label", "least.*")
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).toPandas()
    return learn_rules({f: rows[f].to_numpy() for f in fields}, rows["label"].to_numpy(), **options)


def classify(docs: DataFrame, rules: list[list[Test]], keep: list[str]) -> DataFrame:
    """``keep`` columns, statistics, ``base_failed``, ``rule`` (the first that holds) and ``kept`` of every row."""
    out = with_statistics(docs, keep)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = out.withColumns({"base_failed": failed, "rule": verdict_column(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the rules learnt from ``labels`` keep, with all their columns."""
    return classify(packed(docs), train(docs, labels, **options), ["__row"]).where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, rules, ["doc_id"])
