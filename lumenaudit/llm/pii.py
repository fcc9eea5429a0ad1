"""Personal data: base patterns, and identifiers that bootstrapped contexts reveal.

The base patterns' matches are the seeds, and with them tokens whose shape alone tells a key (hexadecimal, base64 and the like: ``shaped``), which are no spans
unless a learnt pattern stands before them. The one to three words before a seed, on its line, are candidate patterns; one counts if at least
``least_seeds`` different seeds of a kind stand behind it, however large the corpus. Their number grows with the corpus, so they stay a table, and texts meet
them in blocks of about ``MOST_PATTERNS``, a pass over all texts for each block: all that is broadcast is one block. These passes
count what follows each pattern: seeds, other identifier-like tokens, or ordinary words. On this graph of patterns and
instances Spark scores in turn patterns by their instances and instances by their patterns. The last passes (one for each block of learnt patterns) add, as
kind ``id``, the identifier-like tokens that follow a pattern of at least ``least_score``. Base spans always stay.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are searched each by itself; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import columns, free_name, map_slices, release, shared_value, written

KINDS = ("email", "ip", "card", "phone", "id")
ORDER = {k: n for n, k in enumerate(KINDS)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits matches in one piece, with or without the three parts: the search never starts anew inside it, so it is linear.
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
#: What may be an identifier: six or more characters, two digits among them, between marks that may enclose it. Only the token bounds its length.
IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_/.@-]{4,})[A-Za-z0-9]")
#: Tokens long enough for a key, and changes between letters and digits.
LONG = re.compile(r"\S{20,}")
CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
Span = tuple[str, int, int]
#: Words whose plain form a worker keeps; beyond, it starts afresh.
KEPT_WORDS = 500_000
#: Patterns that the driver and a worker hold at a time.
MOST_PATTERNS = 500_000


class Patterns:
    """A table of distinct patterns, of any number; iteration fetches them in blocks."""

    def __init__(self, table: DataFrame, most: int = MOST_PATTERNS):
        self.table, self.most = table, most

    def blocks(self) -> Iterator[list[str]]:
        """The patterns in blocks of about ``most``, cut by hash."""
        n = math.ceil(self.table.count() / self.most)
        for k in range(n):
            yield sorted(r.pattern for r in self.table.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k).select("pattern").collect())

    def __iter__(self) -> Iterator[str]:
        return (p for block in self.blocks() for p in block)


def sent(docs: DataFrame, block: list[str]):
    """A block of patterns and their last words, for the workers."""
    return shared_value(docs.sparkSession, (set(block), {p.split(" ")[-1] for p in block}))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern, found from each ``@``: a local part never holds one, so each has its own."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def base_spans(text: str | None) -> list[Span]:
    """Spans ``(kind, start, end)`` of the base patterns, by start, then by kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and _parts(m[0])]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class PlainWords(dict):
    """Words as patterns have them: in lower case, runs of digits as 0, 40 characters at most."""

    def __missing__(self, word: str) -> str:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = made = re.sub(r"[0-9]+", "0", word.lower())[:40]
        return made


PLAIN = PlainWords()


def contexts(text: str, at: int) -> list[str]:
    """The one to three words before a position, on its line; quotes and brackets that open the token at ``at`` are passed over."""
    line = text.rfind("\n", 0, at) + 1
    before = text[max(line, at - 130) : at].rstrip("\"'([{<")
    words = [PLAIN[w] for w in before.split()[-3:]] if not before or before[-1:].isspace() else []
    return [" ".join(words[-n:]) for n in range(1, len(words) + 1)]


def identifier(token: str) -> re.Match | None:
    """The first run of the token that may be an identifier."""
    return next((m for m in IDENTIFIER.finditer(token) if len(DIGIT.findall(m[0])) >= 2), None)


def shaped(run: str) -> bool:
    """Whether letters and digits are mixed as in a random key: 20 characters or more, four changes between letters and digits or more."""
    return len(run) >= 20 and len(CHANGE.findall(run)) >= 4


def keys(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that are keys by their shape, without what encloses them."""
    for m in LONG.finditer(text):
        if (hit := identifier(m[0])) and shaped(hit[0]):
            yield m.start() + hit.start(), m.start() + hit.end()


def _seeds(docs: DataFrame) -> DataFrame:
    def run(cols: dict) -> dict:
        got: Counter = Counter()
        for t in cols["text"].to_pylist():
            base = base_spans(t)
            for kind, a, b in [*base, *(("id", a, b) for a, b in keys(t or "") if not any(x < b and a < y for _, x, y in base))]:
                for c in contexts(t, a):
                    got[kind, c, t[a:b]] += 1
        return {"kind": [k for k, _, _ in got], "pattern": [c for _, c, _ in got], "instance": [i for _, _, i in got]}

    return map_slices(docs.select("text"), run, "kind string, pattern string, instance string").distinct()


def candidate_patterns(docs: DataFrame, least_seeds: int) -> DataFrame:
    """``pattern``: all contexts of at least ``least_seeds`` different seeds of a kind."""
    counts = _seeds(docs).groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    return written(counts.where(F.col("n") >= least_seeds).select("pattern").distinct())


def followers(text: str, patterns: set[str], last: set[str], spans: list[Span]):
    """For each token after a pattern: the pattern, its start, and the seed, the identifier-like match or None there."""
    words = text.split()
    hits = [k for k, w in enumerate(words[:-1]) if PLAIN[w] in last]
    if not hits:
        return
    starts = {a: (a, b) for _, a, b in reversed(spans)}
    places = list(TOKEN.finditer(text))
    for k in hits:
        m = places[k + 1]
        line = text.rfind("\n", 0, m.start()) + 1
        window = [PLAIN[words[j]] for j in range(max(0, k - 2), k + 1) if places[j].start() >= line]
        for n in range(1, len(window) + 1):
            if (p := " ".join(window[-n:])) in patterns:
                at = m.start() + len(m[0]) - len(m[0].lstrip("\"'([{<"))
                seed = starts.get(at) or starts.get(m.start())
                hit = None if seed else identifier(m[0])
                yield p, seed, hit and (m.start() + hit.start(), m.start() + hit.end())


def _edges(docs: DataFrame, block: list[str]) -> DataFrame:
    """What follows the patterns of a block in all texts: ``(pattern, instance, seed, n)``, with null instances for ordinary words."""

    def run(cols: dict, state: tuple) -> dict:
        got: Counter = Counter()
        for t in cols["text"].to_pylist():
            if t:
                for p, seed, hit in followers(t, *state, base_spans(t)):
                    at = seed or hit
                    found = t[at[0] : at[1]] if at else None
                    got[p, found, bool(seed) or found is not None and shaped(found)] += 1
        keys = list(got)
        return {"pattern": [k[0] for k in keys], "instance": [k[1] for k in keys], "seed": [k[2] for k in keys], "n": [got[k] for k in keys]}

    rows = map_slices(docs.select("text"), run, "pattern string, instance string, seed boolean, n long", setup=sent(docs, block))
    return rows.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))


def score_patterns(edges: DataFrame, rounds: int) -> DataFrame:
    """``(pattern, score)``: the share of what follows a pattern that are identifiers, each weighed by its own score; an instance that is no seed has the
    mean score of its patterns by how often it follows them. Patterns and instances are both joined by key."""
    settled = edges.where("instance IS NULL OR seed").select("pattern", "n", F.col("seed").cast("double").alias("value"))
    unsettled = edges.where("instance IS NOT NULL AND NOT seed")
    weighed = settled.unionByName(unsettled.select("pattern", "n", F.lit(0.0).alias("value")))
    patterns = weighed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("score"))
    for _ in range(rounds - 1):
        known = unsettled.join(patterns, "pattern")
        instances = known.groupBy("instance").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("value"))
        weighed = settled.unionByName(unsettled.join(instances, "instance").select("pattern", "n", "value"))
        patterns = weighed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("score"))
    return patterns


def learn_patterns(docs: DataFrame, *, least_seeds: int = 5, least_score: float = 0.6, rounds: int = 3, most: int = MOST_PATTERNS) -> Patterns:
    """The contexts that announce identifiers, learnt from all texts."""
    found = candidate_patterns(docs, least_seeds)
    parts = [written(_edges(docs, block)) for block in Patterns(found, most).blocks()]
    if not parts:
        return Patterns(found, most)
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    learnt = written(score_patterns(edges, rounds).where(F.col("score") >= least_score).select("pattern"))
    release(found, *parts)
    return Patterns(learnt, most)


def all_spans(text: str | None, patterns: set[str], last: set[str], known: list[Span] = ()) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the ``known`` spans and those that the patterns announce."""
    base = base_spans(text)
    if not text or not (patterns or known):
        return base, base
    extra = {("id", *hit) for _, seed, hit in followers(text, patterns, last, base) if hit and not any(a < hit[1] and hit[0] < b for _, a, b in base)}
    return base, ordered([*base, *extra.union(known)])


def searched(cols: dict, state: tuple, noted: str | None) -> list[tuple[list[Span], list[Span]]]:
    """``all_spans`` of each row of a slice; the column ``noted``, if any, holds what other blocks of patterns announce."""
    known = cols[noted].to_pylist() if noted else [None] * len(cols["text"])
    return [all_spans(t, *state, [("id", *map(int, k.split(":"))) for k in ks.split(",")] if ks else []) for t, ks in zip(cols["text"].to_pylist(), known, strict=True)]


def _to_last_block(docs: DataFrame, patterns: Patterns | Iterable[str]) -> tuple[DataFrame, list[str], str | None]:
    """The rows with what all blocks of patterns but the last announce, the last block, and the name of the column that holds what the others announce (None if there is one block)."""
    if not isinstance(patterns, Patterns):
        return docs, list(patterns), None
    last: list[str] = []
    stored: list[DataFrame] = []
    noted, name = None, free_name(docs, "__known")
    for k, block in enumerate(patterns.blocks()):
        if k:
            docs = written(_noted(docs, last, noted, name))
            release(*stored)
            stored, noted = [docs], name
        last = block
    return docs, last, noted


def _noted(docs: DataFrame, block: list[str], noted: str | None, name: str) -> DataFrame:
    names = [c for c in docs.columns if c != noted]

    def run(cols: dict, state: tuple) -> dict:
        return {c: cols[c] for c in names} | {name: [",".join(f"{a}:{b}" for k, a, b in spans if k == "id") for _, spans in searched(cols, state, noted)]}

    return map_slices(docs, run, columns(docs, names, f"{name} string")[1], setup=sent(docs, block))


def find(docs: DataFrame, keep: list[str], patterns: Patterns | Iterable[str]) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (as ``kind:start:end``, comma-joined) of every row."""
    keep, ddl = columns(docs, keep, "base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[:4]))
    docs, block, noted = _to_last_block(docs.select(*dict.fromkeys([*keep, "text"])), patterns)

    def run(cols: dict, state: tuple) -> dict:
        got = searched(cols, state, noted)
        return {c: cols[c] for c in keep} | {"base": [spelled(b) for b, _ in got], "spans": [spelled(s) for _, s in got]} | {
            f"n_{k}": pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS[:4]
        }

    return map_slices(docs, run, ddl, setup=sent(docs, block))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, end, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
        k += 1
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, patterns: Patterns | Iterable[str]) -> DataFrame:
    """All columns of ``docs``, with personal data in ``text`` replaced; a column ``n_chars`` is set to the new length."""
    names, schema = docs.columns, docs.schema
    docs, block, noted = _to_last_block(docs, patterns)

    def run(cols: dict, state: tuple) -> dict:
        texts = [t and masked(t, spans) for t, (_, spans) in zip(cols["text"].to_pylist(), searched(cols, state, noted), strict=True)]
        return {c: texts if c == "text" else cols[c] for c in names}

    out = map_slices(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), setup=sent(docs, block))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find(docs, ["doc_id"], learn_patterns(docs))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
