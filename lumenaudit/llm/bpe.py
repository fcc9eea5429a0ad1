"""Byte-level BPE, encoding and decoding, by a pair occurrence index.

The distinct pre-tokens that a partition has not met yet, of some MB of its texts at a time, are laid out as one sequence of symbols. An index maps each adjacent pair
with a rank to all its positions; a heap holds the active ranks. The least rank is applied at all its positions at once, from left to right where they overlap;
each merge takes a symbol away and enters the two new pairs beside it. What a pre-token encodes to is kept for the partition's other texts.

Results are those of the ``tokenizers`` library for such a file with ``add_special_tokens=False``: added tokens found in a text are
cut out first and become their own id. Null texts encode as empty ones, to no ids. Any length works: the index is linear in it.
Decoding maps ids to bytes and reads them as UTF-8, with U+FFFD for malformed parts. Repeated rows and further columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenaudit.llm.common import columns, shared_value

#: How byte-level vocabularies split text before merging (fixed by that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a worker keeps: beyond, those that the last half of them didn't meet go.
KEPT_WORDS = 400_000
#: Characters of text whose new pre-tokens are encoded together.
PART_CHARS = 4_000_000
NONE, GONE = -1, -2  # symbols: the end of a pre-token, and what a merge has taken away


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next free letter from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary: ``encode`` and ``decode``."""

    def __init__(self, source: str):
        """source: the JSON text of a tokenizer file of kind BPE with byte-level pre-tokens and without normaliser."""
        spec = json.loads(source)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.by_rank = {rank: (pair >> 32, pair & 0xFFFFFFFF, made) for pair, (rank, made) in merges.items()}
        self.pairs = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[p][0] for p in self.pairs.tolist()], np.int64)
        least: dict[int, int] = {}  # of each symbol the least rank that it takes part in
        for rank, (left, right, _) in self.by_rank.items():
            least[left], least[right] = min(rank, least.get(left, rank)), min(rank, least.get(right, rank))
        #: Merges whose result may at once merge by a lesser rank: after each of these the least rank is looked up anew.
        self.early = {rank for rank, (_, _, made) in self.by_rank.items() if least.get(made, rank) < rank}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.tokens = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(PATTERN).findall
        #: Of each known pre-token: number of ids, the ids as text with a comma after each, and their bytes.
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def pretokens(self, text: str) -> list[list[str] | int]:
        """Runs of pre-tokens, and ids of added tokens between them."""
        if self.split_added is None or not any(t in text for t in self.added):
            return [self.split(text)]
        parts = self.split_added.split(text)
        return [self.added[p] if k % 2 else self.split(p) for k, p in enumerate(parts) if p]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where they don't merge."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        n = int(lengths.sum()) + len(words)
        symbols = self.byte_ids[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
        symbols[ends] = NONE  # no pair crosses it
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            on = np.flatnonzero(ranks >= 0)
            if not len(on):
                return
            on = on[np.argsort(ranks[on], kind="stable")]
            ranks, places = ranks[on], places[on]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                got = index.get(rank)
                if got is None:
                    index[rank] = [places[a:b]]
                    heapq.heappush(active, rank)
                else:
                    got.append(places[a:b])

        enter(self.rank_of(symbols[:-1], symbols[1:]), np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            got = index.pop(rank)
            left, right, made = self.by_rank[rank]
            at = got[0] if len(got) == 1 else np.concatenate(got)
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if not len(at):
                continue
            if len(got) > 1:
                at = np.unique(at)
            if rank in self.early:  # of each word only the first place now; the rest comes again
                word = np.searchsorted(ends, at)
                first = np.concatenate([[True], word[1:] != word[:-1]])
                if not first.all():
                    enter(np.full(int((~first).sum()), rank), at[~first])
                    at = at[first]
            elif left == right:
                at = at[_apart(at, after[at])]
            gone = after[at]
            end = after[gone]
            symbols[at], symbols[gone] = made, GONE
            after[at], before[end] = end, at
            first = before[at]
            ok = np.flatnonzero(first >= 0)
            x, y = first[ok], symbols[end]
            enter(np.concatenate([self.rank_of(symbols[x], np.full(len(ok), made)), self.rank_of(np.full(len(at), made), y)]), np.concatenate([x, at]))
        stays = symbols >= 0
        counts = np.add.reduceat(stays, np.concatenate([[0], ends[:-1] + 1])) if len(words) else lengths
        return symbols[stays], counts

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet, all at once."""
        distinct = dict.fromkeys(words)
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in distinct:
            if w not in known:
                if (got := older.get(w)) is not None:
                    known[w] = got
                else:
                    new.append(w)
        if not new:
            return
        ids, counts = self.merged([w.encode() for w in new])
        ids, end, tokens = ids.tolist(), 0, self.tokens
        spelled = {i: f"{i}," for i in set(ids)}
        for w, k in zip(new, counts.tolist(), strict=True):
            mine = ids[end : end + k]
            end += k
            known[w] = (k, "".join([spelled[i] for i in mine]), b"".join([tokens[i] for i in mine]))

    def coded(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text its pre-tokens and added tokens in order: number of ids, ids as text with a comma after each, bytes that the ids stand for."""
        cut = [self.pretokens(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(run for runs in cut for run in runs if isinstance(run, list)))
        get = self.known.__getitem__
        for runs in cut:
            yield [x for run in runs for x in ([(1, f"{run},", self.tokens[run])] if isinstance(run, int) else map(get, run))]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, "".join([ids for _, ids, _ in run]).split(",")[:-1])) for run in self.coded(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the ascending places of a pair of equal symbols merge: in a run of overlapping ones each other one, from the left."""
    tied = np.zeros(len(at), bool)
    tied[1:] = following[:-1] == at[1:]
    k = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(tied, 0, k))
    return (k - begin) % 2 == 0


def codec_setup(spark: SparkSession, path: str):
    """Reads the vocabulary on the driver and broadcasts it: its size is the file's, a few MB, whatever the documents."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    sent = shared_value(spark, source)
    return lambda: Codec(sent())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _map_parts(rows: DataFrame, weights: str, fn: Callable[[dict, Codec], dict], ddl: str, path: str | None, chars: int) -> DataFrame:
    """``fn`` on parts of the rows of about ``chars`` characters of texts, or ids, in column ``weights``; a row of more is a part of its own."""
    out, codec_of = to_arrow_schema(T.StructType.fromDDL(ddl)), codec_setup(rows.sparkSession, path or default_path())

    def run(batches):
        codec = codec_of()
        for batch in batches:
            column = batch.column(batch.schema.names.index(weights))
            sizes = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            at, held = 0, 0
            for k, n in enumerate(sizes.tolist(), 1):
                held += n
                if held >= chars or k == len(sizes):
                    part = batch.slice(at, k - at)
                    got = fn({name: part.column(j) for j, name in enumerate(part.schema.names)}, codec)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in out for x in [got[f.name]]], schema=out)
                    at, held = k, 0

    return rows.mapInArrow(run, ddl)


def encode(docs: DataFrame, keep: list[str], *, path: str | None = None, chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every row's text."""

    keep, ddl = columns(docs, keep, "ids array<int>")

    def run(cols: dict, codec: Codec) -> dict:
        return {c: cols[c] for c in keep} | {"ids": codec.encode(cols["text"].to_pylist())}

    return _map_parts(docs.select(*dict.fromkeys([*keep, "text"])), "text", run, ddl, path, chars)


def decode(coded: DataFrame, keep: list[str], *, path: str | None = None, chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns and ``text``, decoded from ``ids`` (null: empty)."""

    keep, ddl = columns(coded, keep, "text string")

    def run(cols: dict, codec: Codec) -> dict:
        return {c: cols[c] for c in keep} | {"text": [codec.decode(x or ()) for x in cols["ids"].to_pylist()]}

    return _map_parts(coded.select(*dict.fromkeys([*keep, "ids"])), "ids", run, ddl, path, chars)


def digests(docs: DataFrame, keep: list[str], *, path: str | None = None, chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: a round trip of every text in one pass."""

    keep, ddl = columns(docs, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(cols: dict, codec: Codec) -> dict:
        made: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for words in codec.coded(cols["text"].to_pylist()):
            made["n_tokens"].append(sum([n for n, _, _ in words]))
            made["ids_sha256"].append(hashlib.sha256("".join([ids for _, ids, _ in words])[:-1].encode()).hexdigest())
            made["decoded_sha256"].append(hashlib.sha256(b"".join([b for _, _, b in words]).decode("utf-8", "replace").encode()).hexdigest())
        return {c: cols[c] for c in keep} | made

    return _map_parts(docs.select(*dict.fromkeys([*keep, "text"])), "text", run, ddl, path, chars)


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
