"""Inverted lists without hot groups: signatures that several members share, found with one shuffle.

Each task sorts its own entries by signature. Its entries of one signature are a star around the least member: only that one is forwarded to meet
other tasks' entries of the signature, and the rest, known to share it already, are dealt out by a key of their own. So a
signature that a third of all members have brings its meeting task one entry per other task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenaudit.llm.hashing import mixed, signed

#: key: where the entry is dealt to; pivot: the least member of the task's star. kind: 0 a forwarded entry, 1 one whose task has further members, both with the
#: signature as key and 0 as sig and pivot, which compress away; 2 a further member.
ENTRY = "key long, sig long, member long, pivot long, kind byte"


def stars(sigs: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The entries of one task: a star for each signature."""
    g, c = signed(sigs), members
    order = np.lexsort((c, g))
    g, c = g[order], c[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    g, c = g[fresh], c[fresh]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(g)))
    kind = np.where(first, np.repeat(size > 1, size), 2).astype(np.int8)
    key = np.where(first, g, signed(mixed((c ^ g).view(np.uint64))))
    pivot = np.where(first, 0, np.repeat(c[starts], size))
    g = np.where(first, 0, g)
    for k in range(0, len(g), 200_000):
        z = slice(k, k + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[z]) for x in (key, g, c, pivot, kind)], names=["key", "sig", "member", "pivot", "kind"])


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries ``(sig, member, pivot)`` of signatures with several members. Forwarded entries meet by list, at most one from each task's share."""

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [x[cut:] for x in cols]
            yield from settle([x[:cut] for x in cols])
        if rest is not None:
            yield from settle(rest)

    def settle(cols):
        key, sig, member, pivot, kind = cols
        if not len(key):
            return
        alone = kind == 2  # a star's further member: it stays beside its local pivot
        f = np.flatnonzero(~alone)
        g, c, l = key[f], member[f], kind[f] == 1
        order = np.lexsort((c, g))
        g, c, l = g[order], c[order], l[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, len(g)))
        several = np.repeat((np.maximum.reduceat(c, starts) != c[starts]) | np.logical_or.reduceat(l, starts), size) if len(g) else np.zeros(0, bool)
        out = [np.concatenate(x) for x in ((sig[alone], g[several]), (member[alone], c[several]), (pivot[alone], np.repeat(c[starts], size)[several] if len(g) else c))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["sig", "member", "pivot"])

    dealt = entries.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "sig long, member long, pivot long")
