"""Lines of streams that come in chunks, cut at any byte: within a line, or within a character.

A batch of chunks is a segmented scan: each chunk's line ends are counted, running sums number its pieces, and only a chunk's first and last piece travel to meet the rest of their lines. A stream keeps
the open end of each run as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenaudit.operators.ordered import running

c = F.col
#: A run of which nothing has come for so long is given up.
RUN_TTL_MS = 24 * 3600 * 1000
MARK = b"\xef\xbb\xbf"


def _decoded(pieces: Column) -> Column:
    """UTF-8 text of bytes held as Latin-1; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.encode(pieces, "ISO-8859-1").cast("string"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``run_id, line, value`` of chunks ``(run_id, seq, data)``: lines with anything in them, numbered from 0 with blank ones counted. A run's last line needs no line end; a byte
    order mark before its first one is left out. Null data is empty, chunks without a run are left out."""
    parted = chunks.select("run_id", "seq", F.split(F.decode(F.coalesce("data", F.lit(b"")), "ISO-8859-1"), "\n", -1).alias("pieces"))
    numbered = running(parted, "run_id", [c("seq")], sums={"ends_before": (F.size("pieces") - 1).cast("long")})
    pieces = numbered.select("run_id", "seq", "ends_before", F.size("pieces").alias("n"), F.posexplode("pieces").alias("at", "piece")).withColumn("line", c("ends_before") + c("at"))
    inner = pieces.where("at > 0 AND at < n - 1").select("run_id", "line", "piece")
    ends = pieces.where("at = 0 OR at = n - 1").groupBy("run_id", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("all"))  # of one line
    whole = ends.select("run_id", "line", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("piece"))
    lines = inner.unionByName(whole).select("run_id", "line", _decoded(c("piece")).alias("value"))
    lines = lines.withColumn("value", F.when(c("line") == 0, F.regexp_replace("value", "^\\uFEFF", "")).otherwise(c("value")))
    return lines.where(F.trim(F.regexp_replace("value", "\\s+", " ")) != "")


class Joined(StatefulProcessor):
    """State of a run: the number of its next chunk and line, the bytes of its open line, and how many chunks that came too early wait in a list, which is read and written as a whole."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "next long, line long, tail binary, early long", self.ttl_ms)
        self.early = handle.getListState("early", "seq long, data binary, last boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, line, tail, early = self.open.get() or (0, 0, b"", 0)
        waiting = {k: (bytes(data), last) for k, data, last in self.early.get()} if early else {}
        held = set(waiting)
        for df in rows:
            for seq, data, last in zip(df["seq"], df["data"], df["last"], strict=True):
                if int(seq) >= number:
                    waiting.setdefault(int(seq), (bytes(data) if data is not None else b"", bool(last)))
        out = []
        while number in waiting:
            data, last = waiting.pop(number)
            number += 1
            *whole, tail = (bytes(tail) + data).split(b"\n")
            if last:
                whole, tail = [*whole, tail], b""
            for x in whole:
                if line == 0 and x.startswith(MARK):
                    x = x[3:]
                if (text := x.decode("utf-8", "replace")).strip():
                    out.append((line, text))
                line += 1
        come = [(seq, *waiting[seq]) for seq in sorted(waiting.keys() - held)]
        if held - waiting.keys():
            self.early.clear()
            come = [(seq, *waiting[seq]) for seq in sorted(waiting)]
        if come:
            self.early.appendList(come)
        self.open.update((number, line, bytes(tail), len(waiting)))
        if out:
            yield pd.DataFrame({"run_id": [key[0]] * len(out), "line": [x[0] for x in out], "value": pd.Series([x[1] for x in out], dtype=object)})

    def close(self) -> None:
        pass


def chunk_lines_stream(chunks: DataFrame, ttl_ms: int = RUN_TTL_MS) -> DataFrame:
    """The same on a stream of ``run_id, seq, data, last``: chunks of a run are numbered from 0, in whatever order and batches they come; a repeated one changes nothing. The last one
    ends its line. Needs ``live.column_state``."""
    kind = chunks.schema["run_id"].dataType.simpleString()
    rows = chunks.select("run_id", c("seq").cast("long").alias("seq"), "data", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("run_id").transformWithStateInPandas(Joined(ttl_ms), f"run_id {kind}, line long, value string", "Append", "ProcessingTime")
