"""WARC archives: a writer with one gzip member per record, and a sequential reader.

``archive_pages`` writes a record per page: the first of equal payloads (by the contract, that with the largest page_id) as response,
the others as revisit records that refer to it and carry its HTTP head alone; payloads under ``least_bytes`` are always responses.
An archive is the content of one ``.warc.gz`` file, a row ``(archive, content)`` of about ``archive_bytes``; Spark's writer stores the
rows, so that lost executors and any file system are its matter. ``read_archives`` reads such rows, or those of Spark's
``binaryFile`` source, member by member: incremental decompression, framing by Content-Length, and verified SHA-1 digests.

Null html is an empty payload. A null url leaves out its header. A page without page_id is a response unless another row with an
id has its payload. Rows that repeat the winning page_id are all responses. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import count

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_slices, written

LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:lumenaudit:page:"
SALT = 16


class WarcError(ValueError):
    """The archive isn't well formed, or a digest doesn't hold."""


def digest_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record as a gzip member of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = lambda x: f"<{RECORD}{'' if x is None else x}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", digest_text(payload)), ("WARC-Block-Digest", digest_text(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(content: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members of an archive in turn; one is held at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise WarcError("the archive ends inside a gzip member")
            part = view[at : at + chunk]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{RECORD}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_records(content: bytes) -> Iterator[dict]:
    """The records of an archive, in order. Digests and framing are verified; WarcError tells what doesn't hold."""
    for raw in members(content):
        head, mark, rest = raw.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise WarcError("a member doesn't begin with a WARC header")
        f = _fields(head)
        n = int(f.get("content-length", -1))
        block = rest[:n]
        if n < 0 or rest[n:] != b"\r\n\r\n" or len(block) != n:
            raise WarcError("Content-Length doesn't frame the record")
        if "warc-block-digest" in f and f["warc-block-digest"] != digest_text(block):
            raise WarcError(f"block digest of {f.get('warc-record-id')} doesn't hold")
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = f.get("warc-type") == "revisit"
        stated = f.get("warc-payload-digest", "")
        if not revisit and stated and stated != digest_text(payload):
            raise WarcError(f"payload digest of {f.get('warc-record-id')} doesn't hold")
        yield {
            "page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": f.get("warc-type"),
            "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
            "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else hashlib.sha1(payload).hexdigest(),
            "refers_to": _page(f.get("warc-refers-to")), "payload": None if revisit else payload,
        }


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload another page, with a larger page_id, has too. Payloads aren't shuffled for it.

    Pages are dealt by digest and by a salt of their own id, since one payload may be a third of all pages."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least_bytes)
    light = light.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    first = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("refers_to").isNotNull())
    first = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = light.join(first, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to").distinct()


def archive_pages(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, archive_bytes: int = 1 << 20) -> DataFrame:
    """Archives ``(archive, content)`` of the pages' records."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    other = revisits(pages, least_bytes).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    # most pages have no twin: only those that have take part in the join by key
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("__d"))
    rows = rows.join(other, rows["page_id"].eqNullSafe(other["__id"]) & (rows["__d"] == other["__digest"]), "left").select("page_id", "url", "payload", "refers_to")

    def write(cols: dict, number: Iterator[int]) -> dict:
        out, parts, size = [], [], 0
        for p, u, b, r in zip(cols["page_id"].to_pylist(), cols["url"].to_pylist(), cols["payload"].to_pylist(), cols["refers_to"].to_pylist(), strict=True):
            parts.append(record(p, u, b or b"", r))
            size += len(parts[-1])
            if size >= archive_bytes:
                out.append(b"".join(parts))
                parts, size = [], 0
        if parts:
            out.append(b"".join(parts))
        task = TaskContext.get().partitionId()
        return {"archive": [f"part-{task:06d}-{next(number):06d}.warc.gz" for _ in out], "content": out}

    return map_slices(rows, write, "archive string, content binary", setup=count)


def read_archives(archives: DataFrame, *, payloads: bool = False) -> DataFrame:
    """A row per record of archives with a column ``content``; with ``payloads`` also the payload."""
    fields = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long"} | ({"payload": "binary"} if payloads else {})

    def read(cols: dict) -> dict:
        got: dict[str, list] = {k: [] for k in fields}
        for content in cols["content"]:
            for r in read_records(content.as_py() or b""):
                for k in fields:
                    got[k].append(r[k])
        return got

    return map_slices(archives.select("content"), read, ", ".join(f"{k} {v}" for k, v in fields.items()), rows=1)


def save_files(archives: DataFrame, folder: str) -> None:
    """Each archive as a file of ``folder``, a path that all executors have mounted; a file appears under its name only when whole."""

    def save(rows):
        import os

        for r in rows:
            part = os.path.join(folder, f".{r.archive}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, os.path.join(folder, r.archive))

    archives.foreachPartition(save)


def query(spark, sf_dir: str) -> DataFrame:
    from lumenaudit.sources.tables import table

    archives = written(archive_pages(table(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m USING (d)
"""
