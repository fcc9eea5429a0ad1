"""Tables that grow by appends and merges, published whole.

Rows are Parquet files, written by Spark in ranges of the table's key. A write shows once its manifest, a small JSON file with the least and greatest key of each new file, gets the next number; a writer that
dies before has changed nothing. Two writers can't take one number: an append takes the next, a merge whose files a rival has replaced starts again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenaudit.operators.history import upsert_clients


class Conflict(RuntimeError):
    """Others have written meanwhile, again and again."""


class Store:
    """A table in a folder that the driver and all executors share, with ``key`` as the column that point reads ask for."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, T.StructType.fromDDL(schema)
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def manifests(self) -> list[dict]:
        """All published writes in order; small, a line a file."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifests")) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._fs_text(f"{self.path}/manifests/{n}")) for n in names]

    def _fs_text(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> bool:
        """Whether the manifest got the number. It is written under another name first: nobody reads half of one."""
        draft, final = (self._at(f"{self.path}/manifests/{n}") for n in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        never_over = gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, never_over)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _written(self, rows: DataFrame) -> list[dict]:
        """New files with their least and greatest key; not published yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{folder}")
        got = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
        found = got.agg(F.count("*").alias("rows"), F.min(self.key).cast("string").alias("least"), F.max(self.key).cast("string").alias("most"), F.count_if(F.col(self.key).isNull()).alias("nulls")).collect()  # a row a file
        return [{**r.asDict(), "file": f"{folder}/{r.file}"} for r in found]

    @staticmethod
    def _live(manifests: list[dict]) -> dict[str, dict]:
        live: dict[str, dict] = {}
        for m in manifests:
            for f in m["gone"]:
                del live[f]
            live |= {f["file"]: f for f in m["files"]}
        return live

    def append(self, rows: DataFrame, *, writer: str | None = None, batch: int | None = None, tries: int = 20) -> bool:
        """Adds rows. With a writer's name and a batch's number: only if that batch hasn't been added already; returns whether it was added now."""
        said = [writer, batch] if writer is not None else None
        done = lambda all_: said is not None and any(m["said"] == said for m in all_)
        if done(self.manifests()):
            return False
        files = self._written(rows)
        for _ in range(tries):
            before = self.manifests()
            if done(before):
                return False
            if self._publish(len(before), {"files": files, "gone": [], "said": said}):
                return True
        raise Conflict(f"{self.path}: {tries} rivals in turn")

    def merge(self, rows: DataFrame, kept: tuple[str, ...], tries: int = 5) -> None:
        """Rows by key: new ones are added, known ones keep their columns ``kept`` and take the others. Files that can't hold a new row's key aren't read or rewritten."""
        for _ in range(tries):
            before = self.manifests()
            live = self._live(before)
            least, most = rows.agg(F.min(self.key), F.max(self.key)).first()
            near = [f for f in live.values() if least is not None and self._meets(f, least, most)]
            held = self._read(near).withColumn("__file", F.input_file_name()) if near else None
            touched = [] if held is None else [r[0] for r in held.join(rows.select(self.key).distinct(), self.key, "left_semi").select("__file").distinct().collect()]  # names of files
            gone = [f["file"] for f in near if any(t.endswith(f["file"]) for t in touched)]
            files = self._written(upsert_clients(self._read([live[f] for f in gone]), rows, self.key, kept))
            after = self.manifests()
            rivals = after[len(before) :]
            if any(f in m["gone"] for m in rivals for f in gone) or any(self._meets(f, least, most) for m in rivals for f in m["files"] if least is not None):
                continue  # what it has merged with isn't there any more, or rows of its range have come
            if self._publish(len(after), {"files": files, "gone": gone, "said": None}):
                return
        raise Conflict(f"{self.path}: {tries} rivals in turn")

    def _meets(self, file: dict, least, most) -> bool:
        if file["least"] is None:
            return False
        kind = self.schema[self.key].dataType
        cast = int if isinstance(kind, T.IntegralType) else str
        return cast(file["least"]) <= most and least <= cast(file["most"])

    def _read(self, files: list[dict]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f['file']}" for f in files)) if files else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All published rows."""
        return self._read(list(self._live(self.manifests()).values()))

    def find(self, keys: list) -> DataFrame:
        """The rows of some keys; files whose range holds none of them aren't part of the plan."""
        files = [f for f in self._live(self.manifests()).values() if any(self._meets(f, k, k) for k in keys)]
        return self._read(files).where(F.col(self.key).isin(*keys))
