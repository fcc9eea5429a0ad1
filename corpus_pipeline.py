"""A training-data pipeline of five stages, each one of the corpus operators.

Each stage takes what its predecessor kept, whole, and gives documents with the same columns; the last gives token ids. Between stages
the rows are written as Parquet in shared storage and read again.

Quality rules reject null, empty and very short texts (their base rule); rows with a null doc_id go through all stages, and of a component of near copies such a row stays only
where no other has an id. Repeated rows are near copies of each other: one stays. Texts of any length are worked on whole, further columns of documents pass through up to the
last stage, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from lumenaudit.llm.common import written
from lumenaudit.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learnt decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least doc_id."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.mask(docs, pii.learn_patterns(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, which decode to their texts."""
    return bpe.encode(docs, ["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("personal data", personal_data), ("BPE encoding", token_ids),
]

#: The learnt rules and contexts, the components and the merges have no SQL form; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
