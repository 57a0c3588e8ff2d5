"""A corpus from raw documents to shards: every stage works on what the one before kept.

Stages drop whole documents only (toxic ones, all but one of a group of near duplicates,
holders of benchmark items), then repeat or thin out sources by weight, then name shards.
Texts are never changed. ORACLE_SQL is None: training and min-max hashing are no SQL; the
tests hold each stage against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexichron.llm._common import stored, table
from lexichron.llm.decontamination import drop_contaminated
from lexichron.llm.mixing import mixed_documents
from lexichron.llm.near_duplicates import drop_near_duplicates
from lexichron.llm.sharding import kd_shards
from lexichron.llm.toxicity import drop_toxic

#: Bytes of text in a shard of the result.
SHARD_BYTES = 64 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text scores as toxic. Null and empty texts, null or repeated ids stay; each row is judged by its own text."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the least doc_id; rows without words all stay; null and repeated ids are rows of their own."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose own text holds a benchmark item; with no items, or texts without words, nothing goes."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows as often as the mix takes them, or not at all. Rows without words have nothing to take and go; null sources are a source."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``shard_size``; columns of these names in ``docs`` are replaced. An empty table has no shards."""
    sharded = kd_shards(docs.drop("shard", "shard_size"), target_bytes=SHARD_BYTES)
    return sharded.drop("kd_crc32").withColumnsRenamed({"kd_size": "shard_size", "kd_shard": "shard"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
