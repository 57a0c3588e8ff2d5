"""A store of findings on Parquet: saves are appended, readers see the newest row of each word.

``folder`` holds two tables, ``findings`` and ``turkic_entries``, both dealt into ``BUCKETS``
partitions by the word, so that a word is got from one of them. Saving a word again hides its old
row and entries (nothing is rewritten); :func:`compact` writes what is still seen to another folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import relational as R

BUCKETS = 64
FINDINGS = "id long, query_word string, proto_turkic_root string, root_meaning string, sources_json string, full_finding_json string, created_at timestamp, bucket int"
ENTRIES = "finding_id long, created_at timestamp, position int, lang_code string, lang_name string, word string, meaning string, script string, bucket int"
_ENTRY = "array<struct<lang_code:string,lang_name:string,word:string,meaning:string,script:string>>"


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(FINDINGS if table == "findings" else ENTRIES).parquet(f"{folder}/{table}")


def _append(rows: DataFrame, folder: str, table: str) -> None:
    rows.write.mode("append").partitionBy("bucket").parquet(f"{folder}/{table}")


def create(spark: SparkSession, folder: str) -> None:
    """The two tables, empty; a store that is there stays as it is."""
    for table, schema in (("findings", FINDINGS), ("turkic_entries", ENTRIES)):
        _append(spark.createDataFrame([], schema), folder, table)


def save(findings: DataFrame, folder: str, now: datetime | None = None) -> None:
    """Appends findings (query_word, proto_root, root_meaning, sources, entries, and more) and their entries.

    Words are trimmed and lower-cased; blank ones are left out; of rows with one word one is taken. ``now`` is the time
    of the save, else this moment; of two saves of a word the later time is seen."""
    spark = findings.sparkSession
    create(spark, folder)
    at = F.lit(now or datetime.now(timezone.utc))
    word = W.normalise(F.col("query_word"))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in findings.columns]), {"ignoreNullFields": "false"})
    rows = findings.select(F.xxhash64(word).alias("id"), word.alias("query_word"), F.col("proto_root").alias("proto_turkic_root"), "root_meaning", F.to_json("sources").alias("sources_json"), whole.alias("full_finding_json"), at.alias("created_at"))
    _append(rows.where("query_word <> ''").dropDuplicates(["query_word"]).withColumn("bucket", _bucket(F.col("query_word"))), folder, "findings")
    saved = _read(spark, folder, "findings").where(F.col("created_at") == at)  # the search isn't run again for its entries
    listed = F.from_json(F.get_json_object("full_finding_json", "$.entries"), _ENTRY)
    each = saved.select(F.col("id").alias("finding_id"), "created_at", "bucket", F.posexplode(listed).alias("position", "e"))
    _append(each.select("finding_id", "created_at", "position", "e.lang_code", "e.lang_name", "e.word", "e.meaning", F.coalesce("e.script", F.lit("Latin")).alias("script"), "bucket"), folder, "turkic_entries")


def current(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """The newest row of each word."""
    found = _read(spark, folder, "findings") if rows is None else rows
    return found.groupBy("query_word").agg(F.max_by(F.struct(*found.columns), "created_at").alias("r")).select("r.*")


def get(spark: SparkSession, folder: str, word: str) -> DataFrame:
    """The finding of one word, as saved; the filters reach one partition's scan."""
    asked = W.normalise(F.lit(word))
    return current(spark, folder, _read(spark, folder, "findings").where((F.col("bucket") == _bucket(asked)) & (F.col("query_word") == asked))).select("query_word", "full_finding_json", "created_at")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the findings that are seen; those of earlier saves went with them."""
    seen = current(spark, folder).select(F.col("id").alias("finding_id"), "created_at", "query_word")
    return _read(spark, folder, "turkic_entries").join(seen, ["finding_id", "created_at"]).drop("bucket")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """All findings, the newest first."""
    return R.stored_list(current(spark, folder).select("id", "query_word", "proto_turkic_root", "root_meaning", "created_at"), "created_at", "id")


def count(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "findings").agg(F.countDistinct("query_word").alias("findings"))


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """What is seen of the store, written to another folder."""
    _append(current(spark, folder), to, "findings")
    kept = entries(spark, folder)
    _append(kept.withColumn("bucket", _bucket(F.col("query_word"))).drop("query_word"), to, "turkic_entries")


def write_cldf(findings: DataFrame, folder: str) -> None:
    """Forms and cognates as CSV, metadata as JSON, of findings (query_word, proto_root, entries)."""
    each = findings.select(F.col("query_word").alias("word"), F.col("proto_root").alias("root"), F.posexplode("entries").alias("position", "e"))
    forms = R.cldf_forms(each.select("word", "position", "e.lang_code", F.col("e.word").alias("form")))
    cognates = R.cldf_cognates(each.select("word", "root", "position", F.col("e.word").alias("form")))
    forms.toDF("ID", "Language_ID", "Parameter_ID", "Form", "Value", "Segments").write.mode("overwrite").option("header", True).csv(f"{folder}/forms.csv")
    cognates.toDF("ID", "Form_ID", "Cognateset_ID", "Alignment", "Source").write.mode("overwrite").option("header", True).csv(f"{folder}/cognates.csv")
    R.cldf_metadata(findings.select(F.col("query_word").alias("word"))).write.mode("overwrite").json(f"{folder}/metadata.json")
