"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets its weighted share of the wanted amount; a source that would repeat more
than ``EPOCHS`` times is clamped there and its excess goes to the others by weight, until none is
above. Sorted by cap per weight, the clamped sources are a prefix, so one window finds them.
Then every document is taken as many whole times as its source is, and the fractional rest
of the source is filled from its documents in a seeded order (md5): histogram sums of the
order find the bucket in which the rest ends, and only that bucket (1/4096 of a source) is
ranked. The last document of the rest is taken in part, so a source meets its target to a
word. No source, however large, is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, fresh, materialise, table

SHARE, EPOCHS, SEED = 1.5, 2, 17
WEIGHTS = (5, 2, 1)
#: Sources are broadcast up to this number of rows (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(bars: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from sizes by source. Sources in code point order, null last, take the weights in turn."""
    sources = bars.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    weighed = weighed.withColumn("cap", epochs * F.col("source_size").cast("double")).withColumn("wanted", share * F.sum("source_size").over(Window.partitionBy()).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.col("wanted") - clamped) / rest).withColumn("fits", F.col("level") * F.col("weight") < F.col("cap"))
    water = F.first(F.when(F.col("fits"), F.col("level")), True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = levels.withColumn("water", water)
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


RESULT = ("mix_size", "mix_source_size", "mix_target", "mix_taken")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` in all its columns, with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken``; columns of these names in ``docs`` are replaced.

    A null text has size 0 and is never taken; null sources are a source of their own; repeated
    rows are documents of their own; a null doc_id is ordered as ''. The same input gives the same mix."""
    kept = [c for c in docs.columns if c not in RESULT]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))  # so that no column of the caller can clash
    doc_id, source = F.col("row.doc_id"), F.col("row.source")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    sized = packed.withColumn("size", words(F.col("row.text"))).withColumn("order", order).withColumn("bucket", F.substring("order", 1, 4))
    bars = materialise(sized.groupBy(source.alias("source"), "bucket").agg(F.sum("size").alias("size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets(bars, share, epochs, weights).withColumn("whole", whole)
    plan = plan.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = bars.withColumn("before", before).withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    # the bucket in which the rest ends: the last one that starts below it
    plan = materialise(reached.groupBy("source", "source_size", "target", "whole", "rest").agg(F.max(F.when(F.col("before") < F.col("rest"), F.struct("bucket", "before"))).alias("end")))
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", F.col("end.bucket").alias("end"), F.col("end.before").alias("before"))
    met = sized.join(F.broadcast(plan) if few else plan, source.eqNullSafe(F.col("of")))
    whole = F.col("whole") * F.col("size")
    clear = met.where(F.col("end").isNull() | (F.col("bucket") != F.col("end"))).withColumn("taken", whole + F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(0))
    ranked = Window.partitionBy("of", "end").orderBy("order", doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ranked), F.lit(0))
    last = met.where(F.col("bucket") == F.col("end")).withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = [F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken")]
    return clear.union(last).select(*[F.col(f"row.`{c}`") for c in kept], *out)


def mixed_documents(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as it is taken, the one taken in part if half of it or more is. Texts stay whole."""
    names = {c: fresh(docs, c) if c in RESULT else c for c in docs.columns}
    mixed = mix(docs.withColumnsRenamed(names), share, epochs)
    times = F.when(F.col("mix_size") > 0, F.floor((2 * F.col("mix_taken") + F.col("mix_size")) / (2 * F.col("mix_size")))).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(1), times)).alias(fresh(docs, "copy"))
    return mixed.where(times > 0).select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()], copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
        2 * CAST(source_size AS DOUBLE) AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r,
        (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, r) FROM l WHERE level * weight < cap) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
