"""Near duplicates of texts by min-max hashing, confirmed on whole shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so ``BANDS`` bands of six values cost three hash evaluations per shingle each.
Two sets of similarity 0.8 miss each other in all 40 bands with odds of 5e-6.

1. Documents with equal shingle sets are one class (its id the smallest doc_id).
2. Classes that meet in a band are tied to the least class of that bucket. A class's least
   partners are tied to the least of them, so that each class has one tie, and the partners,
   far fewer, the others. The components of these ties are families; a true link lies within one.
3. Families are dealt into chunks of bounded size, and each chunk's sets, with the family's
   least class in every chunk, are compared by an inverted list. Confirmed links join what is
   alike into components; a group of near copies, however large, is mostly one after this.
4. Only families of several chunks that fell into several components are compared further: their
   classes are dealt into blocks by component and size, and blocks meet where sizes allow a link
   and the component isn't one, so what is joined already is never compared again.
5. Components of the confirmed links are the result. Links leave a task as a forest, one
   for each class at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, materialise, only, stored, table
from ._graph import components
from ._tokens import mix, pieces, shingle_sets

BANDS = 40
PER_BAND = 3  # permutations; each has a minimum and a maximum
#: Classes and shingles of a chunk or block, about; a family has as many chunks as these need.
CHUNK_SETS, CHUNK_SHINGLES = 128, 400_000
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 2_000_000


def signatures(sets: np.ndarray, sizes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Band keys (a row for each set) of consecutive non-empty sets of 64-bit hashes."""
    rng = np.random.default_rng(97)
    odd = rng.integers(1, 1 << 31, bands * PER_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * PER_BAND, dtype=np.uint32)
    keys = np.empty((len(sizes), bands), np.uint64)
    stops = np.cumsum(sizes)
    row = 0
    while row < len(sizes):  # runs of sets that stay in the processor's cache
        first = int(stops[row] - sizes[row])
        end = max(row + 1, int(np.searchsorted(stops, first + 32768, "right")))
        part = (sets[first : int(stops[end - 1])] >> np.uint64(32)).astype(np.uint32)
        at = (stops[row:end] - sizes[row:end] - first).astype(np.int64)
        for band in range(bands):
            acc = np.full(end - row, band + 1, np.uint64)
            for p in range(band * PER_BAND, (band + 1) * PER_BAND):
                v = (part ^ shift[p]) * odd[p]
                low, high = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
                acc = mix(acc ^ (low.astype(np.uint64) << np.uint64(32) | high))
            keys[row:end, band] = acc
        row = end
    return keys


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, sizes = shingle_sets(part.column("text"), k)
                some = sizes > 0
                full = sizes[some]
                prints = np.zeros((2, len(sizes)), np.uint64)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    at = np.cumsum(full) - full
                    for j in (0, 1):
                        prints[j, some] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5 + 77 * j)), at)
                    keys = signatures(sets, full)
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "keys"],
                )

    return run


def _whole(k: int, kept: list[str]):
    """The whole shingle set of each text in place of the text; the columns ``kept`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, sizes = shingle_sets(part.column("text"), k)
                stops = np.cumsum(sizes)
                blobs = [sets[b - n : b].tobytes() for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([*[part.column(c) for c in kept], pa.array(blobs, pa.binary())], names=[*kept, "shingles"])

    return run


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs of sets with 100 * intersection >= percent * union, each once; within ``left`` where there is no ``right``."""
    other = left if right is None else right
    if not left or not other:
        return
    sizes = np.array([len(x) for x in other])
    flat, owner = np.concatenate(other), np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, x in enumerate(left):
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = high - low
        where = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[where], minlength=len(other))
        hit = 100 * shared >= percent * (len(x) + sizes - shared)
        for j in np.flatnonzero(hit[i + 1 :] if right is None else hit).tolist():
            yield i, j + (i + 1 if right is None else 0)


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Confirmed links among the sets of side 0, or between sides where there is a side 1, as a forest of their labels."""
        side, label = group.column("side").to_numpy(), group.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other = two if len(two) else one
        parent = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in _links([sets[x] for x in one], [sets[x] for x in two] if len(two) else None, percent):
            a, b = root(int(label[one[i]])), root(int(label[other[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
        tied = [(x, root(x)) for x in parent if parent[x] != x]
        return pa.table({"a": pa.array([x for x, _ in tied], pa.int64()), "b": pa.array([x for _, x in tied], pa.int64())})

    return run


LINK = "a long, b long"


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of the ids in ``chosen`` (narrow and checkpointed), with its columns."""
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    return only(docs, "doc_id", "text").withColumnRenamed("doc_id", "id").join(few, "id")


def _families(single: DataFrame) -> DataFrame:
    """(id, component) from (id, key): classes that meet in a bucket, directly or through others."""
    buckets = single.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    met = single.join(buckets, "key").groupBy("id").agg(F.collect_set("least").alias("leasts"))  # at most a value for each band
    ends = F.explode(F.array_union(F.array("id"), F.col("leasts"))).alias("a")
    return components(met.select(ends, F.array_min("leasts").alias("b")).where("a <> b").distinct())


def _parts(sets: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(sets) / CHUNK_SETS), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts).cast("int")


def _across(docs: DataFrame, open_: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components of one family. ``open_``: (id, family, n_shingles, label), the label being the component so far.

    A block is of one component, where that has ``CHUNK_SETS`` / 2 classes or more, or else of several, and of one size
    class; sets of size classes that aren't neighbours can't be linked."""
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    large = open_.groupBy("family", "label").count().where(F.col("count") >= CHUNK_SETS // 2).select("family", "label", F.col("label").alias("unit"))
    placed = open_.join(large, ["family", "label"], "left").withColumn("size", F.floor(F.log("n_shingles") / step).cast("int"))
    placed = materialise(placed.select("id", "family", "label", "size", F.coalesce("unit", F.lit(-1)).alias("unit"), "n_shingles", F.col("unit").isNotNull().alias("pure")))
    of = ["family", "pure", "unit", "size"]
    blocks = placed.groupBy(*of).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).select(*of, _parts("n", "total").alias("parts"))
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.struct("size", "pure", "unit", "part")
    left, right = each.select("family", key.alias("low")), each.select("family", key.alias("high"))
    apart = F.expr("low <= high and high.size - low.size <= 1 and not (low.pure and high.pure and low.unit = high.unit)")
    pairs = materialise(left.join(right, "family").where(apart))
    members = placed.join(blocks, of).withColumn("part", _dealt(F.col("parts"))).select("id", "family", "label", key.alias("block"))
    ends = pairs.select("family", F.col("low").alias("block"), "low", "high", F.lit(0).alias("side")).union(pairs.where("low <> high").select("family", "high", "low", "high", F.lit(1)))
    whole = _texts_of(docs, materialise(members)).mapInArrow(_whole(k, ["id", "family", "label", "block"]), "id long, family long, label long, block struct<size:int,pure:boolean,unit:bigint,part:int>, shingles binary")
    return whole.join(ends, ["family", "block"]).groupBy("family", "low", "high").applyInArrow(_compare(percent), LINK)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are ASCII-lower-cased; a text of fewer than ``k`` words has its whole sequence
    as the one shingle; a null or empty text has none and is linked with nothing (its own
    component). Rows of one doc_id come back as often as they came in; rows with a null
    doc_id are kept and have a null component. Sets are compared by 64-bit shingle hashes.
    A doc_id names one document: where rows of one id differ in text, what links either may join both."""
    signed = materialise(only(docs, "doc_id", "text").mapInArrow(_sign(k), "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>"))
    set_of = ["n_shingles", "print_a", "print_b"]
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy(*set_of).agg(F.min("doc_id").alias("id")))
    single = materialise(some.withColumnRenamed("doc_id", "id").join(classes, ["id", *set_of], "left_semi").dropDuplicates(["id", *set_of]).select("id", F.explode("keys").alias("key")))
    families = _families(single).withColumnRenamed("component", "family")
    member = materialise(families.join(classes.select("id", "n_shingles"), "id"))
    totals = member.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).select("family", _parts("n", "total").alias("chunks"))
    active = materialise(member.join(totals, "family"))
    in_all = F.when(F.col("id") == F.col("family"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(_dealt(F.col("chunks"))))
    whole = _texts_of(docs, active.select("id", "family", "chunks")).mapInArrow(_whole(k, ["id", "family", "chunks"]), "id long, family long, chunks int, shingles binary")
    chunk = whole.select("family", F.explode(in_all).alias("chunk"), F.col("id").alias("label"), F.lit(0).alias("side"), "shingles")
    links = materialise(chunk.groupBy("family", "chunk").applyInArrow(_compare(percent), LINK))
    found = components(links)
    labelled = active.where("chunks > 1").join(found, "id", "left").select("id", "family", "n_shingles", F.coalesce("component", "id").alias("label"))
    several = labelled.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("family")
    open_ = materialise(labelled.join(several, "family", "left_semi"))
    if not open_.isEmpty():
        found = components(links.union(_across(docs, open_, k, percent)))
    members_of = classes.join(found, "id", "left").select(*set_of, F.coalesce("component", "id").alias("component"))
    result = signed.drop("keys").join(members_of, set_of, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, in all its columns: the one with the least doc_id (null last), whatever
    ids repeat or are null. Rows without words aren't duplicates of each other and all stay. Rows are told apart
    by a number of their own, stored with them once."""
    row = fresh(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered.select(F.col(f"`{row}`").alias("doc_id"), "text"), k, percent).where("n_shingles > 0")
    several = found.groupBy(F.col("component_id").alias("c")).count().where("count > 1").select("c")
    grouped = found.join(several, F.col("component_id") == F.col("c"), "left_semi").select(F.col("doc_id").alias("r"), "component_id")
    named = materialise(numbered.select(F.col(f"`{row}`").alias("r"), "doc_id").join(grouped, "r").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")))
    stay = named.groupBy("component_id").agg(F.min("rank").alias("least")).select("least.r")
    gone = named.select("r").join(stay, "r", "left_anti")
    return numbered.join(gone, numbered[row] == gone["r"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


ORACLE = None
