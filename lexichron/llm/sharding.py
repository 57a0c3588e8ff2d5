"""K-d tree sharding by bytes, in DataFrame functions only.

A node with several shards is cut along its widest metadata dimension (the range of its values
against the whole table's) at the weighted median of bytes, or at the weighted quantile that
fits an odd number of shards. The dimensions, bytes, words, lines and mean bytes of a word, are
functions of the text; rows of one value are told apart by the text's digest, which is the lower
half of each coordinate, so a cut is off by no more than half the bytes of one text and its copies.
Medians of all nodes of a level are found together by refining histograms: each round sums bytes in
``BINS`` bins of every node's bracket (added up before the shuffle) and keeps the bin that holds the
median, until it is a single coordinate.

Equal texts lie on one point and stay in one shard, unless one text with its copies is larger than a
shard: its rows are told apart by doc_id. Only the nodes' brackets and cuts (fewer than shards) come to
the driver, and go to the tasks in the plan, for any number of shards alike."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, table

BINS = 4096
#: Rows that one task numbers, about.
SLOT_ROWS = 50_000
DIMENSIONS = ("bytes", "words", "lines", "word_bytes")
RESULT = ("kd_size", "kd_crc32", "kd_shard")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, and more) with size, crc32, the id's digest and the values of all dimensions."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    sized = rows.withColumns({"size": text_size(F.col("text")), "crc32": text_crc32(F.col("text")), "id_digest": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))})
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return sized.withColumns({"bytes": F.col("size"), "words": words, "lines": lines}).withColumn("word_bytes", F.expr("bytes div greatest(words, 1)"))


def _placed(measured: DataFrame, heavy: DataFrame) -> DataFrame:
    """Each dimension's value with the digest that tells rows of one value apart."""
    marked = measured.join(F.broadcast(heavy), ["size", "crc32"], "left")  # fewer rows than shards
    digest = F.when(F.col("is_heavy"), F.col("id_digest")).otherwise(F.col("crc32"))
    return marked.withColumns({d: F.shiftleft(d, 32) + digest for d in DIMENSIONS}).withColumn("node", F.lit(0)).drop("is_heavy")


def _at(dim: Column) -> Column:
    """The coordinate along a row's own dimension."""
    out = F.when(dim == 0, F.col(DIMENSIONS[0]))
    for i, d in enumerate(DIMENSIONS[1:], 1):
        out = out.when(dim == i, F.col(d))
    return out


def _by_node(values: dict[int, float], kind: str = "bigint") -> Column:
    """The value of a row's node, null for others: an array that the optimizer folds into one literal, so rows aren't joined."""
    listed = json.dumps([values.get(i) for i in range(max(values, default=0) + 1)])
    return F.get(F.from_json(F.lit(listed), f"array<{kind}>"), F.col("node"))


def _quantiles(points: DataFrame, brackets: dict[int, dict]) -> None:
    """Narrows each node's bracket (dim, lo, hi, goal, below, inside) to the one coordinate at which ``goal`` bytes are reached."""
    while wide := {k: b for k, b in brackets.items() if b["hi"] > b["lo"]}:
        dim, lo, hi, below = (_by_node({k: b[c] for k, b in wide.items()}) for c in ("dim", "lo", "hi", "below"))
        step = _by_node({k: (b["hi"] - b["lo"]) // BINS + 1 for k, b in wide.items()})
        goal = _by_node({k: float(b["goal"]) for k, b in wide.items()}, "double")
        hit = points.withColumn("x", _at(dim)).where((F.col("x") >= lo) & (F.col("x") <= hi)).withColumns({"off": F.col("x") - lo, "step": step})
        bars = hit.groupBy("node", F.expr("off div step").alias("bin")).agg(F.sum("size").alias("inside"))
        upto = F.sum("inside").over(Window.partitionBy("node").orderBy("bin")) + below
        best = bars.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("bin", "upto", "inside")).alias("b"))
        for r in best.select("node", "b.*").collect():  # a row for each node
            b = brackets[r["node"]]
            step_of = (b["hi"] - b["lo"]) // BINS + 1
            b["lo"] += r["bin"] * step_of
            b |= {"hi": min(b["hi"], b["lo"] + step_of - 1), "below": r["upto"] - r["inside"], "inside": r["inside"]}


def _descend(rows: DataFrame, cuts: list[tuple[int, int, int, int]]) -> DataFrame:
    """Rows one level further down. cuts: (node, dim, cut, left) where ``left`` shards are on the left side; the right side's node is node + left."""
    dim, cut, left = (_by_node({x[0]: x[i] for x in cuts}) for i in (1, 2, 3))
    return rows.withColumn("node", F.when(_at(dim) > cut, F.col("node") + left).otherwise(F.col("node")).cast("int"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """Every row of ``docs`` in all its columns, with ``kd_size``, ``kd_crc32`` and ``kd_shard``; columns of these names in ``docs`` are replaced.

    ``shards`` leaves, or as many as hold ``target_bytes`` each. Null texts count as empty (size 1).
    Rows that agree in text and, should that text and its copies be heavier than a shard, in doc_id can't be told
    apart and share a shard, so a shard may then be large and others empty. An empty table has no shards."""
    kept = [c for c in docs.columns if c not in RESULT]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id", "text")
    measured = _measured(packed)
    narrow = materialise(measured.select("size", "crc32", "id_digest", *DIMENSIONS))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    heavy = narrow.groupBy("size", "crc32").agg(F.sum("size").alias("of_text")).where(F.col("of_text") > total / shards)
    heavy = materialise(heavy.select("size", "crc32", F.lit(True).alias("is_heavy")))
    points = materialise(_placed(narrow, heavy).select("node", "size", *DIMENSIONS))
    ends = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    value = lambda r, d: (r[f"high_{d}"] >> 32) - (r[f"low_{d}"] >> 32)
    parts, levels, whole = {0: shards}, [], None
    while open_ := {k: n for k, n in parts.items() if n > 1}:
        found = points.where(_by_node(open_).isNotNull()).groupBy("node").agg(F.sum("size").alias("total"), *ends).collect()  # a row for each node
        whole = whole or {d: max(1, *(value(r, d) for r in found)) for d in DIMENSIONS} if found else None
        brackets = {}
        for r in found:
            dim = max(range(len(DIMENSIONS)), key=lambda i: (value(r, DIMENSIONS[i]) / whole[DIMENSIONS[i]], -i))  # noqa: B023
            low, high = (r[f"{n}_{DIMENSIONS[dim]}"] for n in ("low", "high"))
            n = open_[r["node"]]
            brackets[r["node"]] = {"dim": dim, "lo": low, "hi": high, "goal": r["total"] * (n // 2) / n, "below": 0, "inside": r["total"]}
        _quantiles(points, brackets)
        cuts = []
        for k, b in brackets.items():
            with_it = b["below"] + b["inside"] - b["goal"] <= b["goal"] - b["below"]
            cuts.append((k, b["dim"], b["lo"] if with_it else b["lo"] - 1, open_[k] // 2))
        parts = {k: n for k, n in parts.items() if n == 1}
        for k, *_, left in cuts:
            parts |= {k: left, k + left: open_[k] - left}
        if cuts:
            levels.append(cuts)
            if any(n > 1 for n in parts.values()):
                points = materialise(_descend(points, cuts))
    rows = _placed(measured, heavy)
    for cuts in levels:
        rows = _descend(rows, cuts)
    return rows.select(*[F.col(f"row.`{c}`") for c in kept], F.col("size").alias("kd_size"), F.col("crc32").alias("kd_crc32"), F.col("node").alias("kd_shard"))


def slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each ``shard`` of (doc_id, size, text_crc32, shard) rows: rows are
    numbered within hash buckets and the buckets' counts are added up, so no shard is one task."""
    rows = materialise(rows)
    n = max(1, -(-rows.count() // SLOT_ROWS)) * 4
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n)).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("own", own).join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("own") + F.col("before")).cast("long")).drop("own", "before", "bucket")


def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    numbered = slots(sharded.select("doc_id", F.col("kd_size").alias("size"), F.col("kd_crc32").alias("text_crc32"), F.col("kd_shard").alias("shard")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = None
