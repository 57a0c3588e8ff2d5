"""Quality rules with cutoffs that labelled holdouts prove to be safe.

Each rule gives a document a badness of 0 to 1000 and rejects it at a cutoff. In every
stratum (language) and for every rule, labelled good documents that pass the fixed base
rules are the holdout. Cutoffs of a fixed grid are tested from the laxest to the strictest
and the last one that passes is taken: a cutoff passes if the exact (Clopper-Pearson) upper
bound of its false rejection rate is at most ``RISK`` / rules. Within a rule's fixed
sequence no correction is due; over all strata and rules the error ``DELTA`` is divided
(Bonferroni). So with confidence 1 - DELTA no stratum loses more than RISK of its good
documents. A stratum with too few holdouts for any cutoff rejects nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table
from ._tokens import chain, mix, pieces, word_hashes

RISK, DELTA = 0.02, 0.05
#: Cutoffs in the order in which they are tested.
GRID = [*range(1000, 500, -50), *range(500, 100, -20), *range(100, 0, -5)]
RULES = ("symbols", "repeats", "dup_lines", "shouting")
#: A stratum with fewer holdouts can't pass any test at any number of strata; such strata are left out of the table that comes to the driver.
LEAST_HOLDOUTS = math.ceil(math.log(len(RULES) / DELTA) / -math.log1p(-RISK / len(RULES)))
_SPACES = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def repeated_words(h: np.ndarray, counts: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text the words that lie in ``k``-word windows which it holds twice or more."""
    if len(h) < k:
        return np.zeros(len(counts), np.int64)
    acc, left = chain(h, counts, k)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    at = np.flatnonzero(left >= k)
    _, which, n = np.unique(acc[at] ^ mix(text[at] + np.uint64(1)), return_inverse=True, return_counts=True)
    hit = at[n[which] > 1]
    covered = np.zeros(len(h), bool)
    for j in range(k):
        covered[hit + j] = True
    return np.bincount(text[covered].astype(np.int64), minlength=len(counts))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            h, n_words = word_hashes(part.column("text"), lower=False)
            rows = []
            for text in part.column("text").to_pylist():
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                seen: set[str] = set()
                dup = with_word = 0
                for line in text.split("\n"):
                    if line.strip(" \t\n\x0b\x0c\r"):
                        with_word += 1
                        dup += line in seen
                        seen.add(line)
                spaces = len(raw) - len(raw.translate(None, _SPACES))
                rows.append((len(text) - spaces, len(raw) - len(raw.translate(None, b"#*$%&|<>")), dup, with_word, len(raw) - len(raw.translate(None, _CAPITALS))))
            chars, symbols, dup, lines, capitals = np.array(rows, np.int64).reshape(-1, 5).T
            columns = dict(zip(COUNTS, (n_words, chars, symbols, dup, repeated_words(h, n_words), lines, capitals), strict=True))
            yield pa.record_batch([part.column("doc_id"), part.column("stratum"), *[pa.array(columns[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", "stratum", *COUNTS])


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts of every whole text, the base rules' verdict and each rule's badness."""
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), "text")
    counted = rows.mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1000), F.expr(f"{a} * 1000 div {b}"))).otherwise(0)
    return counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumns(
        {"bad_symbols": share("n_symbols", "word_chars"), "bad_repeats": share("n_repeat_words", "n_words"), "bad_dup_lines": share("n_dup_lines", "n_lines"), "bad_shouting": share("n_capitals", "word_chars")}
    )


def passes(rejected: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, of a rate seen ``rejected`` times of ``n`` is at most ``risk``."""
    if rejected >= n * risk:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk) for i in range(rejected + 1)]
    top = max(logs)
    return top + math.log(math.fsum(math.exp(x - top) for x in logs)) <= math.log(delta)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[tuple[str, str, int, int]]:
    """(stratum, rule, cutoff, holdouts) for every stratum and rule of which a cutoff is proved."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = materialise(measured.where("not base_failed").join(good, "doc_id", "left_semi").select("stratum", *[f"bad_{r}" for r in RULES]))
    enough = held.groupBy("stratum").count().where(F.col("count") >= LEAST_HOLDOUTS)
    sizes = {r["stratum"]: r["count"] for r in enough.collect()}
    if not sizes:
        return []
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bad_{r}").cast("int").alias("bad")) for r in RULES])).alias("x")
    bars = held.where(F.col("stratum").isin(list(sizes))).select("stratum", each).groupBy("stratum", "x.rule", "x.bad").count().collect()  # at most strata x rules x 1001 rows
    found = []
    for stratum, n in sorted(sizes.items()):
        for rule in RULES:
            bar = {r["bad"]: r["count"] for r in bars if r["stratum"] == stratum and r["rule"] == rule}
            best = None
            for c in GRID:
                if not passes(sum(k for b, k in bar.items() if b >= c), n, risk / len(RULES), delta / (len(RULES) * len(sizes))):
                    break
                best = c
            if best is not None:
                found.append((stratum, rule, best, n))
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base verdict, the first rule that rejects (null: none) and ``kept`` for every row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null stratum is the stratum ''.
    Label rows that repeat count once; labels other than 1 are no holdouts; rows of one labelled doc_id are a holdout each.
    A badness equal to the cutoff rejects."""
    measured = materialise(measures(docs, stratum))
    proved = cutoffs(measured, labels, risk, delta)
    spark = docs.sparkSession
    limits = spark.createDataFrame([(s, r, c) for s, r, c, _ in proved], "stratum string, rule string, cutoff int")
    wide = limits.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = F.broadcast(wide.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES]))  # a row for each stratum with LEAST_HOLDOUTS labelled rows
    rejects = F.coalesce(*[F.when(F.col(f"bad_{r}") >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    return measured.join(wide, "stratum", "left").withColumn("rejected_by", rejects).withColumn("kept", F.expr("not base_failed and rejected_by is null"))


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


ORACLE = None
