"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1) are the positives; a sample of all documents, labelled or not, is
the unlabelled mixture, so no text is ever taken for a confirmed clean one and no label but 1 is
read. With the class prior p, losses l and a linear score f the risk is
    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]),
and where the second part falls below zero (more fitting of the unlabelled than the prior
allows) a step undoes it instead. The prior is not given by labels either: of every set of texts the
mixture holds at least p times the positives' share, so p is at most the ratio of the two. Two fits, each on
half of the sample and with the prior ``FIRST_PRIOR``, order the other half, and the least ratio over the sets above
a score, each share moved by its standard error (chance makes the least of many too small), is the prior of the final fit. The score is
then moved so that 0.5 lies where the same risk with zero-one loss is least.

Features are letter runs of the lower-cased text and their prefixes of 4 to 6 letters (word
stems), present or not; the ``FEATURES`` most significant of those that positives hold at least
``RATIO`` times as often as the mixture are used, at ``LEAST_Z`` or more standard errors, since thousands are tried. Fitting is bounded: ``SAMPLE`` positives and
``SAMPLE`` unlabelled texts, the first in the order of a hash of doc_id. Scoring reads every
whole text once, with the weights in the closure; nothing is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, materialise, only, table
from ._tokens import pieces

SAMPLE = 20_000
FIRST_PRIOR = 0.2
FEATURES = 4_096
RATIO, LEAST_Z = 3.0, 4.0
PREFIXES = (4, 5, 6)
_RUN = re.compile(r"[^\W\d_]+")
CACHE = 300_000


def features(text: str | None) -> set[str]:
    """Letter runs, and their prefixes marked by a star."""
    found = set(_RUN.findall((text or "").lower()))
    return found | {f"{w[:n]}*" for w in found for n in PREFIXES if len(w) >= n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 16 << 20):
            in_p: Counter[str] = Counter()
            in_u: Counter[str] = Counter()
            for text, p, u in zip(*(part.column(c).to_pylist() for c in ("text", "positive", "unlabelled")), strict=True):
                own = features(text)
                if p:
                    in_p.update(own)
                if u:
                    in_u.update(own)
            names = list(in_p.keys() | in_u.keys())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([in_p[x] for x in names], pa.int64()), pa.array([in_u[x] for x in names], pa.int64())], names=["feature", "p", "u"])


def _index(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[x] for x in features(t) if x in place) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("positive"), batch.column("unlabelled"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "unlabelled", "at"])

    return run


def fit_nnpu(rows: list[tuple[bool, bool, list[int]]], n_features: int, prior: float, steps: int = 500, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from (positive, unlabelled, feature indices) rows, by Adam on all rows at once."""
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    flat = np.array([i for r in rows for i in r[2]], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    p, u = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    p, u = p / max(1.0, p.sum()), u / max(1.0, u.sum())
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        f = np.bincount(owner, weights=theta[flat], minlength=len(rows)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = float((np.logaddexp(0, f) * (u - prior * p)).sum())
        slope = s * (u - prior * p)  # of the part on negatives
        g = prior * p * (s - 1) + slope if negative >= 0 else -slope
        grad = np.append(np.bincount(flat, weights=g[owner], minlength=n_features), g.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1]) - threshold(np.bincount(owner, weights=theta[flat], minlength=len(rows)) + theta[-1], p, u, prior)


def threshold(f: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The score at which the prior-corrected risk of zero-one loss is least; of equal ones the middle of the widest gap."""
    order = np.argsort(f, kind="stable")
    f, p, u = f[order], p[order], u[order]
    ends = np.flatnonzero(np.diff(f) > 1e-9)  # between two different scores
    if not len(ends):
        return 0.0
    below_p, below_u = np.cumsum(p)[ends], np.cumsum(u)[ends]
    risk = prior * below_p + np.maximum(0, (1 - below_u) - prior * (1 - below_p))
    best = ends[risk <= risk.min() + 1e-12]
    widest = best[np.argmax(f[best + 1] - f[best])]
    return float((f[widest] + f[widest + 1]) / 2)


def class_prior(f: np.ndarray, p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio of shares, unlabelled to positive, above any score that at least half of the positives reach; ``p`` and ``u`` mark the rows.
    Shares count with one standard error against the ratio."""
    order = np.argsort(-f, kind="stable")
    f, p, u = f[order], p[order], u[order]
    ends = np.append(np.flatnonzero(np.diff(f) < -1e-9), len(f) - 1)
    n_p, n_u = p.sum(), u.sum()
    of_p, of_u = np.cumsum(p)[ends] / n_p, np.cumsum(u)[ends] / n_u
    far = of_p >= 0.5
    of_p, of_u = of_p[far], of_u[far]
    low, high = of_p - np.sqrt(of_p * (1 - of_p) / n_p), of_u + np.sqrt(of_u * (1 - of_u) / n_u)
    return float(min(0.9, max(1 / n_u, (high / np.maximum(low, 1e-9)).min())))


def first_then_final(rows: list[tuple[bool, bool, list[int]]], n_features: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the prior that they were fitted with. Rows come in an order that says nothing of them."""
    halves, f = (rows[::2], rows[1::2]), np.zeros(len(rows))
    for k, own in enumerate(halves):
        weights, bias = fit_nnpu(halves[1 - k], n_features, FIRST_PRIOR)
        f[k::2] = [weights[r[2]].sum() + bias for r in own]
    p, u = (np.array([r[c] for r in rows], float) for c in (0, 1))
    prior = class_prior(f, p, u)
    return *fit_nnpu(rows, n_features, prior), prior


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Feature weights and bias, learnt from rows that are not held out."""
    learnt = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    first = lambda df: df.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    toxic, every = (first(df.where(learnt).select("doc_id")) for df in (labels.where("toxic = 1"), docs))
    drawn = toxic.select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled")).union(every.select("doc_id", F.lit(False), F.lit(True)))
    drawn = materialise(drawn.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled")))  # at most 2 * sample rows
    # copies of one text count once: else the rare words of a text with many copies look toxic
    # and of rows with one doc_id one does, so that the sample stays bounded
    met = only(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    texts = materialise(met.groupBy("text").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled")))
    n_p, n_u = (x or 0 for x in texts.agg(F.sum(F.col("positive").cast("int")), F.sum(F.col("unlabelled").cast("int"))).first())
    if not n_p or not n_u:
        return {}, -4.0
    counts = texts.mapInArrow(_count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b, mean = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (a - b) / F.sqrt(mean * (1.0000001 - mean) * (1 / n_p + 1 / n_u))
    chosen = counts.where((F.col("p") >= 3) & (a >= RATIO * b)).select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    place = {r.feature: i for i, r in enumerate(chosen)}
    if not place:
        return {}, -4.0
    indexed = texts.orderBy(F.xxhash64("text"), "text").mapInArrow(_index(place), "positive boolean, unlabelled boolean, at array<int>")
    weights, bias, _ = first_then_final([(r.positive, r.unlabelled, r.at) for r in indexed.toLocalIterator()], len(place))
    return {x: float(weights[i]) for x, i in place.items()}, bias


def score_texts(column: pa.Array, weights: dict[str, float], bias: float, cache: dict[str, tuple[str, ...]]) -> np.ndarray:
    """Probabilities of the texts. cache: the weighted features of each letter run, as far as met."""
    out = np.empty(len(column))
    for i, text in enumerate(column.to_pylist()):
        hit: set[str] = set()
        for w in set(_RUN.findall((text or "").lower())):
            own = cache.get(w)
            if own is None:
                if len(cache) >= CACHE:
                    cache.clear()
                own = cache[w] = tuple(x for x in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) >= n)) if x in weights)
            if own:
                hit.update(own)
        out[i] = bias + sum(weights[x] for x in sorted(hit))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _score(weights: dict[str, float], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                yield pa.record_batch([part.column("doc_id"), pa.array(score_texts(part.column("text"), weights, bias, cache))], names=["doc_id", "score"])

    return run


def _clean(weights: dict[str, float], bias: float, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                yield part.filter(pa.array(score_texts(part.column("text"), weights, bias, cache) < limit))

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no features and score the bias alone. Without a toxic label to
    learn from, every score is the same and low. A null doc_id is held out. Copies of one text count
    once in learning; rows that repeat are scored as often; texts of any length are read whole."""
    weights, bias = train(docs, labels)
    scored = only(docs, "doc_id", "text").mapInArrow(_score(weights, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Documents that score below ``limit``, in all their columns."""
    weights, bias = train(docs, labels)
    return docs.mapInArrow(_clean(weights, bias, limit), docs.schema)


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = None
