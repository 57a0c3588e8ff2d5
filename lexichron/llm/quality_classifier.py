"""Quality scores from random-indexing word vectors and a small calibrated network.

Tokens are runs of letters and digits, or of signs, with their case. A token's 64-bit hash gives
it a sparse random index vector; a word's vector is the sum of the index vectors of its neighbours
(two on either side) over all texts of the corpus. Words' mean vectors, centred and scaled to
length one, are pooled (mean) over a document; the energy of the pooled index vectors (how much
a text repeats itself) and the length are two more inputs.

The vectors of a whole corpus fit no single task, so they are dealt out by hash range, every word
with its own: texts are read in blocks of bounded size; a block sends the sums of its distinct
words, one row for each range (a request); a range adds up what all blocks sent and answers each
in the order of its words (a reply); the block's bags of words then meet the vectors they need.
Blocks are made twice, for requests and for bags, so ``docs`` must come in the same order at each
reading, as files do; where they don't, the blocks' fingerprints differ and the query fails.

The network (one hidden layer of tanh units) is fitted in numpy on at most ``SAMPLE`` labelled
texts, the first in the order of a hash of doc_id; a fifth of them is kept back to fit the
temperature that calibrates its probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, materialise, only, table
from ._packing import pack, unpack
from ._tokens import RUNS, mix, pieces, word_hashes

SAMPLE = 20_000
DIMS, NONZERO, WINDOW = 32, 4, 2
#: Bytes of text in a block, distinct words at most, and the least number of hash ranges.
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 2_000_000
LEAST_PARTS = 32
HIDDEN = 32
REQUEST = "block long, part int, print long, keys binary, sums binary"
REPLY = "block long, part int, print long, sums binary, total binary"
BAG = "block long, print long, doc_ids array<long>, counts binary, energy binary, words long, gaps binary, times binary"


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """The index vector of each word hash: ``NONZERO`` signs, one in each stretch of dimensions."""
    bits, wide = mix(keys ^ np.uint64(0x1207)), DIMS // NONZERO
    out = np.zeros((len(keys), DIMS), np.int8)
    for k in range(NONZERO):
        x = bits >> np.uint64(16 * k)
        out[np.arange(len(keys)), k * wide + (x >> np.uint64(1)).astype(np.int64) % wide] = 1 - 2 * (x & np.uint64(1)).astype(np.int8)
    return out


def add_contexts(total: np.ndarray, b: np.ndarray, counts: np.ndarray, index: np.ndarray) -> None:
    """Add the index vectors of all words' neighbours to ``total`` (dims and a row of counts x words); ``b`` are the tokens' words."""
    text = np.repeat(np.arange(len(counts)), counts)
    near = [text[o:] == text[:-o] for o in range(1, WINDOW + 1)]
    for d in range(DIMS):  # a dimension at a time: no copy of all tokens' vectors
        own = index[b, d]
        s = np.zeros(len(b), np.int8)
        for o, same in enumerate(near, 1):
            if len(b) > o:
                s[:-o] += own[o:] * same
                s[o:] += own[:-o] * same
        total[d] += np.bincount(b, weights=s, minlength=total.shape[1]).astype(total.dtype)
    total[DIMS] += np.bincount(b, minlength=total.shape[1]).astype(total.dtype)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int | None], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(id, fingerprint, doc_ids, sorted distinct words, [tokens' words and texts' token counts of each piece]) of each block of a task."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    ids: list[int | None] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    mark = size = words = 0

    def made():
        keys = np.unique(np.concatenate([x[0] for x in found]))
        own = [(np.searchsorted(keys, k).astype(np.int32)[b], n) for k, b, n in found]
        return number, (mark + (1 << 63)) % (1 << 64) - (1 << 63), ids, keys, own

    for batch in batches:
        for part in pieces(batch, "text"):
            h, counts = word_hashes(part.column("text"), lower=False, classes=RUNS)
            mark = mark * 31 + int(mix(h + np.arange(len(h), dtype=np.uint64)).sum(dtype=np.uint64)) + len(counts)
            keys, b = np.unique(h, return_inverse=True)
            found.append((keys, b.astype(np.int32), counts))
            ids += part.column("doc_id").to_pylist()
            size, words = size + part.column("text").nbytes, words + len(keys)
            if size >= BLOCK_BYTES or words >= BLOCK_WORDS:
                yield made()
                number, ids, found, mark, size, words = number + 1, [], [], 0, 0, 0
    if found:
        yield made()


def _ask(parts: int):
    borders = np.array([((1 << 64) // parts + 1) * i for i in range(parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, _, keys, texts in _blocks(batches):
            total, index = np.zeros((DIMS + 1, len(keys)), np.int32), index_vectors(keys)
            for b, counts in texts:
                add_contexts(total, b, counts, index)
            at = np.append(np.searchsorted(keys, borders), len(keys))
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.record_batch(
                [pa.array([number] * parts, pa.int64()), pa.array(range(parts), pa.int32()), pa.array([mark] * parts, pa.int64()), pa.array([keys[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([pack(total[:, i:j]) for i, j in cut], pa.binary())],
                names=["block", "part", "print", "keys", "sums"],
            )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """The corpus sums of every word of one hash range, for each block in its own order, and the range's sums over all words."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")]
    words, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros((DIMS + 1, len(words)), np.int64)
    stops = np.cumsum([len(k) for k in keys])
    places = [which[b - len(k) : b] for b, k in zip(stops, keys, strict=True)]
    for place, blob in zip(places, group.column("sums"), strict=True):
        total[:, place] += unpack(blob.as_py()).reshape(DIMS + 1, -1)  # a block's words are distinct
    sums = pa.array([pack(total[:, place]) for place in places], pa.binary())
    return pa.table({"block": group.column("block"), "part": group.column("part"), "print": group.column("print"), "sums": sums, "total": pa.array([total.sum(axis=1).tobytes()] * len(group), pa.binary())})


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the texts' token counts and energy, and their distinct words with counts."""
    for number, mark, ids, keys, texts in _blocks(batches):
        index, energy, gaps, all_times, before, last = index_vectors(keys), [], [], [], 0, 0
        for b, counts in texts:
            some, own = counts > 0, np.zeros(len(counts))
            for d in range(DIMS if len(b) else 0):
                own[some] += np.add.reduceat(index[b, d].astype(np.int64), (np.cumsum(counts) - counts)[some]).astype(float) ** 2
            energy.append(own)
            bag, times = np.unique(np.repeat(np.arange(before, before + len(counts)), counts) * len(keys) + b, return_counts=True)
            gaps.append(np.diff(bag, prepend=last))
            all_times.append(times)
            before, last = before + len(counts), int(bag[-1]) if len(bag) else last
        counts = np.concatenate([n for _, n in texts])
        yield pa.record_batch(
            [pa.array([number], pa.int64()), pa.array([mark], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(counts)], pa.binary()), pa.array([np.concatenate(energy).tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([pack(np.concatenate(gaps))], pa.binary()), pa.array([pack(np.concatenate(all_times))], pa.binary())],
            names=["block", "print", "doc_ids", "counts", "energy", "words", "gaps", "times"],
        )


def unit_vectors(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Words' mean vectors (from sums with counts in the last row), less the corpus's mean, at length one; dims x words."""
    v = sums[:DIMS] / np.maximum(sums[DIMS:], 1) - (total[:DIMS] / max(1, int(total[DIMS])))[:, None]
    return (v / np.maximum(np.linalg.norm(v, axis=0, keepdims=True), 1e-9)).astype(np.float32)


def _pool(parts: int):
    def run(bags: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("part")
        marks = set(bags.column("print").to_pylist()) | set(replies.column("print").to_pylist())
        if len(bags) != 1 or len(replies) != parts or len(marks) != 1:
            raise ValueError("a block of texts was not read twice in the same order")
        bag = bags.to_pylist()[0]
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in replies.column("total"))
        vectors = np.concatenate([unit_vectors(unpack(x.as_py()).reshape(DIMS + 1, -1), total) for x in replies.column("sums")], axis=1)
        counts, times = unpack(bag["counts"]), unpack(bag["times"])
        out, some = np.zeros((len(counts), DIMS + 2), np.float32), counts > 0
        if some.any():
            text, word = np.divmod(np.cumsum(unpack(bag["gaps"])), bag["words"])
            starts = np.searchsorted(text, np.flatnonzero(some))
            for d in range(DIMS):
                out[some, d] = np.add.reduceat(vectors[d, word] * times.astype(np.float64), starts) / counts[some]
            out[some, DIMS] = np.log(np.frombuffer(bag["energy"])[some] / (NONZERO * counts[some]) + 0.1)
        out[:, DIMS + 1] = np.log1p(counts)
        return pa.table({"doc_id": pa.array(bag["doc_ids"], pa.int64()), "x": pa.array([r.tobytes() for r in out], pa.binary())})

    return run


def pooled(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of ``docs`` (doc_id, text): mean word vector, log energy of the index vectors and log length, as float32."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // BLOCK_BYTES))
    replies = docs.mapInArrow(_ask(parts), REQUEST).groupBy("part").applyInArrow(_answer, REPLY)
    return docs.mapInArrow(_bags, BAG).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_pool(parts), "doc_id long, x binary")


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """A two-layer network with a temperature. Every fifth row is kept back for the temperature."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    back = np.arange(len(y)) % 5 == 4
    a, t = z[~back], y[~back]
    rng = np.random.default_rng(5)
    net = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(w) for k, w in net.items()} for _ in range(2))
    for i in range(1, steps + 1):
        h = np.tanh(a @ net["w1"] + net["b1"])
        p = 1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30)))
        e = (p - t) / len(t)
        back_h = np.outer(e, net["w2"]) * (1 - h * h)
        grad = {"w1": a.T @ back_h + decay * net["w1"], "b1": back_h.sum(axis=0), "w2": h.T @ e + decay * net["w2"], "b2": e.sum(keepdims=True)}
        for k, g in grad.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net[k] = net[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    net |= {"mean": mean, "scale": scale, "t": np.ones(1)}
    if back.any():
        f, t = logits(x[back], net), y[back]
        loss = lambda c: float((np.logaddexp(0, f / c) - t * f / c).mean())
        net["t"] = np.array([min(np.geomspace(0.25, 8, 61), key=loss)])
    return net


def logits(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    h = np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"])
    return (h @ net["w2"] + net["b2"]) / net["t"]


def _score(net: dict[str, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, DIMS + 2)
            f = logits(x.astype(float), net) if net else np.zeros(len(x))
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts have the inputs 0 and are scored like any other. Without labels of both
    classes every score is 0.5. A null doc_id is held out. Rows that repeat are scored as often; of rows
    with one doc_id one is learnt from. Texts of any length are read whole."""
    inputs = materialise(pooled(only(docs, "doc_id", "text")))
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    drawn = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    met = inputs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("good").alias("good"))  # one row of a repeated id, so at most ``sample``
    rows = met.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(len(rows), DIMS + 2)
    y = np.array([r.good for r in rows], float)
    net = fit_network(x, y) if 0 < y.sum() < len(y) else None
    scored = inputs.mapInArrow(_score(net), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = None
