"""Log-probabilities of whole texts by a weighted backoff automaton.

Model: n-grams up to ``ORDER``, each order smoothed by a Dirichlet prior of weight ``MU`` over
the one below, the lowest by one:
    P1(w) = (c(w) + 1) / (N + V + 1)        P(w | x y) = (c(x y w) + MU P(w | y)) / (c(x y) + MU).
Automaton: the root and every context seen in training are states. A state has an arc for each
word seen after it, with weight log P and the longest suffix that is a state as its end, and a
failure arc, with weight log MU / (c + MU), to the context without its first word. The root has an arc
for every word; unseen words lead from the root to the root. Arcs and failure arcs together give
exactly P. A text is read from left to right: the carried state's arc is taken or, where there
is none, failure arcs until there is one, and weights are added up. All texts of a block are read
side by side, in lanes of ``LANE`` tokens; a lane within a text is first led through the ORDER - 1
tokens before it, which fix its state.

The automaton of a whole corpus fits no single task, so it is dealt out by arc: texts are read in
blocks of bounded size; a block asks for its distinct n-grams, packed by hash range into one row
each (a request; ranges that a block has nothing for get none, so requests never outnumber
n-grams); each range adds up what all blocks counted and answers every request in the order of
its keys (a reply); the block then builds the states and arcs that its texts can touch. Requests carry
counts of training texts, so counting and looking up share one shuffle, and nothing is pruned, capped or
sent to the driver but N, V and the number of texts. Blocks are made twice, for requests and for their tokens, so ``docs``
must come in the same order at each reading, as files do; where they don't, the blocks' fingerprints
differ and the query fails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, only, table
from ._packing import pack, pack_ranks, pack_sorted, unpack, unpack_ranks, unpack_sorted
from ._tokens import mix, pieces, word_hashes

ORDER = 3
MU = 4.0
#: Bytes of text in a block, and bytes of text whose n-grams a hash range holds, about.
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
LEAST_RANGES = 32
#: Different words that a task counts before it tells them.
TASK_WORDS = 2_000_000
LANE = 64
START, END = np.uint64(0x51A7), np.uint64(0xE4D)  # no word's hash but by a chance of 2**-64
_ODD = np.uint64(0x9E3779B97F4A7C15)
VOCABULARY = "part int, tokens long, size long, keys binary"
REQUEST = "block long, part int, print long, sizes array<long>, keys array<binary>, counts array<binary>"
REPLY = "block long, part int, print long, counts array<binary>"
TOKENS = "block long, print long, doc_ids array<long>, held array<boolean>, sizes binary, words long, keys binary, by_rank binary, ranks binary"


def grams(tokens: np.ndarray, n: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The key of the m-gram that ends at each token, for m = 1 to ``order``; texts begin with START. Before a text's (m - 1)th token, m > 2, there is none and the key is not to be used."""
    first, keys = np.cumsum(n) - n, tokens
    yield keys
    for m in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = keys[:-1]
        if m == 2:
            before[first] = START
        keys = mix(before * _ODD + tokens)
        yield keys


def offsets(n: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place where each comes first, and each element's key; in less memory than numpy's own takes."""
    order = np.argsort(x, kind="stable")
    keys = x[order]
    new = np.ones(len(x), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys, first = keys[new], order[new].astype(np.int32)
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys, first, which


def _with_ends(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = counts + 1
    tokens = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(n) - 1] = False
    tokens[inner] = h
    return tokens, n


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, fingerprint, doc_ids, held out, tokens, texts' token counts) of each block of a task."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ids: list = []
    held: list[bool] = []
    bytes_ = 0

    def made():
        tokens, n = (np.concatenate(x) for x in zip(*found, strict=True))
        mark = int(mix(tokens + np.arange(len(tokens), dtype=np.uint64)).sum(dtype=np.uint64)) ^ len(n)
        return number, mark - (1 << 63), ids, np.array(held, bool), tokens, n

    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            found.append(_with_ends(*word_hashes(part.column("text"))))
            ids += part.column("doc_id").to_pylist()
            held += part.column("held_out").to_pylist()
            bytes_ += part.column("text").nbytes
            if bytes_ >= size:
                yield made()
                number, found, ids, held, bytes_ = number + 1, [], [], [], 0
    if found:
        yield made()


def _borders(parts: int) -> np.ndarray:
    return np.array([((1 << 64) // parts + 1) * i for i in range(parts)], np.uint64)


def _ask(parts: int, order: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, _, held, tokens, n in _blocks(batches, size):
            learnt, place = np.repeat(~held, n), offsets(n).astype(np.int32)
            sizes, packed, counted = np.zeros((order, parts), np.int64), [], []
            for m, x in enumerate(grams(tokens, n, order), 1):
                there = slice(None) if m < 3 else np.flatnonzero(place >= m - 2)
                keys, _, which = distinct(x[there])
                counts = np.bincount(which[learnt[there]], minlength=len(keys))
                at = np.append(np.searchsorted(keys, _borders(parts)), len(keys))
                sizes[m - 1] = np.diff(at)
                packed.append([pack_sorted(keys[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
                counted.append([pack(counts[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
            some = np.flatnonzero(sizes.any(axis=0)).tolist()
            yield pa.record_batch(
                [
                    pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([mark] * len(some), pa.int64()),
                    pa.array([sizes[:, p].tolist() for p in some], pa.list_(pa.int64())), pa.array([[x[p] for x in packed] for p in some], pa.list_(pa.binary())), pa.array([[x[p] for x in counted] for p in some], pa.list_(pa.binary())),
                ],
                names=["block", "part", "print", "sizes", "keys", "counts"],
            )

    return run


def _vocabulary(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's trained words and their count of tokens, by hash range; told in between where there are more than ``TASK_WORDS``."""
        words, tokens = np.zeros(0, np.uint64), 0

        def told():
            at = np.append(np.searchsorted(words, _borders(parts)), len(words))
            return pa.record_batch(
                [pa.array(range(parts), pa.int32()), pa.array([tokens] + [0] * (parts - 1), pa.int64()), pa.array(np.diff(at)), pa.array([pack_sorted(words[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["part", "tokens", "size", "keys"],
            )

        for batch in batches:
            for part in pieces(batch, "text"):
                h, n = _with_ends(*word_hashes(part.column("text")))
                own = h[np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), n)]
                words, tokens = np.union1d(words, own), tokens + len(own)
                if len(words) > TASK_WORDS:
                    yield told()
                    words, tokens = np.zeros(0, np.uint64), 0
        if tokens:
            yield told()

    return run


def _types(group: pa.Table) -> pa.Table:
    """Trained tokens and their types in one hash range."""
    words = [unpack_sorted(b, n) for b, n in zip(group.column("keys").to_pylist(), group.column("size").to_pylist(), strict=True)]
    return pa.table({"tokens": [sum(group.column("tokens").to_pylist())], "types": [len(np.unique(np.concatenate(words)))]})


def _answer(group: pa.Table) -> pa.Table:
    """The corpus counts of every key of one hash range, for each block in its own order."""
    sizes, blobs, own = (group.column(c).to_pylist() for c in ("sizes", "keys", "counts"))
    out: list[list[bytes]] = [[] for _ in sizes]
    for m in range(len(sizes[0])):
        flat = np.concatenate([unpack_sorted(b[m], s[m]) for b, s in zip(blobs, sizes, strict=True)])
        keys, _, which = distinct(flat)
        del flat
        total = np.zeros(len(keys), np.int64)
        stops = np.cumsum([s[m] for s in sizes])
        places = [which[b - s[m] : b] for b, s in zip(stops, sizes, strict=True)]
        for place, c in zip(places, own, strict=True):
            total[place] += unpack(c[m])  # a block's keys are distinct
        for row, place in zip(out, places, strict=True):
            row.append(pack(total[place]))
    return pa.table({"block": group.column("block"), "part": group.column("part"), "print": group.column("print"), "counts": pa.array(out, pa.list_(pa.binary()))})


def _sequences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block the texts as ranks of words, the most frequent word first, and the words' keys."""
        for number, mark, ids, held, tokens, n in _blocks(batches, size):
            keys, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
            by_rank = np.argsort(-times, kind="stable")
            rank = np.empty(len(keys), np.int64)
            rank[by_rank] = np.arange(len(keys))
            yield pa.record_batch(
                [
                    pa.array([number], pa.int64()), pa.array([mark], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([pack(n)], pa.binary()),
                    pa.array([len(keys)], pa.int64()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([pack(by_rank)], pa.binary()), pa.array([pack_ranks(rank[which])], pa.binary()),
                ],
                names=["block", "print", "doc_ids", "held", "sizes", "words", "keys", "by_rank", "ranks"],
            )

    return run


class Automaton:
    """States and arcs for the n-grams of some texts (tokens, texts' token counts).

    counts(m, keys) are the corpus counts of sorted distinct m-grams. State 0 is the root, 1 the start of
    a text; then come the contexts of one word, of two and so on. ``arc_at[d, i]`` is the arc that token i has
    after a context of d words, whether or not it was seen."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray, counts, total: int, types: int, texts: int, order: int = ORDER, mu: float = MU):
        start = np.cumsum(n) - n
        depth, fail_to, fail_weight = [np.array([0, 1], np.int8)], [np.zeros(2, np.int32)], [np.array([0.0, np.log10(mu / (texts + mu))])]
        seen, weight, to = [np.array([False])], [np.zeros(1)], [np.zeros(1, np.int32)]  # arc 0 is none
        self.arc_at = np.zeros((order, len(tokens)), np.int32)
        state_of = np.zeros(len(tokens), np.int32)  # the state of the context one word shorter that ends at each token
        before = prob = np.zeros(0)  # before each token the count of its context; its probability in the order below
        arcs, states = 1, 2
        for m, x in enumerate(grams(tokens, n, order), 1):
            there = slice(None) if m < 3 else np.flatnonzero(offsets(n) >= m - 2)
            keys, first, which = distinct(x[there])
            if m > 2:
                first = there[first]
            c, own = counts(m, keys), len(keys)
            del x, keys
            p = (c + 1) / (total + types + 1) if m == 1 else (c + mu * prob[first]) / (before[first] + mu)
            suffix = state_of[first]
            seen.append(c > 0 if m > 1 else np.ones(own, bool))
            weight.append(np.log10(p))
            self.arc_at[m - 1, there] = arcs + which
            arcs += own
            if m == order:
                to.append(suffix)
                break
            # the m-gram is a context itself; one that training never saw is no state: what ends in it ends in the longest one that is
            depth.append(np.full(own, m, np.int8))
            fail_to.append(suffix)
            fail_weight.append(np.log10(mu / (c + mu)))
            to.append(np.where(c > 0, states + np.arange(own, dtype=np.int32), suffix))
            states += own
            state_of[there] = to[-1][which]
            if m == 1:
                prob = np.empty(len(tokens))
            prob[there] = p[which]
            here = np.zeros(len(tokens))
            here[there] = c[which]
            before = np.zeros(len(tokens))
            before[1:] = here[:-1]
            if m == 1:
                before[start] = texts
            del here
        self.depth, self.fail_to, self.fail_weight = np.concatenate(depth), np.concatenate(fail_to), np.concatenate(fail_weight)
        self.seen, self.weight, self.to = np.concatenate(seen), np.concatenate(weight), np.concatenate(to)
        self.n, self.order = n, order

    def read(self) -> np.ndarray:
        """Each text's score: a traversal from left to right that carries a state, in all lanes at once."""
        lanes = -(-self.n // LANE)
        text = np.repeat(np.arange(len(self.n)), lanes)
        lane = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (np.cumsum(self.n) - self.n)[text]
        begin = start + lane * LANE
        end = np.minimum(begin + LANE, start + self.n[text])
        at = np.maximum(begin - (self.order - 1), start)
        state = np.where(at == start, 1, 0)
        score = np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            s, i, w = state[live], at[live], np.zeros(len(live))
            arc = self.arc_at[self.depth[s], i]
            lost = np.flatnonzero(~self.seen[arc])
            while len(lost):
                w[lost] += self.fail_weight[s[lost]]
                s[lost] = self.fail_to[s[lost]]
                arc[lost] = self.arc_at[self.depth[s[lost]], i[lost]]
                lost = lost[~self.seen[arc[lost]]]
            score[live] += np.where(i >= begin[live], w + self.weight[arc], 0.0)
            state[live] = self.to[arc]
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.bincount(text, weights=score, minlength=len(self.n))


def _traverse(total: int, types: int, texts: int, order: int, mu: float):
    def run(bags: pa.Table, replies: pa.Table) -> pa.Table:
        marks = set(bags.column("print").to_pylist()) | set(replies.column("print").to_pylist())
        if len(bags) != 1 or len(marks) != 1:
            raise ValueError("a block of texts was not read twice in the same order")
        bag, answers = bags.to_pylist()[0], replies.sort_by("part").column("counts").to_pylist()
        n = unpack(bag["sizes"])
        tokens = unpack_sorted(bag["keys"], bag["words"])[unpack(bag["by_rank"])[unpack_ranks(bag["ranks"])]]

        def counts(m: int, keys: np.ndarray) -> np.ndarray:
            found = np.concatenate([unpack(x[m - 1]) for x in answers])
            if len(found) != len(keys):
                raise ValueError("a block of texts was not read twice in the same order")
            return found

        automaton = Automaton(tokens, n, counts, total, types, texts, order, mu)
        starts, roots = np.cumsum(n) - n, automaton.arc_at[0]
        known = (automaton.to[roots] > 0).astype(np.int64)  # a word's arc from the root leads to its state if it was seen
        return pa.table({
            "doc_id": pa.array(bag["doc_ids"], pa.int64()), "held_out": pa.array(bag["held"], pa.bool_()), "n_tokens": pa.array(n),
            "n_known": pa.array(np.add.reduceat(known, starts)), "train_tokens": pa.array([total] * len(n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(automaton.weight[roots], starts)), "score": pa.array(automaton.read()),
        })

    return run


def score_texts(docs: DataFrame, divisor: int = 7, at: int = 2, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id) modulo ``divisor`` is not ``at`` (a null doc_id counts as
    held out); a row that repeats counts as often. Null texts are empty; an empty text is its end token
    alone. Scores are log10. With nothing to learn from, every token has the one unseen word's probability of 1."""
    if order < 2:
        raise ValueError("the automaton's order is 2 or more")
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), divisor, at).alias("held_out"))
    bytes_, texts = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.when(~F.col("held_out"), 1))).first()
    parts = max(LEAST_RANGES, -(-(bytes_ or 0) // range_bytes))
    words = rows.mapInArrow(_vocabulary(parts), VOCABULARY).groupBy("part").applyInArrow(_types, "tokens long, types long")
    total, types = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("types")).first())
    replies = rows.mapInArrow(_ask(parts, order, block_bytes), REQUEST).groupBy("part").applyInArrow(_answer, REPLY)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_sequences(block_bytes), TOKENS).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_traverse(total, types, texts, order, mu), out)


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


ORACLE = None
