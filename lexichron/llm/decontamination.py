"""Benchmark items inside documents: MinHash containment search by size partitions.

An item is a small set of shingles, a document may be a large one, and their Jaccard
similarity is then tiny. So items are partitioned by size (powers of two) and each
partition looks at a document through windows of twice its size, advanced by half a
window; the similarity of an item and the window that holds it is then above a quarter,
however long the document. An item and a window are a candidate pair if one of ``HASHES``
minima agrees (bands of one row): an item that shares a share c of its shingles with the
text, in one window or scattered over many, is missed with odds of about
exp(-HASHES * c / 4). Items of at most ``EXACT`` shingles are looked up instead: an item that
is held leaves out few of its shingles, so one of any few more is in the text, and those that
the fewest items share are kept as keys. None of these is missed. Every candidate is verified on whole sets: shared shingles against
the item's shingles. No text is shuffled; the items are the broadcast side, in blocks of at most
``BLOCK_ITEMS`` different sets, one block after another: the documents are scanned once for each block
and its links written before the next one is read, so the driver never holds more than one block.
Items of equal sets are searched for as one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, materialise, only, stored, table
from ._tokens import pieces, shingles, word_hashes

HASHES = 64
#: Items of up to so many shingles are found by their shingles themselves, not by minima.
EXACT = 16
BLOCK_ITEMS = 20_000
#: Shingles of the items of one block at most, so that an index stays below about 100 MB; a single longer item is a block of its own.
BLOCK_SHINGLES = 4_000_000


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(411)
    return rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class Index:
    """Keys of the small items; minima of the others, by size partition and permutation."""

    def __init__(self, ids: list[list[int]], sets: list[np.ndarray], percent: int = 80):
        odd, shift = _permutations()
        self.ids, self.sets = ids, sets
        self.keys, self.owners = self._keys([i for i, s in enumerate(sets) if len(s) <= EXACT], percent)
        classes = [0 if len(s) <= EXACT else int(np.ceil(np.log2(len(s)))) for s in sets]
        #: log2 of the partition's size -> for each permutation the sorted minima and the items that have them
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c in sorted(set(classes) - {0}):
            own = np.array([i for i, x in enumerate(classes) if x == c])
            self.parts[c] = []
            for p in range(HASHES):
                least = np.array([(((sets[i] >> np.uint64(32)).astype(np.uint32) ^ shift[p]) * odd[p]).min() for i in own], np.uint32)
                order = np.argsort(least, kind="stable")
                self.parts[c].append((least[order], own[order]))

    def _keys(self, small: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingles and the small items they stand for: of each item as many that no text with ``percent`` of them lacks all."""
        if not small:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        every, shared = np.unique(np.concatenate([self.sets[i] for i in small]), return_counts=True)
        keys, owners = [], []
        for i in small:
            own = self.sets[i]
            need = min(max(1, -(-percent * len(own) // 100)), len(own))
            keys.append(own[np.argsort(shared[np.searchsorted(every, own)], kind="stable")[: len(own) - need + 1]])
            owners.append(np.full(len(keys[-1]), i))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.concatenate(owners)[order]

    def looked_up(self, s: np.ndarray, stops: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which the text holds a key of the small item."""
        first = np.searchsorted(self.keys, s)
        hits = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == s) if len(self.keys) else np.zeros(0, np.int64)
        where = np.unique(np.stack([np.searchsorted(stops, hits, "right"), first[hits]]), axis=1)
        ends = np.searchsorted(self.keys, self.keys[where[1]], "right") if len(hits) else where[1]
        return {(d, i) for d, a, b in zip(*where.tolist(), ends.tolist(), strict=True) for i in self.owners[a:b].tolist()}

    def candidates(self, s: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which the text holds a key of the item, or a window of it and the item agree in a minimum."""
        odd, shift = _permutations()
        x = (s >> np.uint64(32)).astype(np.uint32)
        stops = np.cumsum(counts)
        found = self.looked_up(s, stops)
        for c, minima in self.parts.items():
            step = 1 << c  # half a window: a window is two steps that follow each other
            steps = -(-counts // step)
            owner = np.repeat(np.arange(len(counts)), steps)
            if not len(owner):
                continue
            at = np.repeat(stops - counts, steps) + (np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)) * step
            pair = np.append(owner[:-1] == owner[1:], False)
            for p, (least, items) in enumerate(minima):
                v = np.minimum.reduceat((x ^ shift[p]) * odd[p], at)
                v[pair] = np.minimum(v[pair], np.append(v[1:], 0).astype(np.uint32)[pair])
                place = np.minimum(np.searchsorted(least, v), len(least) - 1)
                for w in np.flatnonzero(least[place] == v).tolist():
                    j = int(place[w])
                    while j < len(least) and least[j] == v[w]:
                        found.add((int(owner[w]), int(items[j])))
                        j += 1
        return found


def _search(index: Index, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s, counts = shingles(*word_hashes(part.column("text")), k)
                stops = np.cumsum(counts)
                rows: list[tuple[int, int, int, int]] = []
                sets: dict[int, np.ndarray] = {}
                for d, i in sorted(index.candidates(s, counts)):
                    if d not in sets:
                        sets = {d: np.unique(s[stops[d] - counts[d] : stops[d]])}
                    item, own = index.sets[i], sets[d]
                    place = np.minimum(np.searchsorted(own, item), len(own) - 1)
                    shared = int((own[place] == item).sum())
                    if 100 * shared >= percent * len(item):
                        rows += [(d, x, len(item), shared) for x in index.ids[i]]
                row, *columns = (pa.array([r[c] for r in rows], pa.int64()) for c in range(4))
                yield pa.record_batch([part.column("doc_id").take(row), *columns], names=["doc_id", "item_id", "item_shingles", "shared"])

    return run


def _blocks(items: DataFrame, k: int, percent: int) -> Iterator[Index]:
    """Items with words, one block of bounded size after another; read as an iterator, never all at once."""
    found: dict[bytes, tuple[list[int], np.ndarray]] = {}
    size = 0
    for row in items.where("item_id is not null").select("item_id", "text").distinct().toLocalIterator():
        s, n = shingles(*word_hashes(pa.array([row.text], pa.string())), k)
        own = np.unique(s)
        key = hashlib.sha256(own.tobytes()).digest()
        if n[0] and key in found:
            found[key][0].append(row.item_id)
        elif n[0]:
            if found and (len(found) >= BLOCK_ITEMS or size + len(own) > BLOCK_SHINGLES):
                yield Index(*map(list, zip(*found.values(), strict=True)), percent)
                found, size = {}, 0
            found[key] = ([row.item_id], own)
            size += len(own)
    if found:
        yield Index(*map(list, zip(*found.values(), strict=True)), percent)


LINK = "doc_id long, item_id long, item_shingles long, shared long"


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): every document that holds at least
    ``percent`` of the distinct ``k``-word shingles of an item.

    Words are ASCII-lower-cased. A text of fewer than ``k`` words has its whole sequence as the
    one shingle, so such an item matches such a text as a whole only; items and texts without
    words (null, empty) match nothing. Rows that repeat in ``docs`` or ``items`` count once; an item_id with several
    texts is found by each and counts the one of which the most is shared; a null doc_id is a document like any other."""
    texts = only(docs, "doc_id", "text")
    parts = [materialise(texts.mapInArrow(_search(index, k, percent), LINK)) for index in _blocks(items, k, percent)]
    found = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], LINK)
    links = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "item_shingles")).alias("x")).select("doc_id", "item_id", "x.item_shingles", "x.shared")
    return links.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows that hold no item, in all their columns; each row by its own text, whatever its doc_id (null, repeated)."""
    row = fresh(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    held = contained_items(numbered.select(F.col(f"`{row}`").alias("doc_id"), "text"), items, k, percent).select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(held, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') || CASE WHEN len(w) < 5 THEN '|' ELSE '' END AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
s AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 4], ' ') || CASE WHEN len(w) < 5 THEN '|' ELSE '' END AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, shared, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE 100 * shared >= 80 * item_shingles
"""
