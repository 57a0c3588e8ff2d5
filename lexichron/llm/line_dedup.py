"""Lines that many documents share are dropped everywhere.

Each document's lines are normalised and hashed, the distinct hashes of a document are
counted over all documents (added up within each Arrow batch before the shuffle, so a line
that a third of the documents hold is no hot spot), and lines over the threshold go; what
stays is joined again in the order of positions.

While the frequent hashes are at most ``BROADCAST_LINES`` (8 bytes each; counted first), they
are shipped and documents are rewritten where they are read: no text is shuffled. Beyond
that, exploded lines are joined by hash and put together again by document and position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, only, table
from ._tokens import pieces

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_FOLD = {i: i + 32 for i in range(65, 91)}
BROADCAST_LINES = 4_000_000


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_FOLD)


def _hash(key: str) -> int:
    """64 bits of the key's UTF-8 bytes, signed; two of a billion different lines meet with odds of about 3 %, two given ones with 2**-64."""
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                all_of: dict[int, int] = {}
                for text in part.column("text").to_pylist():
                    keys = {k for k in map(line_key, (text or "").split("\n")) if len(k) >= least}
                    for h in {_hash(k) for k in keys}:
                        all_of[h] = all_of.get(h, 0) + 1
                yield pa.record_batch([pa.array(list(all_of), pa.int64()), pa.array(list(all_of.values()), pa.int64())], names=["line", "n"])

    return run


def _rewrite(frequent: bytes, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = set(np.frombuffer(frequent, np.int64).tolist())
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                kept, lines, dropped = [], [], []
                for text in part.column("text").to_pylist():
                    own = (text or "").split("\n")
                    stay = [x for x in own if len(k := line_key(x)) < least or _hash(k) not in gone]
                    kept.append("\n".join(stay))
                    lines.append(len(own))
                    dropped.append(len(own) - len(stay))
                yield pa.record_batch([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])

    return run


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 16 << 20):
                out: tuple[list, ...] = ([], [], [], [], [])
                for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                    for i, x in enumerate((text or "").split("\n")):
                        k = line_key(x)
                        for c, v in zip(out, (row, doc, i, x, _hash(k) if len(k) >= least else None), strict=True):
                            c.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["row", "doc_id", "pos", "text", "line"])

    return run


def drop_shared_lines(docs: DataFrame, threshold: int = 10, least: int = 1, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) for every row of ``docs`` (doc_id, text).

    Every row is a document, also where rows or ids repeat or are null. A null or empty text is one empty
    line. Keys shorter than ``least`` code points never count and their lines stay."""
    rows = only(docs, "doc_id", "text")
    counted = rows.mapInArrow(_count(least), "line long, n long").groupBy("line").agg(F.sum("n").alias("n"))
    frequent = materialise(counted.where(F.col("n") >= threshold).select("line"))
    if frequent.count() <= broadcast_lines:
        lines = np.sort(np.array([r.line for r in frequent.toLocalIterator()], np.int64))
        return rows.mapInArrow(_rewrite(lines.tobytes(), least), "doc_id long, kept_text string, n_lines long, n_dropped long")
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()))  # an id for each row, fixed by the checkpoint
    each = numbered.mapInArrow(_explode(least), "row long, doc_id long, pos int, text string, line long")
    marked = each.join(frequent.withColumn("gone", F.lit(True)), "line", "left")
    stays = F.filter(F.array_sort(F.collect_list(F.struct("pos", "text", F.col("gone").isNull().alias("stays")))), lambda x: x["stays"])
    return marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(stays, lambda x: x["text"]), "\n").alias("kept_text"), F.count("*").alias("n_lines"), F.count("gone").alias("n_dropped")).drop("row")


def op8_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
e AS (SELECT doc_id, p, x[p] AS line,
        translate(trim(x[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, x, unnest(generate_series(1, len(x))) AS p FROM l)),
f AS (SELECT k FROM e WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN f USING (k) GROUP BY doc_id
"""
