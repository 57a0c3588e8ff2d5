"""What the operators of this subpackage share: tables, lineage cuts, label splits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``. Only where that is
    unset and all runs in this one process (tests) a temporary folder is made; else this fails."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: for whole texts, which take less disk so than in a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers and texts as literals of the plan, so that no Python rows are shipped. ``rows`` is not empty."""
    fields = [f.split() for f in schema.split(", ")]

    def literal(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if x is None else f"{x!r}D" if isinstance(x, float) else str(x)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    columns = ", ".join(f"CAST(col{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(fields, 1))
    return spark.sql(f"SELECT {columns} FROM VALUES {body}")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's text, modulo ``divisor``; the split of labelled and unseen rows."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor))


def held_out(key: Column, divisor: int = 5, at: int = 0) -> Column:
    """Whether a row is kept from learning. A null key is learnt from never: it is held out."""
    return F.coalesce(remainder(key, divisor) == at, F.lit(True))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the caller can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
