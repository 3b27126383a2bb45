"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as the word-based operators define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a session with
    a local master (tests on one machine) may do without: a local folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or _local_dir()).rstrip('/')}/{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tapewright-")


_SCRATCH: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside, unless it keeps them, are deleted at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, compression: str = "zstd", outer: bool = False, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The table stays until its ``scratch`` (with ``outer``, the one around it) ends;
    without one, or with ``keep``, until the folder is cleared.  Shuffle files that
    the write needed go as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    lists = _SCRATCH[:-1] if outer else _SCRATCH
    if lists and not keep:
        lists[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *taken: Iterable[str]) -> str:
    """``name``, lengthened until no column in ``taken`` has it (in any case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator, size: int) -> Iterator:
    """Cut Arrow batches into slices of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


#: Bits of the bitmap that ``among`` sends out, 32,768 to a row of it.
MARK_BITS = 1 << 25


def among(df: DataFrame, h: str, marked: DataFrame, mark: str) -> DataFrame:
    """Rows of ``df`` whose hash ``h`` may be one of ``mark`` in ``marked``, before anything is shuffled.

    A bitmap of at most 4 MB is broadcast, whatever the tables; it lets all marked
    rows through, and of a million marks 3 % of the others.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(MARK_BITS)).cast("long")
    row, bits = fresh("row", df.columns), fresh("bits", df.columns)
    at = marked.select(place(mark).alias("at"))
    bitmap = at.groupBy(F.bitmap_bucket_number("at").alias(row)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits))
    bit = F.bitmap_bit_position(place(h))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn(row, F.bitmap_bucket_number(place(h))).join(F.broadcast(bitmap), row)
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*df.columns)
