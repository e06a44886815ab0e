"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One token of text between ASCII white space (Java pattern).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = spark.conf.get("spark.checkpoint.dir", None) or conf or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fernline-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For each open scratch(), the tables written inside it.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() writes inside are removed at the end, but for those written with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike an RDD checkpoint the copy is columnar, prunes columns, and has a size that the
    planner knows. Any executor can be lost afterwards without recomputing what went before.
    With ``keep`` the table outlives the scratch() it is written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fernline-{uuid.uuid4().hex}"
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(b: pa.RecordBatch, column: str, rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``most`` bytes in a text column; a row with more is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < b.num_rows:
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right"))
        last = max(first + 1, min(first + rows, last))
        yield b.slice(first, last - first)
        first = last


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written to the shared folder; the tables that it wrote on the way are removed."""
    with scratch(spark):
        return durable(build(), keep=True)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` itself is used only where the text is pure ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def id_text(col: Column) -> Column:
    """An id as text, the empty string for null."""
    return F.coalesce(col.cast("string"), F.lit(""))


def id_bucket(col: Column, n: int) -> Column:
    """crc32 of an id's text modulo ``n``; null ids count as the empty text."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(n)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (counted), else unmarked."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for joining decisions back to rows: the id and the text's digest, so that different texts of one id are told apart."""
    given = F.when(doc_id.isNotNull(), F.concat(F.lit("i"), doc_id.cast("string"))).otherwise(F.lit("n"))
    return F.concat(given, F.lit(":"), F.coalesce(F.sha2(text.cast("string"), 256), F.lit("")))
