"""Helpers shared by the training-data operators.

Texts travel to Python in Arrow batches.  ``slices`` cuts every batch by the
bytes of text it holds, so a task's memory follows a fixed budget and not the
length of the documents that happen to meet in a batch.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, and what is not in it.
SPACE = "\x20\x09-\x0d"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
SLICE_BYTES = 1 << 20


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, everything else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def words(text: str) -> list[str]:
    """Runs without ASCII white space, which is where bytes are split; other white space is part of a word."""
    found = text.encode("utf-8", "surrogatepass").split()
    return b"\n".join(found).decode("utf-8", "surrogatepass").split("\n") if found else []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``budget`` bytes of ``column``; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > budget:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "gristmill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` has written in this process; frames that read them end with them."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at files that outlive any executor, and what the plan above
    reads twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gristmill-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows of largest ``n``, at most ``limit`` of them: as many whole levels of its logarithm as fit.

    ``counts`` is read twice.  The driver sees one row for each level, so the
    bound needs no sort, and rows of equal ``n`` stand or fall together.
    """
    level = F.floor(F.log(n) / F.log(F.lit(1.01))).cast("int")
    held, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > limit:
            break
        least = row.level
    return counts.where(F.lit(False) if least is None else level >= least)
