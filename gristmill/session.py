"""Tables of a data folder, as DataFrames."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Every table as a temporary view of its name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "gristmill-checkpoints")
    return folder.rstrip("/")


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder of what ``build`` writes under ``name``, once for each application; its tables outlive a lost executor."""
    key = spark.sparkContext.applicationId, name
    if key not in _stored:
        path = f"{shared_folder(spark)}/gristmill-stored-{uuid.uuid4().hex}"
        build(path)
        _stored[key] = path
    return _stored[key]
