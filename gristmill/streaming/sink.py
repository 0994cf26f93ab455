"""A sink that writes an entity only when its content has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def changed(new: DataFrame, shipped: DataFrame, entity: str) -> DataFrame:
    """The rows of ``new`` (entity, content) whose digest is not that of the entity's last row in ``shipped`` (entity, digest, version)."""
    last = shipped.groupBy(entity).agg(F.max_by("digest", "version").alias("_last"))
    told = new.select(entity, "content", F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))
    return told.join(last, entity, "left").where(~F.col("digest").eqNullSafe(F.col("_last"))).drop("_last")


def ship_changed(new: DataFrame, version: int, folder: str, entity: str = "entity") -> int:
    """Write to ``folder``/version=n what has changed since lower versions; how many rows.

    A version that is shipped again replaces its own part, so killing and
    repeating one leaves the folder as one whole run does.
    """
    spark = new.sparkSession
    schema = f"`{entity}` {new.schema[entity].dataType.simpleString()}, content string, digest string, version long"
    shipped = spark.read.schema(schema).parquet(folder).where(F.col("version") < version) if exists(spark, folder) else spark.createDataFrame([], schema)
    path = f"{folder}/version={version}"
    changed(new, shipped.select(entity, "digest", "version"), entity).write.mode("overwrite").parquet(path)
    return spark.read.schema(f"`{entity}` {new.schema[entity].dataType.simpleString()}, content string, digest string").parquet(path).count()
