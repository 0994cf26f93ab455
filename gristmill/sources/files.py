"""Sources and sinks: delimited and JSON text, feature collections, Parquet with an edition.

Every reader takes a path that Spark reads and a schema, and never infers one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "type string, id string, geometry string, properties map<string,string>"


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "|", header: bool = True, where: Column | None = None) -> DataFrame:
    """A table of text columns, so that leading zeros stay; ``where`` is applied in the reading stage."""
    out = spark.read.options(sep=sep, header=header, mode="FAILFAST", emptyValue="", nullValue="\0").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return out if where is None else out.where(where)


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.options(sep=sep, header=True, emptyValue="", nullValue="").mode("overwrite").csv(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of the collections under ``path``: id, geometry as JSON text, properties as a map."""
    found = spark.read.option("wholetext", True).text(path)
    collection = F.from_json("value", f"struct<features:array<struct<{FEATURE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>>".replace("type:string", "type:string"))
    return found.select(F.explode(collection["features"]).alias("f")).select("f.id", "f.geometry", "f.properties")


def write_feature_lines(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    """One point feature in a line."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    df.select(line).write.mode("overwrite").text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Keys in order of name; numbers that JSON has no form for are refused."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(F.isnan(name), F.raise_error(F.lit(f"{name}: not a number"))).otherwise(F.col(name)))
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def tied(rows: DataFrame, reads: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the read they came in, and rows of no read."""
    return rows.join(reads, keys), rows.join(reads, keys, "left_anti")


def write_edition(df: DataFrame, path: str, edition: str) -> None:
    """Parquet under a folder named by its edition, so that readers of another edition see none of it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/edition={edition}")


def read_edition(spark: SparkSession, path: str, edition: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("edition") == edition).drop("edition")


def contract(df: DataFrame) -> str:
    """The schema as JSON, keys in order."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True)


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule of a contract."""
    sums = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])
    return sums.select(F.inline(pairs))
