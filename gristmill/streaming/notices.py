"""Notices that go out once, and products remembered for some hours, over streams.

``send_once`` is the body of a ``foreachBatch``: what it writes for a batch
depends on the candidates and on the log of other batches alone, and a batch
that runs again overwrites its own part of the log.  So a batch that is killed
and repeated sends nothing twice and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.streaming.sink import exists

RISE = 20
MOST_A_DAY = 4


def digest(*columns: str) -> Column:
    """A name for what a notice says."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def quiet(minute: Column, begin: Column, end: Column) -> Column:
    """Whether a minute of the day lies in quiet hours, which may reach over midnight; none where begin and end are equal."""
    return F.when(begin <= end, (minute >= begin) & (minute < end)).otherwise((minute >= begin) | (minute < end))


def due(candidates: DataFrame, sent: DataFrame, keys: list[str], rise: int = RISE, most: int = MOST_A_DAY) -> DataFrame:
    """The candidates (keys, at, percent) to send: the first of a key, then each that lies ``rise`` points over the last one sent, at most ``most`` a key.

    ``sent`` (keys, at, percent) is what went out earlier; each key's last row
    and count are taken from it, so the log's length does not matter.  A key's
    candidates are folded in order of time; equal times go by percent.
    """
    before = sent.groupBy(*keys).agg(F.max_by("percent", "at").alias("_last"), F.count("*").cast("int").alias("_n"))
    listed = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "percent"))).alias("_all"))
    joined = listed.join(before, keys, "left")
    empty = F.filter("_all", lambda c: F.lit(False))
    start = F.struct(F.col("_last").alias("last"), F.coalesce("_n", F.lit(0)).alias("n"), empty.alias("out"))

    def folded(held: Column, c: Column) -> Column:
        goes = (held["n"] < most) & (held["last"].isNull() | (c["percent"] >= held["last"] + rise))
        return F.struct(
            F.when(goes, c["percent"]).otherwise(held["last"]).alias("last"), (held["n"] + goes.cast("int")).alias("n"), F.when(goes, F.concat(held["out"], F.array(c))).otherwise(held["out"]).alias("out")
        )

    return joined.select(*keys, F.inline(F.aggregate("_all", start, folded)["out"]))


def send_once(candidates: DataFrame, batch: int, log: str, keys: list[str], send: Callable[[DataFrame], None] | None = None, rise: int = RISE, most: int = MOST_A_DAY) -> None:
    """Write what is due of a batch to its own part of ``log``, and hand that part to ``send``.

    ``send`` gets each row with a digest of its content, by which a receiver
    outside can tell a repeated delivery.
    """
    spark = candidates.sparkSession
    path = f"{log}/batch={batch}"
    columns = [*keys, "at", "percent"]
    schema = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in columns)
    earlier = spark.read.schema(f"{schema}, digest string, batch long").parquet(log).where(F.col("batch") != batch).select(*columns) if exists(spark, log) else spark.createDataFrame([], schema)
    due(candidates.select(*columns), earlier, keys, rise, most).withColumn("digest", digest(*columns)).write.mode("overwrite").parquet(path)
    if send is not None:
        send(spark.read.parquet(path))


def product_log(products: DataFrame, hours: int = 30) -> DataFrame:
    """A stream of products (key, zones, sent, withdraws, seen), each once for ``hours`` after it was last new.

    A product is what it says: the same key, zones, moment and kind again is a
    repeat and is dropped while it is remembered; later, it is a product anew.
    """
    return products.withWatermark("seen", f"{hours} hours").dropDuplicatesWithinWatermark(["key", "zones", "sent", "withdraws"])


def stood_at(products: DataFrame, moments: DataFrame, hours: int = 30) -> DataFrame:
    """(moment, key, zone, sent, ends): what stood at each moment, by the products (key, zone, sent, start, end, withdraws, last_seen) sent by then.

    For each key and zone the newest product counts, and a withdrawal of the
    same moment comes first; what left the feed before the moment ends when it
    was last seen.  Products not seen for ``hours`` are forgotten.  Products
    and moments are one ordered stream for each key and zone, so no pair of
    them is made; ``moments`` are few and stand beside each key and zone.
    """
    by = Window.partitionBy("key", "zone").orderBy("sent", F.desc("side"), F.desc("withdraws")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = products.select("key", "zone", "sent", F.lit(1).alias("side"), "withdraws", F.struct("sent", "start", "end", "withdraws", "last_seen").alias("p"))
    asked = products.select("key", "zone").distinct().join(F.broadcast(moments.select("moment").distinct()))
    asked = asked.select("key", "zone", F.col("moment").alias("sent"), F.lit(0).alias("side"), F.lit(False).alias("withdraws"), F.lit(None).cast(told.schema["p"].dataType).alias("p"))
    newest = told.unionByName(asked).withColumn("held", F.last("p", ignorenulls=True).over(by)).where("side = 0 AND held IS NOT NULL AND NOT held.withdraws")
    horizon = F.col("held.last_seen") >= F.col("sent") - F.expr(f"interval {hours} hours")
    ends = F.when(F.col("held.last_seen") < F.col("sent"), F.least("held.end", "held.last_seen")).otherwise(F.col("held.end"))
    return newest.where(horizon).select(F.col("sent").alias("moment"), "key", "zone", F.col("held.sent").alias("sent"), F.col("held.start").alias("start"), ends.alias("ends"))
