"""The first-seen ledger over a stream of reads, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.ledger import PRUNE_SECONDS, SCHEMA, State, derive, pack, rows_of, step, unpack


def observe_stream(reads: DataFrame, late: str = "1 hour", version: str = "", of: Callable[[str], str | None] | None = None) -> DataFrame:
    """Updates of the ledger for a stream of (source, at, outcome, rows): the ledger of each source that a batch touched.

    The state of a source is its keys seen in the last two weeks, packed.  Once
    the stream's time, ``late`` behind the newest read, is two weeks past a
    source's last read, its state is dropped; reads behind that time do not
    begin a source.  Restarted from its checkpoint,
    the stream goes on from the packed state; with another ``version`` what was
    derived from the keys is worked out anew.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = unpack(bytes(held.get[0])) if held.exists else State()
        since = 0 if held.exists else held.getCurrentWatermarkMs() / 1000  # a state that was dropped is not begun again by late reads
        came = sorted(((int(at), outcome, rows) for f in frames for at, outcome, rows in zip(f["at"], f["outcome"], f["rows"]) if at >= since), key=lambda r: r[0])
        if not came:
            return
        for at, outcome, rows in came:
            step(state, at, None if rows is None else [(r["key"], r["ident"]) for r in rows], outcome)
        if of is not None:
            derive(state, version, of)
        held.update((pack(state),))
        ends = max(state.last_good or 0, came[-1][0]) + PRUNE_SECONDS
        held.setTimeoutTimestamp(max(ends * 1000, held.getCurrentWatermarkMs() + 1))
        yield rows_of(int(key[0]), state)

    timed = reads.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", late)
    return timed.groupBy("source").applyInPandasWithState(update, SCHEMA, "state binary", "update", GroupStateTimeout.EventTimeTimeout)


def slot_counts(events: DataFrame, late: str = "10 minutes", slot: str = "30 minutes") -> DataFrame:
    """Counts in fixed slots; events later than ``late`` behind the newest are dropped, and a slot comes out once it is closed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", slot).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("slot"), F.col("w.end").alias("slot_end"), "event_type", "n")
