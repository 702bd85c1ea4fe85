"""Positions on a stream: arrivals at stops, and scans merged as they come.

State is kept per work day: the ids already asked about, or the day's stops. Events of a day are handled in the
order of time within a trigger; late ones meet the state as it is.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.geo import metres
from ..operators.ledger import DAY
from ..operators.merge import STOP_SCHEMA, DayStops, _records

# Fixed values.
ARRIVED_M = 120.0
ARRIVAL_SCHEMA = "business_date date, stop_id long, ts timestamp_ntz, metres double"


def live(positions: DataFrame, days: DataFrame, pending_days: DataFrame) -> DataFrame:
    """Positions of open days that have pending stops."""
    return positions.join(days.where("status = 'open'").select(DAY), DAY, "left_semi").join(pending_days, DAY, "left_semi")


def arrivals(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Batch form: for each day and stop the first position less than ARRIVED_M away while it was the next pending one.

    ``targets``: business_date, stop_id, lat, lng, since, until (when the stop was the next one; one at a time). An as-of
    join: positions and targets of a day in one order of time, where each position looks back to the last target.
    """
    target = F.struct("stop_id", "lat", "lng", "until")
    none = F.lit(None)
    begun = targets.select(DAY, F.col("since").alias("at"), F.lit(0).alias("kind"), F.col("stop_id").cast("long").alias("tie"), target.alias("t"), none.cast("double").alias("lat"), none.cast("double").alias("lng"))
    seen = positions.select(DAY, F.col("ts").alias("at"), F.lit(1).alias("kind"), none.cast("long").alias("tie"), none.cast(begun.schema["t"].dataType).alias("t"), F.col("lat").cast("double"), F.col("lng").cast("double"))
    before = Window.partitionBy(DAY).orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = begun.unionByName(seen).withColumn("t", F.last("t", ignorenulls=True).over(before)).where("kind = 1 and t is not null and (t.until is null or at < t.until)")
    rows = rows.select(DAY, "t.stop_id", F.col("at").alias("ts"), metres(F.col("lat"), F.col("lng"), F.col("t.lat"), F.col("t.lng")).alias("metres")).where(F.col("metres") < ARRIVED_M)
    first = rows.groupBy(DAY, "stop_id").agg(F.min(F.struct("ts", "metres")).alias("f"))
    return first.select(DAY, "stop_id", "f.ts", "f.metres")


def arrival_stream(positions: DataFrame) -> DataFrame:
    """Stream form. ``positions``: business_date, ts, lat, lng and the next pending stop's stop_id, stop_lat, stop_lng.

    At most one row per stop and day, whatever the number of positions near it.
    """
    away = metres(F.col("lat"), F.col("lng"), F.col("stop_lat"), F.col("stop_lng"))
    close = positions.withColumn("metres", away).where(F.col("metres") < ARRIVED_M).select(DAY, F.col("stop_id").cast("long"), "ts", "metres")

    def ask(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["ts", "metres"], kind="stable")
        new = rows[~rows["stop_id"].isin(asked)].drop_duplicates("stop_id")
        state.update((sorted(asked | set(new["stop_id"].tolist())),))
        yield new[[DAY, "stop_id", "ts", "metres"]]

    return close.groupBy(DAY).applyInPandasWithState(ask, ARRIVAL_SCHEMA, "asked array<long>", "append", GroupStateTimeout.NoTimeout)


def merge_stream(scans: DataFrame) -> DataFrame:
    """Stops of every day that a trigger brought scans for, as they stand after it (update mode)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        day = DayStops(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["ts", "scan_id"], kind="stable")
        for scan in _records(rows.drop(columns=[DAY, "ts"])):
            day.merge(scan)
        state.update((json.dumps(day.stops),))
        yield day.table(key[0])

    return scans.groupBy(DAY).applyInPandasWithState(fold, STOP_SCHEMA, "stops string", "update", GroupStateTimeout.NoTimeout)
