"""Streams with state that ends: live positions, arrivals of a day that closes at 04:00, and the last photos of a day.

State is kept per work day in a state store that spills to disk. Arrivals hold the day's current target and the ids already asked
about; a timer at the day's end (04:00 of the next date, in event time) says that the day has closed and clears all of it, so state
doesn't grow with the days. Photos hold the last few frames for another try, first in, first out.

Rows of a day are handled in the order of time within a trigger. Rows later than the watermark are dropped by Spark. Rows
without a day or time take no part.
"""

import datetime as dt
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import EARTH_M
from ..operators.ledger import DAY
from ..sources.shared import shared_folder
from ..sources.store import RETRY_FRAMES
from .arrivals import ARRIVED_M

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hour at which a work day ends.
DAY_END = 4
EVENTS = "business_date date, kind string, stop_id long, ts timestamp_ntz, metres double"
FRAMES = "business_date date, frame string, status string"


def as_stream(table: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A table's rows as they would arrive in files of the shared folder; ``files``: so many in a trigger, all by default."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    table.write.parquet(path)
    reader = spark.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Everything that the stream has now, written to a table under ``path`` with its checkpoint; a run after a stop goes on from there."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def live_stream(positions: DataFrame, days: DataFrame, pending: DataFrame) -> DataFrame:
    """Positions, as they come, of days that are open and have pending stops (both tables as they stand)."""
    followed = days.where("status = 'open'").select(DAY).join(pending.select(DAY).distinct(), DAY, "left_semi")
    return positions.withWatermark("ts", "1 hour").join(followed, DAY, "left_semi")


class _Arrivals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.target = handle.getValueState("target", "stop_id long, lat double, lng double, until timestamp_ntz")
        self.asked = handle.getListState("asked", "stop_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day = key[0]
        if not self.target.exists() and not self.asked.exists():
            end = dt.datetime.combine(day + dt.timedelta(days=1), dt.time(DAY_END), dt.UTC)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        held = self.target.get() if self.target.exists() else None
        asked = {r[0] for r in self.asked.get()} if self.asked.exists() else set()
        out, new = [], []
        come = pd.concat(list(rows)).sort_values(["at", "kind", "stop_id"], kind="stable")
        for r in come.itertuples(index=False):
            if r.kind == 0:
                held = (int(r.stop_id), r.lat, r.lng, None if pd.isna(r.until) else r.until)
            elif held is not None and held[0] not in asked and (held[3] is None or r.at < pd.Timestamp(held[3])):
                away = _away(r.lat, r.lng, held[1], held[2])
                if away < ARRIVED_M:
                    asked.add(held[0])
                    new.append((held[0],))
                    out.append((day, "arrived", held[0], r.at, away))
        if held is not None:
            self.target.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in held))
        if new:
            self.asked.appendList(new)
        yield _table(out, EVENTS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.target.clear()
        self.asked.clear()
        end = dt.datetime.combine(key[0] + dt.timedelta(days=1), dt.time(DAY_END))
        yield _table([(key[0], "closed", None, end, None)], EVENTS)

    def close(self) -> None:
        pass


def _away(lat1: float, lng1: float, lat2: float | None, lng2: float | None) -> float:
    if any(v is None or math.isnan(v) for v in (lat1, lng1, lat2, lng2)):
        return math.inf
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    for c in schema.split(", "):
        name, kind = c.split()
        out[name] = out[name].astype({"date": "object", "string": "object", "long": "Int64", "double": "float64"}.get(kind, "datetime64[us]"))
    return out


def arrival_events(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """(business_date, kind, stop_id, ts, metres): ``arrived``, once per stop, at the first position less than ARRIVED_M from
    the stop that is the next one; ``closed``, once the watermark has passed 04:00 of the next date.

    ``positions`` (stream): business_date, ts, lat, lng; ``targets`` (stream): business_date, stop_id, lat, lng, since, until.
    """
    zoned = lambda c: F.col(c).cast("timestamp")
    seen = positions.select(DAY, zoned("ts").alias("event_ts"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("stop_id"), F.col("lat").cast("double"), F.col("lng").cast("double"), F.lit(None).cast("timestamp_ntz").alias("until"))
    begun = targets.select(DAY, zoned("since").alias("event_ts"), F.col("since").alias("at"), F.lit(0).alias("kind"), F.col("stop_id").cast("long"), F.col("lat").cast("double"), F.col("lng").cast("double"), "until")
    both = begun.unionByName(seen).where(f"{DAY} is not null and at is not null").withWatermark("event_ts", "1 hour")
    return both.groupBy(DAY).transformWithStateInPandas(_Arrivals(), EVENTS, "Append", "EventTime")


class _Frames(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", "frame string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [r[0] for r in self.frames.get()] if self.frames.exists() else []
        new = pd.concat(list(rows)).sort_values("frame", kind="stable")["frame"].tolist()
        every = held + new
        kept = every[-self.most :]
        self.frames.put([(f,) for f in kept])
        gone = every[: -self.most] if len(every) > self.most else []
        yield _table([(key[0], f, "evicted") for f in gone] + [(key[0], f, "kept") for f in kept if f in set(new)], FRAMES)

    def close(self) -> None:
        pass


def retry_frames(photos: DataFrame, most: int = RETRY_FRAMES) -> DataFrame:
    """(business_date, frame, status): ``kept`` when a frame comes that is held for another try, ``evicted`` when more than ``most`` of its day have come since.

    ``photos`` (stream): business_date, frame. A day holds its last ``most`` frames, no others; frames that come together come by name.
    """
    return photos.where(f"{DAY} is not null").groupBy(DAY).transformWithStateInPandas(_Frames(most), FRAMES, "Append", "None")


def photo_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(business_date, frame, kilobytes, content): photo files of ``folder``/business_date=.../shot=... as they come."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    of = lambda name: F.nullif(F.regexp_extract("path", rf"{name}=([^/]+)", 1), F.lit(""))
    return files.select(of(DAY).cast("date").alias(DAY), F.concat(F.lit("shot "), of("shot")).alias("frame"), F.floor(F.col("length") / 1024 + 0.5).alias("kilobytes"), "content")

