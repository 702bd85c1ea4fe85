"""Keyed tables in folders of parquet: days, customers, settings, gazetteer packages, texts."""

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ledger import upsert
from .shared import shared_folder

# Fixed value: frames that are kept for another try.
RETRY_FRAMES = 6


def lookup(table: DataFrame, key: str, value: Any) -> DataFrame:
    """The row of a key: no row if it is missing. The filter reaches the parquet scan."""
    return table.where(F.col(key) == F.lit(value))


def newest_first(days: DataFrame) -> DataFrame:
    return days.orderBy(F.desc("business_date"))


def setting(settings: DataFrame, name: str, default: Any) -> DataFrame:
    """(value): the stored JSON; the default only where the row is missing, so a stored null stays null."""
    asked = settings.sparkSession.range(1).select(F.lit(name).alias("key"))
    found = asked.join(settings.select("key", "value", F.lit(True).alias("present")), "key", "left")
    return found.select("key", F.when(F.col("present"), F.col("value")).otherwise(F.lit(json.dumps(default))).alias("value"))


def with_setting(settings: DataFrame, name: str, value: Any) -> DataFrame:
    change = settings.sparkSession.range(1).select(F.lit(name).alias("key"), F.lit(json.dumps(value)).alias("value"), F.lit(1).alias("at"))
    return upsert(settings, change, ["key"], "at")


def depot(value: Column, default_lat: float, default_lng: float) -> Column:
    """The stored depot, if its coordinates are numbers; else the default one."""
    kept = F.from_json(value, "lat double, lng double, name string")
    return F.when(kept["lat"].isNotNull() & kept["lng"].isNotNull(), kept).otherwise(F.struct(F.lit(default_lat).alias("lat"), F.lit(default_lng).alias("lng"), F.lit(None).cast("string").alias("name")))


def write_gazetteer(gazetteer: DataFrame, folder: str) -> None:
    """A partition per district, so a reader opens only the districts that its texts name."""
    gazetteer.write.mode("overwrite").partitionBy("oid").parquet(folder)


def read_districts(spark: SparkSession, folder: str, oids: DataFrame) -> DataFrame:
    """The packages of the given districts; partitions of others are pruned when the query runs."""
    return spark.read.parquet(folder).join(oids.select("oid").distinct(), "oid")


def pasted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as documents."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photo files in order of their names: frame_id, file, kilobytes, content. The files are listed without being read until ``content`` is."""
    found = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    order = Window.orderBy("path")  # a handful of files
    return found.select(F.concat(F.lit("k"), F.row_number().over(order).cast("string")).alias("frame_id"), name.alias("file"), F.floor(F.col("length") / 1024 + 0.5).alias("kilobytes"), "content")


def frames_to_retry(frames: DataFrame, key: str, order: str, most: int = RETRY_FRAMES) -> DataFrame:
    """The last frames of each key that are kept for another try."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return frames.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def own_folder(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


class Store:
    """Tables under one folder. A write makes a new version beside the old one and then points to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in names if fs.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def create(self, name: str, schema: str) -> None:
        if not self._versions(name):
            self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}/v0")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self._versions(name)[-1]}")

    def _claim(self, name: str) -> int:
        """The next version's number, which no other writer gets: its claim is a file that only one can create."""
        context = self.spark.sparkContext
        versions = self._versions(name)
        number = versions[-1] + 1 if versions else 0
        while True:
            claim = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{name}-{number}")
            if claim.getFileSystem(context._jsc.hadoopConfiguration()).createNewFile(claim):
                return number
            number += 1

    def write(self, name: str, table: DataFrame) -> None:
        """A version is seen once it is whole; of several writers, the one with the greatest number is last."""
        table.write.parquet(f"{self.folder}/{name}/v{self._claim(name)}")
