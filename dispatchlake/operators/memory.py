"""The customers' address memory: what deliveries teach, and how scans use it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import full, phone_key

# Fixed values.
PARTS = ("district", "quarter", "road", "door", "flat", "floor")
USE_BELOW, CORRECTED_CONFIDENCE, LEARNED_CONFIDENCE = 70, 100, 85
FROM_MEMORY = ("Adres hafızadan geldi — bu müşteriye daha önce ", " kez gidilmiş")


def learn(deliveries: DataFrame) -> DataFrame:
    """Memory rows from a whole history of deliveries (phone, name, parts, lat, lng, confidence, corrected, ts, stop_id)."""
    return upsert(None, deliveries)


def upsert(memory: DataFrame | None, deliveries: DataFrame) -> DataFrame:
    """The memory after more deliveries, all of them later than those that it has learned from.

    Once a delivery was corrected by hand, only corrected ones change the address, in order of time. The set form
    of the rule: aggregations only, so a phone with any number of deliveries is combined map-side.
    """
    have = [c for c in PARTS if c in deliveries.columns]
    rows = deliveries.withColumn("phone_key", phone_key(F.col("phone"))).where("phone_key is not null and lat is not null")
    at = F.struct("ts", "stop_id")
    first = rows.groupBy("phone_key").agg(F.min(F.when(F.col("corrected"), at)).alias("since"))
    if memory is not None:
        first = first.join(memory.select("phone_key", F.col("corrected").alias("was")), "phone_key", "left")
    was = F.coalesce("was", F.lit(False)) if memory is not None else F.lit(False)
    rows = rows.join(first.withColumn("was", was), "phone_key").withColumn("at", at)
    may = F.col("corrected") | (~F.col("was") & (F.col("since").isNull() | (F.col("at") < F.col("since"))))
    new = rows.groupBy("phone_key").agg(
        F.max_by("name", F.when(full(F.col("name")).isNotNull(), F.col("at"))).alias("name"),
        *[F.max_by(c, F.when(may & full(F.col(c)).isNotNull(), F.col("at"))).alias(c) for c in have],
        F.max_by(F.struct("lat", "lng", "confidence"), F.when(may, F.col("at"))).alias("p"),
        F.bool_or("corrected").alias("corrected"),
        F.count("*").alias("deliveries"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    ).select("phone_key", "name", *have, "p.lat", "p.lng", "p.confidence", "corrected", "deliveries", "first_seen", "last_seen")
    if memory is None:
        return new
    both = memory.alias("m").join(new.alias("n"), "phone_key", "full")
    pick = {c: F.coalesce(f"n.{c}", f"m.{c}") for c in ("name", *have, "last_seen")}
    pick |= {c: F.when(F.col("n.lat").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"m.{c}")) for c in ("lat", "lng", "confidence")}
    pick |= {"corrected": F.coalesce("m.corrected", F.lit(False)) | F.coalesce("n.corrected", F.lit(False)), "deliveries": F.coalesce("m.deliveries", F.lit(0)) + F.coalesce("n.deliveries", F.lit(0)), "first_seen": F.coalesce("m.first_seen", "n.first_seen")}
    return both.select("phone_key", *[pick.get(c, F.col(f"m.{c}")).alias(c) for c in memory.columns if c != "phone_key"])


def recall(scans: DataFrame, memory: DataFrame) -> DataFrame:
    """Scans with a phone and a confidence below 70 take over a remembered address with coordinates, and a message in place of their warnings."""
    m = memory.where("lat is not null").select("phone_key", *[F.col(c).alias(f"m_{c}") for c in ("district", "quarter", "road", "door", "flat", "lat", "lng", "corrected", "deliveries")])
    rows = scans.withColumn("phone_key", phone_key(F.col("phone"))).join(m, "phone_key", "left")
    hit = F.col("m_lat").isNotNull() & (F.coalesce("confidence", F.lit(0)) < USE_BELOW)
    learned = F.greatest(F.coalesce("confidence", F.lit(0)), F.when(F.col("m_corrected"), CORRECTED_CONFIDENCE).otherwise(LEARNED_CONFIDENCE))
    message = F.array(F.concat(F.lit(FROM_MEMORY[0]), F.col("m_deliveries").cast("string"), F.lit(FROM_MEMORY[1])))
    warnings = F.col("warnings") if "warnings" in scans.columns else F.lit(None).cast("array<string>")
    out = {c: F.when(hit, F.col(f"m_{c}")).otherwise(F.col(c)) for c in ("district", "quarter", "road", "door", "lat", "lng")}
    out |= {"flat": F.when(hit, F.coalesce(full(F.col("m_flat")), "flat")).otherwise(F.col("flat")), "precision": F.when(hit, "kapi").otherwise(F.col("precision")), "confidence": F.when(hit, learned).otherwise(F.col("confidence")).cast("int"), "grade": F.when(hit, "green").otherwise(F.col("grade")), "from_memory": hit, "warnings": F.when(hit, message).otherwise(warnings)}
    return rows.withColumns(out).drop(*[c for c in rows.columns if c.startswith("m_")])


def annotate(memory: DataFrame, notes: DataFrame) -> DataFrame:
    """Latest note per phone; customers that aren't known stay unknown."""
    last = notes.withColumn("phone_key", phone_key(F.col("phone"))).groupBy("phone_key").agg(F.max_by("note", "at").alias("new_note"), F.lit(True).alias("noted"))
    rows = memory.join(last, "phone_key", "left")
    old = F.col("note") if "note" in memory.columns else F.lit(None).cast("string")
    return rows.withColumn("note", F.when(F.col("noted"), F.col("new_note")).otherwise(old)).drop("new_note", "noted")


def exact_history(deliveries: DataFrame) -> DataFrame:
    """Every state of the memory: the row as it stands after each delivery, by ordered windows."""
    rows = deliveries.withColumn("phone_key", phone_key(F.col("phone"))).where("phone_key is not null and lat is not null")
    w = Window.partitionBy("phone_key").orderBy("ts", "stop_id").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.max(F.col("corrected").cast("int")).over(w) == 1
    may = ~fixed | F.col("corrected")
    return rows.withColumns({"deliveries": F.count("*").over(w), "memory_lat": F.last(F.when(may, F.col("lat")), ignorenulls=True).over(w), "memory_lng": F.last(F.when(may, F.col("lng")), ignorenulls=True).over(w), "is_corrected": fixed})
