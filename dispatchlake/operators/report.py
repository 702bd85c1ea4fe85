"""The day export and links. Names and phones are never part of the export."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, full, pad_left, pad_right
from .ledger import DAY, export_legs

# The link to directions, and words and signs of the export.
DIRECTIONS = "https://www.google.com/maps/dir/?api=1&destination="
HEADING, STOPS, ON_ROUTE, WARN_OFF, OFF_ROUTE = "═══ ", " durak", "  · rotada ", "  ⚠ ", " DURAK ROTA DIŞI"
NO_POINT, NO_LEG, NO_SEQ, UNKNOWN = "koordinat yok", "  —", "·", "?"
NO_ROUTE, NO_START = "  rota: çıkarılmamış", "YOK"
ROUTE_PARTS = ("  rota: başlangıç ", "  kaynak=", " ±", "  mesafe=", "  yöntem=", "  toplam=", "  zaman=")
VERSION, MADE_AT = "sürüm: ", "   çıkarma: "
#: The first line of an export.
TITLE = "GÜN KAYDI"
#: Places of the lines before a day's stops, which begin at 1, and of those before all days.
TITLE_AT, VERSION_AT, BLANK_AT, HEADING_AT, ROUTE_AT = -4, -3, -2, -1, 0


def directions(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit(DIRECTIONS), lat.cast("string"), F.lit(","), lng.cast("string"))


def export_rows(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """(business_date, place, line): a fixed-width line per stop in the day's order."""
    rows = export_legs(stops, routes)
    km = F.coalesce(fixed(F.col("leg_m") / 1000, 1), F.lit(NO_LEG))
    point = F.coalesce(F.concat(fixed(F.col("lat"), 5), F.lit(","), fixed(F.col("lng"), 5)), F.lit(NO_POINT))
    address = F.concat_ws(" / ", full(F.col("district")), full(F.col("quarter")), full(F.col("road")), F.concat(F.lit("no "), full(F.col("door"))), F.concat(F.lit("d"), full(F.col("flat"))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(
        F.lit("  "), pad_left(F.coalesce(F.col("seq").cast("string"), F.lit(NO_SEQ)), 3), F.lit(". "), pad_left(km, 5), F.lit("km  "), pad_right(F.coalesce("status", F.lit(UNKNOWN)), 9), pad_right(point, 20), F.lit(" "),
        pad_left(text("confidence"), 3), F.lit(" "), pad_right(text("grade"), 8), pad_right(text("precision"), 5), F.lit(" p"), F.coalesce(F.nullif(F.col("pieces"), F.lit(0)), F.lit(1)).cast("string"), F.lit(" | "), address,
    )
    return rows.select(DAY, "place", line.alias("line"))


def route_line(route: Column) -> Column:
    """Where a day's route begins and what it was made from. ``route``: a struct of the route's columns."""
    part = dict(zip(("start", "source", "accuracy", "matrix", "method", "total", "at"), map(F.lit, ROUTE_PARTS), strict=True))
    known = lambda c: F.coalesce(full(route[c].cast("string")), F.lit(UNKNOWN))
    start = F.coalesce(F.concat(fixed(route["start_lat"], 5), F.lit(","), fixed(route["start_lng"], 5)), F.lit(NO_START))
    accuracy = F.when(route["start_accuracy"] != 0, F.concat(part["accuracy"], F.floor(route["start_accuracy"] + 0.5).cast("string"), F.lit("m")))
    total = F.coalesce(F.concat(fixed(route["total_m"] / 1000, 1), F.lit("km")), F.lit(UNKNOWN))
    return F.concat(part["start"], start, part["source"], known("start_source"), F.coalesce(accuracy, F.lit("")), part["matrix"], known("matrix_source"), part["method"], known("method"), part["total"], total, part["at"], known("built_at"))


def export_text(days: DataFrame, stops: DataFrame, routes: DataFrame, version: str | None = None, made_at: str = "", title: str = TITLE) -> DataFrame:
    """(business_date, place, line): title and version (no date), and for each day an empty line, a heading, its route and its stops.

    The text is the lines with dates from late to early, those without first, and places from low to high.
    """
    counts = stops.groupBy(DAY).agg(F.count("*").alias("n"), F.count("seq").alias("on"))
    columns = {"start_lat": "double", "start_lng": "double", "start_source": "string", "start_accuracy": "double", "matrix_source": "string", "method": "string", "total_m": "double", "built_at": "string"}
    route = F.struct(*[(F.col(c) if c in routes.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()])
    rows = days.join(counts, DAY, "left").join(routes.select(DAY, route.alias("route")), DAY, "left").na.fill(0, ["n", "on"])
    off = F.when(F.col("on") < F.col("n"), F.concat(F.lit(WARN_OFF), (F.col("n") - F.col("on")).cast("string"), F.lit(OFF_ROUTE))).otherwise("")
    routed = F.when(F.col("route").isNotNull(), F.concat(F.lit(ON_ROUTE), F.col("on").cast("string"), off)).otherwise("")
    head = F.concat(F.lit(HEADING), F.col(DAY).cast("string"), F.lit("  ("), F.col("status"), F.lit(")  "), F.col("n").cast("string"), F.lit(STOPS), routed)
    route_ = F.when(F.col("route").isNotNull(), route_line(F.col("route"))).otherwise(NO_ROUTE)
    before = F.array(*[F.struct(F.lit(p).alias("place"), x.alias("line")) for p, x in ((BLANK_AT, F.lit("")), (HEADING_AT, head), (ROUTE_AT, route_))])
    lines = rows.select(DAY, F.inline(before))
    titles = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(x).alias("line")) for p, x in ((TITLE_AT, title), (VERSION_AT, VERSION + (version or UNKNOWN) + MADE_AT + made_at))])
    top = days.sparkSession.range(1).select(F.lit(None).cast("date").alias(DAY), F.inline(titles))
    return top.unionByName(lines).unionByName(export_rows(stops, routes))


def write_export(days: DataFrame, stops: DataFrame, routes: DataFrame, folder: str, version: str | None = None, made_at: str = "") -> None:
    """A text file per day, its lines in order; the title's lines are under the day null."""
    rows = export_text(days, stops, routes, version, made_at).withColumn("day", F.col(DAY).cast("string"))
    rows.repartition("day").sortWithinPartitions("day", "place").select("day", "line").write.partitionBy("day").mode("overwrite").text(folder)
