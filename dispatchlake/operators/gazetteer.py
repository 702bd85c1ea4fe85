"""Districts in texts, and resolving addresses against a gazetteer (own design; only its inputs and outputs are given)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_key
from ..sources.shared import cut
from .names import runs_of_words, within_edits

#: Own cut-offs.
GREEN, YELLOW = 80, 50
#: Greatest edit distance of a road or quarter, as a share of its length.
EDITS = 0.25
#: Words after a road's name among which its door is looked for.
DOOR_REACH = 4
#: Below this confidence of the door's word a resolution isn't green.
SURE_DOOR = 70
DOOR = "^[0-9]+[a-z]?$"
#: What a text costs that doesn't name its district.
NO_DISTRICT = 10


def named_districts(texts: DataFrame, districts: DataFrame, key: str, text: str, loaded: DataFrame | None = None) -> DataFrame:
    """(key, oid, name) of the districts whose key is a word of the folded text, less those already loaded.

    The districts are written first, so Spark knows their size and broadcasts them if they are small. Otherwise it may take the
    words for the smaller side: it judges them by the files of the texts, which hold far less than the words made from them.
    The filter on keys is true of all that can match; partitions are pruned by tables with a filter alone.
    """
    asked = districts if loaded is None else districts.join(loaded.select("oid"), "oid", "left_anti")
    words = texts.select(key, F.explode(F.array_distinct(F.split(search_key(F.col(text)), " "))).alias("word"))
    return words.join(cut(asked).where("search_key >= ''"), F.col("word") == F.col("search_key")).select(key, "oid", "name")


def resolve(queries: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """The best gazetteer row for district, quarter, road and door.

    Names are matched before doors, level by level and each different one once: the quarters of a district, then the roads
    of quarters that match, both by an index of their pieces (``names.within_edits``), so every name within EDITS of its
    length is found, wherever its letters differ. A question without a quarter goes to all of its district. Doors join by
    equality. So work grows with the different names of a quarter, not with questions times doors. Confidence: 40 for the road, 30
    for the quarter, 30 for the door, each less its edits. precision: kapi with the door, yol with the road alone, else yok.
    """
    def folded(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumns({f"{prefix}{c}": search_key(F.coalesce(F.col(c), F.lit(""))) for c in ("district", "quarter", "road", "door")})

    g = folded(gazetteer, "g_").select("g_district", "g_quarter", "g_road", "g_door", F.struct("quarter", "road", "door", "lat", "lng").alias("place"))
    q = folded(queries, "q_").select(key, "q_district", "q_quarter", "q_road", "q_door")
    off = lambda c: F.col("edits") / F.greatest(F.length(c), F.lit(1))
    asked_quarters, quarters_there = q.select(F.col("q_district").alias("g_district"), "q_quarter").distinct(), g.select("g_district", "g_quarter").distinct()
    quarters = within_edits(asked_quarters.where("q_quarter <> ''"), quarters_there, ["g_district"], "q_quarter", "g_quarter", EDITS).withColumn("quarter_off", off("g_quarter"))
    any_quarter = asked_quarters.where("q_quarter = ''").join(quarters_there, "g_district").withColumn("quarter_off", F.lit(0.0))
    quarters = quarters.select("g_district", "q_quarter", "g_quarter", "quarter_off").unionByName(any_quarter)
    asked = q.select(F.col("q_district").alias("g_district"), "q_quarter", "q_road").distinct().join(quarters, ["g_district", "q_quarter"])
    roads = g.groupBy("g_district", "g_quarter", "g_road").agg(F.max("place").alias("last"))
    near = within_edits(asked, roads, ["g_district", "g_quarter"], "q_road", "g_road", EDITS).withColumn("road_off", off("g_road")).drop("edits")
    names = asked.join(near, ["g_district", "g_quarter", "q_road"]).join(roads, ["g_district", "g_quarter", "g_road"]).withColumnRenamed("g_district", "q_district")
    base = 40 * (1 - F.col("road_off")) + F.when(F.col("q_quarter") == "", 0).otherwise(30 * (1 - F.col("quarter_off")))
    names = names.select("q_district", "q_quarter", "q_road", "g_quarter", "g_road", base.alias("base"), "last")

    def ranked(confidence: Column, place: str, precision: str) -> Column:
        p = lambda c: F.col(f"{place}.{c}").alias(c)
        return F.max(F.struct(F.floor(confidence).cast("int").alias("confidence"), *map(p, ("quarter", "road", "door", "lat", "lng")), F.lit(precision).alias("precision")))

    name, address = ["q_district", "q_quarter", "q_road"], ["q_district", "q_quarter", "q_road", "q_door"]
    by_road = names.groupBy(*name).agg(ranked(F.col("base"), "last", "yol").alias("road_best"))
    doors = g.where("g_door <> ''").groupBy("g_district", "g_quarter", "g_road", "g_door").agg(F.max("place").alias("place"))
    with_door = q.where("q_door <> ''").select(*address).distinct().join(names, name)
    with_door = with_door.join(doors.withColumnsRenamed({"g_district": "q_district", "g_door": "q_door"}), ["q_district", "g_quarter", "g_road", "q_door"])
    by_door = with_door.groupBy(*address).agg(ranked(F.col("base") + 30, "place", "kapi").alias("door_best"))
    out = q.join(by_road, name, "left").join(by_door, address, "left").withColumn("b", F.greatest("road_best", "door_best"))
    return out.select(key, "b.lat", "b.lng", F.coalesce("b.confidence", F.lit(0)).alias("confidence"), F.coalesce("b.precision", F.lit("yok")).alias("precision")).withColumn("grade", _grade(F.col("confidence")))


def _grade(confidence: Column) -> Column:
    return F.when(confidence >= GREEN, "green").when(confidence >= YELLOW, "yellow").otherwise("red")


def resolve_texts(texts: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", ocr_words: str | None = None) -> DataFrame:
    """The best address that a whole text names: district, quarter, road, door, lat, lng, confidence, precision, grade.

    ``texts``: a row for each key, with the text and, if ``ocr_words`` names them, the words of its reading
    (array<struct<text, confidence>>). Names of the gazetteer are found as runs of words (``names.runs_of_words``). A road counts if the
    text names its quarter or its district too; its door is the first number among the DOOR_REACH words behind it. Of several
    roads the one with the greatest confidence counts, of equal ones the first in the text: 40 for the road, 30 for the
    quarter, 30 for a door that the gazetteer has, less NO_DISTRICT where the district isn't named. The door's word is found among the
    words of the reading by its place: the second 12 of the text is the second 12 that was read. If it was read with less
    than SURE_DOOR, a green grade becomes yellow.

    Texts that name no address, null and empty ones have confidence 0 and precision yok; a reading without that word,
    or without words, changes nothing.
    """
    folded = {f"g_{c}": search_key(F.coalesce(F.col(c), F.lit(""))) for c in ("district", "quarter", "road", "door")}
    g = cut(gazetteer.withColumns(folded).select(*folded, F.struct("district", "quarter", "road", "door", "lat", "lng").alias("place")))
    rows = texts.withColumn("_words", F.split(search_key(F.coalesce(F.col(text), F.lit(""))), " "))
    kinds = [g.select(F.lit(c).alias("kind"), F.col(f"g_{c}").alias("name")) for c in ("district", "quarter", "road")]
    found = runs_of_words(rows, kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), key, "_words", DOOR_REACH)
    # the first number behind a road, and its place in the text
    at = F.array_position(F.transform("after", lambda w: w.rlike(DOOR)), True)
    road = F.struct(F.col("name").alias("g_road"), "begin", F.when(at > 0, F.get("after", (at - 1).cast("int"))).alias("g_door"), (F.col("begin") + F.col("size") + at).cast("int").alias("door_place"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    sets = {f"{kind}s": F.sort_array(F.collect_set(of(kind, F.col("name")))) for kind in ("quarter", "district")}
    finds = cut(found.groupBy(key).agg(F.collect_list(of("road", road)).alias("roads"), *[c.alias(n) for n, c in sets.items()]))
    # What can be found of a road only depends on its question: its door and what else the text names. Each different one is asked once.
    question = ["g_road", "g_door", "quarters", "districts"]
    asked = finds.select(key, F.explode("roads").alias("r"), "quarters", "districts").select(key, "r.*", "quarters", "districts").withColumn("g_door", F.coalesce("g_door", F.lit(""))).where("size(quarters) + size(districts) > 0")
    # A road is looked up in the districts that the text names, and in the quarters that it names: there the best of all districts
    # stands for them, as they only differ by their names. What is found again in a named district is less by NO_DISTRICT.
    area = lambda everywhere: lambda name: F.named_struct(F.lit("everywhere"), F.lit(everywhere), F.lit("area"), name)
    areas = F.concat(F.transform("districts", area(False)), F.transform("quarters", area(True)))
    roads = asked.select(*question).distinct().select(*question, F.explode(areas).alias("a")).select(*question, "a.*")
    both = g.select(F.lit(False).alias("everywhere"), F.col("g_district").alias("area"), "g_quarter", "g_road", "g_door", "place").unionByName(g.select(F.lit(True).alias("everywhere"), F.col("g_quarter").alias("area"), "g_quarter", "g_road", "g_door", "place"))
    spot = ["everywhere", "area", "g_quarter", "g_road"]
    tried = roads.join(cut(both.groupBy(*spot).agg(F.max("place").alias("road_place"))).hint("merge"), ["everywhere", "area", "g_road"])
    tried = tried.withColumn("has_quarter", F.col("everywhere") | F.array_contains("quarters", F.col("g_quarter")))
    doors = both.where("g_door <> ''").groupBy(*spot, "g_door").agg(F.max("place").alias("door_there"))
    tried = tried.join(doors.hint("merge"), [*spot, "g_door"], "left")
    confidence = F.lit(40) + F.when(F.col("has_quarter"), 30).otherwise(0) + F.when(F.col("door_there").isNotNull(), 30).otherwise(0) - F.when(F.col("everywhere"), NO_DISTRICT).otherwise(0)
    place = F.coalesce("door_there", "road_place")
    there = F.struct(confidence.alias("confidence"), place["district"].alias("district"), place["quarter"].alias("quarter"), place["road"].alias("road"), F.when(F.col("door_there").isNotNull(), place["door"]).alias("door"), place["lat"].alias("lat"), place["lng"].alias("lng"), F.when(F.col("door_there").isNotNull(), F.col("g_door")).alias("g_door"))
    answers = tried.groupBy(*question).agg(F.max(there).alias("there"))
    answered = asked.join(answers.hint("merge"), question)
    best = F.max(F.struct(F.col("there.confidence").alias("confidence"), (-F.col("begin")).alias("first"), *[F.col(f"there.{c}").alias(c) for c in ("district", "quarter", "road", "door", "lat", "lng", "g_door")], "door_place"))
    own = rows.select(key)
    if ocr_words:  # only numbers can be doors, so only they go on
        read = F.flatten(F.transform(ocr_words, lambda w: F.transform(F.split(search_key(F.coalesce(w["text"], F.lit(""))), " "), lambda t: F.struct(t.alias("t"), w["confidence"].alias("confidence")))))
        places = F.transform("_words", lambda w, i: F.struct(w.alias("t"), (i + 1).alias("place")))
        own = rows.select(key, F.filter(places, lambda x: x["t"].rlike(DOOR)).alias("_numbers"), F.filter(read, lambda x: x["t"].rlike(DOOR)).alias("_read"))
    # merged: a text's files say little of the size of what is made from it, which is nothing for the driver
    out = own.join(answered.groupBy(key).agg(best.alias("b")).hint("merge"), key, "left").withColumn("confidence", F.coalesce("b.confidence", F.lit(0)))
    grade = _grade(F.col("confidence"))
    if ocr_words:
        same = F.filter("_read", lambda x: x["t"] == F.col("b.g_door"))
        nth = F.size(F.filter("_numbers", lambda x: (x["t"] == F.col("b.g_door")) & (x["place"] <= F.col("b.door_place"))))
        out = out.withColumn("door_confidence", F.get(same, nth - 1)["confidence"].cast("double"))
        grade = F.when((grade == "green") & (F.col("door_confidence") < SURE_DOOR), "yellow").otherwise(grade)
    precision = F.when(F.col("b.g_door").isNotNull(), "kapi").when(F.col("b").isNotNull(), "yol").otherwise("yok")
    return out.select(key, *[f"b.{c}" for c in ("district", "quarter", "road", "door", "lat", "lng")], "confidence", precision.alias("precision"), grade.alias("grade"), *(["door_confidence"] if ocr_words else []))


def best_per_group(rows: DataFrame, group: str, order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
