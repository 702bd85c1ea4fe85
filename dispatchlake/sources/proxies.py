"""Delivery tables made from the star-schema test tables, and the same in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LAT = "37.70 + ((user_id * 37) % 100) * 0.001 + (event_id % 5) * 0.0001"
_LNG = "29.00 + ((user_id * 53) % 100) * 0.001"
_PIECES = {"spark": "cast(get_json_object(props, '$.k') as int)", "duckdb": "cast(json_extract_string(props, '$.k') as int)"}
_LIST = {"spark": "array(concat('w', cast(event_id % 4 AS string)))", "duckdb": "list_value(concat('w', cast(event_id % 4 AS string)))"}
_DATE = {"spark": "to_date(ts - interval 4 hours)", "duckdb": "cast(ts - interval 4 hour as date)"}


def _stop_columns(engine: str) -> str:
    return f"""
    event_id AS stop_id, {_DATE[engine]} AS business_date, ts, user_id,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('D', cast(event_id % 400 AS string)) END AS doc_no,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat(CASE WHEN event_id % 2 = 0 THEN 'Müşteri  ' ELSE 'MÜŞTERİ ' END, cast(user_id AS string)) END AS name,
    CASE WHEN event_id % 9 = 0 THEN '12 34' ELSE concat('+90 532 ', lpad(cast(user_id AS string), 7, '0')) END AS phone,
    concat('Ürün ', cast(event_id % 7 AS string)) AS product,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE {_PIECES[engine]} % 5 END AS pieces,
    concat('İlçe ', cast(user_id % 19 AS string)) AS district,
    CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('Mahalle ', cast(user_id % 12 AS string)) END AS quarter,
    concat('Yol ', cast(user_id % 30 AS string)) AS road,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(event_id % 90 AS string) END AS door,
    CASE WHEN event_id % 3 = 0 THEN cast(event_id % 12 AS string) END AS flat,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_LAT} END AS lat,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_LNG} END AS lng,
    CASE WHEN event_id % 11 = 0 THEN 'yok' WHEN event_id % 3 = 0 THEN 'yol' ELSE 'kapi' END AS precision,
    cast(floor(least(value, 499.0) / 5) AS int) AS confidence,
    CASE WHEN value >= 350 THEN 'green' WHEN value >= 30 THEN 'yellow' ELSE 'red' END AS grade,
    CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
    event_type = 'signup' AS corrected,
    CASE WHEN event_type = 'error' THEN 'no one there' END AS status_reason,
    CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL 2 hour END AS finished_at,
    CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 hour END AS updated_at,
    {_LIST[engine]} AS warnings, concat('text ', cast(event_id AS string)) AS raw_text
    """


#: Route position: most stops of a day that have coordinates, in a shuffled but fixed order.
_SEQ = "CASE WHEN lat IS NOT NULL AND stop_id % 4 <> 0 THEN cast(row_number() OVER (PARTITION BY business_date, lat IS NOT NULL AND stop_id % 4 <> 0 ORDER BY (stop_id * 7919) % 10007, stop_id) AS int) END AS seq"

STOPS_SQL = f"stops AS (SELECT *, {_SEQ} FROM (SELECT {_stop_columns('duckdb')} FROM events))".replace("AS string", "AS varchar")
#: Days with an even number have a route; it starts at the depot, or nowhere (each third).
ROUTES_SQL = """routes AS (
    SELECT business_date, CASE WHEN day(business_date) % 3 = 0 THEN NULL ELSE 37.760175::DOUBLE END AS start_lat,
        CASE WHEN day(business_date) % 3 = 0 THEN NULL ELSE 29.042555::DOUBLE END AS start_lng,
        cast(day(business_date) * 1234.5 AS double) AS total_m,
        CASE WHEN day(business_date) % 3 <> 0 THEN 'gps' END AS start_source, CASE WHEN day(business_date) % 4 = 0 THEN day(business_date) * 1.3 END AS start_accuracy,
        'ors' AS matrix_source, CASE WHEN day(business_date) % 8 = 0 THEN NULL ELSE '2-opt' END AS method, concat(cast(business_date AS string), 'T08:00:00.000Z') AS built_at
    FROM (SELECT DISTINCT business_date FROM stops) WHERE day(business_date) % 2 = 0)""".replace("AS string", "AS varchar")
DAYS_SQL = """days AS (
    SELECT business_date, CASE WHEN business_date = max(business_date) OVER () THEN 'open' ELSE 'closed' END AS status
    FROM (SELECT DISTINCT business_date FROM stops UNION ALL SELECT DATE '2023-12-01'))"""


def stops(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").selectExpr(*_split(_stop_columns("spark")))
    return rows.selectExpr("*", _SEQ)


def _split(columns: str) -> list[str]:
    """The select list's items."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += not quoted and (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def routes(spark: SparkSession, folder: str) -> DataFrame:
    days = stops(spark, folder).select("business_date").distinct().where("day(business_date) % 2 = 0")
    day = F.dayofmonth("business_date")
    somewhere = day % 3 != 0
    return days.select(
        "business_date", F.when(somewhere, 37.760175).alias("start_lat"), F.when(somewhere, 29.042555).alias("start_lng"), (day * 1234.5).alias("total_m"), F.when(somewhere, "gps").alias("start_source"),
        F.when(day % 4 == 0, day * 1.3).alias("start_accuracy"), F.lit("ors").alias("matrix_source"), F.when(day % 8 != 0, "2-opt").alias("method"), F.concat(F.col("business_date").cast("string"), F.lit("T08:00:00.000Z")).alias("built_at"),
    )


def days(spark: SparkSession, folder: str) -> DataFrame:
    """Work days, and one without stops; the latest is open."""
    found = stops(spark, folder).select("business_date").distinct()
    last = found.agg(F.max("business_date").alias("last"))
    every = found.unionByName(spark.sql("SELECT DATE '2023-12-01' AS business_date"))
    return every.join(F.broadcast(last)).select("business_date", F.when(F.col("business_date") == F.col("last"), "open").otherwise("closed").alias("status"))


#: Invoice texts made from orders; \\n stands for a line break in both engines' literals.
_INVOICE = [
    "CASE o_orderkey % 5 WHEN 0 THEN concat('Çıkış Belgesi: ', cast(1000000 + o_orderkey AS string)) WHEN 1 THEN concat('FATURA No. ', cast(10000000 + o_orderkey AS string)) WHEN 2 THEN concat('Teslimat No: ', cast(200000 + o_orderkey AS string), '_1') WHEN 3 THEN concat('Sipariş No. ', cast(300000 + o_orderkey AS string)) ELSE 'ÇIKIŞ BELGESİ 123456' END",
    "CASE o_orderkey % 4 WHEN 0 THEN concat('Alıcı: Müşteri   ', cast(o_custkey AS string)) WHEN 1 THEN concat('SAYIN', {nl}, 'Firma  ', cast(o_custkey AS string)) WHEN 2 THEN 'ALICI: X' ELSE concat('Alıcı Adres: Yol ', cast(o_custkey AS string)) END",
    "CASE o_orderkey % 3 WHEN 0 THEN concat('Tel 0532 ', lpad(cast(o_custkey % 1000 AS string), 3, '0'), ' 45 67') WHEN 1 THEN concat('+90 5', lpad(cast(o_custkey AS string), 9, '1')) ELSE 'Kart 4530532123456789' END",
    "concat('Ürün: ', o_orderpriority, ' kalem')",
    "CASE o_orderkey % 6 WHEN 0 THEN 'Koli 3/1' WHEN 1 THEN 'x2/1' WHEN 2 THEN '4 / 2' ELSE 'tek' END",
    "CASE o_orderkey % 7 WHEN 0 THEN 'KALE MERKEZEFENDİ' WHEN 1 THEN 'Çal' WHEN 2 THEN 'pamukkale, honaz' ELSE 'çalı' END",
]


def _invoice(engine: str) -> str:
    nl = "chr(10)"
    parts = [p.replace("{nl}", nl) for p in _INVOICE]
    return f"concat_ws({nl}, {', '.join(parts)})"


INVOICES_SQL = f"invoices AS (SELECT o_orderkey, o_custkey, {_invoice('duckdb')} AS text FROM orders)".replace("AS string", "AS varchar")


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey", f"{_invoice('spark')} AS text")


#: Letters: invoices with an address in words, some without district, quarter or door.
_ADDRESS = [
    "CASE WHEN o_orderkey % 9 = 0 THEN 'adres' ELSE concat('MAHALLE ', cast(o_custkey % 12 AS string), ' Mh.') END",
    "concat('Yol ', cast(o_custkey % 30 AS string), CASE WHEN o_orderkey % 4 = 0 THEN ' üzeri' ELSE '' END)",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'kapısız' ELSE concat('No: ', cast(o_orderkey % 90 AS string)) END",
    "CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE concat('İlçe ', cast(o_custkey % 19 AS string)) END",
]


def _letter(engine: str) -> str:
    return f"concat({_invoice(engine)}, chr(10), concat_ws(' ', {', '.join(_ADDRESS)}))"


#: A letter's words as they were read: split at white space, with made-up confidences.
_READ = {
    "spark": "transform(split(text, '[ \\n]'), (w, i) -> struct(w AS text, cast((i * 37 + o_orderkey * 11) % 101 AS double) AS confidence))",
    "duckdb": "list_transform(regexp_split_to_array(text, '[ \\n]'), lambda w, i: {'text': w, 'confidence': (((i - 1) * 37 + o_orderkey * 11) % 101)::DOUBLE})",
}
LETTERS_SQL = f"letters AS (SELECT *, {_READ['duckdb']} AS words FROM (SELECT o_orderkey, {_letter('duckdb')} AS text FROM orders))".replace("AS string", "AS varchar")


def letters(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, ts, text, words)."""
    return table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderdate AS ts", f"{_letter('spark')} AS text").selectExpr("*", f"{_READ['spark']} AS words")


# Districts as (oid, name, search key).
DISTRICTS = [
    (1, "BABADAĞ", "babadag"), (2, "BEKİLLİ", "bekilli"), (3, "ÇAL", "cal"), (4, "ÇİVRİL", "civril"), (5, "GÜNEY", "guney"),
    (6, "ACIPAYAM", "acipayam"), (7, "BULDAN", "buldan"), (8, "BAKLAN", "baklan"), (9, "SERİNHİSAR", "serinhisar"),
    (10, "PAMUKKALE", "pamukkale"), (11, "KALE", "kale"), (12, "SARAYKÖY", "saraykoy"), (13, "TAVAS", "tavas"),
    (14, "MERKEZEFENDİ", "merkezefendi"), (15, "HONAZ", "honaz"), (16, "BOZKURT", "bozkurt"), (17, "ÇARDAK", "cardak"),
    (18, "ÇAMELİ", "cameli"), (19, "BEYAĞAÇ", "beyagac"),
]
DISTRICTS_SQL = "districts AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', '{k}')" for o, n, k in DISTRICTS) + ") AS t(oid, name, search_key))"


def districts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTRICTS, "oid int, name string, search_key string")


#: OCR readings: the words of a document with made-up confidences, four attempts each.
def readings(spark: SparkSession, folder: str) -> DataFrame:
    return plain_readings(spark, folder).withColumn("words", read_words("text", "attempt")).select("doc_id", "attempt", "text", "words", "confidence")


def plain_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The readings without their words, which are several times as large as their texts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"), "text").withColumn("confidence", ((F.col("doc_id") * 31 + F.col("attempt") * 47) % 101).cast("double"))


def read_words(text: str, attempt: str) -> Column:
    """The words of a reading, made from its text."""
    return F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("text"), ((i * 37 + F.col("doc_id") * 11 + F.col(attempt) * 29) % 101).cast("double").alias("confidence")))


READINGS_SQL = """readings AS (
    SELECT doc_id, attempt, text, list_transform(string_split(text, ' '), lambda w, i: {'text': w, 'confidence': (((i - 1) * 37 + doc_id * 11 + attempt * 29) % 101)::DOUBLE}) AS words,
        ((doc_id * 31 + attempt * 47) % 101)::DOUBLE AS confidence
    FROM (SELECT doc_id, text, unnest(range(0, 4)) AS attempt FROM documents))"""
