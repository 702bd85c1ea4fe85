"""All queries of the delivery ledger by name, and their SQL.

A query applies an operator to a whole table made from the test data (``sources.proxies``); its SQL states the same
result for another engine. Metres are compared as whole ones, since sines differ in the last bit between engines.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators import gazetteer, intake, layout, ledger, memory, merge, ocr, report, route
from ..sources import store
from ..sources.proxies import DAYS_SQL, DISTRICTS_SQL, INVOICES_SQL, LETTERS_SQL, READINGS_SQL, ROUTES_SQL, STOPS_SQL, days, districts, invoices, letters, plain_readings, read_words, readings, routes, stops, table
from ..streaming import arrivals, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_M = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
_WHOLE = "cast(floor({m} + 0.5) AS bigint)"
_ORDER = "seq ASC NULLS LAST, stop_id"


def _metres(a: str, b: str, c: str, d: str) -> str:
    return _WHOLE.format(m=_M.format(a=a, b=b, c=c, d=d))


def _whole(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def query(name: str, sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query under its name; ``tables``: SQL of the tables that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


# Scans, sources, sinks


@query("s1_open_store", "SELECT 'days' AS name, (SELECT count(*) FROM days)::INT AS n UNION ALL SELECT 'customers', (SELECT count(*) FROM customer) UNION ALL SELECT 'settings', 0", STOPS_SQL, DAYS_SQL)
def _(spark, d):
    """A store that is opened, filled in two of its tables, and opened again: nothing is lost or made anew."""
    tables = store.Store(spark, store.own_folder(spark))
    schemas = {"days": "business_date date, status string", "customers": "c_custkey bigint, c_name string", "settings": "key string, value string"}
    for again in (False, True):
        for name, schema in schemas.items():
            tables.create(name, schema)
        if not again:
            tables.write("days", days(spark, d))
            tables.write("customers", table(spark, d, "customer").select("c_custkey", "c_name"))
    counts = [tables.read(name).agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n")) for name in schemas]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("s2_transaction", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT NULL, NULL")
def _(spark, d):
    """A version that a later one replaces, a lookup of a missing row (one row of nulls), and all rows of the last version."""
    tables = store.Store(spark, store.own_folder(spark))
    tables.create("customers", "c_custkey bigint, c_name string")
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    tables.write("customers", rows)
    tables.write("customers", tables.read("customers").where("c_custkey % 2 = 0"))
    missing = spark.range(1).join(store.lookup(tables.read("customers"), "c_custkey", -1), F.lit(True), "left").select("c_custkey", "c_name")
    return tables.read("customers").unionByName(missing)


query("s12_photo_files")(lambda spark, d: store.photos(spark, f"{d}/{{nation,region}}.parquet").select("frame_id", "file", "kilobytes", F.length("content").alias("bytes")))


@query("s3_point_lookup", "SELECT stop_id, name, status FROM stops WHERE stop_id = 77", STOPS_SQL)
def _(spark, d):
    return store.lookup(stops(spark, d), "stop_id", 77).select("stop_id", "name", "status")


@query("s4_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '+' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 5 = 0")
def _(spark, d):
    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = old.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("segment"), F.lit("+")).alias("segment"), F.lit(2).alias("at"))
    earlier = changed.select("c_custkey", F.lit("old").alias("segment"), F.lit(1).alias("at"))
    new = old.where("c_custkey % 5 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("new").alias("segment"), F.lit(1).alias("at"))
    return ledger.upsert(old, changed.unionByName(earlier).unionByName(new), ["c_custkey"], "at")


@query("s5_full_scan", "SELECT stop_id, business_date, doc_no, pieces, seq FROM stops", STOPS_SQL)
def _(spark, d):
    return stops(spark, d).select("stop_id", "business_date", "doc_no", "pieces", "seq")


@query("s6_days_newest_first", "SELECT business_date, status FROM days ORDER BY business_date DESC", STOPS_SQL, DAYS_SQL)
def _(spark, d):
    return store.newest_first(days(spark, d))


#: Settings: one of each nation, some of them null.
_SETTINGS = "settings AS (SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 1 THEN '\"' || n_name || '\"' END AS value FROM nation)"


def _settings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr("concat('k', n_nationkey) AS key", "CASE WHEN n_nationkey % 2 = 1 THEN concat('\"', n_name, '\"') END AS value")


@query("s8_setting_default", "SELECT 'missing' AS key, '5' AS value UNION ALL SELECT key, value FROM settings WHERE key IN ('k3', 'k4')", _SETTINGS)
def _(spark, d):
    """A missing setting has its default; a stored one its value, a stored null too."""
    asked = [store.setting(_settings(spark, d), name, 5) for name in ("missing", "k3", "k4")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


@query("s9_setting_write", """SELECT key, CASE WHEN key = 'k4' THEN '"k"' ELSE value END AS value FROM settings UNION ALL SELECT 'new', '{"lat": 37.8}'""", _SETTINGS)
def _(spark, d):
    return store.with_setting(store.with_setting(_settings(spark, d), "k4", "k"), "new", {"lat": 37.8})


_PENDING = "p AS (SELECT *, count(*) OVER (PARTITION BY business_date, district) + 1 AS points FROM stops WHERE status = 'pending' AND lat IS NOT NULL)"
_SECONDS = "CASE WHEN (a + b) % 11 = 0 OR a % 97 = 0 OR b % 97 = 0 THEN NULL ELSE cast(floor(metres * 0.162) AS int) + (a * 7 + b * 13) % 300 END"
_TIMES = f"times AS (SELECT business_date, district, a, b, {_SECONDS} AS seconds FROM (SELECT business_date, district, a.stop_id AS a, b.stop_id AS b, {_metres('a.lat', 'b.lat', 'a.lng', 'b.lng')} AS metres FROM p a JOIN p b USING (business_date, district) WHERE a.stop_id <> b.stop_id AND a.points <= {route.MATRIX_POINTS}))"


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Durations as a road service would give them, for each route within its cap of points; some pairs, and some points, it can't connect."""
    points = route.points_matrix(stops(spark, d).where("status = 'pending' and lat is not null"), ["business_date", "district"])
    return points.withColumn("metres", _whole(F.col("metres"))).selectExpr("business_date", "district", "a", "b", f"{_SECONDS} AS seconds")


query("s14_duration_matrix", "SELECT * FROM times", STOPS_SQL, _PENDING, _TIMES)(lambda spark, d: _times(spark, d))


@query("s16_deep_link", f"SELECT stop_id, concat('{report.DIRECTIONS}', cast(stop_id AS varchar), ',', cast(user_id AS varchar)) AS url FROM stops WHERE lat IS NOT NULL", STOPS_SQL)
def _(spark, d):
    return ledger.placed(stops(spark, d)).select("stop_id", report.directions(F.col("stop_id"), F.col("user_id")).alias("url"))


# Projections


@query("p1_business_date", "SELECT event_id, cast(ts - INTERVAL 4 HOUR AS date) AS business_date FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", dates.business_date(F.col("ts")).alias("business_date"))


@query("p2_phone_key", "SELECT stop_id, CASE WHEN length(x) >= 10 THEN right(x, 10) END AS phone_key FROM (SELECT stop_id, regexp_replace(phone, '[^0-9]', '', 'g') AS x FROM stops)", STOPS_SQL)
def _(spark, d):
    return stops(spark, d).select("stop_id", text.phone_key(F.col("phone")).alias("phone_key"))


@query("p3_haversine", f"SELECT stop_id, coalesce({_metres('lat', '37.760175', 'lng', '29.042555')}, -1) AS metres FROM stops", STOPS_SQL)
def _(spark, d):
    m = geo.metres_or_infinity(F.col("lat"), F.col("lng"), F.lit(geo.DEPOT_LAT), F.lit(geo.DEPOT_LNG))
    return stops(spark, d).select("stop_id", F.when(m == float("inf"), -1).otherwise(_whole(m)).alias("metres"))


@query("p3b_metres", f"SELECT stop_id, {_metres('lat', '37.760175', 'lng', '29.042555')} AS metres FROM stops", STOPS_SQL)
def _(spark, d):
    return stops(spark, d).select("stop_id", _whole(geo.metres(F.col("lat"), F.col("lng"), F.lit(geo.DEPOT_LAT), F.lit(geo.DEPOT_LNG))).alias("metres"))


_PLAIN = "trim(regexp_replace(lower(translate({c}, 'Iİ', 'ıi')), '[^a-zçğıöşü0-9]+', ' ', 'g'))"
_FOLD = f"trim(regexp_replace(lower(translate({{c}}, '{text.FOLDED_FROM}', '{text.FOLDED_TO}')), '[^a-z0-9]+', ' ', 'g'))"


@query("p4_plain_name", f"SELECT stop_id, {_PLAIN.format(c='name')} AS plain FROM stops", STOPS_SQL)
def _(spark, d):
    return stops(spark, d).select("stop_id", text.plain_name(F.col("name")).alias("plain"))


@query("p5_search_key", f"SELECT o_orderkey, {_FOLD.format(c='text')} AS folded FROM invoices", INVOICES_SQL)
def _(spark, d):
    return invoices(spark, d).select("o_orderkey", text.search_key(F.col("text")).alias("folded"))


_ADDRESS = f"coalesce(nullif(concat_ws(' · ', nullif(quarter, '') || ' Mh.', nullif(road, ''), 'No ' || nullif(door, ''), 'D:' || nullif(flat, ''), nullif(district, '')), ''), '{text.NO_ADDRESS}')"


@query("p6_address_line", f"SELECT stop_id, {_ADDRESS} AS address FROM (SELECT stop_id, quarter, CASE WHEN stop_id % 17 <> 0 THEN road END AS road, CASE WHEN stop_id % 17 <> 0 THEN door END AS door, CASE WHEN stop_id % 17 <> 0 THEN flat END AS flat, CASE WHEN stop_id % 17 <> 0 THEN district END AS district FROM stops)", STOPS_SQL)
def _(spark, d):
    some = {c: F.when(F.col("stop_id") % 17 != 0, F.col(c)) for c in ("road", "door", "flat", "district")}
    rows = stops(spark, d).withColumns(some)
    return rows.select("stop_id", text.address_line(*map(F.col, ("quarter", "road", "door", "flat", "district"))).alias("address"))


@query("p7_next_date", "SELECT o_orderkey, cast(o_orderdate + INTERVAL 1 DAY AS date) AS next_date FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.next_date(F.to_date("o_orderdate")).alias("next_date"))


@query("p8_day_and_month", f"SELECT o_orderkey, day(o_orderdate) || ' ' || ({list(text.MONTHS)})[month(o_orderdate)] AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.day_and_month(F.col("o_orderdate")).alias("label"))


def _fixed_sql(x: str, digits: int) -> str:
    n = f"cast(floor({x} * {10**digits} + 0.5) AS bigint)"
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || cast(abs({n}) // {10**digits} AS varchar) || '.' || lpad(cast(abs({n}) % {10**digits} AS varchar), {digits}, '0'))"


_PRIOR = f"(last_value(CASE WHEN lat IS NOT NULL THEN {{'lat': lat, 'lng': lng}} END IGNORE NULLS) OVER (PARTITION BY business_date ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_W2B = f"""w2b AS (
    SELECT *, {_M.format(a='b_lat', b='lat', c='b_lng', d='lng')} AS leg_m FROM (
        SELECT s.*, row_number() OVER (PARTITION BY business_date ORDER BY {_ORDER}) AS place,
            coalesce({_PRIOR}.lat, start_lat) AS b_lat, coalesce({_PRIOR}.lng, start_lng) AS b_lng
        FROM stops s LEFT JOIN routes USING (business_date)))"""
_PAD_L, _PAD_R = "CASE WHEN length({x}) >= {n} THEN {x} ELSE lpad({x}, {n}, ' ') END", "CASE WHEN length({x}) >= {n} THEN {x} ELSE rpad({x}, {n}, ' ') END"
_LINE = (
    "SELECT business_date, place, '  ' || " + _PAD_L.format(x="coalesce(cast(seq AS varchar), '·')", n=3) + " || '. ' || " + _PAD_L.format(x=f"coalesce({_fixed_sql('(leg_m / 1000)', 1)}, '  —')", n=5)
    + " || 'km  ' || " + _PAD_R.format(x="status", n=9) + " || " + _PAD_R.format(x=f"coalesce({_fixed_sql('lat', 5)} || ',' || {_fixed_sql('lng', 5)}, 'koordinat yok')", n=20)
    + " || ' ' || " + _PAD_L.format(x="cast(confidence AS varchar)", n=3) + " || ' ' || " + _PAD_R.format(x="grade", n=8) + " || " + _PAD_R.format(x="precision", n=5)
    + " || ' p' || cast(coalesce(nullif(pieces, 0), 1) AS varchar) || ' | ' || concat_ws(' / ', nullif(district, ''), nullif(quarter, ''), nullif(road, ''), 'no ' || nullif(door, ''), 'd' || nullif(flat, '')) AS line FROM w2b"
)


@query("p9_export_row", _LINE, STOPS_SQL, ROUTES_SQL, _W2B)
def _(spark, d):
    return report.export_rows(stops(spark, d), routes(spark, d))


_OF_DAY = "x AS (SELECT d.business_date, d.status, coalesce(n, 0) AS n, coalesce(o, 0) AS o, r.* EXCLUDE (business_date), r.business_date IS NOT NULL AS routed FROM days d LEFT JOIN (SELECT business_date, count(*) AS n, count(seq) AS o FROM stops GROUP BY business_date) c ON c.business_date = d.business_date LEFT JOIN routes r ON r.business_date = d.business_date)"
_HEADING = "'═══ ' || cast(business_date AS varchar) || '  (' || status || ')  ' || n || ' durak' || CASE WHEN NOT routed THEN '' ELSE '  · rotada ' || o || CASE WHEN o < n THEN '  ⚠ ' || (n - o) || ' DURAK ROTA DIŞI' ELSE '' END END"
_ROUTE_LINE = f"CASE WHEN NOT routed THEN '  rota: çıkarılmamış' ELSE '  rota: başlangıç ' || coalesce({_fixed_sql('start_lat', 5)} || ',' || {_fixed_sql('start_lng', 5)}, 'YOK') || '  kaynak=' || coalesce(start_source, '?') || coalesce(' ±' || cast(cast(floor(start_accuracy + 0.5) AS bigint) AS varchar) || 'm', '') || '  mesafe=' || matrix_source || '  yöntem=' || coalesce(method, '?') || '  toplam=' || {_fixed_sql('(total_m / 1000)', 1)} || 'km  zaman=' || built_at END"


@query("s15_export_text", f"SELECT NULL::DATE AS business_date, -4 AS place, 'GÜN KAYDI' AS line UNION ALL SELECT NULL, -3, 'sürüm: 1.0   çıkarma: 2024-02-01T08:00:00.000Z' UNION ALL SELECT business_date, -2, '' FROM x UNION ALL SELECT business_date, -1, {_HEADING} FROM x UNION ALL SELECT business_date, 0, {_ROUTE_LINE} FROM x UNION ALL " + _LINE, STOPS_SQL, ROUTES_SQL, DAYS_SQL, _W2B, _OF_DAY)
def _(spark, d):
    return report.export_text(days(spark, d), stops(spark, d), routes(spark, d), "1.0", "2024-02-01T08:00:00.000Z")


@query("p10_html_escape", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.html_escaped(F.col("text")).cast("binary")).alias("escaped"))


@query("p11_kilometres", f"SELECT business_date, {_fixed_sql('(total_m / 1000)', 1)} AS km FROM routes", STOPS_SQL, ROUTES_SQL)
def _(spark, d):
    return routes(spark, d).select("business_date", text.fixed(F.col("total_m") / 1000, 1).alias("km"))


@query("p12_depot", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 37 + s_suppkey / 1000.0::DOUBLE ELSE 37.760175 END AS lat, CASE WHEN s_suppkey % 4 = 0 THEN 29.1 ELSE 29.042555 END::DOUBLE AS lng FROM supplier")
def _(spark, d):
    """Stored depots: whole ones count, and ones without a number, without a longitude, or null give the default."""
    of = "CASE s_suppkey % 4 WHEN 0 THEN to_json(named_struct('lat', 37 + s_suppkey / 1000.0D, 'lng', 29.1D, 'name', s_name)) WHEN 1 THEN '{\"lat\": \"x\", \"lng\": 29.1}' WHEN 2 THEN '{\"lat\": 37.8}' END"
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", f"{of} AS value")
    return rows.withColumn("p", store.depot(F.col("value"), geo.DEPOT_LAT, geo.DEPOT_LNG)).select("s_suppkey", "p.lat", "p.lng")


@query("p13_route_age", "SELECT event_id, cast(floor(epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 60000000.0 - epoch_us(ts) / 60000000.0 + 0.5) AS bigint) AS minutes, (floor(epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 60000000.0 - epoch_us(ts) / 60000000.0 + 0.5) > 45) OR event_type IN ('purchase', 'error') AS stale FROM events")
def _(spark, d):
    minutes = dates.age_minutes(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, d, "events").select("event_id", minutes.alias("minutes"), dates.is_stale(minutes, F.col("event_type").isin("purchase", "error")).alias("stale"))


# Fields of document text

def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '{text.EDGES}', '', 'g')"


def _first_sql(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns) + ")"


_FIELDS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "x1_doc_no": (text.document_number, _trim_sql(_first_sql(*text.DOC_NO))),
    "x2_phone": (text.phone, _trim_sql(_first_sql(text.PHONE))),
    "x3_recipient": (text.recipient, "nullif(" + _trim_sql(f"regexp_replace({_first_sql(*text.RECIPIENT)}, '{text.WS}{{2,}}', ' ', 'g')") + ", '')"),
    "x4_product": (text.product, _trim_sql(_first_sql(text.PRODUCT))),
    "x5_pieces": (text.pieces, f"coalesce(cast({_first_sql(text.PIECES)} AS int), 1)"),
}
for _name, (_field, _sql) in _FIELDS.items():
    query(_name, f"SELECT o_orderkey, {_sql} AS value FROM invoices", INVOICES_SQL)(lambda spark, d, f=_field: invoices(spark, d).select("o_orderkey", f(F.col("text")).alias("value")))


_SPLIT = f"""bundles AS (SELECT o_custkey, string_split(array_to_string(list_sort(list(text)), chr(10)), chr(10)) AS ls FROM invoices GROUP BY o_custkey),
l AS (SELECT o_custkey, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM bundles),
g AS (SELECT *, sum(regexp_matches(line, '(?i)(?:Belgesi|Teslimat[ \\t]*No|Sipari[Şş][ \\t]*No)[ \\t]*[:.]?[ \\t]*[0-9_]{{6}}')::INT) OVER (PARTITION BY o_custkey ORDER BY i) AS part FROM l),
parts AS (SELECT o_custkey, part, {_trim_sql("string_agg(line, chr(10) ORDER BY i)")} AS text FROM g GROUP BY o_custkey, part)"""


@query("x6_split_documents", "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY part) - 1)::INT AS n, text FROM parts WHERE text <> ''", INVOICES_SQL, _SPLIT)
def _(spark, d):
    bundles = invoices(spark, d).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return bundles.select("o_custkey", F.posexplode(text.documents_of(F.col("text"))).alias("n", "text"))


@query("s13_pasted_text", f"SELECT o_orderkey, length(regexp_replace(text, '{text.WS}', '', 'g')) AS n, {_FIELDS['x1_doc_no'][1]} AS doc_no FROM invoices WHERE length(regexp_replace(text, '{text.WS}', '', 'g')) > 0", INVOICES_SQL)
def _(spark, d):
    n = text.visible_length(F.col("text"))
    return invoices(spark, d).where(n > 0).select("o_orderkey", n.alias("n"), text.document_number(F.col("text")).alias("doc_no"))


# Filters

_KEYS = "SELECT business_date, stop_id FROM stops WHERE "


def _keys(df: DataFrame) -> DataFrame:
    return df.select("business_date", "stop_id")


query("f1_pending", _KEYS + "status = 'pending'", STOPS_SQL)(lambda spark, d: _keys(ledger.pending(stops(spark, d))))
query("f2_has_coordinates", _KEYS + "lat IS NOT NULL", STOPS_SQL)(lambda spark, d: _keys(ledger.placed(stops(spark, d))))
query("f3_off_route", _KEYS + "status = 'pending' AND lat IS NOT NULL AND seq IS NULL AND business_date IN (SELECT business_date FROM routes)", STOPS_SQL, ROUTES_SQL)(lambda spark, d: _keys(ledger.off_route(stops(spark, d), routes(spark, d))))
query("f6_doubtful", _KEYS + "lat IS NOT NULL AND grade <> 'green'", STOPS_SQL)(lambda spark, d: _keys(ledger.doubtful(stops(spark, d))))
query("f13_display_list", f"SELECT business_date, stop_id FROM (SELECT business_date, stop_id, status, row_number() OVER (PARTITION BY business_date, status = 'pending' ORDER BY {_ORDER}) AS n FROM stops) WHERE NOT (status = 'pending' AND n = 1)", STOPS_SQL)(lambda spark, d: _keys(ledger.except_active(stops(spark, d))))


@query("f4_blank_text", f"SELECT doc_id, length(regexp_replace(text, '{text.WS}', '', 'g')) < 12 AS too_short, length(regexp_replace(text, '{text.WS}', '', 'g')) < 6 AS too_short_box FROM documents")
def _(spark, d):
    n = text.visible_length(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (n < 12).alias("too_short"), (n < 6).alias("too_short_box"))


@query("f5_manual_box", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_partkey % 40 >= 12")
def _(spark, d):
    return table(spark, d, "part").where(ocr.box_is_large_enough(F.col("p_size"), F.col("p_partkey") % 40)).select("p_partkey")


@query("f8_same_stop", f"SELECT business_date, stop_id, coalesce(by_number, by_place) AS same_as FROM (SELECT s.business_date, s.stop_id, (SELECT min(t.stop_id) FROM stops t WHERE t.business_date = s.business_date AND t.doc_no = s.doc_no AND t.stop_id < s.stop_id) AS by_number, (SELECT min(t.stop_id) FROM stops t WHERE t.business_date = s.business_date AND t.stop_id < s.stop_id AND {_M.format(a='t.lat', b='s.lat', c='t.lng', d='s.lng')} < 30 AND (t.name IS NULL OR s.name IS NULL OR {_PLAIN.format(c='t.name')} = {_PLAIN.format(c='s.name')})) AS by_place FROM stops s) WHERE coalesce(by_number, by_place) IS NOT NULL", STOPS_SQL)
def _(spark, d):
    return ledger.same_stop(stops(spark, d))


@query("j3_within_30_m", f"WITH p AS (SELECT business_date, lat, lng, min(stop_id) AS stop_id, count(*) AS n FROM stops WHERE lat IS NOT NULL GROUP BY business_date, lat, lng) SELECT business_date, a.stop_id AS a, a.n AS n_a, b.stop_id AS b, b.n AS n_b FROM p a JOIN p b USING (business_date) WHERE a.stop_id < b.stop_id AND {_M.format(a='a.lat', b='b.lat', c='a.lng', d='b.lng')} < 30".replace("WITH p AS", "WITH " + STOPS_SQL + ", p AS"))
def _(spark, d):
    return ledger.near_points(stops(spark, d), 30.0)


_SCALE = "least(2480.0 / w, 4.0, sqrt(4200000.0 / (w * h)))"
_FRAMES = "frames AS (SELECT p_partkey, 400 + (p_partkey * 37) % 4000 AS w, 300 + (p_partkey * 53) % 3000 AS h, p_partkey % 4 * 90 AS turn FROM part)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", "400 + (p_partkey * 37) % 4000 as w", "300 + (p_partkey * 53) % 3000 as h", "p_partkey % 4 * 90 as turn")


@query("f9_zoom_gate", f"SELECT p_partkey, {_SCALE} < 0.95 AS zoom FROM frames", _FRAMES)
def _(spark, d):
    return _frames(spark, d).select("p_partkey", ocr.zoom_helps(F.col("w"), F.col("h")).alias("zoom"))


@query("f10_matrix_gate", f"SELECT business_date, count(*) + 1 <= {route.MATRIX_POINTS} AS within_cap FROM stops WHERE status = 'pending' AND lat IS NOT NULL GROUP BY business_date", STOPS_SQL)
def _(spark, d):
    return route.within_matrix_cap(ledger.placed(ledger.pending(stops(spark, d))), ["business_date"])


@query("f11_live_location_gate", "SELECT business_date FROM days WHERE status = 'open' AND business_date IN (SELECT business_date FROM stops WHERE status = 'pending')", STOPS_SQL, DAYS_SQL)
def _(spark, d):
    waiting = ledger.pending(stops(spark, d)).select("business_date").distinct()
    return days(spark, d).where("status = 'open'").select("business_date").join(waiting, "business_date", "left_semi")


@query("f12_tracking_gate", "SELECT business_date FROM routes WHERE business_date IN (SELECT business_date FROM stops WHERE status = 'pending')", STOPS_SQL, ROUTES_SQL)
def _(spark, d):
    waiting = ledger.pending(stops(spark, d)).select("business_date").distinct()
    return routes(spark, d).select("business_date").join(waiting, "business_date", "left_semi")


# Joins

_ELIGIBLE = "SELECT *, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_key, row_number() OVER (PARTITION BY right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) ORDER BY ts, stop_id) AS pos FROM stops WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 AND lat IS NOT NULL"
_MEMORY = f"""memory AS (
    WITH e AS ({_ELIGIBLE}),
    c AS (SELECT phone_key, min(pos) FILTER (WHERE corrected) AS since FROM e GROUP BY phone_key),
    f AS (SELECT e.*, since IS NULL OR corrected OR pos < since AS may FROM e JOIN c USING (phone_key))
    SELECT phone_key, arg_max(name, pos) FILTER (WHERE name <> '') AS name,
        {', '.join(f"arg_max({c}, pos) FILTER (WHERE may AND {c} <> '') AS {c}" for c in ("district", "quarter", "road", "door", "flat"))},
        arg_max(lat, pos) FILTER (WHERE may) AS lat, arg_max(lng, pos) FILTER (WHERE may) AS lng, arg_max(confidence, pos) FILTER (WHERE may) AS confidence,
        bool_or(corrected) AS corrected, count(*) AS deliveries, min(ts) AS first_seen, max(ts) AS last_seen
    FROM f GROUP BY phone_key)"""


@query("m6_memory_upsert", "SELECT * FROM memory", STOPS_SQL, _MEMORY)
def _(spark, d):
    return memory.learn(stops(spark, d))


@query("m6_memory_grows", "SELECT * FROM memory", STOPS_SQL, _MEMORY)
def _(spark, d):
    """The memory of the first half of the month, brought up to date by the second."""
    rows = stops(spark, d)
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return memory.upsert(memory.learn(rows.where(~late)), rows.where(late))


@query("s7_customers", "SELECT phone_key, name FROM memory", STOPS_SQL, _MEMORY)
def _(spark, d):
    return memory.learn(stops(spark, d)).select("phone_key", "name")


@query("a8_customer_count", "SELECT count(*) AS customers FROM memory", STOPS_SQL, _MEMORY)
def _(spark, d):
    return memory.learn(stops(spark, d)).agg(F.count("*").alias("customers"))


_HIT = "(m.lat IS NOT NULL AND s.confidence < 70)"


@query("j1_memory_recall", f"SELECT s.stop_id, CASE WHEN {_HIT} THEN m.road ELSE s.road END AS road, CASE WHEN {_HIT} THEN coalesce(nullif(m.flat, ''), s.flat) ELSE s.flat END AS flat, CASE WHEN {_HIT} THEN m.lat ELSE s.lat END AS lat, CASE WHEN {_HIT} THEN greatest(s.confidence, CASE WHEN m.corrected THEN 100 ELSE 85 END) ELSE s.confidence END AS confidence, CASE WHEN {_HIT} THEN 'green' ELSE s.grade END AS grade, array_to_string(CASE WHEN {_HIT} THEN ['Adres hafızadan geldi — bu müşteriye daha önce ' || m.deliveries || ' kez gidilmiş'] ELSE s.warnings END, ';') AS warnings, {_HIT} AS from_memory FROM stops s LEFT JOIN memory m ON CASE WHEN length(regexp_replace(s.phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(s.phone, '[^0-9]', '', 'g'), 10) END = m.phone_key", STOPS_SQL, _MEMORY)
def _(spark, d):
    rows = stops(spark, d)
    return memory.recall(rows, memory.learn(rows)).select("stop_id", "road", "flat", "lat", "confidence", "grade", F.array_join("warnings", ";").alias("warnings"), "from_memory")


@query("j2_named_districts", f"SELECT DISTINCT o_orderkey, oid, name FROM (SELECT o_orderkey, unnest(string_split({_FOLD.format(c='text')}, ' ')) AS word FROM invoices) JOIN districts ON word = search_key WHERE oid NOT IN (10, 14)", INVOICES_SQL, DISTRICTS_SQL)
def _(spark, d):
    loaded = spark.createDataFrame([(10,), (14,)], "oid int")
    return gazetteer.named_districts(invoices(spark, d), districts(spark), "o_orderkey", "text", loaded)


@query("s10_gazetteer_districts", f"SELECT oid, count(DISTINCT o_orderkey) AS texts FROM (SELECT o_orderkey, unnest(string_split({_FOLD.format(c='text')}, ' ')) AS word FROM invoices) JOIN districts ON word = search_key GROUP BY oid", INVOICES_SQL, DISTRICTS_SQL)
def _(spark, d):
    return gazetteer.named_districts(invoices(spark, d), districts(spark), "o_orderkey", "text").groupBy("oid").agg(F.count_distinct("o_orderkey").alias("texts"))


def _packages(spark: SparkSession, d: str) -> str:
    """The folder of a written gazetteer, a package for each district: the addresses of the stops."""
    folder = f"{store.own_folder(spark)}/gazetteer"
    store.write_gazetteer(stops(spark, d).selectExpr("cast(user_id % 19 + 1 AS int) AS oid", "quarter", "road", "door").distinct(), folder)
    return folder


_PACKAGES = "packages AS (SELECT DISTINCT cast(user_id % 19 + 1 AS int) AS oid, quarter, road, door FROM stops)"


@query("s11_preload", "SELECT oid, name, count(*) AS addresses FROM packages JOIN districts USING (oid) WHERE oid IN (10, 14) GROUP BY oid, name", STOPS_SQL, DISTRICTS_SQL, _PACKAGES)
def _(spark, d):
    """The packages of the two central districts, loaded before any text comes."""
    loaded = store.read_districts(spark, _packages(spark, d), districts(spark).where("oid in (10, 14)"))
    return loaded.groupBy("oid").agg(F.count("*").alias("addresses")).join(districts(spark), "oid").select("oid", "name", "addresses")


@query("s10_pruned_read", f"SELECT oid, count(*) AS addresses FROM packages WHERE oid IN (SELECT oid FROM (SELECT unnest(string_split({_FOLD.format(c='text')}, ' ')) AS word FROM invoices) JOIN districts ON word = search_key) GROUP BY oid", STOPS_SQL, INVOICES_SQL, DISTRICTS_SQL, _PACKAGES)
def _(spark, d):
    """The packages of the districts that texts name: the others' files aren't opened."""
    named = gazetteer.named_districts(invoices(spark, d), districts(spark), "o_orderkey", "text")
    return store.read_districts(spark, _packages(spark, d), named).groupBy("oid").agg(F.count("*").alias("addresses"))


_REROUTE = "orders_ AS (SELECT business_date, list(stop_id ORDER BY confidence DESC, stop_id) AS stop_ids FROM stops WHERE status = 'pending' AND lat IS NOT NULL AND day(business_date) % 2 = 0 GROUP BY business_date)"


def _reroute(rows: DataFrame) -> DataFrame:
    key = F.struct((-F.col("confidence")).alias("c"), F.col("stop_id"))
    chosen = rows.where("status = 'pending' and lat is not null and day(business_date) % 2 = 0")
    return chosen.groupBy("business_date").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["stop_id"]).alias("stop_ids"))


_M5 = "SELECT business_date, stop_id, CASE WHEN stop_ids IS NULL THEN seq ELSE nullif(list_position(stop_ids, stop_id), 0) END AS seq FROM stops LEFT JOIN orders_ USING (business_date)"


@query("m5_save_route", _M5, STOPS_SQL, _REROUTE)
def _(spark, d):
    rows = stops(spark, d)
    return ledger.save_route(rows, _reroute(rows)).select("business_date", "stop_id", "seq")


@query("j4_route_to_stops", "SELECT business_date, stop_id, pos FROM (SELECT business_date, unnest(stop_ids) AS stop_id, generate_subscripts(stop_ids, 1) AS pos FROM orders_)", STOPS_SQL, _REROUTE)
def _(spark, d):
    return _reroute(stops(spark, d)).select("business_date", F.posexplode("stop_ids").alias("p", "stop_id")).select("business_date", "stop_id", (F.col("p") + 1).alias("pos"))


query("w7_route_position", f"SELECT business_date, stop_id, seq FROM ({_M5}) WHERE seq IS NOT NULL", STOPS_SQL, _REROUTE)(lambda spark, d: QUERIES["m5_save_route"](spark, d).where("seq is not null"))


@query("j6_points_matrix", f"WITH p AS (SELECT *, count(*) OVER (PARTITION BY business_date, district) + 1 AS points FROM stops WHERE status = 'pending' AND lat IS NOT NULL) SELECT business_date, district, a.stop_id AS a, b.stop_id AS b, {_metres('a.lat', 'b.lat', 'a.lng', 'b.lng')} AS metres FROM p a JOIN p b USING (business_date, district) WHERE a.stop_id <> b.stop_id AND a.points <= {route.MATRIX_POINTS}".replace("WITH p AS", "WITH " + STOPS_SQL + ", p AS"))
def _(spark, d):
    # a route for each day and district: most days have more points than one matrix may hold
    rows = ledger.placed(ledger.pending(stops(spark, d)))
    return route.points_matrix(rows, ["business_date", "district"]).withColumn("metres", _whole(F.col("metres")))


_RESOLVED = f"""places AS (SELECT district, quarter, road, door, min(lat) AS lat, min(lng) AS lng FROM stops WHERE lat IS NOT NULL AND door IS NOT NULL GROUP BY district, quarter, road, door),
g AS (SELECT {', '.join(f"{_FOLD.format(c=c)} AS g_{c}" for c in ('district', 'quarter', 'road', 'door'))}, quarter, road, door, lat, lng FROM places),
q AS (SELECT stop_id, {', '.join(f"coalesce({_FOLD.format(c=c)}, '') AS q_{c}" for c in ('district', 'quarter', 'new_road', 'door'))} FROM (SELECT *, CASE WHEN stop_id % 4 = 0 THEN road || 'x' WHEN stop_id % 4 = 1 THEN 'x' || substr(road, 2) ELSE road END AS new_road FROM stops)),
pairs AS (SELECT stop_id, g.*, levenshtein(q_new_road, g_road) / greatest(length(g_road), 1)::DOUBLE AS road_off, levenshtein(q_quarter, g_quarter) / greatest(length(g_quarter), 1)::DOUBLE AS quarter_off, q_quarter, q_door = g_door AND q_door <> '' AS same_door FROM q JOIN g ON q_district = g_district),
judged AS (SELECT *, floor(40 * (1 - road_off) + CASE WHEN q_quarter = '' THEN 0 ELSE 30 * (1 - quarter_off) END + CASE WHEN same_door THEN 30 ELSE 0 END)::INT AS confidence FROM pairs WHERE road_off <= 0.25 AND (quarter_off <= 0.25 OR q_quarter = '')),
best AS (SELECT stop_id, max({{'confidence': confidence, 'quarter': quarter, 'road': road, 'door': door, 'lat': lat, 'lng': lng, 'precision': CASE WHEN same_door THEN 'kapi' ELSE 'yol' END}}) AS b FROM judged GROUP BY stop_id)"""


@query("j7_resolve_address", "SELECT stop_id, b.lat AS lat, b.lng AS lng, coalesce(b.confidence, 0) AS confidence, coalesce(b.precision, 'yok') AS precision, CASE WHEN coalesce(b.confidence, 0) >= 80 THEN 'green' WHEN coalesce(b.confidence, 0) >= 50 THEN 'yellow' ELSE 'red' END AS grade FROM stops LEFT JOIN best USING (stop_id)", STOPS_SQL, _RESOLVED)
def _(spark, d):
    road = F.when(F.col("stop_id") % 4 == 0, F.concat("road", F.lit("x"))).when(F.col("stop_id") % 4 == 1, F.concat(F.lit("x"), F.substr("road", F.lit(2)))).otherwise(F.col("road"))
    return gazetteer.resolve(stops(spark, d).select("stop_id", "district", "quarter", road.alias("road"), "door"), _places(spark, d), "stop_id")


def _places(spark: SparkSession, d: str) -> DataFrame:
    rows = stops(spark, d).where("lat is not null and door is not null")
    return rows.groupBy("district", "quarter", "road", "door").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))


_GRADE = "CASE WHEN {c} >= 80 THEN 'green' WHEN {c} >= 50 THEN 'yellow' ELSE 'red' END"
_FREE = f"""places AS (SELECT district, quarter, road, door, min(lat) AS lat, min(lng) AS lng FROM stops WHERE lat IS NOT NULL AND door IS NOT NULL GROUP BY district, quarter, road, door),
g AS (SELECT {', '.join(f"{_FOLD.format(c=c)} AS g_{c}" for c in ('district', 'quarter', 'road', 'door'))}, {{'district': district, 'quarter': quarter, 'road': road, 'door': door, 'lat': lat, 'lng': lng}} AS place FROM places),
t AS (SELECT o_orderkey, words AS ocr, string_split({_FOLD.format(c='text')}, ' ') AS ws FROM letters),
i AS (SELECT o_orderkey, ws, unnest(range(1, len(ws) + 1)) AS pos_ FROM t),
grams AS (SELECT o_orderkey, pos_, n, array_to_string(ws[pos_ : pos_ + n - 1], ' ') AS name, ws[pos_ + n : pos_ + n + 3] AS after FROM i, (VALUES (1), (2)) AS v(n) WHERE pos_ + n - 1 <= len(ws)),
qs AS (SELECT DISTINCT o_orderkey, name FROM grams WHERE name IN (SELECT g_quarter FROM g)),
ds AS (SELECT DISTINCT o_orderkey, name FROM grams WHERE name IN (SELECT g_district FROM g)),
rs AS (SELECT o_orderkey, name AS g_road, pos_, list_filter(after, lambda w: regexp_matches(w, '^[0-9]+[a-z]?$'))[1] AS g_door, pos_ + n + list_position(list_transform(after, lambda w: regexp_matches(w, '^[0-9]+[a-z]?$')), true) - 1 AS door_at FROM grams WHERE name IN (SELECT g_road FROM g)),
homes AS (SELECT g_district, g_quarter, g_road, max(place) AS road_place FROM g GROUP BY ALL),
doors AS (SELECT g_district, g_quarter, g_road, g_door, max(place) AS door_there FROM g GROUP BY ALL),
tried AS (
    SELECT rs.*, door_there, coalesce(door_there, road_place) AS p, 40 + CASE WHEN qs.name IS NULL THEN 0 ELSE 30 END + CASE WHEN door_there IS NULL THEN 0 ELSE 30 END - CASE WHEN ds.name IS NULL THEN 10 ELSE 0 END AS confidence
    FROM rs JOIN homes USING (g_road) LEFT JOIN qs ON qs.o_orderkey = rs.o_orderkey AND qs.name = g_quarter LEFT JOIN ds ON ds.o_orderkey = rs.o_orderkey AND ds.name = g_district LEFT JOIN doors USING (g_district, g_quarter, g_road, g_door)
    WHERE qs.name IS NOT NULL OR ds.name IS NOT NULL
),
best AS (SELECT o_orderkey, max({{'confidence': confidence, 'first': -pos_, 'district': p.district, 'quarter': p.quarter, 'road': p.road, 'door': CASE WHEN door_there IS NOT NULL THEN p.door END, 'lat': p.lat, 'lng': p.lng, 'g_door': CASE WHEN door_there IS NOT NULL THEN g_door END, 'door_at': door_at}}) AS b FROM tried GROUP BY o_orderkey),
read AS (
    SELECT t.*, b, flatten(list_transform(ocr, lambda w: list_transform(string_split({_FOLD.format(c="w['text']")}, ' '), lambda x: {{'t': x, 'c': w['confidence']}}))) AS tokens, len(list_filter(ws[1 : b.door_at], lambda w: w = b.g_door)) AS place
    FROM t LEFT JOIN best USING (o_orderkey)
),
resolved AS (
    SELECT o_orderkey, b.district AS district, b.quarter AS quarter, b.road AS road, b.door AS door, b.lat AS lat, b.lng AS lng, coalesce(b.confidence, 0) AS confidence, CASE WHEN b.g_door IS NOT NULL THEN 'kapi' WHEN b IS NOT NULL THEN 'yol' ELSE 'yok' END AS precision,
        {_GRADE.format(c='coalesce(b.confidence, 0)')} AS grade, list_filter(tokens, lambda x: x.t = b.g_door)[place].c AS door_confidence
    FROM read
)"""


@query("j7_free_text", "SELECT * EXCLUDE (door_confidence) FROM resolved", STOPS_SQL, LETTERS_SQL, _FREE)
def _(spark, d):
    return gazetteer.resolve_texts(letters(spark, d).drop("ts"), _places(spark, d), "o_orderkey")


@query("j7_ocr_words", "SELECT * REPLACE (CASE WHEN grade = 'green' AND door_confidence < 70 THEN 'yellow' ELSE grade END AS grade) FROM resolved", STOPS_SQL, LETTERS_SQL, _FREE)
def _(spark, d):
    return gazetteer.resolve_texts(letters(spark, d).drop("ts"), _places(spark, d), "o_orderkey", ocr_words="words")


# The whole way of a text

#: What is remembered of customers' phones, as the letters have them: of several customers the one with the least key.
_KNOWN = """known AS (
    SELECT '532' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '4567' AS phone_key, min(c_custkey) AS k FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1
),
remembered AS (SELECT phone_key, 'Mahalle ' || k % 12 AS quarter, 'Yol ' || k % 30 AS road, 37 + k / 100000.0::DOUBLE AS lat, k % 2 = 0 AS corrected FROM known WHERE k % 5 <> 0)"""


def _remembered(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").groupBy(F.expr("concat('532', lpad(c_custkey % 1000, 3, '0'), '4567')").alias("phone_key")).agg(F.min("c_custkey").alias("k"))
    return known.selectExpr(
        "phone_key", "concat('İlçe ', k % 19) AS district", "concat('Mahalle ', k % 12) AS quarter", "concat('Yol ', k % 30) AS road", "cast(k % 90 AS string) AS door", "cast(NULL AS string) AS flat",
        "CASE WHEN k % 5 <> 0 THEN 37 + k / 100000.0D END AS lat", "29.0D AS lng", "k % 2 = 0 AS corrected", "k % 4 + 1 AS deliveries",
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return letters(spark, d).select("o_orderkey", "ts", "text")


_KEPT = "(m.phone_key IS NOT NULL AND r.confidence < 70)"


@query(
    "chain_texts_to_scans",
    f"SELECT business_date, o_orderkey, doc_no, name, pieces, CASE WHEN {_KEPT} THEN m.quarter ELSE r.quarter END AS quarter, CASE WHEN {_KEPT} THEN m.road ELSE r.road END AS road, CASE WHEN {_KEPT} THEN m.lat ELSE r.lat END AS lat, CASE WHEN {_KEPT} THEN 'kapi' ELSE precision END AS precision, CASE WHEN {_KEPT} THEN greatest(r.confidence, CASE WHEN corrected THEN 100 ELSE 85 END) ELSE r.confidence END AS confidence, CASE WHEN {_KEPT} THEN 'green' ELSE grade END AS grade, {_KEPT} AS from_memory "
    f"FROM (SELECT o_orderkey, cast(o_orderdate - INTERVAL 4 HOUR AS date) AS business_date, {_FIELDS['x1_doc_no'][1]} AS doc_no, {_FIELDS['x3_recipient'][1]} AS name, {_FIELDS['x5_pieces'][1]} AS pieces, right(regexp_replace({_FIELDS['x2_phone'][1]}, '[^0-9]', '', 'g'), 10) AS phone_key FROM letters JOIN orders USING (o_orderkey)) s "
    "JOIN resolved r USING (o_orderkey) LEFT JOIN remembered m USING (phone_key)",
    STOPS_SQL,
    LETTERS_SQL,
    _FREE,
    _KNOWN,
)
def _(spark, d):
    """Every letter's fields and address, or the remembered one."""
    found = intake.scans_of_texts(_texts(spark, d), _places(spark, d), _remembered(spark, d), "o_orderkey")
    return found.select("business_date", "o_orderkey", "doc_no", "name", "pieces", "quarter", "road", "lat", "precision", "confidence", "grade", "from_memory")


query("chain_texts_to_stops")(lambda spark, d: intake.stops_of_texts(_texts(spark, d), _places(spark, d), _remembered(spark, d), "o_orderkey"))


# Aggregations

_SUMMARY = "summary AS (SELECT business_date, count(*) AS total, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, sum(coalesce(nullif(pieces, 0), 1))::BIGINT AS pieces, count(*) FILTER (WHERE grade = 'red') AS red, count(*) FILTER (WHERE grade = 'yellow') AS yellow FROM stops GROUP BY business_date)"


@query("a1_day_summary", "SELECT business_date, status, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total", "delivered", "failed", "pending", "pieces", "red", "yellow")) + " FROM days LEFT JOIN summary USING (business_date)", STOPS_SQL, DAYS_SQL, _SUMMARY)
def _(spark, d):
    return ledger.day_summary(days(spark, d), stops(spark, d))


query("a2_route_counts", "SELECT business_date, count(seq) AS on_route, count(*) - count(seq) AS off_route FROM stops GROUP BY business_date", STOPS_SQL)(lambda spark, d: ledger.route_counts(stops(spark, d)))
query("a3_best_confidence", "SELECT l_orderkey, max(l_quantity) AS confidence FROM lineitem GROUP BY l_orderkey")(lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("confidence")))

_NEAREST = f"near AS (SELECT business_date, stop_id, seq, {_M.format(a='start_lat', b='lat', c='start_lng', d='lng')} AS m, count(*) OVER (PARTITION BY business_date) AS n, min(seq) OVER (PARTITION BY business_date) AS first_seq FROM stops JOIN routes USING (business_date) WHERE seq IS NOT NULL AND lat IS NOT NULL AND start_lat IS NOT NULL)"


@query("a4_nearest_to_start", "SELECT business_date, stop_id, seq, cast(floor(m + 0.5) AS bigint) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY floor(m * 1000), seq) AS k FROM near) WHERE k = 1 AND n > 2 AND seq <> first_seq", STOPS_SQL, ROUTES_SQL, _NEAREST)
def _(spark, d):
    return ledger.nearest_to_start(stops(spark, d), routes(spark, d))


_POINTS = f"CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 WHEN len(words) = 0 THEN length(regexp_replace(text, '[^{ocr.LETTERS}]', '', 'g')) / 20 ELSE len(list_filter(words, lambda w: w.confidence >= 70 AND regexp_matches(w.text, '[{ocr.LETTERS}]{{3,}}')))::DOUBLE END"
query("a5_readable_words", f"SELECT doc_id, attempt, {_POINTS} AS points FROM readings", READINGS_SQL)(lambda spark, d: readings(spark, d).select("doc_id", "attempt", ocr.readable_words(F.col("text"), F.col("words")).alias("points")))

_PIXELS = "pixels AS (SELECT l_suppkey, (299 * (l_partkey * 7 % 256) + 587 * (l_orderkey % 256) + 114 * (l_linenumber * 30)) // 1000 AS grey FROM lineitem)"
_HIST = "hist AS (SELECT l_suppkey, grey, count(*) AS n FROM pixels GROUP BY l_suppkey, grey)"
_CLIP = "clip AS (SELECT l_suppkey, min(grey) FILTER (WHERE up > 0.02 * total) AS low, max(grey) FILTER (WHERE down > 0.02 * total) AS high FROM (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY grey) AS up, sum(n) OVER (PARTITION BY l_suppkey ORDER BY grey DESC) AS down, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM hist) GROUP BY l_suppkey)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_suppkey", ocr.grey(F.col("l_partkey") * 7 % 256, F.col("l_orderkey") % 256, F.col("l_linenumber") * 30).alias("grey"))


query("a6_grey_histogram", "SELECT * FROM hist", _PIXELS, _HIST)(lambda spark, d: ocr.histogram(_pixels(spark, d), "l_suppkey", "grey"))
query("w4_clip_levels", "SELECT * FROM clip", _PIXELS, _HIST, _CLIP)(lambda spark, d: ocr.clip_levels(ocr.histogram(_pixels(spark, d), "l_suppkey", "grey"), "l_suppkey", "grey"))


@query("i5_grey_stretch", "SELECT l_suppkey, grey, CASE WHEN high - low > 8 THEN least(255, greatest(0, round_even((grey - low) * (255.0::DOUBLE / (high - low)), 0)))::INT ELSE grey END AS stretched, n FROM hist JOIN clip USING (l_suppkey)", _PIXELS, _HIST, _CLIP)
def _(spark, d):
    hist = ocr.histogram(_pixels(spark, d), "l_suppkey", "grey")
    rows = hist.join(ocr.clip_levels(hist, "l_suppkey", "grey"), "l_suppkey")
    return rows.select("l_suppkey", "grey", ocr.stretched(F.col("grey"), F.col("low"), F.col("high")).alias("stretched"), "n")


query("a7_archive", "SELECT business_date, status, coalesce(total, 0) AS total, coalesce(delivered, 0) AS delivered, coalesce(failed, 0) AS failed, floor(total_m / 1000 * 10 + 0.5) / 10 AS km FROM days LEFT JOIN summary USING (business_date) LEFT JOIN routes USING (business_date)", STOPS_SQL, DAYS_SQL, ROUTES_SQL, _SUMMARY)(lambda spark, d: ledger.archive(days(spark, d), stops(spark, d), routes(spark, d)))

# Windows

query("w1_stop_order", f"SELECT business_date, stop_id, row_number() OVER (PARTITION BY business_date ORDER BY {_ORDER}) AS place FROM stops", STOPS_SQL)(lambda spark, d: ledger.in_order(stops(spark, d)).select("business_date", "stop_id", "place"))

_LAG = "lag({c}) OVER (PARTITION BY business_date ORDER BY seq, stop_id)"


@query("w2_legs", f"SELECT business_date, stop_id, seq, {_metres('b_lat', 'lat', 'b_lng', 'lng')} AS metres FROM (SELECT s.*, coalesce({_LAG.format(c='lat')}, start_lat) AS b_lat, coalesce({_LAG.format(c='lng')}, start_lng) AS b_lng FROM (SELECT * FROM stops WHERE seq IS NOT NULL AND lat IS NOT NULL) s LEFT JOIN routes USING (business_date))", STOPS_SQL, ROUTES_SQL)
def _(spark, d):
    return ledger.legs(stops(spark, d), routes(spark, d)).withColumn("metres", _whole(F.col("metres")))


query("w2b_export_legs", "SELECT business_date, stop_id, place, cast(floor(leg_m + 0.5) AS bigint) AS metres FROM w2b", STOPS_SQL, ROUTES_SQL, _W2B)(lambda spark, d: ledger.export_legs(stops(spark, d), routes(spark, d)).select("business_date", "stop_id", "place", _whole(F.col("leg_m")).alias("metres")))
_SAME = "SELECT business_date, stop_id, CASE WHEN lat IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY business_date, floor(lat * 100000 + 0.5), floor(lng * 100000 + 0.5)) END AS same_address FROM stops"
query("w3_same_address", _SAME, STOPS_SQL)(lambda spark, d: ledger.same_address(stops(spark, d)).select("business_date", "stop_id", "same_address"))
query("j5_same_coordinate", f"SELECT * FROM ({_SAME}) WHERE same_address > 1", STOPS_SQL)(lambda spark, d: QUERIES["w3_same_address"](spark, d).where("same_address > 1"))
query("w5_next_pending", f"SELECT business_date, stop_id FROM (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY {_ORDER}) AS n FROM stops WHERE status = 'pending') WHERE n = 1", STOPS_SQL)(lambda spark, d: _keys(ledger.next_pending(stops(spark, d))))
query("w6_last_handled_order", f"SELECT business_date, stop_id FROM (SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY seq DESC NULLS FIRST, stop_id DESC) AS n FROM stops WHERE status <> 'pending' AND lat IS NOT NULL) WHERE n = 1", STOPS_SQL)(lambda spark, d: _keys(ledger.last_handled(stops(spark, d))))
query("w6_last_handled_finished", "SELECT business_date, arg_max(stop_id, (ts, stop_id)) AS stop_id FROM stops WHERE status <> 'pending' AND lat IS NOT NULL GROUP BY business_date", STOPS_SQL)(lambda spark, d: _keys(ledger.last_handled(stops(spark, d).withColumn("finished_at", F.col("ts")), by_finish=True)))


@query("w8_best_reading", "SELECT doc_id, attempt, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, attempt) AS k FROM (SELECT *, coalesce(max(confidence) OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 70, false) AS done FROM readings) WHERE NOT done) WHERE k = 1", READINGS_SQL)
def _(spark, d):
    return ocr.best_reading(readings(spark, d).select("doc_id", "attempt", "confidence"), "doc_id", score="confidence")


query("w9_top_two_regions", "SELECT doc_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, attempt) AS k FROM readings) WHERE k <= 2", READINGS_SQL)(lambda spark, d: gazetteer.best_per_group(readings(spark, d).select("doc_id", "attempt", "confidence"), "doc_id", [F.desc("confidence"), F.col("attempt")], 2).select("doc_id", "attempt"))

# Changes of the ledger

query("m1_merge_scans")(lambda spark, d: merge.merge_scans(merge.scans(stops(spark, d))))


@query("m1_merge_by_number", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY business_date, doc_no ORDER BY ts, stop_id) AS pos FROM stops WHERE doc_no IS NOT NULL AND lat IS NOT NULL) SELECT business_date, doc_no, arg_max(name, pos) FILTER (WHERE name <> '') AS name, arg_max(phone, pos) FILTER (WHERE phone <> '') AS phone, max(coalesce(nullif(pieces, 0), 1)) AS pieces, max(confidence) AS confidence, arg_max(lat, confidence * 1000000 - pos) AS lat, arg_max(lng, confidence * 1000000 - pos) AS lng, arg_max(precision, confidence * 1000000 - pos) AS precision, arg_max(grade, confidence * 1000000 - pos) AS grade, count(*) AS frames FROM x GROUP BY business_date, doc_no".replace("WITH x AS", "WITH " + STOPS_SQL + ", x AS"))
def _(spark, d):
    return merge.by_document_number(merge.scans(stops(spark, d)))


query("m2_delete_stops", "SELECT business_date, stop_id, seq FROM stops WHERE stop_id % 5 <> 0", STOPS_SQL)(lambda spark, d: ledger.delete_stops(stops(spark, d), stops(spark, d).where("stop_id % 5 = 0")).select("business_date", "stop_id", "seq"))


@query("m3_correct_stops", "SELECT business_date, stop_id, CASE WHEN stop_id % 7 = 0 THEN NULL ELSE flat END AS flat, CASE WHEN stop_id % 7 = 0 THEN 'Yeni Yol' ELSE road END AS road, CASE WHEN stop_id % 7 = 0 THEN 9 ELSE pieces END AS pieces, CASE WHEN stop_id % 7 = 0 THEN NULL ELSE lat END AS lat, corrected OR stop_id % 7 = 0 AS corrected, CASE WHEN stop_id % 7 = 0 THEN 'green' ELSE grade END AS grade, CASE WHEN stop_id % 7 = 0 THEN 100 ELSE confidence END AS confidence, CASE WHEN stop_id % 7 = 0 THEN TIMESTAMP '2024-02-01 08:00:00' ELSE updated_at END AS updated_at FROM stops", STOPS_SQL)
def _(spark, d):
    rows = stops(spark, d)
    overlay = F.create_map(F.lit("road"), F.lit("Yeni Yol"), F.lit("flat"), F.lit(None).cast("string"), F.lit("pieces"), F.lit("9"), F.lit("lat"), F.lit(None).cast("string"))
    fixes = rows.where("stop_id % 7 = 0").select("business_date", "stop_id", overlay.alias("fields"))
    return ledger.correct_stops(rows, fixes, F.lit("2024-02-01 08:00:00").cast("timestamp_ntz")).select("business_date", "stop_id", "flat", "road", "pieces", "lat", "corrected", "grade", "confidence", "updated_at")


@query("m4_set_status", "SELECT business_date, stop_id, CASE WHEN stop_id % 4 = 0 THEN CASE WHEN stop_id % 8 = 0 THEN 'failed' ELSE 'delivered' END ELSE status END AS status, CASE WHEN stop_id % 8 = 0 THEN 'closed' WHEN stop_id % 4 <> 0 THEN status_reason END AS status_reason, CASE WHEN stop_id % 4 = 0 THEN ts ELSE finished_at END AS finished_at, CASE WHEN stop_id % 4 = 0 THEN ts ELSE updated_at END AS updated_at FROM stops", STOPS_SQL)
def _(spark, d):
    rows = stops(spark, d)
    return ledger.set_status(rows, _changes(rows)).select("business_date", "stop_id", "status", "status_reason", "finished_at", "updated_at")


def _changes(rows: DataFrame) -> DataFrame:
    eighth = F.col("stop_id") % 8 == 0
    last = rows.where("stop_id % 4 = 0").select("business_date", "stop_id", F.when(eighth, "failed").otherwise("delivered").alias("new_status"), F.when(eighth, "closed").otherwise("").alias("reason"), F.col("ts").alias("at"))
    earlier = last.select("business_date", "stop_id", F.lit("pending").alias("new_status"), F.lit("x").alias("reason"), (F.col("at") - F.expr("interval 1 hour")).alias("at"))
    return last.unionByName(earlier)


@query("m4_delivered_to_memory", "SELECT phone_key, deliveries, last_seen FROM memory", STOPS_SQL.replace("FROM events)", "FROM events WHERE event_id % 8 = 4)"), _MEMORY)
def _(spark, d):
    rows = stops(spark, d)
    return memory.learn(ledger.deliveries(rows, _changes(rows))).select("phone_key", "deliveries", "last_seen")


@query("m7_customer_note", "SELECT phone_key, CASE WHEN x.k IS NOT NULL THEN 'note ' || x.k END AS note FROM memory LEFT JOIN (SELECT DISTINCT right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS k FROM stops WHERE user_id % 2 = 0 AND length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10) x ON k = phone_key", STOPS_SQL, _MEMORY)
def _(spark, d):
    rows = stops(spark, d)
    notes = rows.where("user_id % 2 = 0").select("phone", F.concat(F.lit("note "), text.phone_key(F.col("phone"))).alias("note"), F.col("ts").alias("at"))
    return memory.annotate(memory.learn(rows), notes).select("phone_key", "note")


_DATED = "dated AS (SELECT business_date, status, business_date + INTERVAL 8 HOUR AS opened_at, CASE WHEN status = 'closed' THEN business_date + INTERVAL 20 HOUR END AS closed_at, CASE WHEN day(business_date) % 3 <> 0 THEN 'old' END AS note FROM days)"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("business_date").cast("timestamp_ntz")
    closed = F.when(F.col("status") == "closed", start + F.expr("interval 20 hours"))
    return days(spark, d).select("business_date", "status", (start + F.expr("interval 8 hours")).alias("opened_at"), closed.alias("closed_at"), F.when(F.dayofmonth("business_date") % 3 != 0, "old").alias("note"))


_AT = "2024-02-01 08:00:00"


def _now() -> Column:
    return F.lit(_AT).cast("timestamp_ntz")


@query("m8_open_day", f"SELECT business_date, 'closed' AS status, CASE WHEN status = 'open' THEN TIMESTAMP '{_AT}' ELSE closed_at END AS closed_at, CASE WHEN status = 'open' THEN coalesce(note, '') || '{ledger.CLOSED_NOTE}' ELSE note END AS note FROM dated UNION ALL SELECT DATE '2024-02-01', 'open', NULL, NULL", STOPS_SQL, DAYS_SQL, _DATED)
def _(spark, d):
    return ledger.open_day(_dated(spark, d), F.lit("2024-02-01").cast("date"), _now()).select("business_date", "status", "closed_at", "note")


query("r4_day_rollover", "SELECT business_date, CASE WHEN business_date = DATE '2024-02-01' THEN 'open' ELSE 'closed' END AS status FROM (SELECT business_date FROM days UNION ALL SELECT DATE '2024-02-01')", STOPS_SQL, DAYS_SQL)(lambda spark, d: ledger.open_day(_dated(spark, d), dates.business_date(F.lit("2024-02-02 03:59:59").cast("timestamp_ntz")), _now()).select("business_date", "status"))


@query("m9_close_day", f"SELECT business_date, CASE WHEN day(business_date) IN (10, 11) THEN 'closed' ELSE status END AS status, CASE WHEN day(business_date) IN (10, 11) THEN TIMESTAMP '{_AT}' ELSE closed_at END AS closed_at, CASE WHEN day(business_date) = 10 THEN 'done' ELSE note END AS note FROM dated", STOPS_SQL, DAYS_SQL, _DATED)
def _(spark, d):
    rows = ledger.close_day(_dated(spark, d), F.lit("2024-01-10").cast("date"), _now(), F.lit("done"))
    return ledger.close_day(rows, F.lit("2024-01-11").cast("date"), _now(), F.lit("")).select("business_date", "status", "closed_at", "note")


query("m10_reopen_day", "SELECT business_date, CASE WHEN day(business_date) = 10 THEN 'open' ELSE status END AS status, CASE WHEN day(business_date) <> 10 THEN closed_at END AS closed_at FROM dated", STOPS_SQL, DAYS_SQL, _DATED)(lambda spark, d: ledger.reopen_day(_dated(spark, d), F.lit("2024-01-10").cast("date")).select("business_date", "status", "closed_at"))
query("m11_save_day", "SELECT business_date, CASE WHEN day(business_date) = 10 THEN 'saved' ELSE status END AS status FROM days", STOPS_SQL, DAYS_SQL)(lambda spark, d: ledger.upsert(days(spark, d), days(spark, d).where("day(business_date) = 10").select("business_date", F.lit("saved").alias("status"), F.lit(1).alias("at")), ["business_date"], "at"))


@query("m12_join_readings", "SELECT a.doc_id, md5(a.text || chr(10) || coalesce(b.text, '')) AS text_md5, greatest(a.confidence, b.confidence) AS confidence, len(a.words) + len(b.words) AS n, len(string_split(a.text, chr(10))) + len(string_split(b.text, chr(10))) AS n_lines FROM readings a JOIN readings b ON a.doc_id = b.doc_id AND a.attempt = 0 AND b.attempt = 1", READINGS_SQL)
def _(spark, d):
    # words and lines are made from texts once these have met
    rows = plain_readings(spark, d)
    pairs = rows.where("attempt = 0").join(rows.where("attempt = 1").select("doc_id", *[F.col(c).alias(f"other_{c}") for c in ("attempt", "text", "confidence")]).hint("merge"), "doc_id")

    def reading(of: str) -> Column:
        lines = F.transform(F.split(of + "text", "\n"), lambda x: F.struct(x.alias("text")))
        return F.struct(F.col(of + "text").alias("text"), F.col(of + "confidence").alias("confidence"), read_words(of + "text", of + "attempt").alias("words"), lines.alias("lines"))

    both = pairs.withColumn("j", ocr.joined(reading(""), reading("other_")))
    return both.select("doc_id", F.md5(F.col("j.text").cast("binary")).alias("text_md5"), "j.confidence", F.size("j.words").cast("bigint").alias("n"), F.size("j.lines").cast("bigint").alias("n_lines"))


query("m13_auto_reopen", "SELECT business_date, CASE WHEN hit THEN 'open' ELSE status END AS status, CASE WHEN NOT hit THEN closed_at END AS closed_at FROM (SELECT *, status = 'closed' AND business_date IN (SELECT business_date FROM stops WHERE stop_id % 500 = 3) AS hit FROM dated)", STOPS_SQL, DAYS_SQL, _DATED)(lambda spark, d: ledger.reopened_by_scans(_dated(spark, d), stops(spark, d).where("stop_id % 500 = 3")).select("business_date", "status", "closed_at"))
query("m14_silent_reroute", "SELECT DISTINCT business_date FROM x WHERE status = 'pending' AND lat IS NOT NULL AND seq IS NULL AND business_date IN (SELECT business_date FROM routes) AND business_date NOT IN (SELECT business_date FROM x WHERE status <> 'pending')", STOPS_SQL, ROUTES_SQL, "x AS (SELECT * FROM stops WHERE status = 'pending' OR day(business_date) % 4 <> 0)")(lambda spark, d: ledger.to_reroute(stops(spark, d).where("status = 'pending' or day(business_date) % 4 <> 0"), routes(spark, d)))

# Frames and crops


@query("i1_crop_in_source", "SELECT p_partkey, CASE turn WHEN 90 THEN 20 WHEN 180 THEN w - 110 WHEN 270 THEN w - 60 ELSE 10 END AS x0, CASE turn WHEN 90 THEN h - 110 WHEN 180 THEN h - 60 WHEN 270 THEN 10 ELSE 20 END AS y0, CASE turn WHEN 90 THEN 60 WHEN 180 THEN w - 10 WHEN 270 THEN w - 20 ELSE 110 END AS x1, CASE turn WHEN 90 THEN h - 10 WHEN 180 THEN h - 20 WHEN 270 THEN 110 ELSE 60 END AS y1 FROM frames", _FRAMES)
def _(spark, d):
    box = [F.lit(v).cast("bigint") for v in (10, 20, 110, 60)]
    rect = ocr.crop_in_source(*box, F.col("turn") - 360, F.col("w"), F.col("h"))
    return _frames(spark, d).withColumn("r", rect).select("p_partkey", "r.x0", "r.y0", "r.x1", "r.y1")


query("i2_frame_size", "SELECT p_partkey, CASE WHEN turn IN (90, 270) THEN h ELSE w END AS width, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS height FROM frames", _FRAMES)(lambda spark, d: _frames(spark, d).withColumn("f", ocr.frame_size(F.col("turn"), F.col("w"), F.col("h"))).select("p_partkey", "f.width", "f.height"))
query("i3_scale", f"SELECT p_partkey, greatest(1, floor(w * {_SCALE} + 0.5))::INT AS width, greatest(1, floor(h * {_SCALE} + 0.5))::INT AS height FROM frames", _FRAMES)(lambda spark, d: _frames(spark, d).withColumn("s", ocr.output_size(F.col("w"), F.col("h"), ocr.scale(F.col("w"), F.col("h")))).select("p_partkey", "s.width", "s.height"))


@query("i4_blank_canvas", "SELECT p_partkey, abs(250 - f) <= 6 AND abs(250 - p_partkey % 16 - f) <= 6 AS blank FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 256 ELSE 250 END AS f FROM part)")
def _(spark, d):
    p = F.col("p_partkey")
    pixel = lambda r, a: F.struct(r.cast("int").alias("r"), a.cast("int").alias("a"))
    first = F.array(pixel(p % 256, F.when(p % 2 == 1, 255).otherwise(0)), pixel(F.lit(250), F.lit(255)))
    second = F.array(pixel(250 - p % 16, F.lit(255)), pixel(F.lit(0), F.lit(0)))
    return table(spark, d, "part").select("p_partkey", ocr.is_blank(F.array(first, second)).alias("blank"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of one paragraph for each order: a line of one word for each item."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    boxed = [F.col("l_suppkey").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    word = F.struct(F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.lit(80.0).alias("confidence"), *boxed)
    line = F.struct(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("l"), F.col("l_partkey").cast("string"))).alias("text"), *boxed, F.array(word).alias("words"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return lines.select("l_orderkey", F.array(F.struct(F.array(F.struct("lines")).alias("paragraphs"))).alias("blocks"))


_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos"


@query("i8_flatten_tree", f"SELECT l_orderkey, pos, txt AS text, 5 + x / 2.0 AS x0 FROM (SELECT l_orderkey, {_POS}, 'w' || l_partkey AS txt, l_suppkey AS x FROM lineitem)")
def _(spark, d):
    origin = F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y"))
    return ocr.flat_words(_tree(spark, d), "l_orderkey", "blocks", origin, F.lit(2.0)).select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "text", "x0")


@query("i8_flatten_lines", f"SELECT l_orderkey, pos, CASE WHEN k % 2 = 0 THEN 'l' || k ELSE '' END AS text, 7 + x / 2.0 AS y1 FROM (SELECT l_orderkey, {_POS}, l_partkey AS k, l_suppkey AS x FROM lineitem)")
def _(spark, d):
    origin = F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y"))
    return ocr.flat_lines(_tree(spark, d), "l_orderkey", "blocks", origin, F.lit(2.0)).select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), "text", "y1")


query("i10_zoom_gate", f"SELECT p_partkey FROM frames WHERE {_SCALE} < 0.95", _FRAMES)(lambda spark, d: _frames(spark, d).where(ocr.zoom_helps(F.col("w"), F.col("h"))).select("p_partkey"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages of 120 characters a line, a dark pixel for each visible one, turned by some degrees."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.expr("tan(radians(doc_id % 11 - 5))").alias("slope"))
    return docs.mapInArrow(_drawn, "doc_id long, width int, grey array<int>")


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, some at a time: a page's pixels are looked up at once in its characters, four lines of pixels each."""
    for batch in batches:
        for row in batch.to_pylist():
            shift = (np.arange(120) - 60) * row["slope"]
            shift = (np.sign(shift) * np.floor(np.abs(shift) + 0.5)).astype(np.int64)
            marks = np.frombuffer(row["text"].encode("utf-32-le"), "<u4")
            lines = len(marks) // 120 + 1
            seen = np.zeros(lines * 120, bool)
            seen[: len(marks)] = (marks != 32) & (marks != 10)
            place = np.arange(lines * 4 + 40)[:, None] - 20 - shift
            inside = (place >= 0) & (place % 4 < 2) & (place // 4 < lines)
            dark = inside & seen.reshape(lines, 120)[np.where(inside, place // 4, 0), np.arange(120)]
            grey = pa.array(np.where(dark, 20, 230).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([120], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(grey)], pa.int32()), grey)], ["doc_id", "width", "grey"])


query("i12_skew_angle")(lambda spark, d: layout.skew_angles(_pages(spark, d), "doc_id"))
query("i12_text_regions")(lambda spark, d: layout.text_regions(_pages(spark, d), "doc_id"))


_CASCADE_K = {"manual": 13, "page": 37, "region1": 53, "region2": 71, "probe180": 17, "page180": 29, "region180_1": 91, "region180_2": 61}
_CASCADE = f"""s AS (SELECT doc_id, doc_id % 2 = 0 AS zoom, {', '.join(f"CASE WHEN {'doc_id % 11 = 0' if n == 'manual' else f'doc_id % 9 <> {i}'} THEN ((doc_id * {k}) % 100)::DOUBLE END AS {n}" for i, (n, k) in enumerate(_CASCADE_K.items()))}, (doc_id * 37) % 23 AS words, (doc_id * 17) % 23 AS probe FROM documents),
a AS (SELECT *, manual IS NOT NULL AS by_hand, coalesce(page, 0) AS p0, CASE WHEN page IS NULL THEN 0 ELSE words END AS w, CASE WHEN probe180 IS NULL THEN 0 ELSE probe END AS pw FROM s),
b AS (SELECT *, NOT by_hand AND zoom AND p0 < 70 AND region1 IS NOT NULL AS r1 FROM a),
c AS (SELECT *, r1 AND greatest(p0, region1) < 70 AND region2 IS NOT NULL AS r2 FROM b),
e AS (SELECT *, greatest(p0, CASE WHEN r1 THEN region1 ELSE 0 END, CASE WHEN r2 THEN region2 ELSE 0 END) AS so_far FROM c),
f AS (SELECT *, NOT by_hand AND so_far < 70 AND w < 12 AND pw > greatest(3, 1.4 * w) AS turned, coalesce(page180, 0) AS p180 FROM e),
g AS (SELECT *, turned AND zoom AND p180 < 70 AND region180_1 IS NOT NULL AS t1 FROM f),
h AS (SELECT *, t1 AND greatest(p180, region180_1) < 70 AND region180_2 IS NOT NULL AS t2 FROM g),
l AS (SELECT *, list_filter([
    CASE WHEN by_hand THEN {{'s': manual, 'n': 0, 'stage': 'manual'}} END, CASE WHEN NOT by_hand THEN {{'s': p0, 'n': -1, 'stage': 'page'}} END,
    CASE WHEN r1 THEN {{'s': region1, 'n': -2, 'stage': 'region1'}} END, CASE WHEN r2 THEN {{'s': region2, 'n': -3, 'stage': 'region2'}} END,
    CASE WHEN turned THEN {{'s': p180, 'n': -4, 'stage': 'page180'}} END, CASE WHEN t1 THEN {{'s': region180_1, 'n': -5, 'stage': 'region180_1'}} END,
    CASE WHEN t2 THEN {{'s': region180_2, 'n': -6, 'stage': 'region180_2'}} END], lambda x: x IS NOT NULL) AS t FROM h)"""


@query("i11_cascade", "SELECT doc_id, list_max(t).s AS score, list_max(t).stage AS kept, turned, r1 AS zoomed, array_to_string(list_transform(t, lambda x: x.stage), ',') AS stages FROM l", _CASCADE)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    id_ = F.col("doc_id")
    stages = F.array(*[F.when(id_ % 11 == 0 if n == "manual" else id_ % 9 != i, F.struct(F.lit(n).alias("stage"), ((id_ * k) % 100).cast("double").alias("score"), ((id_ * k) % 23).alias("words"))) for i, (n, k) in enumerate(_CASCADE_K.items())])
    rows = docs.withColumn("a", F.explode(F.array_compact(stages))).select("doc_id", "a.stage", "a.score", "a.words", (id_ % 2 == 0).alias("zoom"))
    return ocr.cascade(rows, "doc_id").withColumn("stages", F.array_join("stages", ","))


# Routes and positions


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d).select("business_date", F.coalesce("start_lat", F.lit(geo.DEPOT_LAT)).alias("start_lat"), F.coalesce("start_lng", F.lit(geo.DEPOT_LNG)).alias("start_lng"))


@query("route_by_time", "SELECT business_date, district, count(*) AS stops, CASE WHEN any_value(points) <= " + str(route.MATRIX_POINTS) + " AND count(*) > 1 THEN 'matrix' ELSE 'straight line' END AS matrix_source, CASE WHEN any_value(points) <= " + str(route.MATRIX_POINTS) + " AND count(*) > 1 THEN (SELECT count(*) + 1 FROM p x WHERE x.business_date = p.business_date AND x.district = p.district AND NOT EXISTS (SELECT 1 FROM times t WHERE t.business_date = p.business_date AND t.district = p.district AND seconds IS NOT NULL AND (t.a = x.stop_id OR t.b = x.stop_id))) ELSE 0 END AS gaps FROM p GROUP BY business_date, district", STOPS_SQL, _PENDING, _TIMES)
def _(spark, d):
    """Routes of a day's districts by the service's durations; orders have no SQL, but which matrix was used, for how many stops, and its gaps do. The start is never connected."""
    depot = days(spark, d).select("business_date", F.lit(geo.DEPOT_LAT).alias("start_lat"), F.lit(geo.DEPOT_LNG).alias("start_lng"))
    found = route.build_routes(stops(spark, d), depot, _times(spark, d), ["business_date", "district"])
    return found.select("business_date", "district", F.size("stop_ids").cast("bigint").alias("stops"), "matrix_source", F.col("gaps").cast("bigint").alias("gaps"))


query("route_order")(lambda spark, d: route.build_routes(stops(spark, d), _starts(spark, d)))


@query("route_start_points", "SELECT business_date, coalesce(l.lat, r.start_lat, 37.760175) AS start_lat, CASE WHEN l.lat IS NOT NULL THEN 'last_handled' WHEN r.start_lat IS NOT NULL THEN 'previous' ELSE 'depot' END AS start_source FROM days LEFT JOIN (SELECT business_date, arg_max(lat, (seq IS NULL, coalesce(seq, stop_id), stop_id)) AS lat FROM stops WHERE status <> 'pending' AND lat IS NOT NULL AND day(business_date) % 5 = 0 GROUP BY business_date) l USING (business_date) LEFT JOIN routes r USING (business_date)", STOPS_SQL, DAYS_SQL, ROUTES_SQL)
def _(spark, d):
    rows = stops(spark, d).where("day(business_date) % 5 = 0")
    handled = ledger.last_handled(rows).join(rows.select("business_date", "stop_id", "lat", "lng"), ["business_date", "stop_id"])
    previous = routes(spark, d).select("business_date", F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng"))
    depot = days(spark, d).select("business_date", F.lit(geo.DEPOT_LAT).alias("lat"), F.lit(geo.DEPOT_LNG).alias("lng"))
    return route.start_points(days(spark, d), ("last_handled", handled), ("previous", previous), ("depot", depot)).select("business_date", "start_lat", "start_source")


_TARGETS = "targets AS (SELECT business_date, stop_id, lat, lng, ts AS since, lead(ts) OVER (PARTITION BY business_date ORDER BY ts, stop_id) AS until FROM stops WHERE seq IS NOT NULL)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return stops(spark, d).where("seq is not null").selectExpr("business_date", "stop_id", "lat", "lng", "ts as since", "lead(ts) over (partition by business_date order by ts, stop_id) as until")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return stops(spark, d).where("lat is not null").selectExpr("business_date", "ts + interval 1 second as ts", "lat + 0.0005 as lat", "lng")


_ARRIVED = f"SELECT business_date, stop_id, min(pts) AS ts FROM (SELECT t.business_date, t.stop_id, p.ts + INTERVAL 1 SECOND AS pts, {_M.format(a='p.lat + 0.0005', b='t.lat', c='p.lng', d='t.lng')} AS m FROM stops p JOIN targets t ON p.business_date = t.business_date AND p.ts + INTERVAL 1 SECOND >= t.since AND (t.until IS NULL OR p.ts + INTERVAL 1 SECOND < t.until) WHERE p.lat IS NOT NULL) WHERE m < 120 GROUP BY business_date, stop_id"
query("r3_arrivals", _ARRIVED, STOPS_SQL, _TARGETS)(lambda spark, d: arrivals.arrivals(_positions(spark, d), _targets(spark, d)).select("business_date", "stop_id", "ts"))
query("f7_arrived", _ARRIVED.replace("SELECT business_date, stop_id, min(pts) AS ts FROM", "SELECT DISTINCT business_date, stop_id FROM").replace(" GROUP BY business_date, stop_id", ""), STOPS_SQL, _TARGETS)(lambda spark, d: _keys(arrivals.arrivals(_positions(spark, d), _targets(spark, d))))
query("r1_live_positions", "SELECT p.business_date, p.ts + INTERVAL 1 SECOND AS ts FROM stops p WHERE lat IS NOT NULL AND business_date IN (SELECT business_date FROM days WHERE status = 'open') AND business_date IN (SELECT business_date FROM stops WHERE status = 'pending')", STOPS_SQL, DAYS_SQL)(lambda spark, d: arrivals.live(_positions(spark, d), days(spark, d), ledger.pending(stops(spark, d)).select("business_date").distinct()).select("business_date", "ts"))


@query("r1_live_stream", "SELECT p.business_date, p.ts + INTERVAL 1 SECOND AS ts FROM stops p WHERE lat IS NOT NULL AND business_date IN (SELECT business_date FROM days WHERE status = 'open') AND business_date IN (SELECT business_date FROM stops WHERE status = 'pending')", STOPS_SQL, DAYS_SQL)
def _(spark, d):
    folder = store.own_folder(spark)
    positions = _positions(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    come = live.as_stream(positions, f"{folder.rpartition('/')[2]}/positions")
    found = live.run_available(live.live_stream(come, days(spark, d), ledger.pending(stops(spark, d))), f"{folder}/live")
    return found.select("business_date", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "r3_arrival_stream",
    f"SELECT business_date, 'arrived' AS kind, stop_id, ts FROM ({_ARRIVED}) UNION ALL SELECT business_date, 'closed', NULL, business_date + INTERVAL 28 HOUR FROM (SELECT DISTINCT business_date FROM stops WHERE lat IS NOT NULL OR seq IS NOT NULL) WHERE business_date + INTERVAL 28 HOUR <= (SELECT max(ts) + INTERVAL 1 SECOND - INTERVAL 1 HOUR FROM stops WHERE lat IS NOT NULL)",
    STOPS_SQL,
    _TARGETS,
)
def _(spark, d):
    """Arrivals (R3) and the days that closed at 04:00 (R4) of a stream of positions and next stops."""
    folder = store.own_folder(spark)
    name = folder.rpartition("/")[2]
    come = [live.as_stream(t, f"{name}/{n}") for n, t in (("positions", _positions(spark, d)), ("targets", _targets(spark, d)))]
    return live.run_available(live.arrival_events(*come), f"{folder}/events").select("business_date", "kind", "stop_id", "ts")


@query("s12_retry_frames", "SELECT business_date, 'shot ' || shot AS frame, CASE WHEN row_number() OVER (PARTITION BY business_date ORDER BY shot DESC) <= 6 THEN 'kept' ELSE 'evicted' END AS status FROM (SELECT DISTINCT business_date, stop_id % 9 AS shot FROM stops)", STOPS_SQL)
def _(spark, d):
    """Photo files of each day as they come, of which the last six are held; a file for each ninth of a day's stops."""
    folder = store.own_folder(spark)
    shots = stops(spark, d).select("business_date", (F.col("stop_id") % 9).alias("shot"), "raw_text")
    shots.repartition("business_date", "shot").write.partitionBy("business_date", "shot").text(f"{folder}/photos")
    photos = live.photo_stream(spark, f"{folder}/photos")
    return live.run_available(live.retry_frames(photos.select("business_date", "frame")), f"{folder}/frames")
