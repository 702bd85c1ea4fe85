"""From texts to stops: documents, fields, addresses, memory, merging.

All but the last step are narrow or equi joins; the fold of a day is the only group (see ``merge``). Each step is written before the next.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, text
from ..sources.shared import cut, uncut
from .gazetteer import resolve_texts
from .ledger import DAY
from .memory import recall
from .merge import merge_scans, scans

# Fixed value: fewer visible characters than this are no text.
LEAST_VISIBLE = 12
FIELDS = {"doc_no": text.document_number, "phone": text.phone, "name": text.recipient, "product": text.product, "pieces": text.pieces}


def _read(texts: DataFrame, gazetteer: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """The scans without their numbers, as a table.

    Texts are read once: what is made of them is written, and addresses join it by part. Each step is written, so Spark can
    delete the step's shuffle files before the next; tables hold a row in far fewer bytes.
    """
    read = texts.where(text.visible_length(F.col("text")) >= LEAST_VISIBLE)
    parts = read.select(key, "ts", F.posexplode(text.documents_of(F.col("text"))).alias("place", "text")).withColumn("part", F.concat_ws("-", F.col(key), "place"))
    rows = cut(parts.withColumns({c: f(F.col("text")) for c, f in FIELDS.items()}).withColumn(DAY, dates.business_date(F.col("ts"))))
    found = cut(resolve_texts(rows.select("part", "text"), gazetteer, "part"))
    whole = rows.join(found.hint("merge"), "part").withColumn("flat", F.lit(None).cast("string"))
    out = cut(recall(whole.withColumnRenamed("text", "raw_text"), cut(memory)).select(DAY, "ts", key, "place", *FIELDS, "district", "quarter", "road", "door", "flat", "lat", "lng", "precision", "confidence", "grade", "warnings", "raw_text", "from_memory"))
    uncut(rows)
    uncut(found)
    return out


def scans_of_texts(texts: DataFrame, gazetteer: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """A scan for each document of each text: its fields, its address or the remembered one, and its work day.

    ``texts``: key, text, ts (when it came). Texts that are blank or nearly so give no scan. Scans are numbered in the order of
    time, key and place in the text, each day apart.
    """
    out = _read(texts, gazetteer, memory, key)
    number = F.row_number().over(Window.partitionBy(DAY).orderBy("ts", key, "place"))
    return out.select(DAY, "ts", key, "place", number.alias("stop_id"), *out.columns[4:])


def stops_of_texts(texts: DataFrame, gazetteer: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """The stops of each day after all of its texts, in the order in which they came."""
    read = _read(texts, gazetteer, memory, key)
    out = merge_scans(scans(read, F.struct(key, "place")))
    uncut(read)  # merging has written what it needs of them
    return out
