"""The training-data pipeline: five operators of ``dispatchlake.llm`` in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; :func:`run` writes every stage's result to the
shared folder and reads it back as the next one's ``docs``.

All stages carry whole rows: every column that comes in goes out, whatever its name, but those that the last stage adds
(``shard``, ``slot``, ``size``, ``law``, ``text_crc32``, ``grown_shard``) replace columns of their names. Nulls may stand in any column;
an empty table gives an empty table.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dispatchlake.llm import decontaminate, mixing, sharding, simhash, toxicity
from dispatchlake.llm.storage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model trained on this stage's documents and the labels.

    Null and empty texts are kept, and rows with null doc_id are judged like others; repeated rows are judged one by one. With too few
    labels for a model, all documents are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: that with the least doc_id.

    Null, empty and wordless texts have one fingerprint, so one of them is kept; of repeated rows one is kept.
    """
    return simhash.near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth.

    Null and empty texts are kept; an empty benchmark keeps all; repeated rows are judged one by one.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none, one or several times.

    A null source is a source of its own; null and empty texts come along with whole epochs; a corpus without tokens is returned once.
    """
    return mixing.mix(docs).select(*[c for c in docs.columns if c not in ("epoch", "source_weight", "mix_order")])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; a null text has size 1."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and hash permutations have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None
