"""The registered queries: SQL where it can express them, and the columns and digests of each contract."""

import hashlib
import os
import re

import pytest

import __spark_entry__
from dispatchlake.llm.queries import ORACLE_SQL, QUERIES

from ..comparing import duckdb_rows, spark_rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    1: "doc_id n_words n_removed kept_sha256",
    2: "doc_id held_out score predicted",
    3: "doc_id n_words n_hit n_items items_sha256 contaminated",
    4: "doc_id n_words n_base first_word last_word base_labels labels score",
    5: "doc_id size text_crc32 law shard slot grown_shard",
    6: "doc_id held_out n_tokens n_known train_tokens base_score score",
    7: "page_id url text n_chars",
    8: "doc_id fingerprint component_id",
    9: "doc_id source epoch",
    10: "query_id rank vec_id score",
    11: "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    12: "lang source part item value rank",
    13: "doc_id n_lines n_dropped kept_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    assert (columns, rows) == duckdb_rows(ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_of_the_contract(spark, name):
    assert set(COLUMNS[int(re.match(r"op(\d+)", name)[1])].split()) <= set(QUERIES[name](spark, DATA).columns)


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_digests(spark):
    row = QUERIES["op3_decontamination"](spark, DATA).where("n_items = 0").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()
