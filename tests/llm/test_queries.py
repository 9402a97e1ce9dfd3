"""The registered queries return the columns of their contracts over whole tables."""

import pytest

import __spark_entry__ as E
from tidewater.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Columns by query, and the table with as many rows (None: fewer, or one a group).
CONTRACT = {
    "op1_": ("doc_id item_id", None),
    "op2_": ("doc_id held_out score predicted", "documents"),
    "op3_": ("doc_id held_out score predicted", "documents"),
    "op4_": ("conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", None),
    "op5_": ("page_id payload_bytes payload_digest record_type refers_to", "pages"),
    "op6_": ("doc_id class_id", "documents"),
    "op7_": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "documents"),
    "op8_": ("doc_id size source_size target taken", "documents"),
    "op9_": ("page_id host path rule verdict", "pages"),
    "op10_": ("doc_id n_assign n_access n_hex base_sha256 spans", "documents"),
    "op11_": ("vec_id component n deviation whitened explained identity_error", None),
    "op12_": ("doc_id held_out n_tokens n_known train_tokens base_score score", "documents"),
    "op13_": ("doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "documents"),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    columns, table = CONTRACT[name.partition("_")[0] + "_"]
    df = QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    n = df.count()
    assert n > 0 if table is None else n == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert len(QUERIES) == 13
