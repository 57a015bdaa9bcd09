from __future__ import annotations

import pytest
from oracle import compare, connect

from spanloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], connect(sf_dir)) == ""


@pytest.mark.parametrize("name, names", [
    ("op1_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans"), ("op2_packing", "doc_id start length ids_crc32 doc_tokens sequence_id offset"), ("op3_html", "page_id url text n_chars"),
    ("op6_simhash", "doc_id fingerprint component_id"), ("op8_hmm", "doc_id held_out n_tokens n_known train_tokens base_score score"), ("op9_langid", "doc_id held_out lang_pred score"),
])
def test_query_has_the_contract_columns(spark, sf_dir, name, names):
    assert registry.QUERIES[name](spark, sf_dir).columns[: len(names.split())] == names.split()
