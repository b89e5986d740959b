"""The registered queries against their SQL twins and in form, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from evidentia.llm import catalog
from tools.compare import compare, connect

from .common import SF

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_html_extraction": "page_id url text n_chars",
    "op5_benchmark_decontamination": "doc_id item_id",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op9_url_filters": "page_id host path rule verdict",
    "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_simhash_join": "doc_id fingerprint component_id",
}


def test_all_are_registered():
    assert set(catalog.queries()) == set(COLUMNS)
    assert set(catalog.queries()) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(catalog.oracle_sql())))
def test_form(spark, name):
    assert catalog.queries()[name](spark, SF).columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    _, n, verdict = compare(spark, connect(SF), name, SF)
    assert verdict == "ok" and n > 0, verdict
    found = connect(SF).execute(f"DESCRIBE {catalog.oracle_sql()[name]}").fetchall()
    assert set(COLUMNS[name].split()) <= {r[0] for r in found}
