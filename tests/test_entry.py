import importlib.util

import pytest

import __spark_entry__ as entry
from compare import compare, duck

CHEAP = """tokenize_counts bm25_term_stats ingest_clean ingest_rejected latest_per_key skip_reasons overruling_edges fabricated_rate weighted_vote_trusted weighted_vote_review segment_lines heading_split
case_mentions chunk_fixed numbered_sections holm bootstrap_ci trap_items p1_found p1_orphan_report p1_current_orphans running_target dense_topk
sections_in_text unified_docs built_corpus cleaned_pages date_texts boolean_filter lexical_topk exact_accuracy sampled_rates ir_metrics""".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "ord", "statute", "score", "rank"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf, name):
    ok, said = compare(spark, duck(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, said


def test_core_does_not_need_the_llm_package():
    names = {m for m in entry.MODULES}
    for m in names:
        assert "eralex.llm" not in open(importlib.util.find_spec(m).origin).read()
