"""Registered queries against their SQL.

Every query runs with ``ALL_QUERIES=1``; otherwise a spread over the areas does.
"""

import os

import pytest
from compare import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SPREAD = """
scan_html_blocks upsert_last_wins conditional_upsert cascade_delete restore_snapshot filter_stale coverage
study_page unlock_wave initial_progress pending_work advance_run_state scope_filter evaluate_dq_rules shorten
text_hints url_to_slug validate_questions cells_to_rows spatial_order detect_definitions detect_cross_refs unit_table
concept_cooccurrence cycle_members plan_totals segment_titles best_overlap_style similarity_topk replace_by_document
stream_progress expire_stale_requests
""".split()
# These run over blocks of three rows as well, so that carries between blocks matter.
BLOCKED = """
repair_heading_levels attach_captions merge_paragraphs merge_lists assign_sections reading_order next_section
figure_nearby_text build_units unit_parents segment_chapters split_by_block_and_style chapter_order_offset dfs_sequence
""".split()


def test_every_oracle_has_a_query():
    assert not set(SQL) - set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_query(spark, duck, sf, name):
    ok, message = compare(spark, duck, name, QUERIES[name], SQL.get(name), sf)
    assert ok, message


@pytest.mark.parametrize("name", BLOCKED)
def test_small_blocks(spark, duck, sf, name, monkeypatch):
    from coursewright.operators import sequence

    monkeypatch.setattr(sequence, "BLOCK_ROWS", 3)
    ok, message = compare(spark, duck, name, QUERIES[name], SQL.get(name), sf)
    assert ok, message
