"""Registered queries against their SQL twins at the smallest scale.

A spread over all modules by default; TIDEMARK_ALL_QUERIES=1 runs every one.
"""

import os

import pytest
from oracle import ROOT, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUICK = """a01_region_mean a03_global_metrics a07_region_correlation w02_local_peaks w03_peak_suppression j03_covering_row
j04_tolerance_join a13_row_differences w06_divergence_windows e06_best_lag u01_boundaries j06_interval_overlap e02_fused_timeline
w07_run_length_segments w10_cluster_boundaries w13_merge_label_windows w24_scene_grouping j21_box_suppression e09_temporal_scopes
e18_evaluate_objectives w17_rank_all_orders j12_part_front e16_pattern_similarity x07_structural_role x20_words_in_sentence
a44_nearest_other_cluster a24_frequent_terms e23_feature_evidence u07_deduplicate e28_approved_spec p16_guardrails k09_population
a35_population_diversity w22_patience e45_stop_verdict e32_axis_neighbours a31_kendall j20_nearest_training_distance
s05_latest_by_cache_key s08_immutable_comparison a29_map_validation j15_gate_report a16_linear_coverage e07_gated_comparison
k16_take_by_front e45_space_exhausted e05_feature_grid a19_content_summary a12_timeline_coverage a38_frame_range""".split()
NAMES = sorted(queries()) if os.environ.get("TIDEMARK_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), "0.001")
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
