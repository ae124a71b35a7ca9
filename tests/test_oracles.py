"""A sample of the registered queries against their SQL at the smallest scale.

``python tests/compare.py`` runs all of them at sf0.01.
"""

import pytest

from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_user_movement", "cln9_removal_accounting", "seg4_anchored_windows", "ft18_feature_table", "beh1_movement_class",
    "trp4_trip_statistics", "bas2_speed_baseline_fit", "prf1_cold_start_history", "rsk4_nominal_targets", "met2_roc_auc",
    "zon4_safe_area_state", "lop3_loop_pattern", "hrt3_response_pattern", "dec3_operational_score", "st2_geofence_states",
    "st5_behavior_escalation", "stm8_latest_fix_as_of", "qry10_cell_rollup",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    import __spark_entry__ as entry

    error = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert error in (None, "EMPTY")


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
