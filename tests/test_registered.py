"""A cross-section of the registered queries against DuckDB; verification.check runs them all."""

import pytest

import __spark_entry__ as entry_point
from verification import check
from verification.oracles import ORACLES
from verification.queries import QUERIES

SAMPLE = (
    "csv_round_trip",
    "json_fields",
    "month_comparison",
    "age_in_week_boundaries",
    "excluded_users_with_hot_keys",
    "nested_labels",
    "mixed_session_numbers",
    "cross_game_and_true_session_numbers",
    "repeated_result_ids_with_hot_keys",
    "scores_that_are_no_numbers",
    "observed_session_numbers_with_hot_keys",
    "cleaning_audit",
    "longest_play",
    "distribution_tests",
    "all_curves",
    "linear_fit_bands",
    "user_level_matrix",
    "jump_by_true_session",
)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.duckdb_tables(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    found = entry_point.entry(spark)
    assert found.count() > 0 and "mean" in found.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, connection, sf_dir, name):
    assert check.compare(spark, connection, sf_dir, name) == ""
