"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from corpusloom.catalog import all_queries, all_sql, check

QUERIES = all_queries()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "example_id"
    assert frame.count() > 0


def test_entry_has_all_kinds_and_styles(spark):
    frame = entry.entry(spark)
    assert {r.type for r in frame.select("type").distinct().collect()} == {
        "javascript_function", "javascript_arrow_function", "javascript_class"}
    assert frame.where("user NOT LIKE '%Standard conventions%'").count() > 0


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert check.compare(spark, sf_dir, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(all_sql())))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_cleaned_responses_are_of_every_kind(spark, sf_dir):
    rows = QUERIES["clean_response"](spark, sf_dir).collect()
    kept = [r.instruction for r in rows if r.instruction is not None]
    assert 0 < len(kept) < len(rows)
    assert {text[-1] for text in kept} >= {".", "!", "?"}
