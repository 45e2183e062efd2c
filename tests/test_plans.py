"""Plans of registered queries: what reaches the scan, what is pre-combined, what never appears."""

import re

import pytest
from pyspark.sql import functions as F

from postmill.catalog import QUERIES
from postmill.operators import reports
from postmill.operators.keyed import keep_first

RUNS_JOBS = {"best_match", "best_match_gated", "numbered_rows", "question_ids", "ranked_questions", "stream_seen"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_nested_loops(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_columns_and_filters_reach_the_scan(spark, small):
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(QUERIES["html_to_text"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan(QUERIES["new_only"](spark, small)))


def test_hot_keys_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"), F.lit("x").alias("text"))
    text = plan(keep_first(rows, ["k"], "n"))
    assert "WindowGroupLimit" in text and text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_rules_stay_in_generated_code(spark, small):
    text = plan(QUERIES["geo_filter"](spark, small))
    assert "lambda" not in text and "Python" not in text


def test_message_and_funnel(spark):
    scored = spark.createDataFrame(
        [(1, "A", "T1", 95, "strong_match"), (2, "B", "T2", 80, "medium_match"), (3, "C", "T3", 99, "strong_match")],
        "n int, company string, title string, match_score int, verdict string",
    )
    top = reports.top_strong(scored.withColumn("g", F.lit(1)), ["g"], "n")
    text = reports.summary_message("2026-04-25", reports.verdict_counts(scored), top).first()["message"]
    assert text.splitlines()[1:] == ["🔥 Strong (2): C T3 (99), A T1 (95)", "✅ Medium: 1"]
    none = spark.createDataFrame([], "filter_status string, external_jd_status string")
    row = reports.funnel(scored, none, none).first()
    assert (row["raw_count"], row["unique_count"], row["passes_count"]) == (3, 3, 0)


SPREAD = {
    "assembled_pages": "p_partkey", "detail_pages": "p_partkey", "embedded_postings": "p_partkey", "flow_ingest": "p_partkey",
    "mail_cards": "p_partkey", "mail_links": "p_partkey", "reply_json": "event_id",
}


@pytest.mark.parametrize("name", sorted(SPREAD))
def test_work_on_rows_comes_after_the_shuffle(spark, small, name):
    """A few MB hold millions of short rows: one task reads them, so no parsing may stand below the exchange."""
    text = plan(QUERIES[name](spark, small))
    read = re.findall(rf"hashpartitioning\({SPREAD[name]}#\w+, \d+\), REPARTITION_BY_NUM.*?FileScan", text, re.S)
    assert read and not any(re.search("regexp|from_json|parse_json|Python|lambda", below) for below in read)


def test_titles_and_places_of_boards_are_made_after_the_shuffle(spark, small):
    from postmill.catalog.matching import boards

    for side in boards(spark, small):
        assert re.search(r"hashpartitioning\(p_partkey#\w+, \d+\), REPARTITION_BY_NUM", plan(side))
