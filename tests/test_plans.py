"""The physical plans have the shape the operators promise."""

import re

import pytest

from __spark_entry__ import entry
from catalog import registry
from catalog.readings import readings
from skygauge.operators import anomaly as A, reports as R, views as VW
from skygauge.operators.enrich import enrich
from skygauge.operators.filters import filter_cities, filter_range, with_event_ts
from skygauge.sources.sinks import with_event_date

SF = "/root/testdata/sf0.001"
# Queries that write files before they return a frame; their plan is a plain scan.
EAGER = {
    "json_lines_files", "parquet_files", "csv_files", "raw_json_arrays", "recent_files", "events_sink", "land_raw",
    "parquet_stream", "event_stream", "batch_job", "report_job", "processed_files", "zscore_stream", "zscore_state",
    "iforest_stream", "monitor_stream", "iforest_scores", "iforest_scored_events", "zscore_scores_split",
    "monitoring_logs", "run_counts", "monitor_batch",
    "monitor_metrics", "monitor_stream_iforest", "stream_progress", "inferred_job", "report_tables", "chain_job",
    "retained_files", "zone_volume", "iforest_fixed", "iforest_training",
}

# Queries whose z-scores are made by an Arrow function over the sorted rows of a key.
ARROW = {"anomaly_flags", "anomaly_events"}


registry.load()


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_no_cartesian_and_no_python(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    assert ("MapInArrow" in text) == (name in ARROW)


def test_reports_combine_before_the_shuffle(spark):
    text = plan(R.daily_summary(enrich(readings(spark, SF))))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("HashAggregate") < text.index("Exchange") < text.rindex("HashAggregate")
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "ts" not in schema


def test_enrichment_does_not_shuffle(spark):
    assert "Exchange" not in plan(enrich(readings(spark, SF)))


def test_zscores_shuffle_once(spark):
    text = plan(A.zscore_long(readings(spark, SF), hot_keys=False))
    assert text.count("Exchange") == 1 and "hashpartitioning(city" in text


def test_top_rows_limits_before_the_shuffle(spark):
    text = plan(VW.last_n_per_city(readings(spark, SF)))
    assert text.count("WindowGroupLimit") == 4  # partial and final, for salts and for cities
    assert text.count("Exchange") == 2


def test_filters_reach_the_processed_zone(spark, tmp_path):
    path = str(tmp_path / "zone")
    with_event_date(readings(spark, SF)).write.partitionBy("event_date").parquet(path)
    zone = spark.read.parquet(path)
    chosen = filter_range(filter_cities(zone, ["City 1"]), "2024-01-03", "2024-01-04")
    text = plan(chosen.where("event_date = DATE '2024-01-03'").select("temperature"))
    assert "PushedFilters: [" in text and ("In(city" in text or "EqualTo(city" in text)
    assert "GreaterThanOrEqual(event_ts" in text
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date", text)
    assert with_event_ts(zone).columns.count("event_ts") == 1


@pytest.mark.parametrize("name", ["latest_per_city", "first_per_city", "city_cards", "temperature_map"])
def test_rows_per_city_come_without_sorting_all_rows(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "SortAggregate" not in text and "HashAggregate" in text
