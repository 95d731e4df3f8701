"""Every registered query against its SQL, over the whole small tables."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.conftest import SMALL
from tidegauge.plans.catalogue import QUERIES

# Results that depend on a hash sketch or a random number generator.
WITHOUT_SQL = {"c10_sample_rows", "g15_unique_devices_approx"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    got = QUERIES[name].run(spark, SMALL).toPandas()
    if QUERIES[name].sql is None:
        assert name in WITHOUT_SQL and len(got) > 0
        return
    want = oracle.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = ordered(got), ordered(want)
    for column in got.columns:
        equal = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        assert equal.all(), (column, got[column][~equal].iloc[0], want[column][~equal].iloc[0])


def test_every_family_is_registered():
    ids = {name.split("_")[0] for name in QUERIES}
    wanted = ([f"a{i}" for i in range(1, 7)] + [f"b{i}" for i in range(1, 12)] + [f"c{i}" for i in range(1, 11)]
              + [f"d{i}" for i in range(1, 8)] + [f"e{i}" for i in range(1, 14)] + [f"f{i}" for i in range(1, 7)]
              + [f"g{i}" for i in range(1, 34)] + ["h1", "h2", "h3", "h4", "h5", "h7", "h8", "h9", "h10"]
              + [f"k{i}" for i in range(1, 6)])
    assert not [w for w in wanted if w not in ids]


def test_entry_points(spark):
    # Other packages may register more; some of theirs have no SQL.
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) & set(QUERIES) == set(QUERIES) - WITHOUT_SQL
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    flagship = entry_points.entry(spark)
    assert flagship.count() > 0 and "device_id" in flagship.columns


# Plans that are built without running a stream or writing a table.
LAZY = [n for n in QUERIES if re.match(r"[cdegk]\d", n) and n not in ("d5_fan_out_active", "d6_fan_out_all", "e9_merge_rollups", "f1_merged_compaction")
        and not n.endswith(("_stored", "_job")) and not n.endswith(("_states", "_clustered", "_sketches")) and not n.startswith(("c5_stored", "k2_"))]


@pytest.mark.parametrize("name", sorted(LAZY))
def test_plan_has_no_cross_join_or_python(spark, name):
    plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "collect_list"):
        assert bad not in plan
    assert "events.parquet" in plan


def test_scans_read_only_the_columns_used(spark):
    def schema(name):
        return re.findall(r"ReadSchema: struct<([^>]*)>", QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString())

    assert schema("g14_ingestion_rate") == ["ts:timestamp_ntz"]
    assert schema("g15_unique_devices") == ["user_id:bigint"]
    assert schema("g13_total_rows") == [""]
    assert "props" not in schema("g19_busiest_devices")[0]


def test_time_filters_reach_the_scan(spark):
    for name in ("g8_device_aggregation", "g5_device_current_status", "g1_single_day_temp", "g20_bucket_series_1_hour"):
        plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan), name
