import datetime as dt
import os

import duckdb
from pyspark.sql import functions as F

from tidegauge.functions.timeparts import time_range
from tidegauge.operators import tables
from tidegauge.operators.tables import LAYOUTS
from tidegauge.streaming.jobs import ROLLUPS

T0 = dt.datetime(2024, 1, 1)


def readings(sensor_rows, days=10, per_day=6):
    return sensor_rows([
        (d * per_day + i, f"d{i % 3}", T0 + dt.timedelta(days=d, hours=4 * i)) for d in range(days) for i in range(per_day)
    ])


def days_on_disk(path):
    return sorted(name for _, folders, _ in os.walk(path) for name in folders if name.startswith("day="))


def test_layout_prunes_by_day_and_pushes_the_id(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "sensors")
    df = readings(sensor_rows)
    tables.write_table(df, path, LAYOUTS["sensors"])
    table = tables.read_table(spark, path)
    assert len(days_on_disk(path)) == 10
    assert table.drop("day").exceptAll(df.select(table.drop("day").columns)).isEmpty() and table.count() == df.count()
    picked = table.filter((F.col("day") == "2024-01-03") & (F.col("device_id") == "d1"))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(device_id,d1)" in plan and "PartitionFilters: [isnotnull(day" in plan
    assert len(picked.inputFiles()) >= 1 and picked.count() == 2


def test_files_are_sorted_by_device(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "sensors")
    tables.write_table(readings(sensor_rows), path, LAYOUTS["sensors"])
    for folder, _, files in os.walk(path):
        for name in files:
            if name.endswith(".parquet"):
                rows = [(r.device_id, r.time) for r in spark.read.parquet(f"{folder}/{name}").collect()]
                assert rows == sorted(rows)


def test_layout_without_adaptive_execution(spark, sensor_rows, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables.write_table(readings(sensor_rows), str(tmp_path / "t"), LAYOUTS["sensors"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 60


def test_bloom_filters_are_of_the_size_that_a_file_needs(spark, sensor_rows, tmp_path):
    # Devices of a reading or two, so that the column is no dictionary and has a filter.
    rows = sensor_rows([(i, f"device-{i * 7919:09d}", dt.datetime(2024, 1, 1 + i % 3)) for i in range(1500)])
    for name, write in (("bulk", tables.write_table), ("batch", lambda df, path, layout: tables.write_batch(df, 0, path, layout, "w"))):
        write(rows, str(tmp_path / name), LAYOUTS["sensors"])
        files = list((tmp_path / name).rglob("*.parquet"))
        filters = duckdb.execute("select bloom_filter_length from parquet_metadata(?) where path_in_schema = 'device_id'",
                                 [[str(f) for f in files]]).fetchall()
        assert len(filters) >= 3 and all(64 < length < 10_000 for (length,) in filters)
        assert sum(f.stat().st_size for f in files) < 1_000_000
        found = duckdb.execute("select sum(bloom_filter_excludes::int), count(*) from parquet_bloom_probe(?, 'device_id', 'device-x')",
                               [[str(f) for f in files]]).fetchone()
        assert found[0] >= found[1] - 1
        assert tables.read_table(spark, str(tmp_path / name)).filter("device_id = 'device-000007919'").count() == 1


def test_month_partitions(spark, tmp_path):
    df = spark.sql("select 's' as service, 'h' as hostname, timestamp'2024-02-29 10:00:00' as time")
    tables.write_table(df, str(tmp_path / "cpu"), LAYOUTS["cpu"])
    assert os.path.isdir(tmp_path / "cpu" / "month=2024-02-01")
    table = tables.read_table(spark, str(tmp_path / "cpu"))
    picked = time_range(table, "2024-02-10 00:00:00", "2024-03-01 00:00:00")
    assert picked.count() == 1 and "PartitionFilters: [isnotnull(month" in picked._jdf.queryExecution().executedPlan().toString()
    assert time_range(table, "2024-03-01 00:00:00").count() == 0
    assert tables.drop_expired(spark, str(tmp_path / "cpu"), 90, "2024-05-29 00:00:00", by="month") == []
    assert len(tables.drop_expired(spark, str(tmp_path / "cpu"), 90, "2024-05-30 00:00:00", by="month")) == 1


def test_retention_edge(sensor_rows):
    df = readings(sensor_rows)
    kept = tables.apply_retention(df, "time", 7, "2024-01-11 00:00:00")
    # A row exactly seven days old is expired.
    assert kept.agg(F.min("time")).first()[0] == dt.datetime(2024, 1, 4, 4)


def test_expired_days_go_and_the_rest_is_hidden(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "sensors")
    tables.write_table(readings(sensor_rows), path, LAYOUTS["sensors"])
    tables.write_batch(readings(sensor_rows), 3, str(tmp_path / "batches"), LAYOUTS["sensors"], "w")
    as_of = "2024-01-11 10:00:00"
    assert len(tables.drop_expired(spark, path, 7, as_of)) == 3
    assert days_on_disk(path)[0] == "day=2024-01-04"
    kept = tables.apply_retention(tables.read_table(spark, path), "time", 7, as_of)
    assert kept.agg(F.min("time")).first()[0] == dt.datetime(2024, 1, 4, 12)
    tables.drop_expired(spark, str(tmp_path / "batches"), 7, as_of)
    assert days_on_disk(tmp_path / "batches")[0] == "day=2024-01-04"
    assert tables.drop_expired(spark, path, 7, as_of) == []


def test_a_repeated_batch_replaces_its_rows(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "t")
    df = readings(sensor_rows, days=2)
    tables.write_batch(df, 0, path, LAYOUTS["sensors"], "w")
    tables.write_batch(df.limit(5), 1, path, LAYOUTS["sensors"], "w")
    tables.write_batch(df, 1, path, LAYOUTS["sensors"], "w")
    table = tables.read_table(spark, path)
    assert [tuple(r) for r in table.groupBy("batch_id").count().orderBy("batch_id").collect()] == [(0, 12), (1, 12)]


def test_empty_batches_and_tables(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "t")
    df = readings(sensor_rows, days=1)
    tables.write_batch(df.limit(0), 0, path, LAYOUTS["sensors"], "w")
    assert tables.read_table(spark, path, like=df, layout=LAYOUTS["sensors"], batches=True).count() == 0
    tables.write_batch(df, 1, path, LAYOUTS["sensors"], "w")
    assert tables.read_table(spark, path, like=df, layout=LAYOUTS["sensors"], batches=True).filter("batch_id = 1").count() == 6


def test_compaction_keeps_every_row_once(spark, sensor_rows, tmp_path):
    source, target = str(tmp_path / "src"), str(tmp_path / "dst")
    df = readings(sensor_rows, days=3)
    for i in range(3):
        tables.write_batch(df.filter(F.col("seq") % 3 == i), i, source, LAYOUTS["sensors"], "w")
    tables.compact_batches(spark, source, target, LAYOUTS["sensors"], upto=1)
    rows = tables.read_compacted(spark, source, target)
    assert sorted(r.seq for r in rows.collect()) == list(range(18))
    tables.write_batch(df.withColumn("seq", F.col("seq") + 100), 3, source, LAYOUTS["sensors"], "w")
    tables.write_batch(df.withColumn("seq", F.col("seq") + 200), 0, source, LAYOUTS["sensors"], "other")
    for _ in range(2):
        tables.compact_batches(spark, source, target, LAYOUTS["sensors"])
    every = [*range(18), *range(100, 118), *range(200, 218)]
    assert sorted(r.seq for r in tables.read_compacted(spark, source, target).collect()) == every
    # What a lost call wrote is never read.
    tables.write_table(df.withColumns({"writer": F.lit("w"), "batch_id": F.lit(9)}), f"{target}/rows/run=lost", LAYOUTS["sensors"])
    assert tables.remove_compacted(spark, source, target) == 5
    rows = tables.read_compacted(spark, source, target)
    assert sorted(r.seq for r in rows.collect()) == every
    assert {"day", "writer", "batch_id"} <= set(rows.columns)


def test_writers_do_not_replace_each_other(spark, sensor_rows, tmp_path):
    path = str(tmp_path / "t")
    df = readings(sensor_rows, days=1)
    for writer in ("a", "b", "a"):
        tables.write_batch(df, 0, path, LAYOUTS["sensors"], writer)
    assert tables.read_table(spark, path).count() == 2 * df.count()


def test_partitions_of_window_starts(spark, tmp_path):
    """A report on window ends must not prune by the day of window starts."""
    rows = spark.sql("""select timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as window_start from range(5)""")
    rows = rows.withColumns({"time": F.expr("window_start + interval 1 day"), "device_id": F.lit("d"), "reading_count": F.lit(1)})
    path = str(tmp_path / "t")
    tables.write_table(rows, path, ROLLUPS)
    table = tables.read_table(spark, path)
    assert time_range(table, "2024-01-03 00:00:00").count() == rows.filter("time >= '2024-01-03'").count() == 4
    assert time_range(table, "2024-01-03 00:00:00", column="window_start").count() == 3
    pruned = time_range(table, end="2024-01-02 00:00:00", column="window_start")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_a_hot_device_is_split_over_files(spark, tmp_path):
    """One device holds nearly all rows of a day; its rows go to several files."""
    rows = spark.range(0, 200000, 1, 8).selectExpr(
        "id as seq", "if(id % 50 = 0, concat('d', id % 7), 'hot') as device_id",
        "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, cast(id % 86400 as decimal(18,6))) as time", "uuid() as payload")
    path, key = str(tmp_path / "t"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        tables.write_table(rows, path, LAYOUTS["sensors"])
    finally:
        spark.conf.set(key, before)
    table = tables.read_table(spark, path)
    assert table.count() == 200000 and table.select("seq").distinct().count() == 200000
    files = table.filter("device_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 100000


def states_of(spark, keys, hours, batch):
    return spark.range(keys * hours).selectExpr(
        f"concat('d', id % {keys}) as device_id", f"timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id / {keys} as int)) as window_start",
        "id + 1 as reading_count").withColumn("window_end", F.expr("window_start + interval 1 hour")).filter(f"reading_count % 3 <> {batch % 3}")


def merged(df):
    return df.groupBy("device_id", "window_start").agg(F.max("window_end").alias("window_end"), F.sum("reading_count").alias("reading_count"))


def test_compaction_that_merges(spark, tmp_path):
    """Many batches come to one row a key and window; later ones are merged into the days they touch only."""
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    every = None
    for i in range(12):
        batch = states_of(spark, 3, 60, i)
        every = batch if every is None else every.unionByName(batch)
        tables.write_batch(batch, i, source, ROLLUPS, "w")
    tables.compact_batches(spark, source, target, ROLLUPS, upto=7, merge=merged)
    first = tables.manifest(spark, target)
    late = states_of(spark, 3, 10, 0)
    tables.write_batch(late, 12, source, ROLLUPS, "w")
    columns = ["device_id", "window_start", "window_end", "reading_count"]
    want = sorted(merged(every.unionByName(late)).select(columns).collect())
    rows = tables.read_compacted(spark, source, target)
    assert sorted(merged(rows).select(columns).collect()) == want
    tables.compact_batches(spark, source, target, ROLLUPS, merge=merged)
    assert tables.remove_compacted(spark, source, target) == 13 and tables.remove_compacted(spark, source, target) == 0
    rows = tables.read_compacted(spark, source, target)
    assert sorted(rows.select(columns).collect()) == want  # one row each, without a merge
    assert all(len(r) == 1 for r in tables.manifest(spark, target).runs.values()) and len(first.runs) == 3
    tables.write_batch(late, 13, source, ROLLUPS, "w")
    before = tables.manifest(spark, target)
    tables.compact_batches(spark, source, target, ROLLUPS, merge=merged)
    after = tables.manifest(spark, target)
    assert [d for d in after.runs if after.runs[d] != before.runs[d]] == ["2024-01-01"]


def test_merging_drops_an_older_generation(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    tables.write_batch(states_of(spark, 3, 60, 0), 0, source, ROLLUPS, "w", "old")
    tables.write_batch(states_of(spark, 2, 5, 0), 0, source, ROLLUPS, "other", "g")
    for writer, generation in (("w", "old"), ("other", "g")):
        tables.commits.commit(spark, source, writer, generation, 0)
    tables.compact_batches(spark, source, target, ROLLUPS, merge=merged)
    new = states_of(spark, 3, 40, 1)
    tables.write_batch(new, 0, source, ROLLUPS, "w", "new")
    columns = ["device_id", "window_start", "reading_count"]
    old = sorted(tables.read_compacted(spark, source, target).select(columns).collect())
    tables.commits.commit(spark, source, "w", "new", 0)
    want = sorted(new.unionByName(states_of(spark, 2, 5, 0)).select(columns).collect())
    assert old != want and sorted(tables.read_compacted(spark, source, target).select(columns).collect()) == want
    tables.compact_batches(spark, source, target, ROLLUPS, merge=merged)
    tables.remove_compacted(spark, source, target)
    assert sorted(tables.read_compacted(spark, source, target).select(columns).collect()) == want


def test_no_expired_row_stays(spark, sensor_rows, tmp_path):
    as_of, df, layout = "2024-01-11 10:00:00", readings(sensor_rows), LAYOUTS["sensors"]
    plain, source, target = (str(tmp_path / n) for n in ("plain", "source", "target"))
    kept = sorted(r.seq for r in tables.apply_retention(df, "time", 7, as_of).collect())
    assert 0 < len(kept) < df.count()
    tables.write_table(df, plain, layout)
    tables.drop_expired(spark, plain, 7, as_of)
    assert tables.rewrite_boundary(spark, plain, layout, 7, as_of) > 0
    assert tables.rewrite_boundary(spark, plain, layout, 7, as_of) == 0
    assert sorted(r.seq for r in tables.read_table(spark, plain).collect()) == kept
    assert tables.expired_rows(tables.read_table(spark, plain), "time", 7, as_of).isEmpty()
    # A call that was lost between the two renames is made good by the next.
    os.rename(f"{plain}/day=2024-01-04", f"{plain}/_old/day=2024-01-04")
    assert tables.rewrite_boundary(spark, plain, layout, 7, as_of) == 0
    assert sorted(r.seq for r in tables.read_table(spark, plain).collect()) == kept

    for i in range(2):
        tables.write_batch(df.filter(F.col("seq") % 2 == i), i, source, layout, "w")
    tables.compact_batches(spark, source, target, layout)
    reader = tables.read_compacted(spark, source, target)
    tables.expire_compacted(spark, target, layout, 7, as_of)
    assert reader.count() == df.count()  # one that began before reads on
    assert sorted(r.seq for r in tables.read_compacted(spark, source, target).collect()) == kept
    tables.remove_compacted(spark, source, target)
    assert sorted(r.seq for r in spark.read.parquet(f"{target}/rows").collect()) == kept
    assert sorted(r.seq for r in tables.read_compacted(spark, source, target).collect()) == kept


def test_nothing_is_pruned_on_a_guess(spark, tmp_path):
    rows = spark.sql("""select timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as window_start from range(5)""")
    rows = rows.withColumns({"time": F.expr("window_start + interval 1 day"), "device_id": F.lit("d")})
    path = str(tmp_path / "t")
    tables.write_table(rows, path, ROLLUPS)
    table = tables.read_table(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # The start projected away, replaced, or the table read without its word.
    assert time_range(table.select("time", "day"), "2024-01-03 00:00:00").count() == 4
    shifted = time_range(table.withColumn("window_start", F.expr("window_start + interval 2 day")), "2024-01-04 00:00:00", column="window_start")
    assert shifted.count() == 4
    assert time_range(spark.read.parquet(path), "2024-01-03 00:00:00").count() == 4
    pruned = time_range(table.select("window_start", "day"), "2024-01-03 00:00:00", column="window_start")
    assert pruned.count() == 3 and "PartitionFilters: [isnotnull(day" in plan(pruned)
    upper = time_range(table.select("time", "day"), end="2024-01-03 00:00:00")
    assert upper.count() == 1 and "PartitionFilters: [isnotnull(day" in plan(upper)


def test_a_range_goes_through_the_merge_to_the_folders(spark, tmp_path):
    from tidegauge.operators import rollup
    from tidegauge.plans import views
    from tidegauge.streaming import jobs
    from tests.conftest import SMALL

    path = str(tmp_path / "t")
    sensors = views.sensors(spark, SMALL)
    for i in range(3):
        tables.write_batch(rollup.rollup_states(sensors.filter(F.col("seq") % 3 == i), "1 hour"), i, path, ROLLUPS, "w")
    rolled = jobs.read_rollups(tables.read_table(spark, path), day=True)
    some = time_range(rolled, "2024-01-20 00:00:00", "2024-01-22 00:00:00", column="window_start")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = time_range(rollup.rollup_sensors(sensors, "1 hour"), "2024-01-20 00:00:00", "2024-01-22 00:00:00", column="window_start")
    assert some.drop("day").select(want.columns).exceptAll(want).isEmpty() and some.count() == want.count() > 0
