import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge import schemas
from tidegauge.operators import commits, hourly, rollup, tables
from tidegauge.plans import messages, stream_queries, views
from tidegauge.session import STREAM_SETTINGS, work_dir
from tidegauge.streaming import jobs, progress, sinks


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in eight files, in the order of time."""
    path = str(tmp_path_factory.mktemp("events") / "files")
    views.events(spark, SMALL).repartitionByRange(8, "ts").write.parquet(path)
    return path


def stream(spark, path, per_batch=2):
    rows = spark.readStream.schema(views.EVENTS).option("maxFilesPerTrigger", per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def batch_sensors(spark):
    rows = views.events(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    return views.to_sensors(rows)


def same(a, b):
    a = a.select(b.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def run_at(tmp_path, name="r"):
    return jobs.Run(str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), every=None)


@pytest.mark.parametrize("mode", ["deltas", "update"])
def test_stream_in_many_batches_equals_batch(spark, split_events, tmp_path, mode):
    run = run_at(tmp_path)
    # The files come in no order of time, so nothing may count as late.
    query = jobs.start_rollup_stream(
        views.to_sensors(stream(spark, split_events)), run, "1 day", mode=mode, lateness="60 days")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    table = tables.read_table(spark, run.output)
    assert same(jobs.read_rollups(table, mode), rollup.rollup_sensors(batch_sensors(spark), "1 day"))


@pytest.mark.parametrize("mode", ["deltas", "update"])
def test_rollup_job_in_many_batches_equals_batch(spark, split_events, tmp_path, mode):
    def readings(rows):
        return views.avro_readings(views.to_sensors(rows))

    encoded = messages.encode_readings(readings(stream(spark, split_events)), schemas.AVRO_READING)
    run = run_at(tmp_path)
    jobs.start_rollup_job(encoded, run, "1 day", mode, lateness="60 days", keep=("seq",)).awaitTermination()
    batch = readings(views.events(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp")))
    expected = rollup.rollup_readings(batch.withColumn("time", F.timestamp_millis("timestamp")), "1 day")
    assert same(jobs.read_rollups(tables.read_table(spark, run.output), mode), expected)


def test_append_writes_closed_windows_once(spark, split_events, tmp_path):
    # One batch: files written together come in no order of time, and rows of
    # a later batch could be late.
    run = run_at(tmp_path)
    jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events, 8)), run, "1 hour", mode="append", lateness="2 minutes").awaitTermination()
    rows = batch_sensors(spark)
    edge = rows.agg((F.max("time") - F.expr("interval 2 minutes")).alias("edge")).first().edge
    expected = rollup.rollup_sensors(rows, "1 hour").filter(F.col("window_end") <= F.lit(edge))
    assert same(jobs.read_rollups(tables.read_table(spark, run.output), "append"), expected)
    # The windows it still holds are written by the same query, and nothing is read again.
    jobs.close_windows(spark, run, "2024-03-01 00:00:00")
    query = jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events, 8)), run, "1 hour", mode="append", lateness="2 minutes")
    query.awaitTermination()
    found = progress.throughput(progress.progress_frame(spark, query.recentProgress)).first()
    assert found.total_in == 0 and found.total_dropped_late == 0 and found.total_emitted == found.total_from_windows > 0
    assert same(jobs.read_rollups(tables.read_table(spark, run.output), "append"), rollup.rollup_sensors(rows, "1 hour"))


def test_windows_of_arrival_end_in_silence(spark, split_events, tmp_path):
    """No message follows, and the windows are written all the same."""
    run = jobs.Run(str(tmp_path / "r"), str(tmp_path / "c"), every="1 second")
    query = jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events, 8)), run, "2 seconds", mode="append", clock="processing")
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            if os.path.isdir(f"{run.output}/_commits"):
                table = jobs.read_rollups(tables.read_table(spark, run.output, like=EMPTY_ROLLUP(spark), layout=jobs.ROLLUPS, batches=True), "append")
                if table.agg(F.sum("reading_count")).first()[0] == 1000:
                    return
            time.sleep(1)
        raise AssertionError("the windows were not written")
    finally:
        query.stop()


def EMPTY_ROLLUP(spark):
    return rollup.rollup_sensors(batch_sensors(spark), "1 hour").limit(0)


@pytest.mark.parametrize("fresh", ["replace", "refuse"])
def test_fresh_checkpoint_at_the_same_path(spark, split_events, tmp_path, fresh):
    run = jobs.Run(str(tmp_path / "r"), str(tmp_path / "c"), every=None, fresh=fresh)
    go = lambda per: jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events, per)), run, "1 day").awaitTermination()
    go(2)
    go(2)
    os.rename(run.checkpoint, run.checkpoint + "-lost")
    expected = rollup.rollup_sensors(batch_sensors(spark), "1 day")
    if fresh == "refuse":
        with pytest.raises(Exception, match="another checkpoint"):
            go(8)
    else:
        go(8)
        assert tables.read_table(spark, run.output).select("generation").distinct().count() == 1
    assert same(jobs.read_rollups(tables.read_table(spark, run.output)), expected)


def test_a_batch_counts_when_it_is_committed(spark, split_events, tmp_path):
    """A reader between the rows of a batch and its commit, and a commit that is repeated."""
    run, seen = run_at(tmp_path), []
    rows = views.to_sensors(stream(spark, split_events))
    sink = sinks.table_sink(run.output, tables.LAYOUTS["sensors"], writer=run.writer)

    def write(batch, batch_id):
        if batch_id:
            tables.write_batch(batch, batch_id, run.output, tables.LAYOUTS["sensors"], run.writer, commits.query_of(batch))
            seen.append(tables.read_table(spark, run.output).count())
        sink(batch, batch_id)
        sink(batch, batch_id)
        seen.append(tables.read_table(spark, run.output).count())

    jobs.start(rows, write, run).awaitTermination()
    assert seen[-1] == 1000 and seen[1::2] == seen[0:-1:2] and len(set(seen)) == 4
    assert len(os.listdir(f"{run.output}/_commits/{run.writer}")) in (1, 2)  # and its checksum


def test_lateness_has_to_be_given(spark, split_events, tmp_path):
    for mode in ("append", "update"):
        with pytest.raises(ValueError, match="give the lateness"):
            jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events)), run_at(tmp_path), mode=mode)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")

    def put(name, rows):
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.parquet(f"{source}/{name}")

    def event(i, minute, user=1):
        return (i, dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute), user, "view", 1.0, '{"k": 1}')

    def go():
        rows = spark.readStream.schema(views.EVENTS).parquet(f"{source}/*").withColumn("ts", F.col("ts").cast("timestamp"))
        query = jobs.start_rollup_stream(views.to_sensors(rows), run, "1 minute", mode="append", lateness="5 minutes")
        query.awaitTermination()
        return progress.progress_frame(spark, query.recentProgress).agg(F.sum("rows_dropped_late")).first()[0]

    run = run_at(tmp_path)
    put("a", [event(0, 0), event(1, 30)])
    assert go() == 0
    put("b", [event(2, 0), event(3, 27), event(4, 40)])
    assert go() == 1
    rows = jobs.read_rollups(tables.read_table(spark, run.output), "append").orderBy("window_start").collect()
    assert [(r.window_start.minute, r.reading_count) for r in rows] == [(0, 1), (27, 1), (30, 1)]


def test_resume_after_some_batches(spark, split_events, tmp_path):
    """The sink fails in the third batch; the restarted query repeats it."""
    run = run_at(tmp_path)
    rows = views.to_sensors(stream(spark, split_events))
    sink = sinks.table_sink(run.output, jobs.ROLLUPS, lambda b: rollup.rollup_states(b, "1 hour"), writer="w")

    def failing(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        jobs.start(rows, failing, run).awaitTermination()
    jobs.start(rows, sink, run).awaitTermination()
    table = tables.read_table(spark, run.output)
    assert table.select("batch_id").distinct().count() == 4
    assert same(jobs.read_rollups(table, "deltas"), rollup.rollup_sensors(batch_sensors(spark), "1 hour"))


def test_fan_out_replaces_both_tables(spark, sensor_rows, tmp_path):
    rows = sensor_rows([(0, "a", dt.datetime(2024, 1, 1), 40.0, 1), (1, "b", dt.datetime(2024, 1, 1), 20.0, 2)],
                       "seq long, sensor_id string, timestamp timestamp, temperature double, status int")
    rows = rows.withColumnRenamed("device_type", "sensor_type").withColumnRenamed("site_id", "location")
    write = sinks.raw_and_alerts_sink(str(tmp_path), active=F.col("status") == 1, writer="w")
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "sensor_raw_data")).count() == 1
    alerts = spark.read.parquet(str(tmp_path / "sensor_alerts")).collect()
    assert [(r.sensor_id, r.alert_type) for r in alerts] == [("a", "HIGH_TEMPERATURE")]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_live_message_gives_a_raw_row_and_an_alert(spark, tmp_path):
    message = ('{"sensorId":"sensor-1","sensorType":"temperature","location":"test-location","temperature":42.5,'
               '"humidity":65.0,"pressure":1013.25,"batteryLevel":88.0,"status":"active",'
               '"timestamp":"2024-01-01T00:00:00Z","metadata":null}')
    spark.createDataFrame([(message,), ("junk",)], "value string").write.text(str(tmp_path / "in"))
    run = run_at(tmp_path)
    jobs.start_raw_job(spark.readStream.text(str(tmp_path / "in")), run).awaitTermination()
    raw = spark.read.parquet(f"{run.output}/sensor_raw_data").collect()
    alerts = spark.read.parquet(f"{run.output}/sensor_alerts").collect()
    assert [(r.sensor_id, r.temperature, r.manufacturer) for r in raw] == [("sensor-1", 42.5, "")]
    assert [r.alert_type for r in alerts] == ["HIGH_TEMPERATURE"]


def test_append_only_sink_counts_a_batch_once(spark, tmp_path):
    rows, ledger = str(tmp_path / "rows"), str(tmp_path / "ledger")
    spark.createDataFrame([], "writer string, batch_id long, attempt string").write.parquet(ledger)

    def append(path):
        return lambda df: df.write.mode("append").parquet(path)

    sink = sinks.append_only_sink(append(rows), append(ledger), lambda s: s.read.parquet(ledger), "a")
    other = sinks.append_only_sink(append(rows), append(ledger), lambda s: s.read.parquet(ledger), "b")
    dying = sinks.append_only_sink(append(rows), lambda df: 1 / 0, lambda s: s.read.parquet(ledger), "a")
    with pytest.raises(ZeroDivisionError):
        dying(spark.range(3), 0)
    sink(spark.range(3), 0)
    sink(spark.range(3), 0)
    sink(spark.range(10, 12), 1)
    other(spark.range(20, 21), 0)
    assert spark.read.parquet(rows).count() == 9
    kept = sinks.committed(spark.read.parquet(rows), spark.read.parquet(ledger))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 10, 11, 20]


def test_database_writes_are_batched():
    """No database is started here; the calls to Spark's writer are recorded."""
    class Recorder:
        def __init__(self): self.calls = {}
        @property
        def write(self): return self
        def mode(self, m): self.calls["mode"] = m; return self
        def options(self, **o): self.calls.update(o); return self
        def jdbc(self, url, table): self.calls.update(url=url, table=table)

    frame = Recorder()
    sinks.jdbc_append("jdbc:x", "sensors", {"user": "u"}, connections=8)(frame)
    assert frame.calls == {"mode": "append", "user": "u", "batchsize": "5000", "numPartitions": "8",
                           "url": "jdbc:x", "table": "sensors"}


def test_hourly_states_over_batches(spark, split_events, tmp_path):
    metrics = rollup.sensor_metrics(batch_sensors(spark), "1 minute")
    metrics.repartition(5).write.parquet(str(tmp_path / "metrics"))
    source = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "metrics"))
    run = run_at(tmp_path)
    jobs.start_hourly_stream(source, run).awaitTermination()
    assert same(jobs.read_hourly(tables.read_table(spark, run.output)), hourly.hourly_states(metrics))


def test_session_settings_are_left_alone(spark, split_events, tmp_path):
    keys = list(STREAM_SETTINGS)
    spark.conf.set(keys[2], "17")
    jobs.start_rollup_stream(views.to_sensors(stream(spark, split_events, 8)), run_at(tmp_path), mode="deltas").awaitTermination()
    assert spark.conf.get(keys[2]) == "17"
    spark.conf.set(keys[2], STREAM_SETTINGS[keys[2]])


def test_progress_table(spark, split_events, tmp_path):
    path = str(tmp_path / "progress")
    listener = progress.ProgressTable(spark, path, every=1000)
    query = jobs.start(stream(spark, split_events), lambda b, i: b.write.format("noop").mode("append").save(), run_at(tmp_path))
    query.awaitTermination()

    class Event:
        def __init__(self, p): self.progress = p

    for p in query.recentProgress:
        listener.onQueryProgress(Event(p))
    listener.flush()
    total = progress.throughput(spark.read.parquet(path)).first()
    assert total.total_in == 1000 and total.batches == len(query.recentProgress)


def test_work_dir_follows_the_cluster_setting():
    class Settings(dict):
        def get(self, key, default=None): return super().get(key, default)

    class Context:
        def __init__(self, master, conf): self.master, self.conf = master, conf
        def getConf(self): return self.conf

    class Session:
        def __init__(self, master, **conf):
            self.conf = Settings(conf)
            self.sparkContext = Context(master, self.conf)

    shared = Session("spark://cluster:7077", **{"spark.checkpoint.dir": "s3a://shared/work/"})
    a, b = work_dir(shared, "x"), work_dir(shared, "x")
    assert a != b and a.startswith("s3a://shared/work/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session("spark://cluster:7077"), "x")


def test_batches_are_of_files_that_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 50)
    batches = []

    def write(batch, batch_id):
        rows = batch.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.collect_list("seq").alias("ids"))
        batches.append(rows.collect())

    rows = stream_queries._in_four_batches(spark, SMALL)
    jobs.start(rows, write, jobs.Run(str(tmp_path / "out"), str(tmp_path / "checkpoint"), every=None)).awaitTermination()
    assert len(batches) == 4 and all(len(b) > 1 for b in batches)
    assert max(r.rows for b in batches for r in b) <= 2 * 50
    events = [r.event_id for r in views.events(spark, SMALL).select("event_id").collect()]
    assert sorted(i for b in batches for r in b for i in r.ids) == sorted(events)
