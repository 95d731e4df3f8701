"""Streaming jobs, run over the whole events table until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions.timeparts import last
from tidegauge.operators import hourly, rollup, tables
from tidegauge.operators.alerting import sensor_names
from tidegauge.plans import views
from tidegauge.plans.messages import encode_readings
from tidegauge.plans.registry import over_metrics, over_sensors, plain_times, query
from tidegauge.plans.rollup_queries import AVRO_ROWS, HOURLY_SQL, avro_rollup_sql, rollup_sql
from tidegauge.session import hadoop_path, work_dir
from tidegauge.streaming import jobs, progress
from tidegauge.streaming.sinks import append_only_sink, committed, raw_and_alerts_sink

AS_OF = views.AS_OF
#: After the last event.
END = "2024-03-01 00:00:00"


def run_of(spark: SparkSession, name: str) -> jobs.Run:
    return jobs.Run(work_dir(spark, name), work_dir(spark, f"{name}-checkpoint"), every=None)


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.to_sensors(views.stream_events(spark, sf_dir))


def stream_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_readings(views.avro_readings(_sensors(spark, sf_dir)), schemas.AVRO_READING)


def _rollups(spark: SparkSession, sf_dir: str, name: str, mode: str, window: str, **options) -> DataFrame:
    run = run_of(spark, name)
    jobs.start_rollup_stream(_sensors(spark, sf_dir), run, window, mode=mode, **options).awaitTermination()
    return jobs.read_rollups(tables.read_table(spark, run.output), mode)


@query("h1_processing_time_windows", over_sensors("""
  select device_id, count(*) as readings, avg(temperature) as avg_temp from sensors group by device_id"""))
def processing_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which window a row arrives in depends on the clock; totals per device do not."""
    run = run_of(spark, "h1")
    rows = _sensors(spark, sf_dir)
    jobs.start_rollup_stream(rows, run, mode="update", clock="processing").awaitTermination()
    rolled = jobs.read_rollups(tables.read_table(spark, run.output), "update")
    return rolled.groupBy("device_id").agg(
        F.sum("reading_count").alias("readings"),
        (F.sum(F.col("temperature") * F.col("reading_count")) / F.sum("reading_count")).alias("avg_temp"),
    )


def _append_rollups(start_job, spark: SparkSession, sf_dir: str, name: str, source, **options) -> DataFrame:
    """An ``append`` job over a source that ends, and the same query's last windows."""
    run = run_of(spark, name)
    start = lambda: start_job(source(spark, sf_dir), run, "1 hour", mode="append", lateness="2 minutes", **options)
    start().awaitTermination()
    jobs.close_windows(spark, run, END)
    start().awaitTermination()  # on its checkpoint: the source has nothing new
    return jobs.read_rollups(tables.read_table(spark, run.output), "append")


@query("h2_event_time_append", rollup_sql("hour"))
def event_time_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, and those that ``close_windows`` has."""
    return plain_times(_append_rollups(jobs.start_rollup_stream, spark, sf_dir, "h2", _sensors))


#: Rows of a file that a batch reads; a file is one task's, which sorts its rows.
FILE_ROWS = 250_000


def _in_four_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files by id, a quarter of them per batch: times go back and forth."""
    source = work_dir(spark, "events-by-id")
    rows = views.events(spark, sf_dir)
    per_batch = max(1, -(-rows.count() // (4 * FILE_ROWS)))
    rows.repartition(4 * per_batch, F.xxhash64("event_id")).write.parquet(source)
    files, written = hadoop_path(spark, f"{source}/part-*")
    per_batch = max(1, -(-len(files.globStatus(written)) // 4))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    return views.to_sensors(stream.withColumn("ts", F.col("ts").cast("timestamp")))


@query("h8_unordered_files", rollup_sql("hour"))
def unordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode over files out of time order: no reading is too late."""
    run = run_of(spark, "h8-unordered")
    jobs.start_rollup_stream(_in_four_batches(spark, sf_dir), run, "1 hour").awaitTermination()
    return plain_times(jobs.read_rollups(tables.read_table(spark, run.output)))


@query("h7_new_checkpoint", over_sensors("""
  select device_id, 2 * count(*) as rows from sensors group by device_id"""))
def new_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second query on one table counts its batches from 0 as well and replaces nothing."""
    first, second = run_of(spark, "h7-a"), run_of(spark, "h7-b")
    for checkpoint in (first.checkpoint, second.checkpoint):
        run = jobs.Run(first.output, checkpoint, every=None)
        sink = jobs.table_sink(run.output, tables.LAYOUTS["sensors"], writer=run.writer)
        jobs.start(_sensors(spark, sf_dir), sink, run).awaitTermination()
    return tables.read_table(spark, first.output).groupBy("device_id").agg(F.count("*").alias("rows"))


@query("h3_keyed_state_update", rollup_sql("hour"))
def keyed_state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(_rollups(spark, sf_dir, "h3", "update", "1 hour", lateness="60 days"))


@query("h4_restart_from_checkpoint", rollup_sql("hour"))
def restart_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped and started again on the same checkpoint, nothing is counted twice."""
    run = run_of(spark, "h4")
    for _ in range(2):
        query_ = jobs.start_rollup_stream(_sensors(spark, sf_dir), run, "1 hour", mode="deltas")
        query_.awaitTermination()
    return plain_times(jobs.read_rollups(tables.read_table(spark, run.output), "deltas"))


@query("h5_append_only_replay", over_sensors("select seq, device_id, temperature, time from sensors"))
def append_only_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt that dies after its rows and before its ledger row, then a
    repeat, then another: the rows count once.  Files stand in for the database."""
    out = work_dir(spark, "h5")
    run = run_of(spark, "h5-run")
    def append_rows(df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{out}/rows")

    def append_ledger(df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{out}/ledger")

    def read_ledger(session: SparkSession) -> DataFrame:
        return session.read.parquet(f"{out}/ledger")

    append_ledger(spark.createDataFrame([], "writer string, batch_id long, attempt string"))

    sink = append_only_sink(append_rows, append_ledger, read_ledger, run.writer)
    lost = append_only_sink(append_rows, lambda df: None, read_ledger, run.writer)

    def write(batch: DataFrame, batch_id: int) -> None:
        lost(batch, batch_id)
        sink(batch, batch_id)
        sink(batch, batch_id)

    rows = _sensors(spark, sf_dir).select("seq", "device_id", "temperature", "time")
    jobs.start(rows, write, run).awaitTermination()
    return plain_times(committed(spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/ledger")))


@query("h5_two_writers", over_sensors("""
  select 1 as writer, count(*) as rows from sensors union all select 2, count(*) from sensors"""))
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries append to one target: neither takes the other's batch 0 for its own."""
    out = work_dir(spark, "h5-two")
    append_rows = lambda df: df.write.mode("append").parquet(f"{out}/rows")
    append_ledger = lambda df: df.write.mode("append").parquet(f"{out}/ledger")
    append_ledger(spark.createDataFrame([], "writer string, batch_id long, attempt string"))
    for number in (1, 2):
        run = run_of(spark, f"h5-{number}")
        sink = append_only_sink(append_rows, append_ledger, lambda s: s.read.parquet(f"{out}/ledger"), run.writer)
        jobs.start(_sensors(spark, sf_dir).select(F.lit(number).alias("source"), "seq"), sink, run).awaitTermination()
    rows = committed(spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/ledger"))
    return rows.groupBy(F.col("source").alias("writer")).agg(F.count("*").alias("rows"))


FAN_OUT_SQL = """
  select 'sensor_raw_data' as table_name, {id} as sensor_id, temperature, humidity, battery_level,
    '' as alert_type, date_trunc('millisecond', time) as time from sensors {active}
  union all
  select 'sensor_alerts', {id}, temperature, humidity, battery_level,
    case when temperature > 35 then 'HIGH_TEMPERATURE' when humidity > 80 then 'HIGH_HUMIDITY' else 'LOW_BATTERY' end,
    date_trunc('millisecond', time)
  from sensors where has_alert = 1 {and_active}"""
NUMBER = "cast(substr(device_id, 8) as int)"


def _fan_out(spark: SparkSession, path: str) -> DataFrame:
    raw = tables.read_table(spark, f"{path}/sensor_raw_data").select(
        F.lit("sensor_raw_data").alias("table_name"), "sensor_id", "temperature", "humidity", "battery_level",
        F.lit("").alias("alert_type"), F.col("timestamp").alias("time"))
    alerts = tables.read_table(spark, f"{path}/sensor_alerts").select(
        F.lit("sensor_alerts").alias("table_name"), "sensor_id", "temperature", "humidity", "battery_level",
        "alert_type", F.col("alert_time").alias("time"))
    return plain_times(raw.unionByName(alerts))


@query("d5_fan_out_active", over_sensors(FAN_OUT_SQL.format(
    id="device_id", active="where status = 1", and_active="and status = 1").replace(
        "date_trunc('millisecond', time)", "time")))
def fan_out_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "d5")
    rows = sensor_names(_sensors(spark, sf_dir)).withColumnRenamed("time", "timestamp")
    sink = raw_and_alerts_sink(run.output, active=F.col("status") == 1, writer=run.writer)
    jobs.start(rows, sink, run).awaitTermination()
    return _fan_out(spark, run.output)


@query("d6_fan_out_all", over_sensors(FAN_OUT_SQL.format(id="device_id", active="", and_active="").replace(
    "date_trunc('millisecond', time)", "time")))
def fan_out_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "d6")
    rows = sensor_names(_sensors(spark, sf_dir)).withColumnRenamed("time", "timestamp")
    jobs.start(rows, raw_and_alerts_sink(run.output, writer=run.writer), run).awaitTermination()
    return _fan_out(spark, run.output)


@query("h8_rollup_job_minute", avro_rollup_sql("minute"))
def rollup_job_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "h8")
    jobs.start_rollup_job(stream_avro(spark, sf_dir), run, keep=("seq",), mode="deltas").awaitTermination()
    return plain_times(jobs.read_rollups(tables.read_table(spark, run.output), "deltas"))


@query("h8_rollup_job_append", avro_rollup_sql("hour"))
def rollup_job_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(_append_rollups(jobs.start_rollup_job, spark, sf_dir, "h8-append", stream_avro, keep=("seq",)))


@query("h8_rollup_job_day", avro_rollup_sql("day"))
def rollup_job_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "h8-day")
    query_ = jobs.start_rollup_job(stream_avro(spark, sf_dir), run, keep=("seq",), mode="update", window="1 day", lateness="60 days")
    query_.awaitTermination()
    return plain_times(jobs.read_rollups(tables.read_table(spark, run.output), "update"))


@query("h9_alert_job", over_sensors(FAN_OUT_SQL.format(
    id=NUMBER, active="where status = 1", and_active="and status = 1")))
def alert_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "h9")
    jobs.start_alert_job(views.integer_messages(_sensors(spark, sf_dir)), run).awaitTermination()
    return _fan_out(spark, run.output)


@query("h10_raw_job", over_sensors(FAN_OUT_SQL.format(id="device_id", active="", and_active="")))
def raw_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_of(spark, "h10")
    jobs.start_raw_job(views.local_messages(_sensors(spark, sf_dir)), run).awaitTermination()
    return _fan_out(spark, run.output)


@query("h7_compacted_table", over_sensors("select seq, device_id, temperature, status, time from sensors"))
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batch folders rewritten as one clustered table."""
    run = run_of(spark, "h7")
    compact = work_dir(spark, "h7-compact")
    layout = tables.LAYOUTS["sensors"]
    jobs.start(_sensors(spark, sf_dir), jobs.table_sink(run.output, layout, writer=run.writer), run).awaitTermination()
    tables.compact_batches(spark, run.output, compact, layout)
    rows = tables.read_compacted(spark, run.output, compact)
    return plain_times(rows.select("seq", "device_id", "temperature", "status", "time"))


@query("h7_compacted_twice", over_sensors("select seq, device_id, temperature, status, time from sensors"))
def compacted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted between batches and after them, the old folders removed: every row once."""
    run = run_of(spark, "h7-twice")
    compact = work_dir(spark, "h7-twice-compact")
    layout = tables.LAYOUTS["sensors"]
    sink = jobs.table_sink(run.output, layout, writer=run.writer)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id == 1:
            tables.compact_batches(spark, run.output, compact, layout)

    jobs.start(_in_four_batches(spark, sf_dir), write, run).awaitTermination()
    for _ in range(2):
        tables.compact_batches(spark, run.output, compact, layout)
    tables.remove_compacted(spark, run.output, compact)
    rows = tables.read_compacted(spark, run.output, compact)
    return plain_times(rows.select("seq", "device_id", "temperature", "status", "time"))


@query("h7_compacted_update", rollup_sql("hour"))
def compacted_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of changing windows stays readable when its batches are compacted."""
    run = run_of(spark, "h7-update")
    compact = work_dir(spark, "h7-update-compact")
    jobs.start_rollup_stream(_in_four_batches(spark, sf_dir), run, "1 hour", mode="update", lateness="60 days").awaitTermination()
    tables.compact_batches(spark, run.output, compact, jobs.ROLLUPS, upto=1)
    return plain_times(jobs.read_rollups(tables.read_compacted(spark, run.output, compact), "update"))


@query("f1_hourly_states_stream", over_metrics(HOURLY_SQL, "minute"))
def hourly_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table, read as a stream in several batches."""
    source = work_dir(spark, "f1-metrics")
    metrics = views.metrics(spark, sf_dir, "1 minute")
    tables.write_table(metrics, source, tables.LAYOUTS["sensor_metrics"])
    schema = tables.read_table(spark, source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(source).drop("day")
    run = run_of(spark, "f1")
    jobs.start_hourly_stream(stream, run).awaitTermination()
    return plain_times(jobs.read_hourly(tables.read_table(spark, run.output)))


@query("f6_hybrid", over_sensors(AVRO_ROWS + f"""
  select 'raw' as kind, device_id, time, temperature, cast(1 as bigint) as readings from avro
  where time > timestamp '{AS_OF}' - interval 1 day
  union all
  select 'rollup', device_id, date_trunc('hour', time) + interval 1 hour, avg(temperature), count(*)
  from avro group by 2, 3"""))
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of the last day beside roll-ups of the whole time."""
    raw, rolled = run_of(spark, "f6-raw"), run_of(spark, "f6-rollup")
    for query_ in jobs.start_hybrid(
            stream_avro(spark, sf_dir), raw, rolled, keep=("seq",), mode="deltas", window="1 hour"):
        query_.awaitTermination()
    kept = tables.apply_retention(tables.read_table(spark, raw.output), "time", 1, AS_OF)
    rollups = jobs.read_rollups(tables.read_table(spark, rolled.output), "deltas")
    return plain_times(kept.select(
        F.lit("raw").alias("kind"), "device_id", "time", "temperature", F.lit(1).cast("long").alias("readings")
    ).unionByName(rollups.select(
        F.lit("rollup").alias("kind"), "device_id", "time", "temperature", F.col("reading_count").alias("readings"))))


@query("k2_stream_throughput", over_sensors("""
  select count(*) as total_in, cast(0 as bigint) as total_dropped_late,
    count(distinct concat(device_id, cast(date_trunc('hour', time) as varchar))) as total_emitted from sensors"""))
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in, emitted and dropped late, from the progress table of a run."""
    run = run_of(spark, "k2")
    path = work_dir(spark, "k2-progress")
    table = progress.ProgressTable(spark, path)
    spark.streams.addListener(table)
    try:
        query_ = jobs.start_rollup_stream(_sensors(spark, sf_dir), run, "1 hour", mode="update", lateness="60 days")
        query_.awaitTermination()
        table.wait_for(query_)
    finally:
        spark.streams.removeListener(table)
    own = spark.read.parquet(path).filter(F.col("run_id") == str(query_.runId))
    totals = progress.throughput(own)
    return totals.select("total_in", "total_dropped_late", "total_emitted")


@query("k2_stages_deltas", over_sensors("""
  select count(*) as total_in, cast(0 as bigint) as total_dropped_late,
    count(distinct concat(device_id, cast(date_trunc('hour', time) as varchar))) as total_emitted from sensors"""))
def stages_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode, whose states are made in the sink: rows from the source and rows written."""
    return _throughput_of(spark, sf_dir, "k2-deltas", "deltas").select("total_in", "total_dropped_late", "total_emitted")


@query("k2_stages_append", over_sensors("""
  , w as (select count(distinct concat(device_id, cast(date_trunc('hour', time) as varchar))) as n from sensors)
  select count(*) as total_in, any_value(n) as total_from_windows, any_value(n) as total_emitted from sensors, w"""))
def stages_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the source, out of the windows, and written, over a job and its last windows."""
    return _throughput_of(spark, sf_dir, "k2-append", "append", lateness="2 minutes").select(
        "total_in", "total_from_windows", "total_emitted")


def _throughput_of(spark: SparkSession, sf_dir: str, name: str, mode: str, **options) -> DataFrame:
    run, path = run_of(spark, name), work_dir(spark, f"{name}-progress")
    table = progress.ProgressTable(spark, path)
    spark.streams.addListener(table)
    ids = []
    try:
        for _ in range(2 if mode == "append" else 1):
            query_ = jobs.start_rollup_stream(_sensors(spark, sf_dir), run, "1 hour", mode=mode, **options)
            query_.awaitTermination()
            table.wait_for(query_)
            ids.append(str(query_.runId))
            if mode == "append":
                jobs.close_windows(spark, run, END)
    finally:
        spark.streams.removeListener(table)
    own = spark.read.parquet(path).filter(F.col("run_id").isin(ids))
    return progress.throughput(own)


@query("h7_fresh_checkpoint_same_path", rollup_sql("hour"))
def fresh_checkpoint_same_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint is lost and the job started again at the same paths: the table has each reading once.

    Before that a batch dies after its rows and before its commit, which no reader sees.
    """
    run = run_of(spark, "h7-fresh")
    jobs.start_rollup_stream(_in_four_batches(spark, sf_dir), run, "1 hour").awaitTermination()
    lost = rollup.rollup_states(views.sensors(spark, sf_dir), "1 hour")
    tables.write_batch(lost, 9, run.output, jobs.ROLLUPS, run.writer, tables.commits.committed(spark, run.output)[0].generation)
    files, checkpoint = hadoop_path(spark, run.checkpoint)
    files.rename(checkpoint, hadoop_path(spark, run.checkpoint + "-lost")[1])
    jobs.start_rollup_stream(_sensors(spark, sf_dir), run, "1 hour").awaitTermination()
    return plain_times(jobs.read_rollups(tables.read_table(spark, run.output)))


@query("h5_fresh_checkpoint", over_sensors("select seq, device_id, temperature, time from sensors"))
def append_only_fresh_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of an append-only target after a fresh checkpoint at the same path: the new generation counts."""
    out, run = work_dir(spark, "h5-fresh"), run_of(spark, "h5-fresh-run")
    append_rows = lambda df: df.write.mode("append").parquet(f"{out}/rows")
    append_ledger = lambda df: df.write.mode("append").parquet(f"{out}/ledger")
    append_ledger(spark.createDataFrame([], "writer string, batch_id long, attempt string"))
    sink = append_only_sink(append_rows, append_ledger, lambda s: s.read.parquet(f"{out}/ledger"), run.writer)
    for source in (_in_four_batches, _sensors):
        rows = source(spark, sf_dir).select("seq", "device_id", "temperature", "time")
        jobs.start(rows, sink, run).awaitTermination()
        files, checkpoint = hadoop_path(spark, run.checkpoint)
        files.rename(checkpoint, hadoop_path(spark, f"{run.checkpoint}-lost")[1])
    return plain_times(committed(spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/ledger")))


@query("f1_merged_compaction", rollup_sql("hour"))
def merged_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of many batches, merged by two compactions: the stored rows are one a key and window."""
    run, compact = run_of(spark, "f1-merged"), work_dir(spark, "f1-merged-compact")
    jobs.start_rollup_stream(_in_four_batches(spark, sf_dir), run, "1 hour").awaitTermination()
    for upto in (1, None):
        tables.compact_batches(spark, run.output, compact, jobs.ROLLUPS, upto=upto, merge=jobs.merge_states)
    tables.remove_compacted(spark, run.output, compact)
    # What is stored needs no merge any more.
    stored = tables.read_compacted(spark, run.output, compact)
    return plain_times(rollup.finish_rollup(stored.drop(*tables.BATCH_COLUMNS, "day")))


@query("h8_pruned_rollups", f"""select * from ({rollup_sql("hour")}) where window_start >= timestamp '{AS_OF}' - interval 3 day""")
def pruned_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of windows of a stored roll-up: the folders of other days are neither listed nor merged."""
    run = run_of(spark, "h8-pruned")
    jobs.start_rollup_stream(_in_four_batches(spark, sf_dir), run, "1 hour").awaitTermination()
    rolled = jobs.read_rollups(tables.read_table(spark, run.output), day=True)
    return plain_times(last(rolled, AS_OF, "window_start", days=3).drop("day"))
