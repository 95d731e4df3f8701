"""The streaming jobs: roll-up, alerts, raw fan-out, hourly states.

Each ``start_*`` function takes a streaming DataFrame and a ``Run`` and returns
the running query.  All state a restart needs is in the checkpoint folder; all
sinks may see a batch twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge import schemas
from tidegauge.functions.timeparts import Moment, as_moment, with_partition_source
from tidegauge.operators import canonical, hourly, rollup, tables
from tidegauge.operators.alerting import sensor_names
from tidegauge.operators.tables import LAYOUTS, Layout
from tidegauge.plans import reports
from tidegauge.session import hadoop_path, stream_settings
from tidegauge.sources.avro_messages import decode_avro
from tidegauge.sources.json_messages import decode_json
from tidegauge.streaming.sinks import BatchWriter, raw_and_alerts_sink, table_sink

ROLLUPS = Layout("window_start", ("device_id",), ("device_id",))
READINGS = Layout("window_start", ("sensorId",), ("sensorId",))
ENTITY_HOURS = Layout("hour_start", ("entity",), ("entity",))
HOURS = Layout("hour_window", ("sensor_id",), ("sensor_id",))


@dataclass(frozen=True)
class Run:
    """Where a job writes and how often it runs.

    ``every`` is the interval between batches (a checkpoint each); ``None``
    processes what is there and stops.  ``fresh`` says what a checkpoint that is new
    does to a table that has batches of an older one: ``replace`` them or ``refuse``.
    """

    output: str
    checkpoint: str
    every: str | None = "60 seconds"
    name: str | None = None
    fresh: str = "replace"

    @property
    def writer(self) -> str:
        """The job: the place of its checkpoint.  What is in there, the query's id, is the job's generation."""
        return "w" + hashlib.sha256(self.checkpoint.rstrip("/").encode()).hexdigest()[:16]

    @property
    def ends(self) -> str:
        """Where ``close_windows`` leaves word for the query."""
        return self.checkpoint.rstrip("/") + "-ends"


def start(df: DataFrame, write: BatchWriter, run: Run, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", run.checkpoint)
    writer = writer.trigger(processingTime=run.every) if run.every else writer.trigger(availableNow=True)
    if run.name:
        writer = writer.queryName(run.name)
    with stream_settings(df.sparkSession):
        return writer.start()


def decode_readings(messages: DataFrame, on_error: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """Binary messages to canonical sensor rows with their event time."""
    decoded = decode_avro(messages, on_error=on_error, keep=tuple(keep))
    return canonical.canonicalize_avro(decoded, keep=tuple(keep), with_time=True)


def start_rollup_stream(
    rows: DataFrame,
    run: Run,
    window: str = "1 minute",
    key: str = "device_id",
    mode: str = "deltas",
    lateness: str | None = None,
    clock: str = "event",
) -> StreamingQuery:
    """Roll up canonical rows into ``run.output``.

    ``deltas``: every batch writes its own mergeable states and keeps nothing
    between batches, so no row is ever too late; readers merge.
    ``append``: a window is written once, when the watermark has passed its
    end; of a source that has ended ``close_windows`` has the same query write the
    rest.  ``update``: a window is written again whenever it changes.  In both,
    windows more than ``lateness`` old leave the state, and rows for them are
    dropped and counted in the progress; so ``lateness`` has to be given.
    Read the result with ``read_rollups`` and the same mode.

    ``clock="processing"`` puts rows into the window of their arrival instead
    of their own time.  With ``append`` the clock goes on without messages, so a
    window is written within a batch of its end also where nothing follows.
    """
    def states(df: DataFrame, time: str) -> DataFrame:
        return rollup.rollup_states(df, window, key, time)

    return _start_rollup(rows, run, states, lambda df: rollup.finish_rollup(df, key), mode, lateness, clock)


def start_rollup_job(
    messages: DataFrame,
    run: Run,
    window: str = "1 minute",
    mode: str = "deltas",
    lateness: str | None = None,
    clock: str = "event",
    keep: Sequence[str] = (),
    on_error: str = "fail",
) -> StreamingQuery:
    """Binary messages to rolled-up sensor rows; options as in ``start_rollup_stream``.

    ``keep`` may name the column ``seq``, the position of a message in its
    topic, to settle which of two readings of one instant came first.
    """
    readings = decode_avro(messages, on_error=on_error, keep=tuple(keep))
    readings = readings.withColumn("time", F.timestamp_millis("timestamp"))

    def states(df: DataFrame, time: str) -> DataFrame:
        return rollup.reading_states(df, window, time)

    return _start_rollup(readings, run, states, rollup.finish_readings, mode, lateness, clock)


def _start_rollup(
    rows: DataFrame,
    run: Run,
    states: Callable[[DataFrame, str], DataFrame],
    finish: Callable[[DataFrame], DataFrame],
    mode: str,
    lateness: str | None,
    clock: str,
) -> StreamingQuery:
    time = "time"
    if mode != "deltas" and clock == "event" and lateness is None:
        raise ValueError(f"mode {mode} drops rows later than its watermark: give the lateness")
    rows = rows.observe("source", F.count(F.lit(1)).alias("rows"))
    if clock == "processing":
        rows, time, lateness = rows.withColumn("arrival", F.current_timestamp()), "arrival", "0 seconds"
    if mode == "deltas":
        layout = ROLLUPS if "device_id" in rows.columns else READINGS
        sink = table_sink(run.output, layout, lambda batch: states(batch, time), writer=run.writer, fresh=run.fresh)
        return start(rows, sink, run)
    spark, clocks = rows.sparkSession, []
    if clock == "event":
        files, folder = hadoop_path(spark, run.ends)
        files.mkdirs(folder)
        ends = spark.readStream.schema("upto timestamp").parquet(run.ends)
        clocks.append(ends.select((F.col("upto") + F.expr(f"interval {lateness}")).alias(time)))
    elif mode == "append" and run.every:
        clocks.append(spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.current_timestamp().alias(time)))
    rolled = finish(states(_with_clocks(rows, time, lateness, clocks), time)).observe("window", F.count(F.lit(1)).alias("rows"))
    return start(rolled, table_sink(run.output, ROLLUPS, writer=run.writer, fresh=run.fresh), run, mode)


def _with_clocks(rows: DataFrame, time: str, lateness: str, clocks: Sequence[DataFrame]) -> DataFrame:
    """The rows under a watermark that the moments of ``clocks`` move as well.

    A moment is a row that the watermark sees and that is dropped right after it.  The
    condition asks for the time too, else the optimizer would drop the row before.  Its
    other columns are as nullable as the rows' and no constants, so that the plan, and
    with it the layout of the state, is the same whether a batch has moments or not.
    """
    flag = "__moment"
    rows = rows.withColumn(flag, F.lit(False))
    never = F.lit("0001-01-02 00:00:00").cast(rows.schema[time].dataType)
    for moments in clocks:
        moment = F.col(time).cast(rows.schema[time].dataType)
        fields = {}
        for f in rows.schema.fields:
            value = F.when(moment < never, _default(f.dataType))
            fields[f.name] = value if f.nullable else F.coalesce(value, _default(f.dataType))
        fields |= {flag: F.lit(True), time: moment}
        rows = rows.unionByName(moments.select(*[column.alias(name) for name, column in fields.items()]))
    return rows.withWatermark(time, lateness).filter(~F.col(flag) | (F.col(time) < never)).drop(flag)


def _default(kind: T.DataType) -> Column:
    """A value of a type that is not null."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_default(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return (F.array() if isinstance(kind, T.ArrayType) else F.create_map()).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    return F.lit(b"" if isinstance(kind, T.BinaryType) else "" if isinstance(kind, T.StringType) else 0).cast(kind)


def close_windows(spark: SparkSession, run: Run, upto: Moment) -> None:
    """Have the query of ``run`` close all windows that end by ``upto``, without another message.

    Its next batch (of a query that runs, or of the next start on the same checkpoint)
    moves the watermark there and writes them; its state is then empty of them, and rows
    before ``upto`` that come later are late.  The source is not read again.
    """
    moment = spark.createDataFrame([(as_moment(upto).isoformat(sep=" "),)], "upto string").select(F.col("upto").cast("timestamp"))
    moment.coalesce(1).write.mode("append").parquet(run.ends)


def read_rollups(table: DataFrame, mode: str = "deltas", key: str = "device_id", day: bool = False) -> DataFrame:
    """The roll-up rows of a table written by a roll-up stream or job.

    With ``day`` the partition of the window's start stays: a range over ``window_start``
    (``time_range``) then goes through the merge to the folders, and history outside it
    is neither listed nor merged.
    """
    kept = ("day",) if day else ()
    if mode == "update":
        table = newest_batch(table, (key, "window_start", "writer", *kept))
    table = table.drop(*tables.BATCH_COLUMNS, *(() if day else ("day",)))
    if mode == "deltas":
        if "sensorId" in table.columns:
            table = rollup.finish_readings(rollup.merge_rollups(table, key="sensorId", also=kept), also=kept)
        else:
            table = rollup.finish_rollup(rollup.merge_rollups(table, key=key, also=kept), key, also=kept)
    return with_partition_source(table, "day", "window_start") if day else table


def merge_states(table: DataFrame) -> DataFrame:
    """States of ``deltas`` batches by key and window: the ``merge`` of ``tables.compact_batches``."""
    key = "sensorId" if "sensorId" in table.columns else "device_id"
    return rollup.merge_rollups(table.drop("batch_id"), key=key)


def merge_updates(table: DataFrame) -> DataFrame:
    """The newest row of each window that an ``update`` stream wrote: another ``merge``."""
    return newest_batch(table, ("device_id", "window_start"))


def sensors_table(rolled: DataFrame) -> DataFrame:
    """Roll-up rows as rows of the sensors table: its columns by name and narrowed, and ``has_alert`` over them."""
    return canonical.with_has_alert(schemas.conform(rolled))


def newest_batch(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows with equal keys the one of the latest batch."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")


def start_alert_job(messages: DataFrame, run: Run, on_error: str = "skip") -> StreamingQuery:
    """Integer JSON messages; active readings and their alerts to two tables."""
    rows = decode_json(messages, schemas.JSON_INTEGER, on_error=on_error)
    return start(sensor_names(rows), raw_and_alerts_sink(run.output, active=F.col("status") == 1, writer=run.writer, fresh=run.fresh), run)


def start_raw_job(messages: DataFrame, run: Run, active: Column | None = None) -> StreamingQuery:
    """Nested local JSON messages; all readings and their alerts to two tables."""
    rows = decode_json(messages, schemas.JSON_LOCAL, on_error="skip")
    flat = canonical.flatten_local_json(rows, keep=("timestamp",))
    return start(flat, raw_and_alerts_sink(run.output, active=active, writer=run.writer, fresh=run.fresh), run)


def start_hourly_stream(metrics: DataFrame, run: Run) -> StreamingQuery:
    """Keep hourly states up to date from a stream of metrics rows.

    Each batch adds its own states; ``read_hourly`` merges them.  Nothing is
    read back or rewritten, so the cost of a batch does not grow with history.
    """
    return start(metrics, table_sink(run.output, HOURS, hourly.hourly_states, writer=run.writer, fresh=run.fresh), run)


def read_hourly(table: DataFrame) -> DataFrame:
    return hourly.merge_hourly_states(table.drop(*tables.BATCH_COLUMNS, "day"))


def start_hour_states(rows: DataFrame, run: Run, kind: str) -> StreamingQuery:
    """Keep the hour states of a single-day report (``reports.SINGLE_DAY``) up to date from a stream of canonical rows."""
    return start(rows, table_sink(run.output, ENTITY_HOURS, lambda batch: reports.hour_states(batch, kind), writer=run.writer, fresh=run.fresh), run)


def start_hybrid(
    messages: DataFrame, raw: Run, rolled: Run, keep: Sequence[str] = (), on_error: str = "fail", **options,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Raw rows (to be kept for a day) and roll-ups (kept long) of one topic.

    Two queries with a checkpoint each, so that a slow sink of one does not
    hold up the other; the raw table is trimmed with ``apply_retention``.
    """
    rows = decode_readings(messages, on_error, keep)
    return (
        start(rows, table_sink(raw.output, LAYOUTS["sensors"], writer=raw.writer, fresh=raw.fresh), raw),
        start_rollup_job(messages, rolled, keep=keep, on_error=on_error, **options),
    )
