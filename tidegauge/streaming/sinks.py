"""Sinks for micro-batches that may be repeated after a failure.

Folder tables take each batch in a folder of its own and then a commit; a batch that
is not committed is written anew, one that is committed is skipped.  Targets that can
only be appended to (a database without transactions) get every attempt tagged and a
ledger row when the attempt is complete; readers take the rows whose attempt is in the
ledger.

Who writes is a job (``writer``) and a generation of it, the id of the query, which its
checkpoint keeps.  A job that starts on a fresh checkpoint reads its source anew: its
new generation replaces the old one for readers, or is refused (``fresh``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import alerting, commits
from tidegauge.operators.tables import LAYOUTS, Layout, write_batch

BatchWriter = Callable[[DataFrame, int], None]

# Rows per round trip to a database.
JDBC_BATCH = 5000


#: Rows that this process's sinks have written, by query and batch, until the progress of the batch is taken down.
written: dict[tuple[str, int], int] = {}


def _count(generation: str, batch_id: int, rows: int) -> None:
    if len(written) > 10_000:  # nobody takes them down
        written.clear()
    written[generation, batch_id] = written.get((generation, batch_id), 0) + rows


def table_sink(
    path: str, layout: Layout, shape: Callable[[DataFrame], DataFrame] | None = None, *, writer: str, fresh: str = "replace",
) -> BatchWriter:
    """Write each micro-batch (after ``shape``) to its folder of the table, and commit it.

    ``writer`` must differ between jobs that write to one table (``Run.writer``).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, generation = batch.sparkSession, commits.query_of(batch)
        if commits.is_committed(spark, path, writer, generation, batch_id):
            return
        commits.start_generation(spark, path, writer, generation, fresh)
        _count(generation, batch_id, write_batch(shape(batch) if shape else batch, batch_id, path, layout, writer, generation))
        commits.commit(spark, path, writer, generation, batch_id)

    return write


def raw_and_alerts_sink(
    path: str, active: Column | None = None, time: str = "timestamp", *, writer: str, fresh: str = "replace",
) -> BatchWriter:
    """Write the readings and the alerts among them to two tables.

    The decoded batch is kept (spilling to disk) between the two writes so that
    messages are parsed once.  Both are committed after the second; a crash before
    that repeats the batch, and both folders are replaced.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, generation = batch.sparkSession, commits.query_of(batch)
        names = [n for n in ("sensor_raw_data", "sensor_alerts")
                 if not commits.is_committed(spark, f"{path}/{n}", writer, generation, batch_id)]
        if not names:
            return
        for name in names:
            commits.start_generation(spark, f"{path}/{name}", writer, generation, fresh)
        rows = (batch if active is None else batch.filter(active)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in names:
                out = rows if name == "sensor_raw_data" else alerting.alert_rows(rows, time).withColumn("processing_time", F.current_timestamp())
                _count(generation, batch_id, write_batch(out, batch_id, f"{path}/{name}", LAYOUTS[name], writer, generation))
            for name in names:
                commits.commit(spark, f"{path}/{name}", writer, generation, batch_id)
        finally:
            rows.unpersist()

    return write


def append_only_sink(
    append_rows: Callable[[DataFrame], None],
    append_ledger: Callable[[DataFrame], None],
    read_ledger: Callable[[SparkSession], DataFrame],
    writer: str,
) -> BatchWriter:
    """Effectively-once writes to a target that knows only appends.

    Rows and ledger are tagged with writer (the job, a number and its generation),
    batch and attempt.  A batch of this generation that is already in the ledger is
    skipped.  Rows of an attempt that died half-way stay behind but are never in the
    ledger; those of an older generation are, and ``committed`` leaves them out.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, generation = batch.sparkSession, commits.query_of(batch)
        ledger = read_ledger(spark).filter(F.col("writer").startswith(f"{writer}:"))
        known = sorted(r.writer for r in ledger.select("writer").distinct().collect())  # one a generation
        own = next((w for w in known if w.endswith(f":{generation}")), None)
        if own is None:
            own = f"{writer}:{len(known) + 1:06d}:{generation}"
        elif not ledger.filter((F.col("writer") == own) & (F.col("batch_id") == batch_id)).isEmpty():
            return
        attempt = uuid.uuid4().hex
        tags = {"writer": F.lit(own), "batch_id": F.lit(batch_id).cast("long"), "attempt": F.lit(attempt)}
        append_rows(batch.withColumns(tags))
        append_ledger(spark.range(1).select(*[column.alias(name) for name, column in tags.items()]))

    return write


def committed(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of completed attempts, one attempt per batch of each job's newest generation."""
    newest = ledger.groupBy(F.substring_index("writer", ":", 1).alias("job")).agg(F.max("writer").alias("writer")).drop("job")
    chosen = ledger.join(newest, "writer", "left_semi").groupBy("writer", "batch_id").agg(F.min("attempt").alias("attempt"))
    return rows.join(chosen, ["writer", "batch_id", "attempt"], "left_semi").drop("writer", "batch_id", "attempt")


def jdbc_append(
    url: str, table: str, properties: dict[str, str] | None = None,
    batch_size: int = JDBC_BATCH, connections: int | None = None,
) -> Callable[[DataFrame], None]:
    """Append a frame to a database table in prepared-statement batches.

    ``connections`` bounds the parallel writers the database has to serve.
    """
    options = {**(properties or {}), "batchsize": str(batch_size)}
    if connections:
        options["numPartitions"] = str(connections)

    def append(df: DataFrame) -> None:
        df.write.mode("append").options(**options).jdbc(url, table)

    return append


def jdbc_sink(
    url: str, table: str, ledger_table: str, writer: str, properties: dict[str, str] | None = None,
    batch_size: int = JDBC_BATCH, connections: int | None = None,
) -> BatchWriter:
    """The append-only sink over a database; both tables exist beforehand."""
    def read_ledger(spark: SparkSession) -> DataFrame:
        return spark.read.options(**(properties or {})).jdbc(url, ledger_table)

    return append_only_sink(
        jdbc_append(url, table, properties, batch_size, connections),
        jdbc_append(url, ledger_table, properties, batch_size),
        read_ledger, writer,
    )
