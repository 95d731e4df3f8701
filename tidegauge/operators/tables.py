"""Tables at rest: layout, retention, compaction.

A table is a Parquet folder partitioned by day (or month), each file sorted by
(key, time) so that row-group statistics and bloom filters skip most of a file
for one device.  The table itself says which time column its partition is of.

A compacted table is a set of runs and a manifest.  The manifest names the run (or
runs) that hold each day, and how far each writer's batches are in them.  A change
writes new runs first and a new manifest then; readers go by the newest manifest, so
they see a day as it was or as it is, and what a lost call wrote is never read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.timeparts import Moment, as_moment, last, time_range, with_partition_source
from tidegauge.functions.sampling import sample_edge, sample_hash
from tidegauge.operators import commits
from tidegauge.session import hadoop_path


@dataclass(frozen=True)
class Layout:
    """How a table is laid out: ``by`` is ``day`` or ``month``."""

    time: str
    keys: tuple[str, ...]
    bloom: tuple[str, ...] = ()
    by: str = "day"


#: Sizes that a bloom filter is chosen from: 1 MB and its halves, down to 64 bytes.
BLOOM_SIZES = 15

LAYOUTS = {
    "sensors": Layout("time", ("device_id",), ("device_id", "customer_id")),
    "cpu": Layout("time", ("service", "hostname"), ("hostname", "service"), by="month"),
    "sensor_raw_data": Layout("timestamp", ("sensor_id",), ("sensor_id",)),
    "sensor_alerts": Layout("alert_time", ("sensor_id",), ("sensor_id", "alert_type")),
    "sensor_metrics": Layout("window_start", ("sensor_id",), ("sensor_id",)),
}


def with_partition(df: DataFrame, layout: Layout) -> DataFrame:
    day = F.to_date(layout.time)
    return df.withColumn(layout.by, day if layout.by == "day" else F.trunc(day, "month"))


def _writer(df: DataFrame, layout: Layout) -> DataFrameWriter:
    """Sorted rows; ``df`` already has the partition column."""
    writer = df.sortWithinPartitions(layout.by, *layout.keys, layout.time).write.partitionBy(layout.by)
    # Filters of the size that a file's values need, else each file has one of 1 MB however few they are.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in layout.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.candidates.number#{column}", BLOOM_SIZES)
    return writer


def _mark(spark: SparkSession, path: str, layout: Layout) -> None:
    """Leave word of the layout's partition with the table."""
    files, root = hadoop_path(spark, f"{path}/_layout/{layout.by}-{layout.time}")
    if not files.exists(root):
        files.mkdirs(root)


def _marked(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The partition column of a table and the time column it is of."""
    files, root = hadoop_path(spark, f"{path}/_layout")
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return tuple(names[0].split("-", 1)) if len(names) == 1 else None


def _as_marked(df: DataFrame, mark: tuple[str, str] | None) -> DataFrame:
    return with_partition_source(df, *mark) if mark else df


def write_table(df: DataFrame, path: str, layout: Layout, mode: str = "append") -> None:
    """Bulk write, clustered by (partition, key).

    Ranges of (partition, key, time) keep a day in few files, of neighbouring
    devices each, and cut a device that holds a third of a day by time.
    """
    df = with_partition(df, layout).repartitionByRange(layout.by, *layout.keys, layout.time)
    _writer(df, layout).mode(mode).parquet(path)
    _mark(df.sparkSession, path, layout)


def write_clustered_sample(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """Bulk write in the order of a hash of ``key``, for samples by key.

    The hash is the column ``sample_hash``.  Files hold ranges of it, and its least and
    greatest value are in their footers, so a sample opens its share of the files only.
    """
    rows = df.withColumn("sample_hash", sample_hash(F.col(key)))
    rows.repartitionByRange("sample_hash").sortWithinPartitions("sample_hash").write.mode(mode).parquet(path)


def read_sample(spark: SparkSession, path: str, fraction: float) -> DataFrame:
    """The rows of a share of the keys, the same keys as ``sampling.in_sample`` takes."""
    return spark.read.parquet(path).filter(F.col("sample_hash") < sample_edge(fraction)).drop("sample_hash")


def write_batch(df: DataFrame, batch_id: int, path: str, layout: Layout, writer: str, generation: str = commits.DIRECT) -> int:
    """Write one micro-batch of one writer into its own folder, replacing what a
    failed or repeated run of the same batch left there; gives the number of rows.
    No shuffle: each task sorts and writes the rows it holds.

    ``writer`` tells apart queries that write to one table, each of which counts
    its batches from 0.  Where batches are committed (``commits.commit``) the batch
    counts from then on only.
    """
    target = f"{path}/writer={writer}/generation={generation}/batch_id={batch_id}"
    rows = Observation()
    counted = with_partition(df, layout).observe(rows, F.count(F.lit(1)).alias("rows"))
    _writer(counted, layout).mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)
    _mark(df.sparkSession, path, layout)
    return rows.get["rows"]


# What a table of micro-batches has besides its rows.
BATCH_COLUMNS = {"writer": "string", "generation": "string", "batch_id": "long"}


def read_table(
    spark: SparkSession, path: str, like: DataFrame | None = None, layout: Layout | None = None, batches: bool = False,
) -> DataFrame:
    """A table with its partition columns; of micro-batches the committed ones.

    Where it may still be empty ``like`` gives its columns, ``layout`` its
    partition, and ``batches`` says that micro-batches write it.
    """
    reader = spark.read
    if like is not None:
        schema = T.StructType(like.schema.fields[:])
        partitions = ({layout.by: "date"} if layout else {}) | (BATCH_COLUMNS if batches else {})
        for name, kind in partitions.items():
            if name not in schema.fieldNames():
                schema = schema.add(name, kind)
        reader = reader.schema(schema)
    counted = commits.committed(spark, path)
    table = _as_marked(reader.parquet(path), (layout.by, layout.time) if layout else _marked(spark, path))
    return table if counted is None else table.filter(commits.chosen(counted))


@dataclass
class Manifest:
    """What a compacted table consists of."""

    by: str
    time: str
    # How far each writer's generation is compacted: writer, generation, batch.
    covers: list[tuple[str, str, int]] = field(default_factory=list)
    # The runs that hold each day.
    runs: dict[str, list[str]] = field(default_factory=dict)

    def covered(self) -> dict[tuple[str, str], int]:
        return {(w, g): upto for w, g, upto in self.covers}


def _manifests(spark: SparkSession, target: str) -> list[str]:
    files, root = hadoop_path(spark, f"{target}/_manifest")
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return sorted(n for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, target: str) -> Manifest | None:
    """The newest manifest; None before the first compaction."""
    names = _manifests(spark, target)
    if not names:
        return None
    text = spark.read.text(f"{target}/_manifest/{names[-1]}", wholetext=True).first().value
    found = Manifest(**json.loads(text))
    found.covers = [(w, g, upto) for w, g, upto in found.covers]
    return found


def _publish(spark: SparkSession, target: str, new: Manifest) -> None:
    """A manifest appears under its number when it is whole."""
    names = _manifests(spark, target)
    number = int(names[-1].split(".")[0]) + 1 if names else 1
    files, attempt = hadoop_path(spark, f"{target}/_manifest/.{uuid.uuid4().hex}")
    out = files.create(attempt, True)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    final = hadoop_path(spark, f"{target}/_manifest/{number:012d}.json")[1]
    if not files.rename(attempt, final):
        raise RuntimeError(f"another compaction of {target} came first")


def _run_paths(target: str, of: Manifest, days: set[str] | None = None) -> list[str]:
    return [f"{target}/rows/run={run}/{of.by}={day}" for day, runs in sorted(of.runs.items()) if days is None or day in days for run in runs]


def _run_rows(spark: SparkSession, target: str, of: Manifest, days: set[str] | None = None) -> DataFrame | None:
    paths = _run_paths(target, of, days)
    return spark.read.option("basePath", f"{target}/rows").parquet(*paths).drop("run") if paths else None


def _days(rows: DataFrame, by: str) -> list[str]:
    """The partitions' names, as in their folders."""
    value = F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return [r.day for r in rows.select(value.alias("day")).distinct().collect()]


def _batches(spark: SparkSession, source: str) -> list[commits.Commit]:
    """What counts of a table of micro-batches: the commits, or all that is there where none are made."""
    counted = commits.committed(spark, source)
    if counted is not None:
        return counted
    files, root = hadoop_path(spark, f"{source}/writer=*/generation=*/batch_id=*")
    found: dict[tuple[str, str], int] = {}
    for status in files.globStatus(root) or []:
        writer, generation, batch = (part.split("=", 1)[1] for part in status.getPath().toString().rsplit("/", 3)[1:])
        found[writer, generation] = max(int(batch), found.get((writer, generation), -1))
    return [commits.Commit(w, 1, g, upto) for (w, g), upto in found.items()]


def compact_batches(
    spark: SparkSession, source: str, target: str, layout: Layout, upto: int | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Bring the batches not compacted so far (up to ``upto``) into clustered files.

    Without ``merge`` rows keep their writer and batch.  ``merge`` brings rows of one
    writer to fewer, such as the states of one key and window to one state: the days
    that new batches touch are merged with what the table has of them, so a read costs
    one row a key and window however many batches there were.  Of a writer that has
    begun a new generation the old rows are left out.  One call at a time.
    """
    new = [commits.Commit(c.writer, c.number, c.generation, c.upto if upto is None else min(c.upto, upto)) for c in _batches(spark, source)]
    old = manifest(spark, target) or Manifest(layout.by, layout.time)
    covered = old.covered()
    fresh = [c for c in new if c.upto > covered.get((c.writer, c.generation), -1)]
    if not fresh:
        return
    rows = spark.read.parquet(source).filter(commits.chosen(fresh, covered))
    run = uuid.uuid4().hex
    live = {(c.writer, c.generation) for c in new}
    runs = {day: list(own) for day, own in old.runs.items()}
    if merge is not None:
        # Days with rows of a generation that is over are rewritten as well.
        over = {k for k in covered if k not in live and k[0] in {w for w, _ in live}}
        days = set(_days(rows, layout.by)) | (set(runs) if over else set())
        before = _run_rows(spark, target, old, days)
        rows = rows if before is None else rows.unionByName(before.select(rows.columns))
        kept = [key for key in covered if key not in over] + [c for c in sorted(live) if c not in covered]
        ends = {(c.writer, c.generation): c.upto for c in new}
        merged = []
        for writer, generation in kept:
            own = rows.filter((F.col("writer") == writer) & (F.col("generation") == generation)).drop("writer", "generation", layout.by)
            end = max(ends.get((writer, generation), -1), covered.get((writer, generation), -1))
            merged.append(merge(own).drop("batch_id").withColumns(
                {"writer": F.lit(writer), "generation": F.lit(generation), "batch_id": F.lit(end).cast("long")}))
        rows = merged[0]
        for own in merged[1:]:
            rows = rows.unionByName(own)
        runs = {day: own for day, own in runs.items() if day not in days}
        covered = {key: v for key, v in covered.items() if key not in over}
    write_table(rows.drop(layout.by), f"{target}/rows/run={run}", layout, mode="overwrite")
    files, root = hadoop_path(spark, f"{target}/rows/run={run}/{layout.by}=*")
    for status in files.globStatus(root) or []:
        runs.setdefault(status.getPath().getName().split("=", 1)[1], []).append(run)
    covered |= {(c.writer, c.generation): c.upto for c in fresh}
    _publish(spark, target, Manifest(layout.by, layout.time, [(w, g, n) for (w, g), n in sorted(covered.items())], runs))


def read_compacted(spark: SparkSession, source: str, target: str) -> DataFrame:
    """The compacted rows, and the committed batches that are not compacted yet."""
    done = manifest(spark, target)
    if done is None:
        return read_table(spark, source)
    counted = commits.committed(spark, source)
    old = _run_rows(spark, target, done)
    if old is None:
        old = spark.read.parquet(source).limit(0)
    fresh = spark.read.schema(old.schema).parquet(source)
    if counted is None:
        after = [commits.Commit(w, 1, g, 2**62) for w, g, _ in done.covers]
        known = commits.chosen([commits.Commit(w, 1, g, n) for w, g, n in done.covers])
        fresh = fresh.filter(commits.chosen(after, done.covered()) | ~known)
    else:
        # Rows of a generation that is over are in the files until the next merge.
        live = {c.writer: c.generation for c in counted}
        over = [(w, g) for w, g, _ in done.covers if live.get(w, g) != g]
        for writer, generation in over:
            old = old.filter((F.col("writer") != writer) | (F.col("generation") != generation))
        fresh = fresh.filter(commits.chosen(counted, done.covered()))
    return _as_marked(old.unionByName(fresh.select(old.columns)), (done.by, done.time))


def remove_compacted(spark: SparkSession, source: str, target: str) -> int:
    """Delete the source folders of compacted batches, and runs and manifests that no
    newer reader goes by; gives how many batches there were.

    Only folders that still exist are listed.
    """
    done = manifest(spark, target)
    if done is None:
        return 0
    covered, gone = done.covered(), []
    counted = commits.committed(spark, source)
    live = {c.writer: c.generation for c in counted or ()}
    files, root = hadoop_path(spark, f"{source}/writer=*/generation=*/batch_id=*")
    for status in files.globStatus(root) or []:
        writer, generation, batch = (part.split("=", 1)[1] for part in status.getPath().toString().rsplit("/", 3)[1:])
        if int(batch) <= covered.get((writer, generation), -1) or live.get(writer, generation) != generation:
            gone.append(status.getPath().toString())
    batches = len(gone)
    used = set(_run_paths(target, done))
    files, root = hadoop_path(spark, f"{target}/rows/run=*/{done.by}=*")
    for status in files.globStatus(root) or []:
        run, day = status.getPath().toString().rsplit("/", 2)[1:]
        if f"{target}/rows/{run}/{day}" not in used:
            gone.append(status.getPath().toString())
    delete_folders(spark, gone)
    for name in _manifests(spark, target)[:-1]:
        files.delete(hadoop_path(spark, f"{target}/_manifest/{name}")[1], False)
    return batches


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, many at a time, in tasks; one that is gone already is no error."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                if files.get_file_info(name).type != fs.FileType.NotFound:
                    files.delete_dir(name)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["path"])

    if paths:
        frame = spark.createDataFrame([(p,) for p in paths], "path string")
        frame.repartition(min(len(paths), 64)).mapInArrow(run, "path string").count()


def apply_retention(df: DataFrame, time: str, keep_days: int, as_of: Moment) -> DataFrame:
    """Rows not yet expired.  On a partitioned table expired days or months are
    not even listed."""
    return last(df, as_of, time, after=True, days=keep_days)


def drop_expired(
    spark: SparkSession, path: str, keep_days: int, as_of: Moment, by: str = "day",
) -> list[str]:
    """Delete the ``day=`` (or ``month=``) folders that are expired as a whole.

    The folders are listed once and deleted in tasks.  Rows of the boundary partition
    stay on disk until it is over (``rewrite_boundary`` takes them away, and
    ``expire_compacted`` does in a compacted table); readers hide them with
    ``apply_retention``.  Only folder names pass the driver.
    """
    cutoff = (as_moment(as_of) - dt.timedelta(days=keep_days)).date()
    oldest_kept = cutoff if by == "day" else cutoff.replace(day=1)
    dropped = []
    for above in ("", "writer=*/generation=*/batch_id=*/", "rows/run=*/"):
        files, root = hadoop_path(spark, f"{path}/{above}{by}=*")
        for status in files.globStatus(root) or []:
            folder = status.getPath()
            value = folder.getName().removeprefix(f"{by}=")
            # Rows without a time are in a folder that has no date.
            if not value.startswith("__") and dt.date.fromisoformat(value) < oldest_kept:
                dropped.append(folder.toString())
    delete_folders(spark, dropped)
    return sorted(dropped)


def _boundary(keep_days: int, as_of: Moment, by: str) -> tuple[dt.datetime, str]:
    cutoff = as_moment(as_of) - dt.timedelta(days=keep_days)
    return cutoff, (cutoff.date() if by == "day" else cutoff.date().replace(day=1)).isoformat()


def rewrite_boundary(spark: SparkSession, path: str, layout: Layout, keep_days: int, as_of: Moment) -> int:
    """Take the expired rows out of the partition that the cutoff lies in; gives how many.

    The rows that stay are written beside the partition, out of readers' sight, and the
    two folders change places by renaming.  A reader that began before may find its files
    gone and has to begin again; a lost call leaves the partition as it was, or set aside
    under ``_old``, from where the next call takes it back first.  In a compacted table
    use ``expire_compacted``, which no reader notices.
    """
    cutoff, day = _boundary(keep_days, as_of, layout.by)
    files, folder = hadoop_path(spark, f"{path}/{layout.by}={day}")
    aside, staged = (hadoop_path(spark, f"{path}/_{name}/{layout.by}={day}")[1] for name in ("old", "new"))
    if files.exists(aside):
        if files.exists(folder):
            files.delete(aside, True)
        else:
            files.rename(aside, folder)
    if not files.exists(folder):
        return 0
    rows = spark.read.parquet(folder.toString())
    kept = rows.filter(F.col(layout.time) > F.lit(cutoff.isoformat(sep=" ")).cast(rows.schema[layout.time].dataType))
    expired = rows.count() - kept.count()
    if expired:
        kept.sortWithinPartitions(*layout.keys, layout.time).write.mode("overwrite").parquet(staged.toString())
        files.mkdirs(aside.getParent())
        if not files.rename(folder, aside) or not files.rename(staged, folder):
            raise RuntimeError(f"could not replace {folder.toString()}")
        files.delete(aside, True)
    return expired


def expire_compacted(spark: SparkSession, target: str, layout: Layout, keep_days: int, as_of: Moment) -> None:
    """Take all expired rows out of a compacted table: whole days, and those of the day that the cutoff lies in.

    One new run for that day and one new manifest; readers see the table before or after.
    Folders go with the next ``remove_compacted``.
    """
    done = manifest(spark, target)
    if done is None:
        return
    cutoff, day = _boundary(keep_days, as_of, layout.by)
    runs = {d: own for d, own in done.runs.items() if d.startswith("__") or d >= day}
    if day in runs:
        rows = _run_rows(spark, target, done, {day})
        kept = rows.filter(F.col(layout.time) > F.lit(cutoff.isoformat(sep=" ")).cast(rows.schema[layout.time].dataType))
        run = uuid.uuid4().hex
        write_table(kept.drop(layout.by), f"{target}/rows/run={run}", layout, mode="overwrite")
        files, root = hadoop_path(spark, f"{target}/rows/run={run}/{layout.by}=*")
        runs[day] = [run] if files.globStatus(root) else []
        runs = {d: own for d, own in runs.items() if own}
    _publish(spark, target, Manifest(done.by, done.time, done.covers, runs))


def expired_rows(rows: DataFrame, time: str, keep_days: int, as_of: Moment) -> DataFrame:
    """The rows that ``apply_retention`` hides."""
    return time_range(rows, end=as_moment(as_of) - dt.timedelta(days=keep_days) + dt.timedelta(microseconds=1), column=time)
