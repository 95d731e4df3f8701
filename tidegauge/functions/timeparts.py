"""Time predicates and buckets.

Every "now" of a report is an explicit ``as_of`` argument.  Predicates leave
the time column bare so that they reach the file scan; where a frame has a
``day`` or ``month`` partition column the same range is also stated on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = dt.datetime | str


def as_moment(value: Moment) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)


def _literal(df: DataFrame, column: str, moment: dt.datetime) -> Column:
    """A timestamp literal of the same kind as the column, so nothing is cast."""
    kind = df.schema[column].dataType.simpleString()
    return F.lit(moment.isoformat(sep=" ")).cast(kind)


def with_partition_source(df: DataFrame, by: str, time: str) -> DataFrame:
    """The frame, its partition column ``by`` marked as that of ``time``, and ``time`` as what it is of.

    The marks are column metadata: they stay through filters, projections and joins, and
    go when a column is replaced by another expression.
    """
    for name, mark in ((by, {"partition_of": time}), (time, {"partitioned_by": by})):
        if name in df.columns:
            df = df.withMetadata(name, df.schema[name].metadata | mark)
    return df


def _partition(df: DataFrame) -> str | None:
    """The date column a table is partitioned by, if the frame has one."""
    kinds = dict(df.dtypes)
    return next((name for name in ("day", "month") if kinds.get(name) == "date"), None)


def _prunes(df: DataFrame, column: str, partition_of: str | None) -> tuple[bool, bool]:
    """Whether a lower and an upper bound on ``column`` hold for the partition as well.

    Both do for the column the partition is derived from.  A window begins no later
    than it ends, so an upper bound on the end also bounds the start's partition.
    Where neither the table nor the caller says what the partition is of, nothing holds.
    """
    partition = _partition(df)
    if partition is None:
        return False, False
    source = partition_of or df.schema[partition].metadata.get("partition_of")
    same = source == column and (partition_of is not None or df.schema[column].metadata.get("partitioned_by") == partition)
    return same, same or (source == "window_start" and column in ("time", "window_end"))


def _partition_date(moment: dt.datetime, partition: str) -> Column:
    return F.lit(moment.date() if partition == "day" else moment.date().replace(day=1))


def time_range(
    df: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    column: str = "time",
    after: bool = False,
    partition_of: str | None = None,
) -> DataFrame:
    """Rows with ``start <= column < end`` (``start < column`` with ``after``),
    pruned by day or month partition if there is one.

    ``partition_of`` names the time column that the partition is derived from; by
    default what the table says (``with_partition_source``).
    """
    partition, conditions = _partition(df), []
    below, above = _prunes(df, column, partition_of)
    if start is not None:
        start = as_moment(start)
        edge = _literal(df, column, start)
        conditions.append(F.col(column) > edge if after else F.col(column) >= edge)
        if partition and below:
            conditions.append(F.col(partition) >= _partition_date(start, partition))
    if end is not None:
        end = as_moment(end)
        conditions.append(F.col(column) < _literal(df, column, end))
        if partition and above:
            conditions.append(F.col(partition) <= _partition_date(end, partition))
    for condition in conditions:
        df = df.filter(condition)
    return df


def last(df: DataFrame, as_of: Moment, column: str = "time", after: bool = False, **span: float) -> DataFrame:
    """Rows of the last ``hours=1``, ``days=7`` and so on before ``as_of``.

    As in the reports, there is no upper end: rows after ``as_of`` also count.
    """
    return time_range(df, as_moment(as_of) - dt.timedelta(**span), column=column, after=after)


def between(df: DataFrame, bounds: DataFrame, column: str = "time", partition_of: str | None = None) -> DataFrame:
    """Rows with ``first <= column < end``, of the one row (first, end) of dates in ``bounds``.

    The bounds are known before the scan is planned, and prune its partitions too.
    """
    kind = df.schema[column].dataType
    first, end = [bounds.select(F.col(c).cast(kind)).scalar() for c in ("first", "end")]
    partition, (below, above) = _partition(df), _prunes(df, column, partition_of)
    df = df.filter((F.col(column) >= first) & (F.col(column) < end))
    if partition and below:
        df = df.filter(F.col(partition) >= bounds.select(F.trunc("first", "month") if partition == "month" else F.col("first")).scalar())
    if partition and above:
        df = df.filter(F.col(partition) <= bounds.select("end").scalar())
    return df


def on_day(df: DataFrame, day: dt.date | str, column: str = "time") -> DataFrame:
    start = dt.datetime.combine(dt.date.fromisoformat(str(day)), dt.time())
    return time_range(df, start, start + dt.timedelta(days=1), column=column)


def in_hours(hours, column: str = "time") -> Column:
    return F.hour(column).isin([int(h) for h in hours])


def bucketed(df: DataFrame, width: str, name: str = "t", column: str = "time") -> DataFrame:
    """Add the start of the fixed-width bucket a row falls into."""
    return df.withColumn(name, F.window(column, width).getField("start"))


def month_key(column: Column) -> Column:
    return F.date_format(column, "yyyyMM").cast("int")


def day_key(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd").cast("int")
