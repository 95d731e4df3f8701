"""Where messages and rows come from: topics, files, separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Option that means "from the first message on", per source format.
EARLIEST = {
    "kafka": {"startingOffsets": "earliest"},
    "pulsar": {"startingOffsets": "earliest"},
}


def read_messages(
    spark: SparkSession,
    source: str,
    options: dict[str, str] | None = None,
    schema: T.StructType | None = None,
    path: str | None = None,
    stream: bool = True,
) -> DataFrame:
    """All partitions of a topic (or all files of a folder) from the beginning.

    ``source`` is any Spark source.  Topic connectors need their jar on the
    class path; file sources read every file already there, then new ones.
    """
    reader = (spark.readStream if stream else spark.read).format(source)
    reader = reader.options(**{**EARLIEST.get(source, {}), **(options or {})})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


# Timestamps are written with milliseconds and null as the database does.
TSV_OPTIONS = {
    "sep": "\t",
    "nullValue": "\\N",
    "emptyValue": "",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSS",
}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header_order: list[str] | None = None) -> DataFrame:
    """Tab-separated rows, bound to the table **by name**.

    Without ``header_order`` the header line says which column is where; a file
    whose header differs from the first one's fails the job.  Files without a
    header need the writer's column order.
    """
    reader = spark.read.options(**TSV_OPTIONS)
    if header_order is None:
        # The order of the columns in the files may differ from the table's.
        order = reader.csv(path, header=True, inferSchema=False).columns
    else:
        order = header_order
    file_schema = T.StructType([schema[name] for name in order])
    rows = spark.read.options(**TSV_OPTIONS).csv(
        path, header=header_order is None, schema=file_schema, mode="FAILFAST", enforceSchema=False)
    return rows.select(*[name for name in schema.fieldNames() if name in order])


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").options(**TSV_OPTIONS).csv(path, header=header)


def split_quarantine(decoded: DataFrame, flag: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that could not be decoded)."""
    return decoded.filter(F.col(flag).isNull()).drop(flag), decoded.filter(F.col(flag).isNotNull())
