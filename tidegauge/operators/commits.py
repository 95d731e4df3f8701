"""Which micro-batches of a table count.

A batch lies in ``writer=…/generation=…/batch_id=…`` and counts once it is committed.  A
writer is a job; a generation of it is one stream checkpoint, which counts its batches
from 0.  A job that starts on a fresh checkpoint reads its source anew, so its new
generation takes the place of the old one.

Batches of a generation are committed in order, so one name stands for all before it:
``_commits/<writer>/<number>-<generation>-<batch_id>`` is an empty file that says "complete
up to this batch".  The newer name is there before the older goes.  Readers list these
few names and turn them into partition filters; what a lost batch left behind, and what
is being written, is in none of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import hadoop_path

#: The generation of batches that are written without a stream.
DIRECT = "direct"


@dataclass(frozen=True, order=True)
class Commit:
    """Batches of one generation of a writer, up to one."""

    writer: str
    number: int
    generation: str
    upto: int


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    files, root = hadoop_path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []


def _of_writer(spark: SparkSession, path: str, writer: str) -> list[Commit]:
    """The newest commit of each generation, oldest generation first."""
    found: dict[str, Commit] = {}
    for name in _names(spark, f"{path}/_commits/{writer}"):
        number, rest = name.split("-", 1)
        generation, upto = rest.rsplit("-", 1)
        own = Commit(writer, int(number), generation, int(upto))
        found[generation] = max(own, found.get(generation, own))
    return sorted(found.values())


def committed(spark: SparkSession, path: str) -> list[Commit] | None:
    """What counts of each writer: its newest generation; None for a table without commits."""
    if "_commits" not in _names(spark, path):
        return None
    writers = [_of_writer(spark, path, w) for w in _names(spark, f"{path}/_commits")]
    return [own[-1] for own in writers if own]


def is_committed(spark: SparkSession, path: str, writer: str, generation: str, batch_id: int) -> bool:
    return any(c.generation == generation and c.upto >= batch_id for c in _of_writer(spark, path, writer))


def commit(spark: SparkSession, path: str, writer: str, generation: str, batch_id: int) -> None:
    """Make a batch, and with it all before it, count."""
    known = _of_writer(spark, path, writer)
    own = next((c for c in known if c.generation == generation), None)
    number = own.number if own else known[-1].number + 1 if known else 1
    files, root = hadoop_path(spark, f"{path}/_commits/{writer}")
    files.mkdirs(root)
    name = lambda upto: f"{root.toString()}/{number:06d}-{generation}-{upto:012d}"
    files.create(hadoop_path(spark, name(batch_id))[1], True).close()
    if own and own.upto < batch_id:
        files.delete(hadoop_path(spark, name(own.upto))[1], False)


def start_generation(spark: SparkSession, path: str, writer: str, generation: str, fresh: str) -> None:
    """Refuse a new generation beside an old one where ``fresh`` is ``refuse``."""
    if fresh not in ("replace", "refuse"):
        raise ValueError(f"fresh is replace or refuse, not {fresh}")
    known = _of_writer(spark, path, writer)
    if fresh == "refuse" and known and all(c.generation != generation for c in known):
        raise ValueError(f"{path} has batches of another checkpoint of this job")


def query_of(batch: DataFrame) -> str:
    """The id of the streaming query whose batch this is, which its checkpoint keeps."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def chosen(commits: list[Commit], after: dict[tuple[str, str], int] | None = None) -> Column:
    """Rows of committed batches, of those beyond ``after`` (by writer and generation) only."""
    def of(c: Commit) -> Column:
        rows = (F.col("writer") == c.writer) & (F.col("generation") == c.generation) & (F.col("batch_id") <= c.upto)
        covered = (after or {}).get((c.writer, c.generation))
        return rows if covered is None else rows & (F.col("batch_id") > covered)

    return reduce(lambda a, b: a | b, map(of, commits), F.lit(False))
