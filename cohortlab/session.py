"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "cohortlab") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is made only for a single-machine master that names none: on a
    cluster an intermediate table on one machine's disk dies with that machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlab-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, whatever its kind."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of the shared file system is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class Written:
    """A written table and its folder."""

    path: str
    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, name: str, **options: str) -> Written:
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path, **options)
        return cls(path, df.sparkSession.read.schema(df.schema).parquet(path))

    def drop(self) -> None:
        """Removes the folder; nothing that reads it may run afterwards."""
        remove(self.rows.sparkSession, self.path)


def rewritten(before: Written, df: DataFrame, name: str, **options: str) -> Written:
    """Writes ``df``, made from ``before``, and then removes the table before it: a loop
    leaves one table behind, not one a round."""
    after = Written.of(df, name, **options)
    before.drop()
    return after


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back; ``options`` are the Parquet writer's.

    The written table cuts the lineage, survives lost executors, and, unlike a
    row-based checkpoint, still lets later readers prune columns.
    """
    return Written.of(df, name, **options).rows
