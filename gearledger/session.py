"""Session builder and the small amount of session state the jobs need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Call sites of column expressions are only needed for debugging and double the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "gearledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on. Cluster settings given elsewhere stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, preferring the one the cluster names.

    On a cluster ``spark.checkpoint.dir`` is a shared folder. Only a local master that names none gets
    a scratch folder of its own.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        named = tempfile.mkdtemp(prefix="gearledger-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and go on from the written table.

    The work is done once, lost executors cost no recomputation, and later steps read only the columns they need
    with sizes known to the planner. ``checkpoint()`` would run the plan twice, once to count and once to write.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, share: int, weight: Column | None = None) -> int:
    """How many tasks rows have to be dealt over so that each gets about ``share`` of them, or of the sum of ``weight`` over them.

    Adaptive execution sizes tasks by compressed bytes, which says little of rows that a step opens up a hundredfold. One pass over the
    columns that are asked for.
    """
    total = df.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0] or 0
    return int(-(-total // share)) or 1


class Scratch:
    """Tables written between the steps of one job. They are deleted as soon as they are dropped, the rest when the job ends, also by an error.

    >>> with Scratch(spark) as scratch:
    ...     rows = scratch.cut(rows)
    ...     result = scratch.keep(rows.groupBy("key").count())
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        """The frame as a written table that this job owns."""
        path = f"{ensure_checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        # Known before it is written, so what a failed job leaves is deleted too.
        self.tables.append((None, path))
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables[-1] = (found, path)
        return found

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame as a written table that outlives the job: its result. A table of the job is not written again."""
        owned = [e for e in self.tables if e[0] is df]
        if not owned:
            return cut_lineage(df)
        self.tables.remove(owned[0])
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing yet to be run reads."""
        for frame in frames:
            for entry in [e for e in self.tables if e[0] is frame]:
                self.tables.remove(entry)
                self._delete(entry[1])

    def tidy(self) -> None:
        """Let the shuffle files of finished steps go now: Spark deletes them when their handles are collected, which a small heap may not need for long."""
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def close(self) -> None:
        while self.tables:
            self._delete(self.tables.pop()[1])
        self.tidy()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_error) -> None:
        self.close()
