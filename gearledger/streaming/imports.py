"""Incremental imports: file stream in, catalogue versions and running counters out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gearledger.operators.ranking import round_robin
from gearledger.plans.ingest import changes, repeatable
from gearledger.session import Scratch
from gearledger.sources.writers import CatalogStore, log_errors, log_run


def file_stream(spark: SparkSession, path: str, schema, form: str = "parquet", pattern: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """A folder as a stream; the checkpoint of the query remembers which files were taken."""
    reader = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def import_stream(
    stream: DataFrame, normalize: Callable[[DataFrame], DataFrame], store: CatalogStore, checkpoint: str, seen_at: str,
    log_path: str | None = None, errors: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Take every micro-batch into the catalogue, exactly once.

    The manifest of a catalogue version names the stream and its last batch. A batch that is replayed after a failure finds itself
    there and is skipped; batches of other streams, whatever their numbers, are not taken for it. Repeats of a source
    record inside a batch are taken once and counted as skipped.

    ``log_path`` gets one row per source and category of a batch: read, created, updated, skipped. ``errors`` makes the refused rows of a batch,
    which are counted and go to ``log_path``-errors.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        # Spark writes the id of the stream into its checkpoint before the first batch.
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        writer = f"{stream_id}/{batch_id}"
        if store.committed(writer):
            return
        with Scratch(spark) as scratch:
            records = scratch.cut(normalize(batch))
            outcomes: list[DataFrame] = []

            def change(catalog):
                changed, done = changes(repeatable(records), catalog, seen_at)
                outcomes.append(done)
                return changed

            version = store.upsert(change, writer)
            if version and log_path:
                log_run(import_counters(records, outcomes[-1]), log_path, version, "completed")
                if errors is not None:
                    log_errors(errors(batch), f"{log_path}-errors", version)

    return (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def import_counters(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """read, created, updated and skipped (repeats within the batch) per source and category."""
    read = records.groupBy("source_key", "category").agg(F.count("*").alias("read"))
    kind = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    done = outcomes.groupBy("source_key", "category").agg(kind("created"), kind("updated"))
    return read.join(done, ["source_key", "category"]).withColumn("skipped", F.col("read") - F.col("created") - F.col("updated"))


def running_counters(stream: DataFrame) -> DataFrame:
    """Records read per source and category; the state holds one row per pair."""
    return stream.groupBy("source_key", "category").agg(F.count("*").alias("read"))


def counters_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the counters over what is there now into a table that outlives the query.

    The state lies in ``checkpoint`` and goes on after a restart. Each batch hands over the pairs it changed; they are merged with the version before and
    written as the version that the batch names, so a batch that is repeated writes the same version again.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        before = counters(spark, path, batch_id)
        merged = batch if before is None else before.join(batch, ["source_key", "category"], "left_anti").unionByName(batch)
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return running_counters(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The counters after the last batch, or after the last one ``before`` a batch; None where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    done = [n for n in done if before is None or int(n[6:]) < before]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def next_collection(queue: DataFrame, done: DataFrame, ledger: DataFrame, budget: int) -> DataFrame:
    """The candidates the next bounded run should read: not done yet, fewest failed attempts first, sources in turn."""
    open_rows = queue.join(done.select("candidate_id"), "candidate_id", "left_anti")
    tried = open_rows.join(ledger.select("candidate_id", "attempts"), "candidate_id", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0))
    )
    return round_robin(tried, "source_id", ["attempts", "candidate_id"], budget)
