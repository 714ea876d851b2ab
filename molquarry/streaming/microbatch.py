"""Incremental ingest: a file stream in micro-batches, each adding the keys that are new to a table that only grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.operators.quality import LOGGED, STATUSES
from molquarry.operators.upsert import one_per_key
from molquarry.sources.scratch import discard, written


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys are kept by a state store on disk, of which a batch writes its changes alone.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _append_new(spark: SparkSession, staged: str, schema, keys: list[str], folder: str) -> None:
    """Appends the staged rows that no earlier run has read, and whose keys the state does not know, to folder/rows."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        new = spark.readStream.schema(schema).parquet(f"{staged}/*").dropDuplicates(keys)
        query = new.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/keys").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def ingest_microbatch(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], keys: list[str], order: list[str], folder: str, files_per_batch: int = 1, config: dict | None = None) -> DataFrame:
    """Reads all files of `source` that the checkpoint in `folder` does not know yet, `files_per_batch` at a time. Of each key of a
    batch the first row (by `order`) is staged; a second stream, whose state holds the keys of all earlier batches, appends the
    staged rows with new keys to folder/rows. So a batch looks up its own keys and reads no earlier rows, however many there
    are; only the lists of file names grow with the batches. A batch is staged once: if it is replayed, the second stream has
    read it already, or repeats its own unfinished write. Returns all rows.

    `config` is kept with the load, its values as text.

    `transform` may give rows a status ('loaded', 'skipped' or 'failed') and an error text; only loaded ones are inserted.
    Null keys are keys like others. folder/stats has a row a batch, folder/errors up to LOGGED errors of each; see
    load_progress and load_status. If a batch fails, the load's status is 'failed' and the error is raised."""
    staged, stats, errors = f"{folder}/staged", f"{folder}/stats", f"{folder}/errors"

    def stage(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        status = F.col("status") if "status" in rows.columns else F.lit("loaded")
        error = F.col("error") if "error" in rows.columns else F.lit(None)
        rows = rows.select(*(c for c in rows.columns if c not in ("status", "error")), status.alias("_status"), error.cast("string").alias("_error"))
        counts = Observation()  # by the pass that writes the batch, so that the files are read once
        watched = rows.observe(counts, F.count(F.lit(1)).alias("read"), *(F.count_if(F.col("_status") == s).alias(s) for s in STATUSES))
        rows = written(watched, "batch")
        told = [F.lit(counts.get[c]).cast("long").alias(c) for c in ("read", *STATUSES)]
        spark.range(1, numPartitions=1).select(*told).write.mode("overwrite").parquet(f"{stats}/batch={batch_id}")
        failed = rows.where("_status = 'failed'").select(F.to_json(F.struct(*keys)).alias("item"), F.col("_error").alias("error"))
        failed.orderBy("item", "error").limit(LOGGED).write.mode("overwrite").parquet(f"{errors}/batch={batch_id}")
        loaded = rows.where("_status = 'loaded'").drop("_status", "_error")
        one_per_key(loaded, keys, order).write.mode("overwrite").parquet(f"{staged}/{batch_id}")
        discard(rows)

    def flush(batch: DataFrame, batch_id: int) -> None:
        if not _exists(spark, f"{staged}/{batch_id}/_SUCCESS"):
            stage(batch, batch_id)
        _removed(spark, f"{staged}/{batch_id - 1}")  # its batch has ended
        _append_new(spark, staged, spark.read.parquet(f"{staged}/{batch_id}").schema, keys, folder)

    known = {k: str(v) for k, v in (config or {}).items() if v is not None}
    settings = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair)).cast("map<string,string>")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    state = "failed"
    try:
        query.awaitTermination()
        state = "completed"
    finally:
        spark.range(1, numPartitions=1).select(F.lit(state).alias("status"), settings.alias("config")).write.mode("overwrite").parquet(f"{folder}/status")
    return spark.read.schema(spark.read.parquet(f"{staged}/*").schema).parquet(f"{folder}/rows")


def load_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, read, loaded, skipped, failed, loaded_so_far, skipped_so_far, failed_so_far): one row a batch."""
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    names = ("loaded", "skipped", "failed")
    rows = spark.read.parquet(f"{folder}/stats").withColumnRenamed("batch", "batch_id")
    return rows.select("batch_id", "read", *names, *(F.sum(c).over(so_far).alias(f"{c}_so_far") for c in names))


def load_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: status ('completed' or 'failed'), config, the counts of all batches, and the first LOGGED errors."""
    totals = spark.read.parquet(f"{folder}/stats").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "loaded", "skipped", "failed")))
    log = spark.read.schema("item string, error string").parquet(f"{folder}/errors").orderBy("item", "error").limit(LOGGED)
    log = log.agg(F.array_sort(F.collect_list(F.struct("item", "error"))).alias("errors"))
    return spark.read.parquet(f"{folder}/status").join(F.broadcast(totals)).join(F.broadcast(log))  # one row each
