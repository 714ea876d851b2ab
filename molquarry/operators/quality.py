"""Constraint audits and load statistics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Errors that a load's log keeps; all are counted.
LOGGED = 1000


def duplicate_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").agg(F.lit(name).alias("violation"), F.count("*").alias("n"))


def orphans(df: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti").agg(F.lit(name).alias("violation"), F.count("*").alias("n"))


def outside_domain(df: DataFrame, name: str, column: str, allowed: list) -> DataFrame:
    return df.agg(F.lit(name).alias("violation"), F.count_if(~F.col(column).isin(allowed)).alias("n"))


def nulls(df: DataFrame, name: str, column: str) -> DataFrame:
    return df.agg(F.lit(name).alias("violation"), F.count_if(F.col(column).isNull()).alias("n"))


def dq_constraints(checks: list[DataFrame]) -> DataFrame:
    """(violation, n) of all checks."""
    return reduce(DataFrame.unionByName, checks)


STATUSES = ("loaded", "skipped", "failed")


def load_stats(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: loaded, skipped, failed."""
    return rows.agg(*(F.count_if(F.col(status) == s).alias(s) for s in STATUSES))


def load_errors(rows: DataFrame, cap: int = LOGGED) -> DataFrame:
    """The first failures of a load by item: a report of at most `cap` rows."""
    return rows.where("status = 'failed'").orderBy("item_id").limit(cap)


def recorded_load(rows: DataFrame, folder: str, source_name: str, loader_version: str = "1", config: dict | None = None) -> DataFrame:
    """Writes rows (item_id, status, error, ...) to folder/rows by status and returns the load's record, one row: load_id, source_name, loader_version,
    config (given values as text), status, read, loaded, skipped, failed, errors (the first LOGGED by item and error).

    The counts are observed by the pass that writes, so the source is read once; the log reads the failed rows alone. Rows
    with a null or another status are written and read, and count as none of the three. If the pass fails, folder/record
    says 'failed' with the reason, and the error is raised."""
    spark, counts = rows.sparkSession, Observation()
    known = {k: str(v) for k, v in (config or {}).items() if v is not None}
    settings = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair)).cast("map<string,string>")

    def record(state: str, n: dict, log: DataFrame) -> DataFrame:
        head = [F.lit(str(uuid.uuid4())).alias("load_id"), F.lit(source_name).alias("source_name"), F.lit(loader_version).alias("loader_version"), settings.alias("config"), F.lit(state).alias("status")]
        row = log.agg(F.array_sort(F.collect_list(F.struct("item_id", "error"))).alias("errors")).select(*head, *(F.lit(n.get(c, 0)).cast("long").alias(c) for c in ("read", *STATUSES)), "errors")
        row.write.mode("overwrite").parquet(f"{folder}/record")
        return spark.read.schema(row.schema).parquet(f"{folder}/record")

    watched = rows.observe(counts, F.count(F.lit(1)).alias("read"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    try:
        watched.write.mode("overwrite").partitionBy("status").parquet(f"{folder}/rows")
    except Exception as e:
        record("failed", {}, spark.createDataFrame([(None, f"Fatal: {e}"[:1000])], "item_id string, error string"))
        raise
    table = spark.read.schema(rows.schema).parquet(f"{folder}/rows").where("status = 'failed'")
    log = table.select(F.col("item_id").cast("string").alias("item_id"), F.col("error").cast("string").alias("error")).orderBy("item_id", "error").limit(LOGGED)
    return record("completed", counts.get, log)
