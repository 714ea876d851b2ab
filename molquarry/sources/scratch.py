"""Tables in the folder that driver and executors share: they cut lineage, so that a lost executor repeats unfinished tasks only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions, by application.
_LOCAL: dict[str, str] = {}
#: Tables made within each settled() that is under way, the innermost last.
_MADE: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session that has none a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="molquarry-")
        found = _LOCAL[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a new table in the shared folder."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    if _MADE:
        _MADE[-1].append(table)
    return table


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The result of make() as a new table; all other tables that were written for it are deleted."""
    _MADE.append([])
    try:
        table = written(make(), tag)
    finally:
        made = _MADE.pop()
    discard(*(t for t in made if t is not table))
    if _MADE:
        _MADE[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing lazy reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table read in fewer partitions than there are cores (one small file) is dealt anew, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
