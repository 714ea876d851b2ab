"""Browsing, paging and post-processing of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from molquarry.sources.scratch import fresh_path, written


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing with the listing's total; `order` ends in a unique key, so that pages never overlap."""
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


class Listing:
    """A sorted listing that is paged many times: the rows are dealt into ranges of the order once and written by range, with the
    number of rows of each. A page reads the one or two ranges that it lies in, however deep it is, and sorts those alone.

    `order` ends in a unique key, so that pages never overlap. Pages have the columns of the rows, `place` (from 1) and the
    listing's `total`; the place of a page's last row is the offset of the next one. Equal rows under a key that is not
    unique may change places within a range. An offset beyond the listing gives no rows."""

    def __init__(self, rows: DataFrame, order: list[Column]):
        spark, self.order, self.columns = rows.sparkSession, order, rows.columns
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = fresh_path(spark, "listing")
        dealt = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(self.path)
        self.rows = spark.read.schema(dealt.schema).parquet(self.path)
        counts = {r["_range"]: r["count"] for r in self.rows.groupBy("_range").count().collect()}  # one row a range
        self.before, self.total = {}, 0
        for k in sorted(counts):
            self.before[k] = self.total
            self.total += counts[k]
        self.counts = counts

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        inside = [k for k, n in self.before.items() if n < offset + limit and n + self.counts[k] > offset]
        own = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order))
        first = F.coalesce(*(F.when(F.col("_range") == k, F.lit(self.before[k])) for k in inside), F.lit(0))
        rows = self.rows.where(F.col("_range").isin(inside)).withColumn("place", (first + own).cast("long"))
        return rows.where(F.col("place").between(offset + 1, offset + limit)).select(*self.columns, "place", F.lit(self.total).cast("long").alias("total"))


def browse(df: DataFrame, text_col: str, q: str | None) -> DataFrame:
    """Rows whose text contains q, in any case; all rows without q."""
    return df if q is None else df.where(F.col(text_col).ilike(f"%{q}%"))


def search_reactions(reactions: DataFrame, *, reaction_class=None, min_yield=None, max_yield=None, min_temp=None, max_temp=None, atmosphere=None) -> DataFrame:
    """Rows that meet all given conditions."""
    given = ((reaction_class, "reaction_class", Column.__eq__), (min_yield, "yield_pct", Column.__ge__), (max_yield, "yield_pct", Column.__le__), (min_temp, "temperature_c", Column.__ge__), (max_temp, "temperature_c", Column.__le__), (atmosphere, "atmosphere", Column.__eq__))
    return reactions.where(reduce(Column.__and__, (op(F.col(c), v) for v, c, op in given if v is not None), F.lit(True)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()))


def citations(df: DataFrame, order: str, cap: int | None = 50) -> DataFrame:
    """(id, place, total): the ids in the columns named reaction_id, *_reaction_id or (arrays) *reaction_id*, once each in the order
    of the rows (by the column `order`), the columns and the arrays; the first `cap` and the number of all."""
    names = [f.name for f in df.schema if f.name == "reaction_id" or f.name.endswith("_reaction_id") or (isinstance(f.dataType, ArrayType) and "reaction_id" in f.name)]
    if not names:
        return df.sparkSession.createDataFrame([], "id string, place long, total long")
    parts = [F.col(n).cast("array<string>") if isinstance(df.schema[n].dataType, ArrayType) else F.array(F.col(n).cast("string")) for n in names]
    parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
    ids = df.select(order, F.posexplode(F.concat(*parts)).alias("_place", "id")).where("id is not null").groupBy("id").agg(F.min(F.struct(order, "_place")).alias("first"))
    total = F.broadcast(ids.agg(F.count("*").alias("total")))  # one row
    if cap is None:
        return numbered(ids, "first").select("id", "place").join(total)
    ranked = ids.orderBy("first").limit(cap).withColumn("place", F.row_number().over(Window.orderBy("first")).cast("long"))  # `cap` rows
    return ranked.select("id", "place").join(total)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """The rows with their place (from 1) by a column of distinct values, without one task seeing all: Spark deals ranges of the
    values, the counts of the ranges before are a range's offset, and each range numbers its own rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return rows.join(offsets, "_range").withColumn("place", F.col("_offset") + own).drop("_range", "_offset")


def ids_of(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, place, id): the distinct ids of each key in ascending order with their place (from 1), one row an id; a key may have any number.

    Keys and ids are dealt together by ranges, so no task sees a key whole. Rows with a null key or id are left out."""
    pairs = rows.select(F.struct(F.col(key).alias("key"), F.col(id_col).alias("id")).alias("pair")).where("pair.key is not null and pair.id is not null").distinct()
    placed = written(numbered(pairs, "pair"), "ids")
    first = placed.groupBy("pair.key").agg(F.min("place").alias("first")).withColumnRenamed("key", "of")
    both = placed.join(first, F.col("pair.key") == F.col("of"))
    return both.select(F.col("of").alias(key), (F.col("place") - F.col("first") + 1).alias("place"), F.col("pair.id").alias(id_col))


def result_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, row_count, n, avg, min, max) of the numeric columns among `columns` that df has, in one aggregation."""
    names = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, NumericType)]
    row = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("row_count"), F.col(f"n_{c}").alias("n"), *(F.col(f"{f}_{c}").alias(f) for f in ("avg", "min", "max"))) for c in names))
    made = df.agg(F.count("*").alias("row_count"), *(x for c in names for x in (F.count(c).alias(f"n_{c}"), F.round(F.avg(c), 2).alias(f"avg_{c}"), F.round(F.min(c).cast("double"), 2).alias(f"min_{c}"), F.round(F.max(c).cast("double"), 2).alias(f"max_{c}"))))
    return made.select(F.explode(row).alias("x")).select("x.*")


def result_cap(df: DataFrame, order: list[Column], cap: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(cap)
