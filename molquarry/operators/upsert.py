"""Table maintenance as functions (target, batch) -> new target; keys compare null-safely, batches are deduplicated with a
map-side part, and nothing is written over what is read.

A batch of at most SENT keys is sent to all tasks of the target, which is not shuffled then; a larger one meets it in a join
that shuffles both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.operators.results import numbered
from molquarry.sources.scratch import written

#: Rows of a batch, one a key, that are sent to all tasks.
SENT = 200_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in keys))


def one_per_key(batch: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by `order`."""
    rest = [c for c in batch.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order, *rest))
    return batch.groupBy(*keys).agg(pick.alias("_row")).select(*(F.col(k) for k in keys), "_row.*").select(*batch.columns)


def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the batch's new keys; rows that exist stay, of several new ones the first by `order` wins."""
    fresh = one_per_key(batch, keys, order)
    return target.unionByName(fresh.join(target.select(*keys).distinct(), _same(fresh, target, keys), "left_anti").select(*target.columns))


def _paired(target: DataFrame, batch: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Structs t and b of the rows that share a key, and of the target's others ("left"), or of both sides' others ("full_outer"). The batch has
    one row a key."""
    batch = written(batch, "batch")
    t = target.select(F.struct(*target.columns).alias("t"))
    b = batch.select(F.struct(*batch.columns).alias("b"))
    same = reduce(Column.__and__, (F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    if batch.count() > SENT:
        return t.join(b, same, how)
    known = t.join(F.broadcast(b), same, "left")
    if how == "left":
        return known
    # what the target has is found by a pass over its keys, again without moving them
    have = target.select(*keys).join(F.broadcast(batch.select(*keys)), _same(target, batch, keys), "inner").select(*(batch[k] for k in keys)).distinct()
    new = batch.join(have, _same(batch, have, keys), "left_anti").select(F.struct(*batch.columns).alias("b"))
    return known.unionByName(new.select(F.lit(None).cast(t.schema["t"].dataType).alias("t"), "b"))


def upsert_union_sources(target: DataFrame, batch: DataFrame, key: str, array_col: str, stamp: str, order: list[str]) -> DataFrame:
    """New keys are added; for known ones only the array (united, sorted) and the time stamp change."""
    new = batch.select(key, F.explode_outer(array_col).alias("_one")).groupBy(key).agg(F.array_sort(F.collect_set("_one")).alias("_all"))
    first = one_per_key(batch, [key], order)
    rows = first.join(new, first[key].eqNullSafe(new[key])).drop(new[key]).withColumn(array_col, F.col("_all")).drop("_all")
    both = _paired(target, rows, [key], "full_outer")
    known, added = F.col("t").isNotNull(), F.col("b").isNotNull()
    return both.select(*(
        F.when(known & added, F.array_sort(F.array_union(F.coalesce(F.col(f"t.{c}"), F.array().cast(target.schema[c].dataType)), F.col(f"b.{c}")))).when(known, F.array_sort(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c == array_col
        else F.when(added, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c == stamp
        else F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        for c in target.columns
    ))


def upsert_overwrite(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """New keys are added; for known ones the listed columns take the batch's values; the last by `order` wins."""
    both = _paired(target, one_per_key(batch, keys, order, last=True), keys, "full_outer")
    use_new = lambda c: F.col("b").isNotNull() & (F.col("t").isNull() | F.lit(c in columns))
    return both.select(*(F.when(use_new(c), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def enrich_coalesce(target: DataFrame, batch: DataFrame, key: str, columns: list[str], always: list[str], order: list[str]) -> DataFrame:
    """Known keys take the batch's values where they are not null, `always` columns in any case; unknown keys are ignored."""
    both = _paired(target, one_per_key(batch, [key], order, last=True), [key], "left")
    value = lambda c: F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")) if c in always else F.coalesce(f"b.{c}", f"t.{c}") if c in columns else F.col(f"t.{c}")
    return both.select(*(value(c).alias(c) for c in target.columns))


def fill_if_null(target: DataFrame, batch: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """Sets a column where it is null, from the batch's first row of the key."""
    both = _paired(target, one_per_key(batch, [key], order), [key], "left")
    return both.select(*((F.coalesce(f"t.{c}", f"b.{c}") if c == column else F.col(f"t.{c}")).alias(c) for c in target.columns))


def link_parent(terms: DataFrame, key: str, parent: str) -> DataFrame:
    """Parents that do not exist as terms become null."""
    known = terms.select(F.col(key).alias("_parent")).distinct()
    return terms.join(known, terms[parent] == known["_parent"], "left").withColumn(parent, F.col("_parent")).drop("_parent")


def semi_known(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of known keys, one row with the number of the others)."""
    keys = known.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti").agg(F.count("*").alias("skipped"))


def pending_anti(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def batch_keys(df: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, keys): the distinct integer keys in ascending order, packed `size` to a batch.

    Keys are numbered without one task seeing all of them."""
    keys = df.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    batches = numbered(keys, "k").select("k", F.floor((F.col("place") - 1) / size).alias("batch"))
    return batches.groupBy("batch").agg(F.array_sort(F.collect_list("k")).alias("keys"))


def backfill_derived(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fills a column where it is null; rows whose value cannot be made stay null."""
    return df.withColumn(column, F.coalesce(column, value))


def backfill_counts(before: DataFrame, column: str, value: Column) -> DataFrame:
    """One row: updated, and invalid (still null)."""
    return before.where(F.col(column).isNull()).agg(F.count(value).alias("updated"), F.count_if(value.isNull()).alias("invalid"))


def provenance_rows(keys: DataFrame, key: str, source_name: str, source_id: str, load_id: str) -> DataFrame:
    return keys.select(F.col(key), F.lit(source_name).alias("source_name"), F.col(source_id).cast("string").alias("source_id"), F.lit(load_id).alias("load_id"))
