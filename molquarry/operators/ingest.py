"""Nested reaction records to flat tables. A record is
reaction_id, identifiers array<struct<type,value>>, inputs map<string, struct<components array<C>>>,
outcomes array<struct<reaction_time struct<value,unit>, products array<P>>>, conditions struct<temperature, pressure,
atmosphere>, provenance struct<doi, patent>, with C = struct<role, key, smiles, amount struct<mass, volume, moles>> and
P = struct<key, smiles, is_desired, measurements array<struct<type, pct>>>.

Order matters in places (first or last wins): it is carried by positions, and inputs, which have none, go by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions import units as U


def mentions(records: DataFrame) -> DataFrame:
    """(reaction_id, at array<int>, key, smiles, role, is_input, amount, is_desired, yield_pct): one row a component or
    product that has a key, in the order of at."""
    inputs = records.select("reaction_id", F.posexplode(F.array_sort(F.map_entries("inputs"))).alias("i", "entry"))
    inputs = inputs.select("reaction_id", "i", F.posexplode(F.col("entry")["value"]["components"]).alias("j", "c"))
    used = inputs.select(
        "reaction_id", F.array(F.lit(0), "i", "j", F.lit(0)).alias("at"), "c.key", "c.smiles", U.map_role(F.col("c.role")).alias("role"), F.lit(True).alias("is_input"),
        U.norm_amount(F.col("c.amount.mass"), U.MASS_TO_GRAM, 6).alias("mass_g"), U.norm_amount(F.col("c.amount.volume"), U.VOLUME_TO_ML, 6).alias("volume_ml"),
        U.norm_amount(F.col("c.amount.moles"), U.MOLES, 9).alias("equivalents"), F.lit(True).alias("is_major"), F.lit(None).cast("double").alias("yield_pct"),
    )
    outcomes = records.select("reaction_id", F.posexplode("outcomes").alias("i", "o"))
    products = outcomes.select("reaction_id", "i", F.posexplode("o.products").alias("j", "p"))
    yields = F.filter("p.measurements", lambda m: (m["type"] == "YIELD") & (m["pct"] > 0))
    none = F.lit(None).cast("double")
    made = products.select(
        "reaction_id", F.array(F.lit(1), "i", "j", F.lit(0)).alias("at"), "p.key", "p.smiles", F.lit("product").alias("role"), F.lit(False).alias("is_input"),
        none.alias("mass_g"), none.alias("volume_ml"), none.alias("equivalents"), F.coalesce("p.is_desired", F.lit(False)).alias("is_major"),
        F.round(F.try_element_at(yields, F.lit(-1))["pct"], 2).alias("yield_pct"),
    )
    return used.unionByName(made).where("key is not null and reaction_id is not null")


def input_components(records: DataFrame) -> DataFrame:
    """Per (reaction_id, key, role) of the inputs, products apart: summed mass and volume, the first equivalents."""
    rows = mentions(records).where("is_input and role is not null and role <> 'product'")
    return rows.groupBy("reaction_id", "key", "role").agg(F.round(F.sum("mass_g"), 6).alias("mass_g"), F.round(F.sum("volume_ml"), 6).alias("volume_ml"), F.min_by("equivalents", "at").alias("equivalents"), F.lit(True).alias("is_major"))


def product_components(records: DataFrame) -> DataFrame:
    """Per (reaction_id, key) of the outcomes: the first mention's flag and yield."""
    rows = mentions(records).where("not is_input").groupBy("reaction_id", "key").agg(F.min_by(F.struct("is_major", "yield_pct"), "at").alias("x"))
    return rows.select("reaction_id", "key", F.lit("product").alias("role"), "x.is_major", "x.yield_pct")


def molecule_rows(records: DataFrame) -> DataFrame:
    """(key, smiles): every molecule mentioned, with the last mention of the largest reaction_id."""
    return mentions(records).groupBy("key").agg(F.max_by("smiles", F.struct("reaction_id", "at")).alias("smiles"))


def reaction_rows(records: DataFrame) -> DataFrame:
    """One row a record with a status: 'skipped' without an id or a molecule, else 'loaded'."""
    c = F.col("conditions")
    used = F.exists(F.map_values("inputs"), lambda i: F.exists(i["components"], lambda x: x["key"].isNotNull()))
    made = F.exists("outcomes", lambda o: F.exists(o["products"], lambda p: p["key"].isNotNull()))
    has_molecule = F.coalesce(used, F.lit(False)) | F.coalesce(made, F.lit(False))
    return records.select(
        "reaction_id", U.pick_identifier(F.col("identifiers")).alias("reaction_smiles"),
        U.norm_temperature(c["temperature"]["value"], c["temperature"]["unit"]).alias("temperature_c"), U.norm_pressure(c["pressure"]["value"], c["pressure"]["unit"]).alias("pressure_bar"),
        U.norm_time(F.transform("outcomes", lambda o: o["reaction_time"])).cast("int").alias("time_seconds"), U.map_atmosphere(c["atmosphere"]).alias("atmosphere"),
        U.best_yield(F.col("outcomes")).alias("yield_pct"), F.when(U.best_yield(F.col("outcomes")).isNotNull(), "percentage").alias("yield_type"), U.last_selectivity(F.col("outcomes")).alias("selectivity"),
        F.when(F.col("provenance.doi") != "", F.col("provenance.doi")).alias("doi"), F.when(F.col("provenance.patent") != "", F.col("provenance.patent")).alias("patent_id"),
        F.when(F.col("reaction_id").isNull() | (F.col("reaction_id").cast("string") == "") | ~has_molecule, "skipped").otherwise("loaded").alias("status"),
    )


def condition_rows(reactions: DataFrame) -> DataFrame:
    """Wide to long: (reaction_id, condition_type, value, unit), without nulls."""
    kinds = (("temperature", "temperature_c", "celsius"), ("pressure", "pressure_bar", "bar"), ("time", "time_seconds", "seconds"))
    rows = F.array(*(F.struct(F.lit(k).alias("condition_type"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for k, c, u in kinds))
    return reactions.select("reaction_id", F.explode(rows).alias("x")).select("reaction_id", "x.*").where("value is not null")


def clean_activity(rows: DataFrame, key_length: int = 27) -> DataFrame:
    """Activities with a key of the given length, a type, an assay and a number for a value."""
    value = F.expr("try_cast(value as double)")
    return rows.where((F.length("inchikey") == key_length) & F.col("activity_type").isNotNull() & F.col("assay").isNotNull()).withColumn("value", value).where("value is not null")
