"""Nested profiles: one row a molecule or reaction with its children as bounded arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _children(df: DataFrame, key: str, name: str, fields: list[str], cap: int | None = None) -> DataFrame:
    """(key, name array<struct>): the children of each key in order of their fields, the first `cap`.

    With a cap, a key's children are first cut to `cap` in each of 64 parts, so that a crowded key is never one group."""
    child = F.struct(*fields)
    if cap is None:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(child)).alias(name))
    some = df.groupBy(key, F.pmod(F.xxhash64(*fields), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(child)), 1, cap).alias("some"))
    return some.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, cap).alias(name))


def _with(df: DataFrame, key: str, parts: list[tuple[DataFrame, str]]) -> DataFrame:
    for part, name in parts:
        df = df.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return df


def molecule_profile(molecules: DataFrame, components: DataFrame, reactions: DataFrame, activities: DataFrame, hazards: DataFrame, max_activities: int = 50, max_reactions: int = 100, similar: DataFrame | None = None) -> DataFrame:
    """similar: (query, id, similarity), the hits of similarity.sim_search_batch; with it, `similar` has them, the nearest first."""
    used = components.join(reactions.select("reaction_id", "reaction_class", F.col("yield_pct").alias("reaction_yield")), "reaction_id")
    profile = _with(molecules, "inchikey", [
        (_children(hazards, "inchikey", "hazards", ["signal_word", "ghs_codes"]), "hazards"),
        (_children(activities, "inchikey", "activities", ["activity_type", "assay", "value"], max_activities), "activities"),
        (_children(used, "inchikey", "reactions", ["reaction_id", "role", "reaction_class", "reaction_yield"], max_reactions), "reactions"),
    ])
    if similar is None:
        return profile
    hits = similar.select(F.col("query").alias("inchikey"), (-F.col("similarity")).alias("far"), "id", "similarity")
    near = _children(hits, "inchikey", "similar", ["far", "id", "similarity"])
    return _with(profile, "inchikey", [(near.withColumn("similar", F.transform("similar", lambda x: x.dropFields("far"))), "similar")])


def reaction_profile(reactions: DataFrame, components: DataFrame, molecules: DataFrame, conditions: DataFrame) -> DataFrame:
    parts = components.join(molecules.select("inchikey", "smiles"), "inchikey", "left")
    return _with(reactions, "reaction_id", [
        (_children(parts, "reaction_id", "components", ["role", "inchikey", "smiles", "equivalents"]), "components"),
        (_children(conditions, "reaction_id", "conditions", ["condition_type", "value", "unit"]), "conditions"),
    ])
