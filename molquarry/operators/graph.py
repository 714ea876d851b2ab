"""The property graph of molecules and reactions as node and edge tables. Edges are
(src_kind, src, dst_kind, dst, label, stoichiometry, equivalents, volume_ml, yield_pct, is_major)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.units import lookup

# The labels of the graph, by role; products point from the reaction to the molecule.
LABELS = {"reactant": "REACTANT_IN", "catalyst": "CATALYSES", "solvent": "SOLVENT_IN", "product": "PRODUCT_OF"}


def mol_nodes(molecules: DataFrame) -> DataFrame:
    return molecules.select("inchikey", "smiles", "formula", "mol_weight", F.coalesce("commercially_available", F.lit(False)).alias("commercially_available"))


def rxn_nodes(reactions: DataFrame) -> DataFrame:
    return reactions.select("reaction_id", "reaction_class", "yield_pct", "temperature_c", "source")


def all_edges(components: DataFrame) -> DataFrame:
    """Edges of the components whose role has a label, endpoints unchecked. Components without a column of stoichiometry have none."""
    parts = F.col("stoichiometry") if "stoichiometry" in components.columns else F.lit(None).cast("double")
    rows = components.withColumn("label", lookup(F.col("role"), LABELS)).where("label is not null")
    made = F.col("label") == "PRODUCT_OF"
    side = lambda a, b: F.when(made, F.col(a)).otherwise(F.col(b))
    return rows.select(
        F.when(made, "reaction").otherwise("molecule").alias("src_kind"), side("reaction_id", "inchikey").alias("src"),
        F.when(made, "molecule").otherwise("reaction").alias("dst_kind"), side("inchikey", "reaction_id").alias("dst"), "label",
        F.when(F.col("label") == "REACTANT_IN", parts).alias("stoichiometry"),
        F.when(F.col("label").isin("REACTANT_IN", "CATALYSES"), F.col("equivalents")).alias("equivalents"), F.when(F.col("label") == "SOLVENT_IN", F.col("volume_ml")).alias("volume_ml"),
        F.when(made, F.col("yield_pct")).alias("yield_pct"), F.when(made, F.col("is_major")).alias("is_major"),
    )


def _ends(edges: DataFrame) -> tuple:
    product = F.col("label") == "PRODUCT_OF"
    return F.when(product, F.col("dst")).otherwise(F.col("src")), F.when(product, F.col("src")).otherwise(F.col("dst"))


def edges(components: DataFrame, molecules: DataFrame, reactions: DataFrame) -> DataFrame:
    """Edges whose molecule and reaction exist."""
    return (
        all_edges(components).withColumns(dict(zip(("inchikey", "reaction_id"), _ends(components), strict=True)))
        .join(molecules.select("inchikey").distinct(), "inchikey", "left_semi").join(reactions.select("reaction_id").distinct(), "reaction_id", "left_semi").drop("inchikey", "reaction_id")
    )


def missing_edges(components: DataFrame, molecules: DataFrame, reactions: DataFrame) -> DataFrame:
    """(label, expected, created, missing) per label."""
    expected = all_edges(components).groupBy("label").agg(F.count("*").alias("expected"))
    created = edges(components, molecules, reactions).groupBy("label").agg(F.count("*").alias("created"))
    both = expected.join(created, "label", "left").withColumn("created", F.coalesce("created", F.lit(0)))
    return both.withColumn("missing", F.col("expected") - F.col("created"))


def annotate_hazard(nodes: DataFrame, hazards: DataFrame, key: str = "inchikey") -> DataFrame:
    """Nodes that have hazard data, with signal word (else "Unknown") and codes joined by commas."""
    codes = F.coalesce(F.array_join("ghs_codes", ","), F.lit(""))
    return nodes.join(hazards.select(key, F.coalesce("signal_word", F.lit("Unknown")).alias("signal_word"), codes.alias("ghs_codes")), key)


def graph_stats(molecules: DataFrame, reactions: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(kind, label, n): node counts, and edge counts of the labels that occur."""
    node = lambda df, label: df.agg(F.lit("node").alias("kind"), F.lit(label).alias("label"), F.count("*").alias("n"))
    links = edge_table.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n")
    return node(molecules, "Molecule").union(node(reactions, "Reaction")).union(links)
