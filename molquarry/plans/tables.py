"""The model's tables derived from the driver's tables, in Spark and as SQL text, by integer arithmetic that both share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators import graph, similarity
from molquarry.sources.scratch import spread

MOLECULES = {
    "inchikey": "p_partkey", "smiles": "p_name", "formula": "p_brand", "iupac_name": "p_type", "mol_weight": "p_retailprice", "num_rings": "p_size",
    "commercially_available": "case when p_partkey % 97 = 0 then null else p_size <= 10 end", "logp": "cast(p_partkey % 13 - 4 as double)",
}
REACTIONS = {
    "reaction_id": "o_orderkey", "reaction_class": "o_orderpriority", "atmosphere": "o_orderstatus", "temperature_c": "cast(o_custkey % 200 - 50 as double)",
    "time_seconds": "cast(case when o_orderkey % 5 = 0 then null else (o_custkey % 48) * 900 end as int)",
    "yield_pct": "case when o_orderkey % 7 = 0 then null else cast((o_orderkey * 37) % 101 as double) end", "customer": "o_custkey",
}
ROLE = "case l_returnflag when 'A' then 'reactant' when 'N' then 'product' else case l_linestatus when 'F' then 'catalyst' else 'solvent' end end"
ACTIVITIES = {"inchikey": "user_id", "activity_type": "event_type", "value": "value", "assay": "event_id", "target": "props", "unit": "case when event_id % 3 = 0 then 'uM' else 'nM' end"}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in columns.items())


#: The same tables as SQL; a query's text follows it.
SQL = f"""WITH RECURSIVE molecules AS (SELECT {_columns(MOLECULES)} FROM part),
reactions AS (SELECT {_columns(REACTIONS)}, c_mktsegment AS source FROM orders JOIN customer ON o_custkey = c_custkey),
components AS (
  SELECT l_orderkey AS reaction_id, l_partkey AS inchikey, {ROLE} AS role, sum(l_quantity) AS equivalents, max(l_tax) AS volume_ml, max(l_discount * 1000) AS yield_pct, min(l_linenumber) = 1 AS is_major, CAST(count(*) AS DOUBLE) AS stoichiometry
  FROM lineitem GROUP BY 1, 2, 3),
activities AS (SELECT {_columns(ACTIVITIES)} FROM events),
hazards AS (
  SELECT l.doc_id AS inchikey, CASE WHEN toxic = 1 THEN 'Danger' ELSE 'Warning' END AS signal_word,
    list_sort(list_distinct(['H' || (200 + l.doc_id % 50), 'H' || (300 + l.doc_id % 30)])) AS ghs_codes FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
conditions AS (
  SELECT reaction_id, 'temperature' AS condition_type, temperature_c AS value, 'celsius' AS unit FROM reactions
  UNION ALL SELECT reaction_id, 'time', CAST(time_seconds AS DOUBLE), 'seconds' FROM reactions WHERE time_seconds IS NOT NULL),
bits AS (SELECT vec_id AS id, list_filter(range(0, len(embedding)), lambda i: embedding[i + 1] > 0) AS b FROM embeddings)
"""


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def molecules(self) -> DataFrame:
        return self.table("part").selectExpr(*(f"{v} as {k}" for k, v in MOLECULES.items()))

    @cached_property
    def reactions(self) -> DataFrame:
        customers = self.table("customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("source"))
        return self.table("orders").selectExpr(*(f"{v} as {k}" for k, v in REACTIONS.items())).join(customers, "customer")

    @cached_property
    def components(self) -> DataFrame:
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("reaction_id"), F.col("l_partkey").alias("inchikey"), F.expr(ROLE).alias("role"), "l_quantity", "l_tax", "l_discount", "l_linenumber")
        return rows.groupBy("reaction_id", "inchikey", "role").agg(
            F.sum("l_quantity").alias("equivalents"), F.max("l_tax").alias("volume_ml"), F.max(F.col("l_discount") * 1000).alias("yield_pct"), (F.min("l_linenumber") == 1).alias("is_major"), F.count("*").cast("double").alias("stoichiometry"))

    @cached_property
    def activities(self) -> DataFrame:
        return self.table("events").selectExpr(*(f"{v} as {k}" for k, v in ACTIVITIES.items()))

    @cached_property
    def hazards(self) -> DataFrame:
        code = lambda base, m: F.concat(F.lit("H"), (F.col("doc_id") % m + base).cast("string"))
        rows = self.table("labels").join(self.table("documents").select("doc_id"), "doc_id")
        return rows.select(F.col("doc_id").alias("inchikey"), F.when(F.col("toxic") == 1, "Danger").otherwise("Warning").alias("signal_word"), F.array_sort(F.array_distinct(F.array(code(200, 50), code(300, 30)))).alias("ghs_codes"))

    @cached_property
    def conditions(self) -> DataFrame:
        from molquarry.operators.ingest import condition_rows

        return condition_rows(self.reactions.withColumn("pressure_bar", F.lit(None).cast("double")))

    @cached_property
    def mol_nodes(self) -> DataFrame:
        return graph.mol_nodes(self.molecules)

    @cached_property
    def rxn_nodes(self) -> DataFrame:
        return graph.rxn_nodes(self.reactions)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.components, self.molecules, self.reactions)

    @cached_property
    def fingerprints(self) -> DataFrame:
        rows = self.table("embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), similarity.sign_bits(F.col("embedding")).alias("bits"))
        return rows.withColumn("words", similarity.packed(F.col("bits"), 1))

    @cached_property
    def shingles(self) -> DataFrame:
        """Lower-cased word 3-shingles of documents as sorted sets of hashes."""
        return spread(self.table("documents").select(F.col("doc_id").alias("id"), "text")).select("id", similarity.shingles(F.col("text")).alias("items"))

    @cached_property
    def records(self) -> DataFrame:
        """Nested reaction records: each order with its lines as inputs and outcomes."""
        pick = lambda c, names: F.get(F.array(*(F.lit(n) for n in names)), c.cast("int"))
        amount = lambda v, c, names: F.struct(v.cast("double").alias("value"), pick(c, names).alias("unit"))
        # the lines move once, before they are nested: what follows goes by order
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag").repartition("l_orderkey")
        part, supp, key, n = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
        roles = ("REACTANT", "REAGENT", "SOLVENT", "CATALYST", "INTERNAL_STANDARD", "PRODUCT", "BYPRODUCT", "SIDE_PRODUCT", "WORKUP", "UNSPECIFIED")
        amounts = F.struct(
            amount(F.col("l_extendedprice") + 0.003, supp % 5, ("KILOGRAM", "GRAM", "MILLIGRAM", "MICROGRAM", "UNSPECIFIED")).alias("mass"), amount(F.col("l_quantity") - 10, supp % 4, ("LITER", "MILLILITER", "MICROLITER", "UNSPECIFIED")).alias("volume"),
            amount(F.col("l_quantity"), supp % 3, ("MOLE", "MILLIMOLE", "UNSPECIFIED")).alias("moles"))
        component = F.struct(pick(part % 10, roles).alias("role"), part.cast("string").alias("key"), F.concat(F.lit("C"), part.cast("string"), F.lit("/"), n.cast("string")).alias("smiles"), amounts.alias("amount"))
        measure = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.cast("double").alias("pct"))
        product = F.struct(part.cast("string").alias("key"), F.concat(F.lit("C"), part.cast("string")).alias("smiles"), (n % 2 == 1).alias("is_desired"), F.array(measure("YIELD", (key * 37 + n * 11) % 120 - 20), measure("SELECTIVITY", (key + n) % 90 - 10), measure("YIELD", (key * 17 + n * 5) % 110 - 40)).alias("measurements"))
        rows = line.select(key.alias("o"), n.alias("n"), F.col("l_returnflag").alias("flag"), component.alias("c"), product.alias("p"), F.concat(F.lit("in"), (supp % 3).cast("string")).alias("name"))
        inputs = rows.where("flag <> 'N'").groupBy("o", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("components")).groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("components")))).alias("inputs"))
        outcomes = rows.where("flag = 'N'").groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("products"))
        cust, order = F.col("o_custkey"), F.col("o_orderkey")
        orders = self.table("orders").join(inputs, F.col("o_orderkey") == inputs["o"], "left").drop("o").join(outcomes, F.col("o_orderkey") == outcomes["o"], "left")
        ids = F.array(F.struct(F.lit("REACTION_CXSMILES").alias("type"), F.concat(F.lit("cx"), order).alias("value")), F.struct(F.when(order % 3 == 0, "REACTION_SMILES").otherwise("OTHER").alias("type"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("REACTION_CXSMILES").alias("type"), F.concat(F.lit("cy"), order).alias("value")))
        return orders.select(
            order.cast("string").alias("reaction_id"), ids.alias("identifiers"), "inputs",
            F.when(F.col("products").isNotNull(), F.array(F.struct(amount(order % 4 - 1, order % 5, ("HOUR", "MINUTE", "SECOND", "DAY", "UNSPECIFIED")).alias("reaction_time"), "products"))).alias("outcomes"),
            F.struct(amount(cust % 400, order % 4, ("CELSIUS", "FAHRENHEIT", "KELVIN", "UNSPECIFIED")).alias("temperature"), amount(cust % 90 + 0.3, order % 9, ("BAR", "ATMOSPHERE", "PSI", "KPSI", "KILOPASCAL", "PASCAL", "MM_HG", "TORR", "UNSPECIFIED")).alias("pressure"), pick(order % 5, ("AIR", "NITROGEN", "ARGON", "CARBON_MONOXIDE", "UNKNOWN")).alias("atmosphere")).alias("conditions"),
            F.struct(F.when(order % 2 == 0, F.concat(F.lit("doi"), order)).otherwise("").alias("doi"), F.lit("").alias("patent")).alias("provenance"))
