"""Scans of the file formats that reactions, hazards, properties, ontologies and activities come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNT = "struct<value double, unit string>"
REACTION = f"""reaction_id string, identifiers array<struct<type string, value string>>,
inputs map<string, struct<components array<struct<role string, key string, smiles string, amount struct<mass {AMOUNT}, volume {AMOUNT}, moles {AMOUNT}>>>>>,
outcomes array<struct<reaction_time {AMOUNT}, products array<struct<key string, smiles string, is_desired boolean, measurements array<struct<type string, pct double>>>>>>,
conditions struct<temperature {AMOUNT}, pressure {AMOUNT}, atmosphere string>, provenance struct<doi string, patent string>"""
HAZARD_LINE = "inchikey string, ghs_codes array<string>, signal_word string, pictograms array<string>"
INFORMATION = "struct<Name string, Value struct<StringWithMarkup array<struct<String string>>>>"
HAZARD_TREE = f"""inchikey string, Record struct<Section array<struct<TOCHeading string, Section array<struct<TOCHeading string,
Section array<struct<TOCHeading string, Information array<{INFORMATION}>>>>>>>>"""
PROPERTY_TABLE = "PropertyTable struct<Properties array<struct<InChIKey string, CID long, IUPACName string, ExactMass string, XLogP double, Complexity double>>>"


def read_reactions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Nested reaction records (JSON lines), all files below path; unreadable files are skipped."""
    df = spark.read.schema(REACTION).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def read_jsonl(spark: SparkSession, path: str, schema: str = HAZARD_LINE, limit: int | None = None) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def parse_jsonl(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, one row with the number of lines that are neither blank nor JSON) of a text column."""
    full = lines.where(F.trim(column) != "").select("*", F.from_json(column, schema).alias("parsed"))
    bad = F.col("parsed").isNull() | F.forall(F.map_values(F.from_json(F.to_json("parsed"), "map<string,string>")), lambda v: v.isNull())
    return full.where(~bad), full.where(bad).agg(F.count("*").alias("bad_lines"))


def hazards_from_tree(trees: DataFrame) -> DataFrame:
    """(inchikey, ghs_codes, signal_word, pictograms) from nested section trees: sections whose heading names GHS; codes distinct and
    sorted, the last signal word that is Danger or Warning; keys without any of them are left out."""
    info = trees.select("inchikey", F.posexplode("Record.Section").alias("i", "a")).select("inchikey", "i", F.posexplode("a.Section").alias("j", "b")).select("inchikey", "i", "j", F.posexplode("b.Section").alias("k", "c"))
    info = info.where(F.col("c.TOCHeading").contains("GHS")).select("inchikey", "i", "j", "k", F.posexplode("c.Information").alias("l", "x")).select("inchikey", "i", "j", "k", "l", F.col("x.Name").alias("name"), F.posexplode("x.Value.StringWithMarkup").alias("m", "s"))
    text = F.col("s.String")
    codes = F.when(F.col("name").contains("Hazard Statements"), F.regexp_extract_all(text, F.lit(r"H\d{3}"), F.lit(0)))
    pictures = F.when(F.col("name").contains("Pictogram"), F.regexp_extract_all(text, F.lit(r"GHS\d{2}"), F.lit(0)))
    signal = F.when(F.col("name").contains("Signal") & text.isin("Danger", "Warning"), text)
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = info.groupBy("inchikey").agg(gather(codes).alias("ghs_codes"), F.max_by(signal, F.when(signal.isNotNull(), F.struct("i", "j", "k", "l", "m"))).alias("signal_word"), gather(pictures).alias("pictograms"))
    return rows.where((F.size("ghs_codes") > 0) | F.col("signal_word").isNotNull() | (F.size("pictograms") > 0))


def properties_from_table(payloads: DataFrame) -> DataFrame:
    """One row a property entry that has both key and CID."""
    rows = payloads.select(F.explode_outer("PropertyTable.Properties").alias("p")).where("p.InChIKey is not null and p.CID is not null")
    return rows.select(F.col("p.InChIKey").alias("inchikey"), F.col("p.CID").alias("pubchem_cid"), F.col("p.IUPACName").alias("iupac_name"), F.expr("try_cast(p.ExactMass as double)").alias("exact_mass"), F.col("p.XLogP").alias("logp"), F.col("p.Complexity").alias("complexity"))


def obo_terms(stanzas: DataFrame, prefix: str = "CHEBI:") -> DataFrame:
    """(role_id, name, description, parent_id, inchi) of stanzas (value) whose id has the prefix and that have a name."""
    v = F.col("value")
    field = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    rows = stanzas.where(v.contains("[Term]")).select(
        field(r"(?m)^id: (\S+)").alias("role_id"), field(r"(?m)^name: (.+?)\s*$").alias("name"), field(r'(?m)^def: "(.*?)"').alias("description"),
        field(rf"(?m)^is_a: ({prefix}\S+)").alias("parent_id"), field(r'(?m)^(?:xref|property_value): (?:\S+ )?"?(InChI=[^"\s]+)').alias("inchi"),
    )
    return rows.where(F.col("role_id").startswith(prefix) & F.col("name").isNotNull())


def read_obo(spark: SparkSession, path: str, prefix: str = "CHEBI:") -> DataFrame:
    return obo_terms(spark.read.option("lineSep", "\n\n").text(path), prefix)


def activity_star(activities: DataFrame, assays: DataFrame, targets: DataFrame, molecules: DataFrame, structures: DataFrame) -> DataFrame:
    """The star of activities, assays, targets, molecules and structures, rows with all needed values."""
    rows = activities.join(assays, "assay_id").join(targets, "tid").join(molecules, "molregno").join(structures, "molregno")
    return rows.where("standard_inchi_key is not null and standard_value is not null and standard_type is not null and target_id is not null")


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes doubled inside quotes, nulls empty."""
    df.write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_graph(edge_table: DataFrame, path: str, rebuild: bool = False) -> None:
    """Edges partitioned by label; rebuild replaces what is there, else rows are added."""
    edge_table.write.mode("overwrite" if rebuild else "append").partitionBy("label").parquet(path)
