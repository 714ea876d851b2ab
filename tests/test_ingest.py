import re

import pytest
from pyspark.sql import functions as F

from molquarry.functions import units as U
from molquarry.operators import ingest
from molquarry.plans.queries import QUERIES
from molquarry.plans.tables import Model
from molquarry.sources.readers import HAZARD_LINE, hazards_from_tree, obo_terms, parse_jsonl, properties_from_table, read_jsonl, read_obo, read_reactions, write_csv, write_graph


@pytest.mark.parametrize("value, unit, want", [(25.0, "CELSIUS", 25.0), (373.15, "KELVIN", 100.0), (212.0, "FAHRENHEIT", 100.0), (0.0, None, None), (5.0, "UNSPECIFIED", None)])
def test_temperature(spark, value, unit, want):
    df = spark.createDataFrame([(value, unit)], "v double, u string")
    assert df.select(U.norm_temperature(F.col("v"), F.col("u"))).first()[0] == want


def test_pressure_units(spark):
    df = spark.createDataFrame([(2.0, u) for u in [*U.PRESSURE_TO_BAR, "X", None]], "v double, u string")
    got = [r[0] for r in df.select(U.norm_pressure(F.col("v"), F.col("u"))).collect()]
    assert got == [2.0, 2.0265, 0.1379, 137.8952, 0.02, 0.0, 0.0027, 0.0027, None, None]


def test_amounts(spark):
    rows = [((5.0, "GRAM"), None), ((500.0, "MILLIGRAM"), (10.0, "MILLILITER")), (None, None), ((-1.0, "GRAM"), (1.0, "PINT"))]
    df = spark.createDataFrame(rows, "m struct<value:double,unit:string>, v struct<value:double,unit:string>")
    got = df.select(U.norm_amount(F.col("m"), U.MASS_TO_GRAM, 6), U.norm_amount(F.col("v"), U.VOLUME_TO_ML, 6)).collect()
    assert [tuple(r) for r in got] == [(5.0, None), (0.5, 10.0), (None, None), (None, None)]


def test_roles_lie_in_the_domain(spark):
    df = spark.createDataFrame([(r,) for r in [*U.ROLES, "UNSPECIFIED", None]], "r string")
    got = [r[0] for r in df.select(U.map_role(F.col("r"))).collect()]
    assert got[:4] == ["reactant", "reagent", "solvent", "catalyst"] and got[-2:] == [None, None]
    assert df.select(U.map_atmosphere(F.lit("CARBON_MONOXIDE"))).first()[0] == "carbon_monoxide"


RECORDS = """{"reaction_id":"r1","identifiers":[{"type":"REACTION_CXSMILES","value":"c1"},{"type":"REACTION_SMILES","value":"s1"},{"type":"REACTION_SMILES","value":"s2"},{"type":"REACTION_CXSMILES","value":"c2"}],"inputs":{"b":{"components":[{"role":"REACTANT","key":"A","smiles":"a-late","amount":{"mass":{"value":500,"unit":"MILLIGRAM"},"moles":{"value":3,"unit":"MOLE"}}}]},"a":{"components":[{"role":"REACTANT","key":"A","smiles":"a","amount":{"mass":{"value":1,"unit":"GRAM"},"moles":{"value":2,"unit":"MOLE"}}},{"role":"PRODUCT","key":"P"},{"role":"UNSPECIFIED","key":"U"}]}},"outcomes":[{"reaction_time":{"value":0,"unit":"HOUR"},"products":[{"key":"P","is_desired":true,"measurements":[{"type":"YIELD","pct":90},{"type":"YIELD","pct":40},{"type":"SELECTIVITY","pct":7}]},{"key":"P","is_desired":false}]},{"reaction_time":{"value":2,"unit":"MINUTE"},"products":[]}],"conditions":{"temperature":{"value":300,"unit":"KELVIN"},"atmosphere":"ARGON"}}
{"reaction_id":"r2","identifiers":[{"type":"REACTION_CXSMILES","value":"c1"},{"type":"REACTION_CXSMILES","value":"c2"}],"inputs":{},"outcomes":[]}
{broken
"""


def test_nested_records(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.json").write_text(RECORDS)
    df = read_reactions(spark, str(tmp_path / "in")).cache()
    rows = {r["reaction_id"]: r for r in ingest.reaction_rows(df).collect()}
    assert (rows["r1"]["reaction_smiles"], rows["r1"]["temperature_c"], rows["r1"]["time_seconds"], rows["r1"]["yield_pct"], rows["r1"]["selectivity"], rows["r1"]["status"]) == ("s1", 26.85, 120, 90.0, "7.0", "loaded")
    assert (rows["r2"]["reaction_smiles"], rows["r2"]["status"]) == ("c2", "skipped")
    used = ingest.input_components(df).collect()
    assert [(r["key"], r["role"], r["mass_g"], r["equivalents"]) for r in used] == [("A", "reactant", 1.5, 2.0)]
    made = ingest.product_components(df).collect()
    assert [(r["key"], r["is_major"], r["yield_pct"]) for r in made] == [("P", True, 40.0)]
    assert {r["key"]: r["smiles"] for r in ingest.molecule_rows(df).collect()} == {"A": "a-late", "P": None, "U": None}
    long = ingest.condition_rows(ingest.reaction_rows(df)).collect()
    assert sorted((r["condition_type"], r["value"], r["unit"]) for r in long) == [("temperature", 26.85, "celsius"), ("time", 120.0, "seconds")]


def test_json_lines(spark, tmp_path):
    lines = ['{"inchikey":"K1","ghs_codes":["H225"],"signal_word":"Danger"}', "", "{bad", '{"inchikey":"K2"}']
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    assert [r["inchikey"] for r in read_jsonl(spark, str(tmp_path / "h.jsonl")).collect()] == ["K1", "K2"]
    good, bad = parse_jsonl(spark.createDataFrame([(x,) for x in lines], "line string"), "line", HAZARD_LINE)
    assert good.count() == 2 and bad.first()[0] == 1


def test_hazard_tree_and_properties(spark):
    def said(name, *texts):
        return {"Name": name, "Value": {"StringWithMarkup": [{"String": t} for t in texts]}}

    info = [said("Pictogram(s)", "GHS02 GHS07"), said("Signal", "Danger"), said("GHS Hazard Statements", "H225 (x): flammable", "H319 and H225"), said("Signal", "Warning"), said("Signal", "Caution")]
    tree = {"Section": [{"TOCHeading": "Safety", "Section": [{"TOCHeading": "Hazards", "Section": [{"TOCHeading": "GHS Classification", "Information": info}, {"TOCHeading": "Other", "Information": [said("Signal", "Danger")]}]}]}]}
    from molquarry.sources.readers import HAZARD_TREE, PROPERTY_TABLE

    got = hazards_from_tree(spark.createDataFrame([("K", tree), ("N", {"Section": None})], HAZARD_TREE)).collect()
    assert [tuple(r) for r in got] == [("K", ["H225", "H319"], "Warning", ["GHS02", "GHS07"])]
    entries = [("K1", 5, "n", "12.5", 1.0, None), (None, 6, "n", "1", None, None), ("K2", None, "n", "1", None, None), ("K3", 7, None, "bad", None, 2.0)]
    got = properties_from_table(spark.createDataFrame([((entries,),)], PROPERTY_TABLE)).collect()
    assert [(r["inchikey"], r["pubchem_cid"], r["exact_mass"]) for r in got] == [("K1", 5, 12.5), ("K3", 7, None)]


def test_ontology(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1\n\n[Term]\nid: CHEBI:1\nname: acid\ndef: "an \'acid\'" []\nis_a: CHEBI:9\nis_a: CHEBI:2\nxref: InChI=1S/H2O\n\n[Term]\nid: GO:1\nname: no\n\n[Term]\nid: CHEBI:2\n\n[Term]\nid: CHEBI:3\nname: base')
    got = sorted(tuple(r) for r in read_obo(spark, str(tmp_path / "x.obo")).collect())
    assert got == [("CHEBI:1", "acid", "an 'acid'", "CHEBI:9", "InChI=1S/H2O"), ("CHEBI:3", "base", None, None, None)]
    assert obo_terms(spark.createDataFrame([], "value string")).collect() == []


def test_sinks(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "k int, t string").coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text == 'k,t\n1,"a,""b""\nc"\n2,\n'
    edges = spark.createDataFrame([("a", "b", "X"), ("c", "d", "Y")], "src string, dst string, label string")
    for rebuild, n in ((True, 2), (False, 4), (True, 2)):
        write_graph(edges, str(tmp_path / "g"), rebuild)
        assert spark.read.parquet(str(tmp_path / "g")).count() == n


def test_clean_activity_and_keys(spark):
    key = "ABCDEFGHIJKLMN-ABCDEFGHIJ-K"
    rows = [(key, "IC50", "a", "5"), ("short", "IC50", "a", "5"), (key, None, "a", "5"), (key, "IC50", None, "5"), (key, "IC50", "a", "x")]
    assert ingest.clean_activity(spark.createDataFrame(rows, "inchikey string, activity_type string, assay string, value string")).count() == 1
    df = spark.createDataFrame([(key,), (key.lower(),), (None,), ("",)], "k string")
    assert [r[0] for r in df.select(U.valid_key(F.col("k"))).collect()] == [True, False, False, False]


def test_records_are_written_small_and_their_lines_move_once(spark):
    """JSON repeats field names, so files are compressed; lines are dealt by order before they are nested, not after."""
    sf = "/root/testdata/sf0.001"
    files = QUERIES["src_reactions"](spark, sf).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)
    plan = Model(spark, sf).records._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((\w+)#", plan))
    assert dealt <= {"l_orderkey", "o_orderkey"}
