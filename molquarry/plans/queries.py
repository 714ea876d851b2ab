"""The registered queries of the reaction-network operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import units as U
from molquarry.operators import classify, graph, ingest, paths, profiles, quality, results, similarity, upsert
from molquarry.plans import tables
from molquarry.plans.tables import SQL, Model
from molquarry.sources.scratch import fresh_path, written

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None, model: bool = True):
    """Registers a function of a Model under its name; `sql` follows the model's tables (or stands alone)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (SQL if model else "") + sql
        return f

    return register


def joined(column):
    """An array as text, so that rows compare plainly."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# ---- analytic queries


@query("""SELECT m.smiles AS solvent, round(avg(r.yield_pct), 1) AS avg_yield, count(*) AS reaction_count, array_to_string(list_sort(list_distinct(list(r.reaction_id))), ',') AS reaction_ids
FROM reactions r JOIN components c ON r.reaction_id = c.reaction_id JOIN molecules m ON c.inchikey = m.inchikey
WHERE c.role = 'solvent' AND r.reaction_class ILIKE '%high%' AND r.yield_pct IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_yield DESC, solvent LIMIT 20""")
def q_best_solvents(m: Model) -> DataFrame:
    rows = m.components.drop("yield_pct").where("role = 'solvent'").join(m.reactions.where(F.col("reaction_class").ilike("%high%") & F.col("yield_pct").isNotNull()), "reaction_id").join(m.molecules, "inchikey").withColumnRenamed("smiles", "solvent")
    best = rows.groupBy("solvent").agg(F.round(F.avg("yield_pct"), 1).alias("avg_yield"), F.count("*").alias("reaction_count")).where("reaction_count >= 3")
    return _with_ids(rows, best.orderBy(F.desc("avg_yield"), "solvent").limit(20), "solvent")


def _with_ids(rows: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """A short report with the ids of its rows' reactions, which only the keys that are in it gather."""
    top = F.broadcast(top)  # as many rows as the report
    ids = rows.join(top.select(key), key).groupBy(key).agg(joined(F.array_sort(F.collect_set("reaction_id"))).alias("reaction_ids"))
    return ids.join(top, key).select(*top.columns, "reaction_ids")


@query("""SELECT m.smiles AS catalyst, count(DISTINCT r.reaction_id) AS reaction_count, round(avg(r.yield_pct), 1) AS avg_yield, array_to_string(list_sort(list_distinct(list(r.reaction_id))), ',') AS reaction_ids
FROM reactions r JOIN components c ON r.reaction_id = c.reaction_id JOIN molecules m ON c.inchikey = m.inchikey
WHERE c.role = 'catalyst' AND r.reaction_class ILIKE '%urgent%' GROUP BY 1 ORDER BY reaction_count DESC, catalyst LIMIT 20""")
def q_catalysts(m: Model) -> DataFrame:
    rows = m.components.drop("yield_pct").where("role = 'catalyst'").join(m.reactions.where(F.col("reaction_class").ilike("%urgent%")), "reaction_id").join(m.molecules, "inchikey").withColumnRenamed("smiles", "catalyst")
    best = rows.groupBy("catalyst").agg(F.count_distinct("reaction_id").alias("reaction_count"), F.round(F.avg("yield_pct"), 1).alias("avg_yield"))
    return _with_ids(rows, best.orderBy(F.desc("reaction_count"), "catalyst").limit(20), "catalyst")


def _ids_sql(report: str, key: str) -> str:
    return f"""{report}) SELECT x.*, i.reaction_id, i.place FROM report x JOIN (
  SELECT {key}, reaction_id, row_number() OVER (PARTITION BY {key} ORDER BY reaction_id) AS place FROM (SELECT DISTINCT {key}, reaction_id FROM used)) i USING ({key})"""


_SOLVENTS = """, used AS (SELECT m.smiles AS solvent, r.reaction_id, r.yield_pct FROM reactions r JOIN components c ON r.reaction_id = c.reaction_id JOIN molecules m ON c.inchikey = m.inchikey
  WHERE c.role = 'solvent' AND r.reaction_class ILIKE '%high%' AND r.yield_pct IS NOT NULL),
report AS (SELECT solvent, round(avg(yield_pct), 1) AS avg_yield, count(*) AS reaction_count FROM used GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_yield DESC, solvent LIMIT 20"""

_CATALYSTS = """, used AS (SELECT m.smiles AS catalyst, r.reaction_id, r.yield_pct FROM reactions r JOIN components c ON r.reaction_id = c.reaction_id JOIN molecules m ON c.inchikey = m.inchikey
  WHERE c.role = 'catalyst' AND r.reaction_class ILIKE '%urgent%'),
report AS (SELECT catalyst, count(DISTINCT reaction_id) AS reaction_count, round(avg(yield_pct), 1) AS avg_yield FROM used GROUP BY 1 ORDER BY reaction_count DESC, catalyst LIMIT 20"""


def _used(m: Model, role: str, like: str, key: str) -> DataFrame:
    """(key, reaction_id, yield_pct): the molecules of a role with the reactions of a class that they take part in."""
    chosen = m.reactions.where(F.col("reaction_class").ilike(like)).select("reaction_id", "yield_pct")
    rows = m.components.where(F.col("role") == role).select("reaction_id", "inchikey").join(chosen, "reaction_id")
    return rows.join(m.molecules.select("inchikey", F.col("smiles").alias(key)), "inchikey").select(key, "reaction_id", "yield_pct")


def _placed_ids(used: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """The report's rows with the reactions of each, one row an id, however many there are."""
    report = written(report, "report")
    few = F.broadcast(report)  # as many rows as the report
    ids = results.ids_of(used.join(few.select(key), key, "left_semi"), key, "reaction_id")
    return ids.join(few, key)


@query(_ids_sql(_SOLVENTS, "solvent"))
def q_best_solvents_ids(m: Model) -> DataFrame:
    """The report with its reactions as rows (place 1, 2, ... of each solvent)."""
    used = _used(m, "solvent", "%high%", "solvent").where("yield_pct is not null")
    best = used.groupBy("solvent").agg(F.round(F.avg("yield_pct"), 1).alias("avg_yield"), F.count("*").alias("reaction_count")).where("reaction_count >= 3")
    return _placed_ids(used, best.orderBy(F.desc("avg_yield"), "solvent").limit(20), "solvent")


@query(_ids_sql(_CATALYSTS, "catalyst"))
def q_catalysts_ids(m: Model) -> DataFrame:
    """The report with its reactions as rows (place 1, 2, ... of each catalyst)."""
    used = _used(m, "catalyst", "%urgent%", "catalyst")
    best = used.groupBy("catalyst").agg(F.count_distinct("reaction_id").alias("reaction_count"), F.round(F.avg("yield_pct"), 1).alias("avg_yield"))
    return _placed_ids(used, best.orderBy(F.desc("reaction_count"), "catalyst").limit(20), "catalyst")


@query("SELECT reaction_id, yield_pct, temperature_c, atmosphere FROM reactions WHERE reaction_class ILIKE '%medium%' AND yield_pct IS NOT NULL ORDER BY yield_pct DESC, reaction_id LIMIT 50")
def q_top_yield(m: Model) -> DataFrame:
    rows = m.reactions.where(F.col("reaction_class").ilike("%medium%") & F.col("yield_pct").isNotNull())
    return rows.orderBy(F.desc("yield_pct"), "reaction_id").select("reaction_id", "yield_pct", "temperature_c", "atmosphere").limit(50)


@query("""SELECT round_even(temperature_c / 10, 0) * 10 + 0.0::DOUBLE AS temp_bucket, round(avg(yield_pct), 1) AS avg_yield, count(*) AS reaction_count, array_to_string(list_sort(list(reaction_id))[1:5], ',') AS sample_ids
FROM reactions WHERE reaction_class ILIKE '%low%' AND yield_pct IS NOT NULL AND temperature_c IS NOT NULL GROUP BY 1""")
def q_temp_buckets(m: Model) -> DataFrame:
    rows = m.reactions.where(F.col("reaction_class").ilike("%low%") & F.col("yield_pct").isNotNull() & F.col("temperature_c").isNotNull()).withColumn("temp_bucket", F.rint(F.col("temperature_c") / 10) * 10 + 0.0)
    some = rows.groupBy("temp_bucket", F.pmod(F.xxhash64("reaction_id"), F.lit(64)).alias("part")).agg(F.sum("yield_pct").alias("y"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("reaction_id")), 1, 5).alias("ids"))
    return some.groupBy("temp_bucket").agg(F.round(F.sum("y") / F.sum("n"), 1).alias("avg_yield"), F.sum("n").alias("reaction_count"), joined(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 5)).alias("sample_ids"))


@query("""SELECT r.reaction_id, r.yield_pct, c.inchikey FROM components c JOIN reactions r ON c.reaction_id = r.reaction_id JOIN embeddings e ON c.inchikey = e.vec_id
WHERE c.role = 'reactant' AND len(list_filter([2, 5, 11], lambda i: embedding[i + 1] > 0)) = 3""")
def q_contains_reactant(m: Model) -> DataFrame:
    asked = m.spark.range(1).select(F.lit(0).cast("long").alias("id"), F.array(F.lit((1 << 2) | (1 << 5) | (1 << 11)).cast("long")).alias("words"))
    found = similarity.containment_screen(m.fingerprints, asked).select(F.col("id").alias("inchikey"))
    return m.components.drop("yield_pct").where("role = 'reactant'").join(found, "inchikey").join(m.reactions, "reaction_id").select("reaction_id", "yield_pct", "inchikey")


_HITS = """, hits AS (
  SELECT q.id AS query, x.id AS id, len(list_intersect(q.b, x.b)) AS s, len(q.b) + len(x.b) - len(list_intersect(q.b, x.b)) AS u FROM bits q JOIN bits x ON q.id % 20 = 0),
best AS (SELECT query, id, s / u AS similarity, row_number() OVER (PARTITION BY query ORDER BY s / u DESC, id) AS r FROM hits WHERE u > 0 AND {where})
SELECT query, id, round(similarity, 4) AS similarity FROM best WHERE r <= {limit}"""


def _asked(m: Model) -> DataFrame:
    """The stated query set of searches: the rows whose id is divisible by 20."""
    return m.fingerprints.where("id % 20 = 0")


@query(_HITS.format(where="1 - s / u < 0.6", limit=50))
def q_similar_to(m: Model) -> DataFrame:
    return similarity.sim_search(m.fingerprints, _asked(m), threshold=0.4, limit=50)


@query("SELECT source, count(*) AS n, round(avg(yield_pct), 1) AS avg_yield, min(reaction_id) AS sample_id FROM reactions GROUP BY 1")
def q_by_source(m: Model) -> DataFrame:
    return m.reactions.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("yield_pct"), 1).alias("avg_yield"), F.min("reaction_id").alias("sample_id"))


@query("""SELECT DISTINCT r.reaction_id, r.yield_pct FROM reactions r JOIN components a ON r.reaction_id = a.reaction_id JOIN molecules x ON a.inchikey = x.inchikey
JOIN components b ON r.reaction_id = b.reaction_id JOIN molecules y ON b.inchikey = y.inchikey
WHERE a.role = 'catalyst' AND b.role = 'solvent' AND x.formula ILIKE '%1%' AND y.formula ILIKE '%2%' AND r.yield_pct > 80""")
def q_two_role_join(m: Model) -> DataFrame:
    part = lambda role, like: m.components.where(F.col("role") == role).join(m.molecules.where(F.col("formula").ilike(like)), "inchikey", "left_semi").select("reaction_id")
    return m.reactions.where("yield_pct > 80").join(part("catalyst", "%1%"), "reaction_id", "left_semi").join(part("solvent", "%2%"), "reaction_id", "left_semi").select("reaction_id", "yield_pct")


@query("SELECT reaction_class, count(*) AS n, round(avg(yield_pct), 1) AS avg_yield, array_to_string(list_sort(list(reaction_id))[1:3], ',') AS sample_ids FROM reactions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def q_common_classes(m: Model) -> DataFrame:
    some = m.reactions.groupBy("reaction_class", F.pmod(F.xxhash64("reaction_id"), F.lit(64)).alias("part")).agg(F.sum("yield_pct").alias("y"), F.count("yield_pct").alias("k"), F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("reaction_id")), 1, 3).alias("ids"))
    rows = some.groupBy("reaction_class").agg(F.sum("n").alias("n"), F.round(F.sum("y") / F.sum("k"), 1).alias("avg_yield"), joined(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 3)).alias("sample_ids"))
    return rows.orderBy(F.desc("n"), "reaction_class").limit(20)


_HOPS = """, hop AS (SELECT DISTINCT a.inchikey AS src, a.reaction_id AS r, b.inchikey AS dst FROM components a JOIN components b ON a.reaction_id = b.reaction_id AND a.role = 'reactant' AND b.role = 'product'),
targets AS (SELECT inchikey FROM molecules WHERE inchikey % 20 = 0),
avail AS (SELECT inchikey FROM molecules WHERE commercially_available)"""


def _targets(m: Model) -> DataFrame:
    return m.molecules.where("inchikey % 20 = 0").select("inchikey")


@query(_HOPS + """ SELECT h.dst AS target, h.src AS start, h.r AS reaction_id, x.yield_pct FROM hop h JOIN targets t ON h.dst = t.inchikey JOIN avail a ON h.src = a.inchikey JOIN reactions x ON h.r = x.reaction_id
WHERE x.yield_pct IS NOT NULL ORDER BY x.yield_pct DESC, 1, 2, 3 LIMIT 20""")
def hybrid_routes(m: Model) -> DataFrame:
    routes = paths.route_depth(paths.hops(m.components), m.molecules, m.reactions, _targets(m), 1)
    rows = routes.select("target", "start", F.element_at("reaction_ids", 1).alias("reaction_id")).join(m.reactions.select("reaction_id", "yield_pct"), "reaction_id").where("yield_pct is not null")
    return rows.orderBy(F.desc("yield_pct"), "target", "start", "reaction_id").select("target", "start", "reaction_id", "yield_pct").limit(20)


@query(_HOPS + " SELECT h.dst AS target, h.src AS start, h.r AS reaction_id FROM hop h JOIN targets t ON h.dst = t.inchikey JOIN avail a ON h.src = a.inchikey")
def q_one_step_routes(m: Model) -> DataFrame:
    return paths.route_depth(paths.hops(m.components), m.molecules, m.reactions, _targets(m), 1).select("target", "start", F.element_at("reaction_ids", 1).alias("reaction_id"))


_PAIRS = """, w AS (SELECT doc_id AS id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 3),
reps AS (SELECT min(id) AS id, s, count(*) AS members FROM sets GROUP BY s),
items AS (SELECT id, len(s) AS n, unnest(s) AS g FROM reps),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM items a JOIN items b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
similar_to AS (SELECT a, b, round(c / (n + m - c), 4) AS similarity FROM pairs WHERE 100 * c >= 85 * (n + m - c))"""


@query(_PAIRS + " SELECT a, b, similarity FROM similar_to")
def similar_edges(m: Model) -> DataFrame:
    return similarity.similar_edges(m.shingles, 85, 100)


@query(_PAIRS + " SELECT s.id, r.id AS representative, r.members FROM sets s JOIN reps r ON s.s = r.s")
def similar_members(m: Model) -> DataFrame:
    return similarity.memberships(m.shingles)


@query(_PAIRS + """, both_ways AS (SELECT a AS id, b AS other, similarity FROM similar_to UNION ALL SELECT b, a, similarity FROM similar_to)
SELECT id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM both_ways) WHERE r <= 20""")
def neighbours(m: Model) -> DataFrame:
    edges = similarity.similar_edges(m.shingles, 85, 100)
    return paths.neighbours(edges, m.shingles.select("id"), 20)


@query(_PAIRS + """, both_ways AS (SELECT a AS id, b AS other, similarity FROM similar_to UNION ALL SELECT b, a, similarity FROM similar_to)
SELECT id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM both_ways WHERE id % 20 = 0) WHERE r <= 20""")
def q_graph_neighbours(m: Model) -> DataFrame:
    return paths.neighbours(similarity.similar_edges(m.shingles, 85, 100), m.shingles.where("id % 20 = 0").select("id"), 20)


@query("SELECT m.smiles, a.value, a.assay FROM activities a JOIN molecules m ON a.inchikey = m.inchikey WHERE a.activity_type = 'click' AND a.value < 100 AND a.unit = 'nM' ORDER BY a.value, a.assay LIMIT 50")
def q_potent(m: Model) -> DataFrame:
    rows = m.activities.where("activity_type = 'click' and value < 100 and unit = 'nM'").join(m.molecules, "inchikey")
    return rows.orderBy("value", "assay").select("smiles", "value", "assay").limit(50)


@query("SELECT m.inchikey, m.smiles, h.signal_word FROM hazards h JOIN molecules m ON h.inchikey = m.inchikey WHERE h.signal_word = 'Danger'")
def q_hazard(m: Model) -> DataFrame:
    return m.hazards.where("signal_word = 'Danger'").join(m.molecules, "inchikey").select("inchikey", "smiles", "signal_word")


@query("SELECT inchikey, array_to_string(ghs_codes, ',') AS codes FROM hazards WHERE list_contains(ghs_codes, 'H225')")
def q_hazard_code(m: Model) -> DataFrame:
    return m.hazards.where(F.array_contains("ghs_codes", "H225")).select("inchikey", joined(F.col("ghs_codes")).alias("codes"))


@query("SELECT reaction_id, yield_pct, temperature_c FROM reactions WHERE yield_pct > 95 AND atmosphere = 'O' ORDER BY yield_pct DESC, reaction_id LIMIT 50")
def q_atmosphere(m: Model) -> DataFrame:
    return m.reactions.where("yield_pct > 95 and atmosphere = 'O'").orderBy(F.desc("yield_pct"), "reaction_id").select("reaction_id", "yield_pct", "temperature_c").limit(50)


@query(_HOPS + " SELECT c.inchikey, r.reaction_id, r.reaction_class FROM components c JOIN targets t ON c.inchikey = t.inchikey JOIN reactions r ON c.reaction_id = r.reaction_id WHERE c.role = 'product'")
def q_producers(m: Model) -> DataFrame:
    return m.components.where("role = 'product'").join(_targets(m), "inchikey", "left_semi").join(m.reactions, "reaction_id").select("inchikey", "reaction_id", "reaction_class")


@query("SELECT inchikey, logp, mol_weight FROM molecules WHERE logp > 5 AND mol_weight < 1500")
def q_property_filter(m: Model) -> DataFrame:
    return m.molecules.where("logp > 5 and mol_weight < 1500").select("inchikey", "logp", "mol_weight")


@query("SELECT reaction_id, yield_pct FROM reactions WHERE reaction_class ILIKE '%high%' AND yield_pct > 90")
def q_class_yield(m: Model) -> DataFrame:
    return m.reactions.where(F.col("reaction_class").ilike("%high%") & (F.col("yield_pct") > 90)).select("reaction_id", "yield_pct")


@query("SELECT c.inchikey, count(*) AS n FROM components c JOIN reactions r ON c.reaction_id = r.reaction_id WHERE c.role = 'solvent' AND r.reaction_class ILIKE '%high%' GROUP BY 1")
def q_common_solvents(m: Model) -> DataFrame:
    return m.components.where("role = 'solvent'").join(m.reactions.where(F.col("reaction_class").ilike("%high%")), "reaction_id", "left_semi").groupBy("inchikey").agg(F.count("*").alias("n"))


@query(_HOPS + " SELECT DISTINCT h.dst AS target, h.src AS precursor FROM hop h JOIN targets t ON h.dst = t.inchikey JOIN avail a ON h.src = a.inchikey WHERE h.src <> h.dst")
def q_available_precursors(m: Model) -> DataFrame:
    rows = paths.one_step(m.components, m.reactions).join(_targets(m).withColumnRenamed("inchikey", "dst"), "dst", "left_semi")
    return rows.join(m.molecules.where("commercially_available").select(F.col("inchikey").alias("src")), "src", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("precursor"))


@query("SELECT reaction_id, temperature_c FROM reactions WHERE atmosphere = 'F' AND temperature_c > 100")
def q_atmo_temp(m: Model) -> DataFrame:
    return m.reactions.where("atmosphere = 'F' and temperature_c > 100").select("reaction_id", "temperature_c")


# ---- browsing, profiles, results


@query("""SELECT inchikey, iupac_name, mol_weight, (SELECT count(*) FROM molecules WHERE iupac_name ILIKE '%steel%') AS total FROM molecules WHERE iupac_name ILIKE '%steel%'
ORDER BY mol_weight NULLS LAST, inchikey LIMIT 20 OFFSET 10""")
def browse_molecules(m: Model) -> DataFrame:
    rows = results.browse(m.molecules, "iupac_name", "steel").select("inchikey", "iupac_name", "mol_weight")
    return results.page(rows, [F.asc_nulls_last("mol_weight"), F.asc("inchikey")], 20, 10)


@query("""SELECT reaction_id, reaction_class, yield_pct, (SELECT count(*) FROM reactions WHERE reaction_class ILIKE '%low%') AS total FROM reactions WHERE reaction_class ILIKE '%low%'
ORDER BY yield_pct DESC NULLS LAST, reaction_id LIMIT 20 OFFSET 20""")
def browse_reactions(m: Model) -> DataFrame:
    rows = results.browse(m.reactions, "reaction_class", "low").select("reaction_id", "reaction_class", "yield_pct")
    return results.page(rows, [F.desc_nulls_last("yield_pct"), F.asc("reaction_id")], 20, 20)


@query("SELECT reaction_id, yield_pct, temperature_c FROM reactions WHERE reaction_class = '1-URGENT' AND yield_pct >= 20 AND yield_pct <= 90 AND temperature_c >= 0 AND temperature_c <= 80 AND atmosphere = 'O'")
def search_reactions(m: Model) -> DataFrame:
    return results.search_reactions(m.reactions, reaction_class="1-URGENT", min_yield=20, max_yield=90, min_temp=0, max_temp=80, atmosphere="O").select("reaction_id", "yield_pct", "temperature_c")


_FOUND = """, found AS (SELECT reaction_id, yield_pct, temperature_c, row_number() OVER (ORDER BY yield_pct DESC NULLS LAST, reaction_id) AS place, count(*) OVER () AS total
  FROM reactions WHERE temperature_c >= 0 AND temperature_c <= 140) SELECT * FROM found WHERE place BETWEEN {a} AND {b}"""


def _searched_page(m: Model, limit: int, offset: int) -> DataFrame:
    rows = results.search_reactions(m.reactions, min_temp=0, max_temp=140).select("reaction_id", "yield_pct", "temperature_c")
    return results.Listing(rows, [F.desc_nulls_last("yield_pct"), F.asc("reaction_id")]).page(limit, offset)


@query(_FOUND.format(a=1, b=50))
def search_reactions_page(m: Model) -> DataFrame:
    """The first page of a filtered search in its order, with places and total."""
    return _searched_page(m, 50, 0)


@query(_FOUND.format(a=701, b=750))
def search_reactions_late_page(m: Model) -> DataFrame:
    """A page deep in the same listing."""
    return _searched_page(m, 50, 700)


@query(""", found AS (SELECT inchikey, mol_weight, row_number() OVER (ORDER BY mol_weight NULLS LAST, inchikey) AS place, count(*) OVER () AS total
  FROM molecules JOIN bits ON inchikey = id WHERE len(list_intersect(b, [1, 4])) = 2) SELECT * FROM found WHERE place BETWEEN 21 AND 40""")
def substructure_screen_page(m: Model) -> DataFrame:
    """A page of the molecules that contain a pattern, by weight, with places and total."""
    asked = m.spark.range(1, 2).select("id", F.array(F.lit(2 | 16).cast("long")).alias("words"))
    found = similarity.containment_screen(m.fingerprints, asked).select(F.col("id").alias("inchikey"))
    rows = m.molecules.join(found, "inchikey").select("inchikey", "mol_weight")
    return results.Listing(rows, [F.asc_nulls_last("mol_weight"), F.asc("inchikey")]).page(20, 20)


@query("SELECT 'molecules' AS table_name, count(*) AS n FROM molecules UNION ALL SELECT 'reactions', count(*) FROM reactions UNION ALL SELECT 'components', count(*) FROM components UNION ALL SELECT 'activities', count(*) FROM activities UNION ALL SELECT 'hazards', count(*) FROM hazards")
def table_counts(m: Model) -> DataFrame:
    return results.table_counts({k: getattr(m, k) for k in ("molecules", "reactions", "components", "activities", "hazards")})


_TOP = lambda key, order, cap: f"row_number() OVER (PARTITION BY {key} ORDER BY {order}) <= {cap}"


@query(f""", a AS (SELECT inchikey, string_agg(activity_type || ':' || assay, ',' ORDER BY activity_type, assay) AS activities FROM (SELECT * FROM activities QUALIFY {_TOP("inchikey", "activity_type, assay, value", 50)}) GROUP BY 1),
c AS (SELECT inchikey, string_agg(reaction_id || ':' || role, ',' ORDER BY reaction_id, role) AS reactions FROM (SELECT * FROM components QUALIFY {_TOP("inchikey", "reaction_id, role", 100)}) GROUP BY 1),
h AS (SELECT inchikey, string_agg(signal_word, ',' ORDER BY signal_word) AS hazards FROM hazards GROUP BY 1)
SELECT m.inchikey, coalesce(hazards, '') AS hazards, coalesce(activities, '') AS activities, coalesce(reactions, '') AS reactions FROM molecules m LEFT JOIN h USING (inchikey) LEFT JOIN a USING (inchikey) LEFT JOIN c USING (inchikey)""")
def molecule_profile(m: Model) -> DataFrame:
    rows = profiles.molecule_profile(m.molecules, m.components, m.reactions, m.activities, m.hazards)
    told = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[k] for k in f))), ",").alias(c)
    return rows.select("inchikey", told("hazards", "signal_word"), told("activities", "activity_type", "assay"), told("reactions", "reaction_id", "role"))


@query(f""", a AS (SELECT inchikey, string_agg(activity_type || ':' || assay, ',' ORDER BY activity_type, assay) AS activities FROM (SELECT * FROM activities QUALIFY {_TOP("inchikey", "activity_type, assay, value", 50)}) GROUP BY 1),
used AS (SELECT c.inchikey, c.reaction_id, c.role, r.reaction_class, r.yield_pct AS y FROM components c JOIN reactions r USING (reaction_id)),
c AS (SELECT inchikey, string_agg(concat_ws(':', reaction_id, role, reaction_class, CAST(y AS BIGINT)), ',' ORDER BY reaction_id, role) AS reactions FROM (SELECT * FROM used QUALIFY {_TOP("inchikey", "reaction_id, role", 100)}) GROUP BY 1),
h AS (SELECT inchikey, string_agg(signal_word, ',' ORDER BY signal_word) AS hazards FROM hazards GROUP BY 1),
hits AS (SELECT q.id AS query, x.id AS id, len(list_intersect(q.b, x.b)) AS s, len(q.b) + len(x.b) - len(list_intersect(q.b, x.b)) AS u FROM bits q JOIN bits x ON q.id <> x.id),
near AS (SELECT query, id, round(s / u, 4) AS similarity FROM hits WHERE u > 0 AND s / u > 0.7 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s / u DESC, id) <= 10),
n AS (SELECT query AS inchikey, string_agg(id || ':' || CAST(round(similarity * 10000) AS BIGINT), ',' ORDER BY similarity DESC, id) AS similar_ids FROM near GROUP BY 1)
SELECT m.inchikey, coalesce(hazards, '') AS hazards, coalesce(activities, '') AS activities, coalesce(reactions, '') AS reactions, coalesce(similar_ids, '') AS similar_molecules
FROM molecules m LEFT JOIN h USING (inchikey) LEFT JOIN a USING (inchikey) LEFT JOIN c USING (inchikey) LEFT JOIN n USING (inchikey)""")
def molecule_profile_similar(m: Model) -> DataFrame:
    """With the similar molecules (similarity in ten-thousandths), and class and yield of the reactions."""
    hits = similarity.sim_search_batch(m.fingerprints, m.fingerprints)
    rows = profiles.molecule_profile(m.molecules, m.components, m.reactions, m.activities, m.hazards, similar=hits)
    field = lambda x, k: x[k].cast("long") if k == "reaction_yield" else x[k]
    told = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(field(x, k) for k in f))), ",").alias(c)
    near = F.array_join(F.transform("similar", lambda x: F.concat_ws(":", x["id"], F.round(x["similarity"] * 10000).cast("long"))), ",")
    return rows.select("inchikey", told("hazards", "signal_word"), told("activities", "activity_type", "assay"), told("reactions", "reaction_id", "role", "reaction_class", "reaction_yield"), near.alias("similar_molecules"))


@query(""", c AS (SELECT reaction_id, string_agg(role || ':' || c.inchikey || ':' || coalesce(smiles, ''), ',' ORDER BY role, c.inchikey) AS components FROM components c LEFT JOIN molecules m USING (inchikey) GROUP BY 1),
d AS (SELECT reaction_id, string_agg(condition_type || ':' || unit, ',' ORDER BY condition_type) AS conditions FROM conditions GROUP BY 1)
SELECT r.reaction_id, coalesce(components, '') AS components, coalesce(conditions, '') AS conditions FROM reactions r LEFT JOIN c USING (reaction_id) LEFT JOIN d USING (reaction_id)""")
def reaction_profile(m: Model) -> DataFrame:
    rows = profiles.reaction_profile(m.reactions, m.components, m.molecules, m.conditions)
    parts = F.array_join(F.transform("components", lambda x: F.concat_ws(":", x["role"], x["inchikey"], F.coalesce(x["smiles"], F.lit("")))), ",")
    return rows.select("reaction_id", parts.alias("components"), F.array_join(F.transform("conditions", lambda x: F.concat_ws(":", x["condition_type"], x["unit"])), ",").alias("conditions"))


@query(""", g AS (SELECT inchikey, list_sort(list(reaction_id)) AS ids FROM components WHERE role = 'solvent' GROUP BY 1), u AS (SELECT inchikey, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM g),
f AS (SELECT id, min(inchikey * 100000 + i) AS o FROM u GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY o) AS place, (SELECT count(*) FROM f) AS total FROM f ORDER BY o LIMIT 50""")
def citations(m: Model) -> DataFrame:
    rows = m.components.where("role = 'solvent'").select(F.struct("inchikey", "reaction_id").alias("row"), "reaction_id")
    return results.citations(rows, "row")


@query("""SELECT 'yield_pct' AS column_name, count(*) AS row_count, count(yield_pct) AS n, round(avg(yield_pct), 2) AS avg, round(min(yield_pct), 2) AS min, round(max(yield_pct), 2) AS max FROM reactions
UNION ALL SELECT 'temperature_c', count(*), count(temperature_c), round(avg(temperature_c), 2), min(temperature_c), max(temperature_c) FROM reactions""")
def result_stats(m: Model) -> DataFrame:
    return results.result_stats(m.reactions, ["yield_pct", "temperature_c", "pressure_bar", "avg_yield", "mol_weight"])


@query("SELECT reaction_id, yield_pct FROM reactions ORDER BY reaction_id LIMIT 100")
def result_cap(m: Model) -> DataFrame:
    return results.result_cap(m.reactions.select("reaction_id", "yield_pct"), [F.asc("reaction_id")])


# ---- graph


@query("SELECT inchikey, smiles, formula, mol_weight, coalesce(commercially_available, false) AS commercially_available FROM molecules")
def graph_mol_nodes(m: Model) -> DataFrame:
    return m.mol_nodes


@query("SELECT reaction_id, reaction_class, yield_pct, temperature_c, source FROM reactions")
def graph_rxn_nodes(m: Model) -> DataFrame:
    return m.rxn_nodes


_EDGES = """, edges AS (SELECT CASE role WHEN 'product' THEN 'reaction' ELSE 'molecule' END AS src_kind, CASE role WHEN 'product' THEN c.reaction_id ELSE c.inchikey END AS src,
  CASE role WHEN 'product' THEN 'molecule' ELSE 'reaction' END AS dst_kind, CASE role WHEN 'product' THEN c.inchikey ELSE c.reaction_id END AS dst,
  CASE role WHEN 'reactant' THEN 'REACTANT_IN' WHEN 'catalyst' THEN 'CATALYSES' WHEN 'solvent' THEN 'SOLVENT_IN' ELSE 'PRODUCT_OF' END AS label,
  CASE role WHEN 'reactant' THEN stoichiometry END AS stoichiometry, CASE WHEN role IN ('reactant', 'catalyst') THEN equivalents END AS equivalents, CASE role WHEN 'solvent' THEN volume_ml END AS volume_ml,
  CASE role WHEN 'product' THEN c.yield_pct END AS yield_pct, CASE role WHEN 'product' THEN is_major END AS is_major
  FROM components c JOIN molecules m ON c.inchikey = m.inchikey JOIN reactions r ON c.reaction_id = r.reaction_id WHERE {where})"""


@query(_EDGES.format(where="true") + " SELECT * REPLACE (CAST(is_major AS VARCHAR) AS is_major) FROM edges")
def graph_edges(m: Model) -> DataFrame:
    return m.edges.withColumn("is_major", F.col("is_major").cast("string"))


@query(""", few AS (SELECT *, CASE role WHEN 'reactant' THEN 'REACTANT_IN' WHEN 'catalyst' THEN 'CATALYSES' WHEN 'solvent' THEN 'SOLVENT_IN' ELSE 'PRODUCT_OF' END AS label FROM components)
SELECT label, count(*) AS expected, count(*) FILTER (WHERE inchikey % 50 <> 7) AS created, count(*) FILTER (WHERE inchikey % 50 = 7) AS missing FROM few GROUP BY 1""")
def graph_missing(m: Model) -> DataFrame:
    return graph.missing_edges(m.components, m.molecules.where("inchikey % 50 <> 7"), m.reactions)


@query("SELECT m.inchikey, m.smiles, m.formula, m.mol_weight, coalesce(m.commercially_available, false) AS commercially_available, h.signal_word, array_to_string(ghs_codes, ',') AS ghs_codes FROM molecules m JOIN hazards h USING (inchikey)")
def graph_hazard(m: Model) -> DataFrame:
    return graph.annotate_hazard(m.mol_nodes, m.hazards)


@query(_EDGES.format(where="true") + " SELECT 'node' AS kind, 'Molecule' AS label, count(*) AS n FROM molecules UNION ALL SELECT 'node', 'Reaction', count(*) FROM reactions UNION ALL SELECT 'edge', label, count(*) FROM edges GROUP BY label")
def graph_stats(m: Model) -> DataFrame:
    return graph.graph_stats(m.mol_nodes, m.rxn_nodes, m.edges)


@query(_EDGES.format(where="role = 'solvent'") + " SELECT src_kind, src, dst_kind, dst, label, volume_ml FROM edges")
def sink_graph(m: Model) -> DataFrame:
    from molquarry.sources.readers import write_graph

    folder = _folder(m, "graph")
    write_graph(m.edges, folder, rebuild=True)
    return m.spark.read.parquet(folder).where("label = 'SOLVENT_IN'").select("src_kind", "src", "dst_kind", "dst", "label", "volume_ml")


def _folder(m: Model, name: str) -> str:
    """A new folder that all executors see."""
    return fresh_path(m.spark, name)


# ---- paths


@query(_HOPS + """, one AS (SELECT src, r, dst FROM hop) SELECT t.inchikey AS target, a.src AS start, a.r || ',' || b.r AS reaction_ids, a.src || ',' || a.dst || ',' || b.dst AS molecules,
CASE WHEN x.yield_pct > 0 AND y.yield_pct > 0 THEN round(100.0 * x.yield_pct / 100 * y.yield_pct / 100, 2) END AS total_yield
FROM targets t JOIN one b ON b.dst = t.inchikey JOIN one a ON a.dst = b.src JOIN avail v ON a.src = v.inchikey JOIN reactions x ON a.r = x.reaction_id JOIN reactions y ON b.r = y.reaction_id
WHERE NOT (a.src = b.src AND a.r = b.r) AND NOT (a.dst = b.dst AND a.r = b.r)""")
def route_depth(m: Model) -> DataFrame:
    rows = paths.route_depth(paths.hops(m.components), m.molecules, m.reactions, _targets(m), 2)
    return rows.select("target", "start", joined(F.col("reaction_ids")).alias("reaction_ids"), joined(F.col("molecules")).alias("molecules"), "total_yield")


_ROUTES = _HOPS + """, one AS (SELECT t.inchikey AS target, h.src AS start, 1 AS steps, [h.r] AS rs, [h.src, h.dst] AS ms FROM targets t JOIN hop h ON h.dst = t.inchikey JOIN avail v ON h.src = v.inchikey),
two AS (SELECT t.inchikey AS target, a.src AS start, 2 AS steps, [a.r, b.r] AS rs, [a.src, a.dst, b.dst] AS ms FROM targets t JOIN hop b ON b.dst = t.inchikey JOIN hop a ON a.dst = b.src JOIN avail v ON a.src = v.inchikey
  WHERE NOT (a.src = b.src AND a.r = b.r) AND NOT (a.dst = b.dst AND a.r = b.r)),
routes AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY target ORDER BY steps, start, rs, ms) <= 10)"""


_ROUTE_ROWS = " SELECT target, start, steps, array_to_string(rs, ',') AS reaction_ids, array_to_string(ms, ',') AS molecules FROM routes"


@query(_ROUTES + _ROUTE_ROWS)
def route_search(m: Model) -> DataFrame:
    rows = paths.route_search(paths.hops(m.components), m.molecules, m.reactions, _targets(m), max_depth=4, max_routes=10)
    return rows.select("target", "start", "steps", joined(F.col("reaction_ids")).alias("reaction_ids"), joined(F.col("molecules")).alias("molecules"))


_ROUTE_ELEMENTS = """, n AS (SELECT list_concat(list_transform(range(1, 2 * len(rs) + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'm' || ms[(i + 1) // 2] ELSE 'r' || rs[i // 2] END), ['m' || ms[-1]]) AS n FROM routes),
e AS (SELECT DISTINCT unnest(list_transform(range(1, len(n)), lambda i: {'a': n[i], 'b': n[i + 1]})) AS e FROM n)
SELECT 'node' AS kind, id, CASE WHEN id LIKE 'm%' THEN 'molecule' ELSE 'reaction' END AS type, NULL AS src, NULL AS dst FROM (SELECT DISTINCT unnest(n) AS id FROM n)
UNION ALL SELECT 'edge', e.a || '>' || e.b, 'link', e.a, e.b FROM e"""


@query(_ROUTES + _ROUTE_ELEMENTS)
def route_elements(m: Model) -> DataFrame:
    return paths.route_elements(paths.route_search(paths.hops(m.components), m.molecules, m.reactions, _targets(m), max_depth=4, max_routes=10))


def _routes_sql(n: int) -> str:
    """SQL of all routes of n steps."""
    hs = range(1, n + 1)
    joins = "".join(f" JOIN hop h{i} ON h{i}.dst = h{i + 1}.src" for i in reversed(range(1, n)))
    apart = " AND ".join(f"NOT (h{i}.{end} = h{j}.{end} AND h{i}.r = h{j}.r)" for i in hs for j in range(i + 1, n + 1) for end in ("src", "dst")) or "true"
    rs, ms = ", ".join(f"h{i}.r" for i in hs), ", ".join(["h1.src", *(f"h{i}.dst" for i in hs)])
    return f"SELECT t.inchikey AS target, h1.src AS start, {n} AS steps, [{rs}] AS rs, [{ms}] AS ms FROM targets t JOIN hop h{n} ON h{n}.dst = t.inchikey{joins} JOIN avail v ON h1.src = v.inchikey WHERE {apart}"


_ROUTES_DEEP = _HOPS + ", routes AS (SELECT * FROM (" + " UNION ALL ".join(_routes_sql(n) for n in range(1, 5)) + ") QUALIFY row_number() OVER (PARTITION BY target ORDER BY steps, start, rs, ms) <= 10)"


@query(_ROUTES_DEEP + _ROUTE_ROWS)
def route_search_depth8(m: Model) -> DataFrame:
    """Up to four steps, the reference's default."""
    rows = paths.route_search(paths.hops(m.components), m.molecules, m.reactions, _targets(m))
    return rows.select("target", "start", "steps", joined(F.col("reaction_ids")).alias("reaction_ids"), joined(F.col("molecules")).alias("molecules"))


@query(None)
def route_search_depth16(m: Model) -> DataFrame:
    """Up to eight steps, the most that may be asked for, and fifty routes a target."""
    rows = paths.route_search(paths.hops(m.components), m.molecules, m.reactions, _targets(m), max_depth=16, max_routes=50)
    return rows.select("target", "start", "steps", joined(F.col("reaction_ids")).alias("reaction_ids"), joined(F.col("molecules")).alias("molecules"), "total_yield")


@query(_ROUTES_DEEP + _ROUTE_ELEMENTS)
def route_elements_depth8(m: Model) -> DataFrame:
    return paths.route_elements(paths.route_search(paths.hops(m.components), m.molecules, m.reactions, _targets(m)))


@query(""" SELECT reaction_id, CASE WHEN min(y) > 0 AND count(y) = count(*) THEN round(100.0 * any_value(y) FILTER (WHERE k = 1) / 100 * any_value(y) FILTER (WHERE k = 2) / 100, 2) END AS total_yield
FROM (SELECT reaction_id, 1 AS k, yield_pct AS y FROM reactions UNION ALL SELECT reaction_id, 2, CAST(reaction_id % 50 AS DOUBLE) FROM reactions) GROUP BY 1""")
def cumulative_yield(m: Model) -> DataFrame:
    return m.reactions.select("reaction_id", paths.cumulative_yield(F.array("yield_pct", (F.col("reaction_id") % 50).cast("double"))).alias("total_yield"))


@query(_HOPS + """, best AS (SELECT src, dst, max(yield_pct) AS y FROM hop JOIN reactions ON r = reaction_id WHERE src <> dst GROUP BY 1, 2)
SELECT a.src, b.dst, 2 AS step_count, round(max(a.y * b.y / 100), 2) AS total_yield FROM best a JOIN best b ON a.dst = b.src AND a.src <> b.dst GROUP BY 1, 2""")
def precursor_edges(m: Model) -> DataFrame:
    return paths.precursor_edges(m.components, m.reactions, max_depth=2)


@query(_HOPS + """, best AS (SELECT src, dst, max(yield_pct) AS y FROM hop JOIN reactions ON r = reaction_id WHERE src <> dst GROUP BY 1, 2),
two AS (SELECT a.src, a.dst AS mid, b.dst, a.y * b.y / 100 AS y FROM best a JOIN best b ON a.dst = b.src AND a.src <> b.dst),
edges AS (SELECT src, dst, 2 AS step_count, max(y) AS y FROM two GROUP BY 1, 2
  UNION ALL SELECT t.src, c.dst, 3, max(t.y * c.y / 100) FROM two t JOIN best c ON t.dst = c.src AND c.dst NOT IN (t.src, t.mid) GROUP BY 1, 2)
SELECT src, dst, step_count, CAST(round(CAST(CAST(y AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS total_yield FROM edges""")
def precursor_edges_depth3(m: Model) -> DataFrame:
    """All depths of the reference's default."""
    return paths.precursor_edges(m.components, m.reactions)


_PRECURSORS_OF = _HOPS + """, best AS (SELECT src, dst, max(yield_pct) AS y FROM hop JOIN reactions ON r = reaction_id WHERE src <> dst GROUP BY 1, 2),
one AS (SELECT dst AS v0, src AS v1, y FROM best JOIN targets ON dst = inchikey),
two AS (SELECT v0, v1, src AS v2, one.y * b.y / 100 AS y FROM one JOIN best b ON b.dst = v1 WHERE src <> v0),
three AS (SELECT v0, v1, v2, src AS v3, two.y * b.y / 100 AS y FROM two JOIN best b ON b.dst = v2 WHERE src NOT IN (v0, v1)),
four AS (SELECT v0, src AS v4, three.y * b.y / 100 AS y FROM three JOIN best b ON b.dst = v3 WHERE src NOT IN (v0, v1, v2)),
edges AS (SELECT v2 AS src, v0 AS dst, 2 AS step_count, max(y) AS y FROM two GROUP BY 1, 2 UNION ALL SELECT v3, v0, 3, max(y) FROM three GROUP BY 1, 2 UNION ALL SELECT v4, v0, 4, max(y) FROM four GROUP BY 1, 2)
SELECT src, dst, step_count, CAST(round(CAST(CAST(y AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS total_yield FROM edges"""


@query(_PRECURSORS_OF)
def precursor_edges_depth4(m: Model) -> DataFrame:
    """All precursors up to the deepest level, four steps, of the stated targets."""
    return paths.precursor_edges(m.components, m.reactions, max_depth=4, targets=_targets(m))



# ---- similarity


@query(" SELECT id, len(b) AS n_bits, array_to_string(b, ',') AS bits FROM bits")
def fp_build(m: Model) -> DataFrame:
    return m.fingerprints.select("id", F.size("bits").cast("long").alias("n_bits"), joined(F.col("bits")).alias("bits"))


@query(" SELECT a.id, round(len(list_intersect(a.b, b.b)) / (len(a.b) + len(b.b) - len(list_intersect(a.b, b.b))), 9) AS similarity FROM bits a JOIN bits b ON b.id = a.id + 1")
def tanimoto(m: Model) -> DataFrame:
    nxt = m.fingerprints.select((F.col("id") - 1).alias("id"), F.col("words").alias("other"))
    return m.fingerprints.join(nxt, "id").select("id", F.round(similarity.tanimoto_words(F.col("words"), F.col("other")), 9).alias("similarity"))


@query(_HITS.format(where="s / u > 0.45", limit=50))
def sim_search(m: Model) -> DataFrame:
    return similarity.sim_search(m.fingerprints, _asked(m), threshold=0.45, limit=50)


@query(_HITS.format(where="s / u > 0.45 AND query <> id", limit=10))
def sim_search_batch(m: Model) -> DataFrame:
    return similarity.sim_search_batch(m.fingerprints, _asked(m), threshold=0.45, limit=10)


@query(_HITS.replace("q.id % 20 = 0", "q.id <> x.id").format(where="s / u > 0.5", limit=10))
def sim_search_indexed(m: Model) -> DataFrame:
    """All rows as queries, by the index of bit blocks."""
    return similarity.sim_search_indexed(m.fingerprints, m.fingerprints, threshold=0.5, limit=10)


@query(_HITS.format(where="query <> id", limit=50))
def knn(m: Model) -> DataFrame:
    return similarity.knn(m.fingerprints, _asked(m), 50)


@query(" SELECT 1::BIGINT AS query, id FROM bits WHERE len(list_intersect(b, [1, 4, 9])) = 3")
def substructure_screen(m: Model) -> DataFrame:
    asked = m.spark.range(1, 2).select("id", F.array(F.lit(2 | 16 | 512).cast("long")).alias("words"))
    return similarity.containment_screen(m.fingerprints, asked)


@query(" SELECT q.id AS query, x.id FROM bits q JOIN bits x ON q.id % 20 = 0 AND len(x.b) > 0 AND len(list_intersect(q.b, x.b)) = len(q.b)")
def substructure_screen_batch(m: Model) -> DataFrame:
    return similarity.containment_screen(m.fingerprints, _asked(m))


# ---- ingest; the SQL side builds the same nested values flat


_LINES = """WITH line AS (SELECT CAST(l_orderkey AS VARCHAR) AS reaction_id, l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS key, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS flag,
  ['reactant', 'reagent', 'solvent', 'catalyst', 'internal_standard', 'product', 'product', 'product', 'additive', NULL][l_partkey % 10 + 1] AS role,
  l_extendedprice AS price, round((l_extendedprice + 0.003::DOUBLE) * [1000.0::DOUBLE, 1, 0.001, 0.000001, NULL][l_suppkey % 5 + 1], 6) AS mass, CASE WHEN l_quantity > 10 THEN round((l_quantity - 10) * [1000.0, 1, 0.001, NULL][l_suppkey % 4 + 1], 6) END AS volume,
  CASE WHEN l_quantity > 0 THEN round(l_quantity * [1, 0.001, NULL][l_suppkey % 3 + 1], 9) END AS moles, 'in' || (l_suppkey % 3) AS input,
  CAST((l_orderkey * 37 + l_linenumber * 11) % 120 - 20 AS DOUBLE) AS y1, CAST((l_orderkey + l_linenumber) % 90 - 10 AS DOUBLE) AS sel, CAST((l_orderkey * 17 + l_linenumber * 5) % 110 - 40 AS DOUBLE) AS y2 FROM lineitem)"""


@query("SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'cy' || o_orderkey END AS reaction_smiles FROM orders", model=False)
def pick_identifier(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "reaction_smiles")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, round(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 400 AS DOUBLE) WHEN 1 THEN (o_custkey % 400 - 32) * 5.0::DOUBLE / 9.0::DOUBLE WHEN 2 THEN o_custkey % 400 - 273.15::DOUBLE END, 2) AS temperature_c FROM orders""", model=False)
def norm_temperature(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "temperature_c")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, round((o_custkey % 90 + 0.3::DOUBLE) * [1.0::DOUBLE, 1.01325, 0.0689476, 68.9476, 0.01, 0.00001, 0.00133322, 0.00133322, NULL][o_orderkey % 9 + 1], 4) AS pressure_bar FROM orders", model=False)
def norm_pressure(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "pressure_bar")


@query(_LINES + """ SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, CASE WHEN o_orderkey % 4 > 1 AND EXISTS (SELECT 1 FROM line WHERE flag = 'N' AND o = o_orderkey)
THEN CAST((o_orderkey % 4 - 1) * [3600, 60, 1, 86400, NULL][o_orderkey % 5 + 1] AS INTEGER) END AS time_seconds FROM orders""", model=False)
def norm_time(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "time_seconds")


@query(_LINES + " SELECT reaction_id, key, n AS line, mass AS mass_g, volume AS volume_ml, moles AS equivalents FROM line WHERE flag <> 'N'", model=False)
def norm_amount(m: Model) -> DataFrame:
    rows = m.records.select("reaction_id", F.explode(F.map_values("inputs")).alias("i")).select("reaction_id", F.explode("i.components").alias("c"))
    a = F.col("c.amount")
    line = F.substring_index("c.smiles", "/", -1).cast("int")
    return rows.select("reaction_id", "c.key", line.alias("line"), U.norm_amount(a["mass"], U.MASS_TO_GRAM, 6).alias("mass_g"), U.norm_amount(a["volume"], U.VOLUME_TO_ML, 6).alias("volume_ml"), U.norm_amount(a["moles"], U.MOLES, 9).alias("equivalents"))


@query(_LINES + " SELECT role, count(*) AS n FROM line WHERE flag <> 'N' AND role IS NOT NULL GROUP BY 1", model=False)
def map_role(m: Model) -> DataFrame:
    return ingest.mentions(m.records).where("is_input and role is not null").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, ['air', 'nitrogen', 'argon', 'carbon_monoxide', NULL][o_orderkey % 5 + 1] AS atmosphere FROM orders", model=False)
def map_atmosphere(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "atmosphere")


@query(_LINES + """, y AS (SELECT reaction_id, max(greatest(y1, y2)) FILTER (WHERE y1 > 0 OR y2 > 0) AS best, arg_max(sel, n) FILTER (WHERE sel > 0) AS sel FROM line WHERE flag = 'N' GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, best AS yield_pct, CASE WHEN best IS NOT NULL THEN 'percentage' END AS yield_type, CAST(sel AS VARCHAR) AS selectivity FROM orders LEFT JOIN y ON reaction_id = CAST(o_orderkey AS VARCHAR)""", model=False)
def extract_yield(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).select("reaction_id", "yield_pct", "yield_type", "selectivity")


@query(_LINES + """ SELECT reaction_id, key, role, round(sum(mass), 6) AS mass_g, round(sum(volume), 6) AS volume_ml, first(moles ORDER BY input, n, price) AS equivalents, true AS is_major FROM line
WHERE flag <> 'N' AND role IS NOT NULL AND role <> 'product' GROUP BY 1, 2, 3""", model=False)
def input_components(m: Model) -> DataFrame:
    return ingest.input_components(m.records)


@query(_LINES + """ SELECT reaction_id, key, 'product' AS role, first(n % 2 = 1 ORDER BY n) AS is_major, first(CASE WHEN y2 > 0 THEN y2 WHEN y1 > 0 THEN y1 END ORDER BY n) AS yield_pct FROM line WHERE flag = 'N' GROUP BY 1, 2""", model=False)
def product_components(m: Model) -> DataFrame:
    return ingest.product_components(m.records)


@query(_LINES + """ SELECT key, last('C' || p || CASE WHEN flag = 'N' THEN '' ELSE '/' || n END ORDER BY reaction_id, flag = 'N', CASE WHEN flag = 'N' THEN '' ELSE input END, n) AS smiles FROM line GROUP BY 1""", model=False)
def molecule_rows(m: Model) -> DataFrame:
    return ingest.molecule_rows(m.records)


@query(" SELECT reaction_id, condition_type, value, unit FROM conditions")
def conditions_unpivot(m: Model) -> DataFrame:
    return m.conditions


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'loaded' ELSE 'skipped' END AS status, count(*) AS n FROM orders GROUP BY 1", model=False)
def reaction_skip(m: Model) -> DataFrame:
    return ingest.reaction_rows(m.records).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT event_id, value FROM (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'K' ELSE 'ABCDEFGHIJKLMN-ABCDEFGHIJ-K' END AS inchikey, TRY_CAST(CASE WHEN event_id % 6 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS value FROM events)
WHERE length(inchikey) = 27 AND event_type IS NOT NULL AND value IS NOT NULL""", model=False)
def clean_activity(m: Model) -> DataFrame:
    key = F.when(F.col("event_id") % 4 == 0, "K").otherwise("ABCDEFGHIJKLMN-ABCDEFGHIJ-K")
    rows = m.table("events").select("event_id", key.alias("inchikey"), F.col("event_type").alias("activity_type"), F.col("event_id").alias("assay"), F.when(F.col("event_id") % 6 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("value"))
    return ingest.clean_activity(rows).select("event_id", "value")


@query("SELECT c_custkey AS id, c_custkey % 3 <> 1 AS valid FROM customer", model=False)
def valid_key(m: Model) -> DataFrame:
    key = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("abc-"), F.col("c_custkey"))).otherwise("ABCDEFGHIJKLMN-ABCDEFGHIJ-K")
    return m.table("customer").select(F.col("c_custkey").alias("id"), U.valid_key(key).alias("valid"))


# ---- table maintenance


def _split(m: Model) -> tuple[DataFrame, DataFrame]:
    """A target (parts of every third key missing, some values null) and a batch with repeated keys."""
    target = m.molecules.where("inchikey % 3 <> 0").select("inchikey", F.when(F.col("inchikey") % 4 != 0, F.col("formula")).alias("formula"), "mol_weight", F.array(F.lit("a"), F.col("formula")).alias("sources"), F.lit(1).alias("stamp"))
    lines = m.table("lineitem").where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("inchikey"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("formula"), F.col("l_extendedprice").alias("mol_weight"), F.array("l_returnflag").alias("sources"), F.lit(2).alias("stamp"), F.col("l_orderkey"), F.col("l_linenumber"))
    return target, lines


_ORDER = ["l_orderkey", "l_linenumber"]
_SPLIT = """, target AS (SELECT inchikey, CASE WHEN inchikey % 4 <> 0 THEN formula END AS formula, mol_weight, ['a', formula] AS sources, 1 AS stamp FROM molecules WHERE inchikey % 3 <> 0),
batch AS (SELECT l_partkey AS inchikey, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS formula, l_extendedprice AS mol_weight, l_returnflag AS flag, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 2 = 0),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY inchikey ORDER BY l_orderkey, l_linenumber) = 1),
lasts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY inchikey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)"""


@query(_SPLIT + " SELECT inchikey, formula, mol_weight FROM target UNION ALL SELECT inchikey, formula, mol_weight FROM firsts WHERE inchikey NOT IN (SELECT inchikey FROM target)")
def insert_absent(m: Model) -> DataFrame:
    target, batch = _split(m)
    return upsert.insert_absent(target, batch, ["inchikey"], _ORDER).select("inchikey", "formula", "mol_weight")


@query(_SPLIT + """, s AS (SELECT inchikey, list_sort(list_distinct(list(flag))) AS f FROM batch GROUP BY 1)
SELECT inchikey, coalesce(t.mol_weight, x.mol_weight) AS mol_weight, CASE WHEN s.f IS NULL THEN t.stamp ELSE 2 END AS stamp, array_to_string(list_sort(list_distinct(list_concat(coalesce(t.sources, []), coalesce(s.f, [])))), ',') AS sources
FROM target t FULL JOIN firsts x USING (inchikey) LEFT JOIN s USING (inchikey)""")
def upsert_union_sources(m: Model) -> DataFrame:
    target, batch = _split(m)
    rows = upsert.upsert_union_sources(target, batch, "inchikey", "sources", "stamp", _ORDER)
    return rows.select("inchikey", "mol_weight", "stamp", joined(F.col("sources")).alias("sources"))


@query(_SPLIT + " SELECT inchikey, CASE WHEN x.flag IS NULL THEN t.formula ELSE x.formula END AS formula, coalesce(t.mol_weight, x.mol_weight) AS mol_weight FROM target t FULL JOIN lasts x USING (inchikey)")
def upsert_overwrite(m: Model) -> DataFrame:
    target, batch = _split(m)
    return upsert.upsert_overwrite(target, batch, ["inchikey"], ["formula"], _ORDER).select("inchikey", "formula", "mol_weight")


@query(_SPLIT + " SELECT t.inchikey, coalesce(x.formula, t.formula) AS formula, CASE WHEN x.flag IS NULL THEN t.mol_weight ELSE x.mol_weight END AS mol_weight FROM target t LEFT JOIN lasts x USING (inchikey)")
def enrich_coalesce(m: Model) -> DataFrame:
    target, batch = _split(m)
    return upsert.enrich_coalesce(target, batch, "inchikey", ["formula"], ["mol_weight"], _ORDER).select("inchikey", "formula", "mol_weight")


@query(_SPLIT + " SELECT t.inchikey, coalesce(t.formula, x.formula) AS formula FROM target t LEFT JOIN firsts x USING (inchikey)")
def fill_if_null(m: Model) -> DataFrame:
    target, batch = _split(m)
    return upsert.fill_if_null(target, batch, "inchikey", "formula", _ORDER).select("inchikey", "formula")


@query(" SELECT inchikey, CASE WHEN inchikey * 2 IN (SELECT inchikey FROM molecules) THEN inchikey * 2 END AS parent FROM molecules")
def link_parent(m: Model) -> DataFrame:
    return upsert.link_parent(m.molecules.select("inchikey", (F.col("inchikey") * 2).alias("parent")), "inchikey", "parent").select("inchikey", "parent")


@query(_SPLIT + " SELECT 'kept' AS kind, count(*) AS n FROM batch WHERE inchikey IN (SELECT inchikey FROM target) UNION ALL SELECT 'skipped', count(*) FROM batch WHERE inchikey NOT IN (SELECT inchikey FROM target)")
def semi_known(m: Model) -> DataFrame:
    target, batch = _split(m)
    kept, skipped = upsert.semi_known(batch, target, "inchikey")
    return kept.agg(F.lit("kept").alias("kind"), F.count("*").alias("n")).union(skipped.select(F.lit("skipped"), "skipped"))


@query(" SELECT inchikey, smiles FROM molecules WHERE inchikey NOT IN (SELECT inchikey FROM hazards)")
def pending_anti(m: Model) -> DataFrame:
    return upsert.pending_anti(m.molecules.select("inchikey", "smiles"), m.hazards, "inchikey")


@query(" SELECT (row_number() OVER (ORDER BY inchikey) - 1) // 100 AS batch, inchikey FROM molecules")
def batch_keys(m: Model) -> DataFrame:
    return upsert.batch_keys(m.molecules, "inchikey", 100).select("batch", F.explode("keys").alias("inchikey"))


@query(_SPLIT + " SELECT inchikey, coalesce(formula, CASE WHEN inchikey % 8 <> 0 THEN 'F' || inchikey END) AS formula FROM target")
def backfill_derived(m: Model) -> DataFrame:
    value = F.when(F.col("inchikey") % 8 != 0, F.concat(F.lit("F"), F.col("inchikey")))
    return upsert.backfill_derived(_split(m)[0].select("inchikey", "formula"), "formula", value)


@query(_SPLIT + " SELECT count(*) FILTER (WHERE formula IS NULL AND inchikey % 8 <> 0) AS updated, count(*) FILTER (WHERE formula IS NULL AND inchikey % 8 = 0) AS invalid FROM target")
def backfill_report(m: Model) -> DataFrame:
    """How many rows a backfill fills, and how many stay without a value."""
    value = F.when(F.col("inchikey") % 8 != 0, F.concat(F.lit("F"), F.col("inchikey")))
    return upsert.backfill_counts(_split(m)[0].select("inchikey", "formula"), "formula", value)


@query(""" SELECT 'reactions.pk' AS violation, 0::BIGINT AS n UNION ALL SELECT 'lineitem.unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag HAVING count(*) > 1)
UNION ALL SELECT 'hazards.fk', count(*) FROM hazards WHERE inchikey NOT IN (SELECT inchikey FROM molecules) UNION ALL SELECT 'components.role', count(*) FILTER (WHERE role NOT IN ('reactant', 'product', 'solvent')) FROM components
UNION ALL SELECT 'reactions.yield', count(*) FILTER (WHERE yield_pct IS NULL) FROM reactions""")
def dq_constraints(m: Model) -> DataFrame:
    return quality.dq_constraints([
        quality.duplicate_keys(m.reactions, "reactions.pk", ["reaction_id"]), quality.duplicate_keys(m.table("lineitem"), "lineitem.unique", ["l_orderkey", "l_partkey", "l_returnflag"]),
        quality.orphans(m.hazards, "hazards.fk", "inchikey", m.molecules, "inchikey"), quality.outside_domain(m.components, "components.role", "role", ["reactant", "product", "solvent"]), quality.nulls(m.reactions, "reactions.yield", "yield_pct"),
    ])


@query("SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS loaded, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS skipped, 0::BIGINT AS failed FROM orders", model=False)
def load_stats(m: Model) -> DataFrame:
    return quality.load_stats(ingest.reaction_rows(m.records))


@query("""SELECT 'completed' AS status, 'events' AS source_name, 'kind=all,limit=5' AS config, count(*) AS read, count(*) FILTER (WHERE event_id % 7 > 1) AS loaded, count(*) FILTER (WHERE event_id % 7 = 1) AS skipped, count(*) FILTER (WHERE event_id % 7 = 0) AS failed,
(SELECT string_agg(item || ':bad ' || item, ',' ORDER BY item) FROM (SELECT CAST(event_id AS VARCHAR) AS item FROM events WHERE event_id % 7 = 0 ORDER BY 1 LIMIT 1000)) AS errors FROM events""", model=False)
def load_log(m: Model) -> DataFrame:
    """The record of a load that writes its rows: status, settings, counts and the first thousand errors."""
    k = F.col("event_id") % 7
    status = F.when(k == 0, "failed").when(k == 1, "skipped").otherwise("loaded")
    rows = m.table("events").select(F.col("event_id").alias("item_id"), "event_type", status.alias("status"), F.when(k == 0, F.concat(F.lit("bad "), "event_id")).alias("error"))
    told = quality.recorded_load(rows, _folder(m, "load"), "events", config={"limit": 5, "kind": "all", "unset": None})
    settings = F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    errors = F.array_join(F.transform("errors", lambda x: F.concat_ws(":", x["item_id"], x["error"])), ",")
    return told.select("status", "source_name", settings.alias("config"), "read", "loaded", "skipped", "failed", errors.alias("errors"))


@query(" SELECT inchikey, 'docs' AS source_name, CAST(min(doc_id) AS VARCHAR) AS source_id FROM (SELECT doc_id % 500 AS inchikey, doc_id FROM documents) GROUP BY 1")
def provenance_upsert(m: Model) -> DataFrame:
    rows = m.table("documents").select((F.col("doc_id") % 500).alias("inchikey"), "doc_id")
    batch = upsert.provenance_rows(rows, "inchikey", "docs", "doc_id", "load").withColumn("order", F.col("source_id").cast("long"))
    target = batch.drop("order").limit(0)
    return upsert.insert_absent(target, batch, ["inchikey", "source_name"], ["order"]).drop("load_id")


@query("SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1", model=False)
def ingest_microbatch(m: Model) -> DataFrame:
    from molquarry.streaming.microbatch import ingest_microbatch as run

    path = f"{m.sf_dir}/events.parquet*"  # a glob, as the table is a file or a folder of files
    rows = run(m.spark, path, m.table("events").schema, lambda b: b.select("event_id", "event_type", "user_id", "ts"), ["event_id"], ["ts"], _folder(m, "ingest"))
    return rows.select("event_id", "event_type", "user_id")


# ---- sources, sinks, rules


@query(" SELECT e.event_id, e.value, p.p_name, s.s_name, n.n_name FROM events e JOIN part p ON e.user_id = p.p_partkey JOIN supplier s ON e.event_id % 10 = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE e.value IS NOT NULL AND e.event_type IS NOT NULL")
def src_activity_star(m: Model) -> DataFrame:
    from molquarry.sources.readers import activity_star

    activities = m.table("events").select("event_id", F.col("user_id").alias("molregno"), (F.col("event_id") % 10).alias("assay_id"), F.col("value").alias("standard_value"), F.col("event_type").alias("standard_type"))
    assays = m.table("supplier").select(F.col("s_suppkey").alias("assay_id"), F.col("s_nationkey").alias("tid"), "s_name")
    targets = m.table("nation").select(F.col("n_nationkey").alias("tid"), F.col("n_name").alias("target_id"))
    molecules = m.table("part").select(F.col("p_partkey").alias("molregno"), "p_name")
    structures = m.table("part").select(F.col("p_partkey").alias("molregno"), F.col("p_brand").alias("standard_inchi_key"))
    rows = activity_star(activities, assays, targets, molecules, structures)
    return rows.select("event_id", F.col("standard_value").alias("value"), "p_name", "s_name", F.col("target_id").alias("n_name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 10 > 1", model=False)
def src_jsonl(m: Model) -> DataFrame:
    from molquarry.sources.readers import parse_jsonl

    line = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "{bad").otherwise(F.col("props"))
    good, _ = parse_jsonl(m.table("events").select("event_id", line.alias("line")), "line", "k int")
    return good.select("event_id", "parsed.k")


@query("SELECT reaction_id, key, role FROM (" + _LINES + " SELECT reaction_id, key, role FROM line WHERE flag <> 'N' AND role IS NOT NULL) t", model=False)
def src_reactions(m: Model) -> DataFrame:
    from molquarry.sources.readers import read_reactions

    folder = _folder(m, "records")
    m.records.write.option("compression", "gzip").json(folder)  # each line repeats the names of its fields
    return ingest.mentions(read_reactions(m.spark, folder)).where("is_input and role is not null").select("reaction_id", "key", "role")


MAPPED = {"molecules": tables.MOLECULES, "reactions": tables.REACTIONS, "activities": tables.ACTIVITIES}


@query(" " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS n_values FROM {t}" for t, columns in MAPPED.items() for c in columns))
def src_tables_mapped(m: Model) -> DataFrame:
    """Every column of the mapped tables with its values and different values, by one pass a table."""
    parts = []
    for t, columns in MAPPED.items():
        made = getattr(m, t).agg(*(F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("n_values")).alias(c) for c in columns))
        parts.append(made.select(F.explode(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.n_values").alias("n_values")) for c in columns))).alias("x")).select("x.*"))
    return reduce(DataFrame.union, parts)


@query("SELECT name, count(*) AS n FROM (SELECT 'events' AS name FROM events UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'part' FROM part) GROUP BY 1", model=False)
def src_tables(m: Model) -> DataFrame:
    return results.table_counts({t: m.table(t) for t in ("events", "nation", "part")}).withColumnRenamed("table_name", "name")


@query("SELECT user_id AS inchikey, array_to_string(list_sort(list_distinct(list('H' || (200 + event_id % 90)))), ',') AS codes, CASE last(event_id % 2 ORDER BY event_id) WHEN 0 THEN 'Danger' ELSE 'Warning' END AS signal_word FROM events GROUP BY 1", model=False)
def src_hazard_tree(m: Model) -> DataFrame:
    from molquarry.sources.readers import hazards_from_tree

    said = lambda name, text: F.struct(F.lit(name).alias("Name"), F.struct(F.array(F.struct(text.alias("String"))).alias("StringWithMarkup")).alias("Value"))
    info = F.array(said("GHS Hazard Statements", F.concat(F.lit("H"), F.col("event_id") % 90 + 200, F.lit(": danger"))), said("Signal", F.when(F.col("event_id") % 2 == 0, "Danger").otherwise("Warning")), said("Signal", F.lit("Other")))
    rows = m.table("events").select("user_id", "event_id", info.alias("info")).groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "info"))), lambda x: x["info"])).alias("Information"))
    section = lambda heading, **f: F.array(F.struct(F.lit(heading).alias("TOCHeading"), *(v.alias(k) for k, v in f.items())))
    tree = F.struct(section("Safety", Section=section("Hazards", Section=section("GHS Classification", Information=F.col("Information")))).alias("Section"))
    found = hazards_from_tree(rows.select(F.col("user_id").alias("inchikey"), tree.alias("Record")))
    return found.select("inchikey", joined(F.col("ghs_codes")).alias("codes"), "signal_word")


@query("SELECT p_partkey AS pubchem_cid, 'K' || p_partkey AS inchikey, p_retailprice AS exact_mass FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0", model=False)
def src_property_table(m: Model) -> DataFrame:
    from molquarry.sources.readers import properties_from_table

    p = F.col("p_partkey")
    entry = F.struct(F.when(p % 5 != 0, F.concat(F.lit("K"), p)).alias("InChIKey"), F.when(p % 7 != 0, p).alias("CID"), F.col("p_name").alias("IUPACName"), F.col("p_retailprice").cast("string").alias("ExactMass"), F.lit(None).cast("double").alias("XLogP"), F.lit(None).cast("double").alias("Complexity"))
    payloads = m.table("part").groupBy((p % 100).alias("request")).agg(F.struct(F.collect_list(entry).alias("Properties")).alias("PropertyTable"))
    return properties_from_table(payloads).select("pubchem_cid", "inchikey", "exact_mass")


@query("SELECT 'CHEBI:' || p_partkey AS role_id, p_name AS name, 'is ' || p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN 'CHEBI:' || (p_partkey // 3) END AS parent_id FROM part WHERE p_partkey % 4 <> 1", model=False)
def src_obo(m: Model) -> DataFrame:
    from molquarry.sources.readers import obo_terms

    p = F.col("p_partkey")
    kind = F.when(p % 4 == 1, "OTHER:").otherwise("CHEBI:")
    stanza = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), kind, p), F.concat(F.lit("name: "), "p_name"), F.concat(F.lit('def: "is '), "p_type", F.lit('" []')), F.when(p % 3 == 0, F.concat(F.lit("is_a: OTHER:1\nis_a: CHEBI:"), (p / 3).cast("long"))))
    return obo_terms(m.table("part").select(stanza.alias("value"))).drop("inchi")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'a \"q\", ' || c_name END AS name FROM customer", model=False)
def sink_csv_json(m: Model) -> DataFrame:
    from molquarry.sources.readers import write_csv, write_json

    rows = m.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('a "q", '), "c_name")).alias("name"))
    csv, json = _folder(m, "csv"), _folder(m, "json")
    write_csv(rows, csv)
    write_json(rows, json)
    back = m.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(csv)
    return back.join(m.spark.read.schema(rows.schema).json(json).select("c_custkey"), "c_custkey", "left_semi")


RULES = [classify.Rule("plated", r"PLATED", r"\d$"), classify.Rule("brass", r"BRASS"), classify.Rule("small", r"SMALL", r"[5-9]$")]


@query(""", t AS (SELECT inchikey, iupac_name || CASE WHEN inchikey % 11 = 0 THEN '' ELSE '>>' || CASE WHEN inchikey % 2 = 0 THEN 'x' ELSE CAST(inchikey AS VARCHAR) END END AS s, CASE WHEN inchikey % 10 = 0 THEN 'known' END AS c FROM molecules)
SELECT inchikey, CASE WHEN c IS NOT NULL THEN c WHEN s NOT LIKE '%>>%' THEN 'unclassified' WHEN s LIKE '%PLATED%>>%' AND regexp_matches(s, '[0-9]$') THEN 'plated' WHEN s LIKE '%SMALL%>>%' AND regexp_matches(s, '[5-9]$') THEN 'small'
WHEN s LIKE '%PLATED%' THEN 'plated' WHEN s LIKE '%BRASS%' THEN 'brass' WHEN s LIKE '%SMALL%' THEN 'small' ELSE 'unclassified' END AS reaction_class FROM t""")
def classify_rules(m: Model) -> DataFrame:
    k = F.col("inchikey")
    text = F.concat("iupac_name", F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(">>"), F.when(k % 2 == 0, "x").otherwise(k.cast("string")))))
    rows = m.molecules.select("inchikey", text.alias("text"), F.when(k % 10 == 0, "known").alias("reaction_class"))
    return classify.classify_rules(rows, RULES, "text", "reaction_class").select("inchikey", "reaction_class")


@query(" SELECT reaction_class, count(*) AS n FROM reactions GROUP BY 1")
def classify_counts(m: Model) -> DataFrame:
    return classify.classify_counts(m.reactions, "reaction_class")


#: Kinds of things that a reaction's names speak of, in the order of the rules made from them.
KINDS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
#: What is used and what is made, both named, come first; a kind that is used alone is the second tier.
NAMED = [classify.Rule(f"{a}.to_{b}", rf"\b{a}\b", rf"\b{b}\b") for a in KINDS for b in KINDS if a != b] + [classify.Rule(f"{a}.used", rf"\b{a}\b") for a in KINDS]

_CLASSES = """, told AS (SELECT c.reaction_id, coalesce(string_agg(DISTINCT smiles, '.' ORDER BY smiles) FILTER (WHERE role = 'reactant'), '') AS l, coalesce(string_agg(DISTINCT smiles, '.' ORDER BY smiles) FILTER (WHERE role = 'product'), '') AS r
  FROM components c JOIN molecules m ON c.inchikey = m.inchikey GROUP BY 1),
classes AS (SELECT reaction_id, CASE """ + " ".join(f"WHEN regexp_matches(l, '{x.left}') AND regexp_matches(r, '{x.right}') THEN '{x.name}'" for x in NAMED if x.right) + " " + " ".join(f"WHEN regexp_matches(l, '{x.left}') THEN '{x.name}'" for x in NAMED) + " ELSE 'unclassified' END AS reaction_class FROM told)"


def _classified(m: Model) -> DataFrame:
    """Reactions as text, `names of reactants>>names of products`, with the class that the rules find."""
    names = lambda role: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("smiles")))), ".")
    rows = m.components.join(m.molecules.select("inchikey", "smiles"), "inchikey").groupBy("reaction_id").agg(F.concat(names("reactant"), F.lit(">>"), names("product")).alias("text"))
    return classify.classify_rules(rows.withColumn("reaction_class", F.lit(None).cast("string")), NAMED, "text", "reaction_class").select("reaction_id", "reaction_class")


@query(_CLASSES + " SELECT reaction_id, reaction_class FROM classes")
def classify_reactions(m: Model) -> DataFrame:
    return _classified(m)


@query(_CLASSES + " SELECT reaction_class, count(*) AS n FROM classes GROUP BY 1")
def classify_reaction_counts(m: Model) -> DataFrame:
    return classify.classify_counts(_classified(m), "reaction_class")


@query(None)
def fp_build_text(m: Model) -> DataFrame:
    """Fingerprints of the molecules' names: hashed 3-grams, 2048 bits."""
    rows = m.molecules.select(F.col("inchikey").alias("id"), similarity.fp_build(F.col("smiles")).alias("bits"))
    return rows.select("id", F.size("bits").cast("long").alias("n_bits"), joined(F.col("bits")).alias("bits"))


@query("SELECT 'CHEBI:' || p_partkey AS role_id, p_name AS name, 'is ' || p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN 'CHEBI:' || (p_partkey // 3) END AS parent_id, CASE WHEN p_partkey % 2 = 0 THEN 'InChI=1S/C' || p_partkey END AS inchi FROM part WHERE p_partkey % 4 <> 1", model=False)
def src_obo_file(m: Model) -> DataFrame:
    """Stanzas written to files and scanned."""
    from molquarry.sources.readers import read_obo

    p = F.col("p_partkey")
    kind = F.when(p % 4 == 1, "OTHER:").otherwise("CHEBI:")
    known = F.when(p % 2 == 0, F.concat(F.lit("xref: InChI=1S/C"), p))
    stanza = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), kind, p), F.concat(F.lit("name: "), "p_name"), F.concat(F.lit('def: "is '), "p_type", F.lit('" []')), F.when(p % 3 == 0, F.concat(F.lit("is_a: OTHER:1\nis_a: CHEBI:"), (p / 3).cast("long"))), known)
    folder = _folder(m, "obo")
    m.table("part").select(F.concat(stanza, F.lit("\n")).alias("value")).write.text(folder)
    return read_obo(m.spark, folder)


@query("SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 10 > 1", model=False)
def src_jsonl_file(m: Model) -> DataFrame:
    """JSON lines, some blank or malformed, written to files and scanned."""
    from molquarry.sources.readers import read_jsonl

    whole = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    line = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "{bad").otherwise(whole)
    folder = _folder(m, "jsonl")
    m.table("events").select(line.alias("value")).write.text(folder)
    return read_jsonl(m.spark, folder, "event_id long, kind string, k int")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'a \"q\", ' || c_name END AS name, c_custkey || ',' || c_nationkey AS keys FROM customer", model=False)
def sink_json(m: Model) -> DataFrame:
    """The rows that come back from JSON files."""
    from molquarry.sources.readers import write_json

    rows = m.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('a "q", '), "c_name")).alias("name"), F.array("c_custkey", F.col("c_nationkey").cast("long")).alias("keys"))
    folder = _folder(m, "json")
    write_json(rows, folder)
    back = m.spark.read.schema(rows.schema).json(folder)
    return back.select("c_custkey", "name", joined(F.col("keys")).alias("keys"))


@query("""SELECT inchikey, iupac_name, mol_weight, (SELECT count(*) FROM molecules WHERE iupac_name ILIKE '%ECO%') AS total FROM molecules WHERE iupac_name ILIKE '%ECO%'
ORDER BY mol_weight NULLS LAST, inchikey LIMIT 20 OFFSET 10""")
def browse_molecules_named(m: Model) -> DataFrame:
    rows = results.browse(m.molecules, "iupac_name", "eco").select("inchikey", "iupac_name", "mol_weight")
    return results.page(rows, [F.asc_nulls_last("mol_weight"), F.asc("inchikey")], 20, 10)


@query(_PAIRS + """, both_ways AS (SELECT a AS id, b AS other, similarity FROM similar_to UNION ALL SELECT b, a, similarity FROM similar_to)
SELECT id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM both_ways WHERE id % 2 = 0) WHERE r <= 20""")
def graph_neighbours_even(m: Model) -> DataFrame:
    return paths.neighbours(similarity.similar_edges(m.shingles, 85, 100), m.shingles.where("id % 2 = 0").select("id"), 20)


@query("SELECT 'completed' AS status, count(*) AS read, count(*) FILTER (WHERE event_id % 7 > 1) AS loaded, count(*) FILTER (WHERE event_id % 7 = 1) AS skipped, count(*) FILTER (WHERE event_id % 7 = 0) AS failed, least(1000, count(*) FILTER (WHERE event_id % 7 = 0)) AS logged FROM events", model=False)
def ingest_status(m: Model) -> DataFrame:
    """Status and counts of a load in which some rows are skipped and some fail."""
    from molquarry.streaming.microbatch import ingest_microbatch as run
    from molquarry.streaming.microbatch import load_status

    k = F.col("event_id") % 7
    status = F.when(k == 0, "failed").when(k == 1, "skipped").otherwise("loaded")
    folder = _folder(m, "ingest")
    run(m.spark, f"{m.sf_dir}/events.parquet*", m.table("events").schema, lambda b: b.select("event_id", "event_type", "ts", status.alias("status"), F.when(k == 0, F.concat(F.lit("bad "), "event_id")).alias("error")), ["event_id"], ["ts"], folder)
    return load_status(m.spark, folder).select("status", "read", "loaded", "skipped", "failed", F.size("errors").cast("long").alias("logged"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_best_solvents"](spark, sf_dir)
