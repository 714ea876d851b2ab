"""Paths of reactions. A hop is (src, reaction_id, dst): a molecule that is a reactant of a reaction which makes another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from molquarry.operators import reach
from molquarry.sources.scratch import discard, written


def hops(components: DataFrame) -> DataFrame:
    """Distinct hops; a molecule that a reaction both uses and makes is a hop to itself."""
    used = components.where("role = 'reactant'").select("reaction_id", F.col("inchikey").alias("src"))
    made = components.where("role = 'product'").select("reaction_id", F.col("inchikey").alias("dst"))
    return used.join(made, "reaction_id").select("src", "reaction_id", "dst").distinct()


def cumulative_yield(yields: Column) -> Column:
    """Product of step yields in percent, two digits; null unless all are positive."""
    product = F.aggregate(yields, F.lit(100.0), lambda a, y: a * y / 100)
    return F.when(F.forall(yields, lambda y: F.coalesce(y > 0, F.lit(False))), F.round(product, 2))


def _open(targets: DataFrame) -> DataFrame:
    """Routes of no step: (target, at, molecules, reaction_ids)."""
    return targets.select(F.col("inchikey").alias("target"), F.col("inchikey").alias("at"), F.array("inchikey").alias("molecules"), F.array().cast("array<bigint>").alias("reaction_ids"))


def _extended(routes: DataFrame, hop_table: DataFrame, simple: bool) -> DataFrame:
    """The routes with one more hop before their first molecule."""
    h = hop_table.select(F.col("dst").alias("at"), "src", F.col("reaction_id").alias("r"))
    both = F.arrays_zip(F.slice("molecules", 1, F.size("reaction_ids")).alias("m"), F.col("reaction_ids").alias("r"))
    after = F.arrays_zip(F.slice("molecules", 2, F.size("reaction_ids")).alias("m"), F.col("reaction_ids").alias("r"))
    again = F.exists(both, lambda x: (x["m"] == F.col("src")) & (x["r"] == F.col("r"))) | F.exists(after, lambda x: (x["m"] == F.col("at")) & (x["r"] == F.col("r")))
    if simple:
        again = F.array_contains("molecules", F.col("src"))
    return routes.join(h, "at").where(~again).select("target", F.col("src").alias("at"), F.concat(F.array("src"), "molecules").alias("molecules"), F.concat(F.array("r"), "reaction_ids").alias("reaction_ids"))


def _told(routes: DataFrame, reactions: DataFrame) -> DataFrame:
    """Routes (target, steps, molecules, reaction_ids) with their start and what is known of their reactions."""
    each = routes.select("target", "steps", "molecules", "reaction_ids", F.posexplode("reaction_ids").alias("i", "reaction_id")).join(reactions.select("reaction_id", "reaction_class", "yield_pct"), "reaction_id", "left")
    rows = each.groupBy("target", "steps", "molecules", "reaction_ids").agg(F.array_sort(F.collect_list(F.struct("i", "reaction_class", "yield_pct"))).alias("s"))
    yields = F.transform("s", lambda x: x["yield_pct"].cast("double"))
    return rows.select("target", F.element_at("molecules", 1).alias("start"), "steps", "molecules", "reaction_ids", F.transform("s", lambda x: x["reaction_class"]).alias("classes"), yields.alias("yields"), cumulative_yield(yields).alias("total_yield"))


def _starts(molecules: DataFrame) -> DataFrame:
    return molecules.where("commercially_available").select(F.col("inchikey").alias("at"))


def route_depth(hop_table: DataFrame, molecules: DataFrame, reactions: DataFrame, targets: DataFrame, steps: int, simple: bool = False) -> DataFrame:
    """(target, start, steps, molecules, reaction_ids, classes, yields, total_yield): all routes of `steps` hops from an
    available molecule to a target (inchikey). Expanded backwards from the targets; a molecule may occur again, the same
    edge of it and a reaction may not (with `simple`, no molecule twice)."""
    routes = _open(targets)
    for _ in range(steps):
        routes = _extended(routes, hop_table, simple)
    return _told(routes.join(_starts(molecules), "at", "left_semi").withColumn("steps", F.lit(steps)), reactions)


def _layers(hop_table: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(m, left): the molecules from which a target is at most `steps` hops away, with the least number of hops."""
    pairs = hop_table.select("src", "dst").distinct()
    near = written(targets.select(F.col("inchikey").alias("m"), F.lit(0).alias("left")), "layers")
    for left in range(1, steps + 1):
        before = pairs.join(near.where(F.col("left") == left - 1), F.col("dst") == F.col("m"), "left_semi").select(F.col("src").alias("m"), F.lit(left).alias("left"))
        more = written(near.unionByName(before).groupBy("m").agg(F.min("left").alias("left")), "layers")
        discard(near)
        near = more
    return near


def _first_routes(rows: DataFrame, width: int) -> DataFrame:
    """The first `width` routes that end at each molecule, in order, of rows (at, start, reaction_ids, molecules, open). An open row stands for
    unknown routes at its place or later: it ends the list, as does the first route beyond `width`, which is kept as an open one."""
    order = Window.partitionBy("at").orderBy("start", "reaction_ids", "molecules")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width + 1)
    rows = rows.withColumn("open", F.col("open") | (F.col("rank") > width))
    before = Window.partitionBy("at").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ended", F.coalesce(F.max("open").over(before), F.lit(False))).where("not ended").drop("ended")


def _lengthened(routes: DataFrame, hop_table: DataFrame, simple: bool) -> DataFrame:
    """The routes (at, start, reaction_ids, molecules, open) with one more hop after their last molecule."""
    h = hop_table.select(F.col("src").alias("at"), F.col("reaction_id").alias("r"), "dst")
    n = F.size("reaction_ids")
    used = F.arrays_zip(F.slice("molecules", F.lit(1), n).alias("m"), F.col("reaction_ids").alias("r"))
    made = F.arrays_zip(F.slice("molecules", F.lit(2), n).alias("m"), F.col("reaction_ids").alias("r"))
    again = F.exists(used, lambda x: (x["m"] == F.col("at")) & (x["r"] == F.col("r"))) | F.exists(made, lambda x: (x["m"] == F.col("dst")) & (x["r"] == F.col("r")))
    if simple:
        again = F.array_contains("molecules", F.col("dst"))
    longer = routes.join(h, "at").where(F.col("open") | ~again)
    return longer.select(F.col("dst").alias("at"), "start", F.concat("reaction_ids", F.array("r")).alias("reaction_ids"), F.concat("molecules", F.array("dst")).alias("molecules"), "open")


def route_search(hop_table: DataFrame, molecules: DataFrame, reactions: DataFrame, targets: DataFrame, max_depth: int = 8, max_routes: int = 10, simple: bool = False) -> DataFrame:
    """The first max_routes routes of each target by length, start, reactions and molecules; max_depth counts hops of nodes, two a step (the
    columns of route_depth()).

    Routes grow forwards from the available molecules, one step at a time, and every molecule keeps the first few routes
    that end there: for a given last hop, routes are in the order of what comes before it, so the first ones of a
    molecule are among those of the molecules before it. What is cut off is not forgotten: the first route left out stays
    as an open end, whose continuations mark from where on a list may be incomplete (a kept route may repeat an edge and go,
    and one that was left out would follow). A target takes routes from before such a mark only; the targets that a mark
    leaves in doubt are searched again with longer lists. So results are exact, and a step's rows are bounded by the hops
    times the lists' length, not by the number of routes. Molecules from which no unfinished target can be reached in the
    steps left are dropped. The search deepens, two steps, four and so on, for the targets that lack routes, so that what is
    far from a target is not looked at where near routes are enough. Null targets are left out, repeated ones count once;
    targets without a route have no rows."""
    made: list[DataFrame] = []
    found: list[DataFrame] = []
    deepest, horizon = max_depth // 2, 2
    hop_table, starts = written(hop_table.distinct(), "hops"), written(_starts(molecules).distinct(), "starts")
    open_, width = written(targets.select("inchikey").where("inchikey is not null").distinct(), "targets"), 2 * max_routes
    while True:
        new, doubt = _searched(hop_table, starts, open_, min(horizon, deepest), max_routes, width, simple)
        made.append(open_)
        if horizon < deepest:  # targets with too few routes are searched deeper
            full = written(new.groupBy("target").count().where(F.col("count") >= max_routes).select(F.col("target").alias("inchikey")), "full")
            kept = written(new.join(full, new["target"] == full["inchikey"], "left_semi"), "found-routes")
            made += [new, doubt, full]
            new, doubt, horizon = kept, written(open_.join(full, "inchikey", "left_anti"), "targets"), 2 * horizon
        else:
            width = 4 * width
        found.append(new)
        if doubt.isEmpty():
            break
        open_ = doubt
    result = written(_told(reduce(DataFrame.unionByName, found), reactions), "routes-told")
    discard(hop_table, starts, *made, *found, doubt)
    return result


def _searched(hop_table: DataFrame, starts: DataFrame, targets: DataFrame, steps: int, max_routes: int, width: int, simple: bool) -> tuple[DataFrame, DataFrame]:
    """(routes (target, steps, molecules, reaction_ids) of the targets that lists of `width` decide, the other targets)."""
    empty = F.array().cast(f"array<{dict(hop_table.dtypes)['reaction_id']}>")
    lists = starts.select("at", F.col("at").alias("start"), empty.alias("reaction_ids"), F.array("at").alias("molecules"), F.lit(False).alias("open"))
    wanted = written(targets.select(F.col("inchikey").alias("target"), F.lit(max_routes).alias("need")), "wanted")  # targets with the routes that they lack
    layers, asked = _layers(hop_table, targets, steps), wanted.count()
    found, doubt, held, before = [], [], [], None
    for step in range(1, steps + 1):
        ends = layers.where(F.col("left") <= steps - step).select(F.col("m").alias("at"))
        lists = written(_first_routes(_lengthened(lists, hop_table, simple).join(ends, "at", "left_semi"), width), "routes")
        if before is not None:
            discard(before)
        before = lists
        hits = lists.join(wanted, lists["at"] == wanted["target"]).select("target", "need", "rank", "open", "molecules", "reaction_ids").where("rank <= need or open")
        hits = written(hits, "hits")
        held.append(hits)
        unsure = hits.groupBy("target").agg(F.max("open").alias("open"), F.count_if(~F.col("open")).alias("n"), F.max("need").alias("need")).where("open and n < need").select("target")
        new = hits.where("not open and rank <= need").join(unsure, "target", "left_anti").select("target", F.lit(step).alias("steps"), "molecules", "reaction_ids")
        found.append(new)
        doubt.append(unsure)
        had = hits.where("not open and rank <= need").groupBy("target").agg(F.count("*").alias("had"))
        rest = wanted.join(unsure, "target", "left_anti").join(had, "target", "left").select("target", (F.col("need") - F.coalesce("had", F.lit(0))).cast("int").alias("need"))
        sizes = Observation()
        rest = written(rest.where("need > 0").observe(sizes, F.count(F.lit(1)).alias("n")), "wanted")
        discard(wanted)
        wanted, left = rest, sizes.get["n"]
        if not left:
            break
        lists = lists.select("at", "start", "reaction_ids", "molecules", "open")
        if 2 * left <= asked and step < steps:  # many are finished: less has to be kept for the others
            discard(layers)
            layers, asked = _layers(hop_table, wanted.select(F.col("target").alias("inchikey")), steps - step), left
    again = written(reduce(DataFrame.unionByName, doubt).select(F.col("target").alias("inchikey")), "doubt")
    routes = reduce(DataFrame.unionByName, found)
    routes = written(routes.join(again, routes["target"] == again["inchikey"], "left_anti"), "found-routes")  # what they had is found again
    discard(layers, wanted, *held, *([before] if before is not None else []))
    return routes, again


def one_step(components: DataFrame, reactions: DataFrame) -> DataFrame:
    """(src, dst, y): for each pair of different molecules one reaction apart the best yield, null where none is known."""
    pairs = hops(components).where("src <> dst").join(reactions.select("reaction_id", "yield_pct"), "reaction_id", "left")
    return pairs.groupBy("src", "dst").agg(F.max("yield_pct").cast("double").alias("y"))


def precursor_edges(components: DataFrame, reactions: DataFrame, min_depth: int = 2, max_depth: int = 3, shortest_only: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(src, dst, step_count, total_yield): pairs joined by a path of 2 to 4 distinct molecules' steps (max_depth 4 at most), one row a depth, with
    the best product of the steps' best yields (null if no path has all yields). With `targets` (inchikey), their precursors alone: paths
    grow backwards from them.

    No table of all paths: of the paths between two molecules only a representative family is kept, such that whatever
    molecules come next, the best path without them is in it. Two steps keep the best middle molecules, one more than may be
    forbidden; three steps keep the best path, the best one without its first and the best one without its second molecule.
    Three and four steps go by blocks of starts, see reach.reached(): paths are not shuffled, and the rows of the result are
    made as they are read. Null molecules are in no hop; yields are 0 or more."""
    hop = written(one_step(components, reactions), "one-step")
    near, far = ("src", "dst") if targets is None else ("dst", "src")
    if max_depth == 2:
        one = hop.select(F.col(near).alias("v0"), F.col(far).alias("v1"), "y")
        if targets is not None:
            one = one.join(targets.select(F.col("inchikey").alias("v0")).distinct(), "v0", "left_semi")
        step = hop.select(F.col(near).alias("v1"), F.col(far).alias("v2"), F.col("y").alias("z"))
        two = one.join(step, "v1").where("v0 <> v2").select("v0", "v2", (F.col("y") * F.col("z") / 100).alias("y"))
        found = two.groupBy("v0", "v2").agg(F.round(F.max("y"), 2).alias("total_yield")).select(F.col("v0").alias(near), F.col("v2").alias(far), F.lit(2).alias("step_count"), "total_yield")
    else:
        begin = (hop.select(F.col(near).alias("at")) if targets is None else targets.select(F.col("inchikey").alias("at"))).distinct()
        names, first = _numbers(hop), begin.withColumn("start", F.lit(True))
        hops_ = hop.select(F.col(near).alias("near"), F.col(far).alias("far"), "y")
        hops_ = hops_.withColumn("start", F.lit(True)) if targets is None else hops_.join(first, hops_["near"] == first["at"], "left").select("near", "far", "y", F.coalesce("start", F.lit(False)).alias("start"))
        for c in ("near", "far") if names is not None else ():
            hops_ = hops_.join(names.select(F.col("name").alias(c), F.col("number").alias("k")), c).drop(c).withColumnRenamed("k", c)
        flat = written(hops_.select(F.col("near").cast("bigint"), F.col("far").cast("bigint"), "y", "start"), "hops")
        found = reach.reached(flat, max_depth, min_depth)
        discard(flat)
        kind = hop.schema["src"].dataType
        for c, to in (("near", near), ("far", far)):
            if names is None:
                found = found.withColumn(c, F.col(c).cast(kind)).withColumnRenamed(c, to)
            else:
                found = found.join(names.select(F.col("number").alias(c), F.col("name").alias(to)), c).drop(c)
        discard(hop)
    found = found.select("src", "dst", "step_count", "total_yield")
    if shortest_only:
        found = found.groupBy("src", "dst").agg(F.min_by(F.struct("step_count", "total_yield"), "step_count").alias("x")).select("src", "dst", "x.*")
    return found


def _numbers(hop: DataFrame) -> DataFrame | None:
    """(name, number) of the molecules of hops (src, dst), unless they are whole numbers that reach.reached() takes as they are."""
    if isinstance(hop.schema["src"].dataType, IntegralType):
        least = hop.agg(F.min(F.least("src", "dst")).alias("a"), F.max(F.greatest("src", "dst")).alias("b")).first()
        if least["a"] is None or (least["a"] >= 0 and least["b"] < reach.MOST):
            return None
    # numbers of a partition follow each other, and partitions are 2^33 apart: 128 of them stay below MOST
    named = hop.select(F.col("src").alias("name")).union(hop.select("dst")).distinct()
    return written(named.coalesce(128).select("name", F.monotonically_increasing_id().alias("number")), "molecules-numbered")


def neighbours(similar: DataFrame, keys: DataFrame, limit: int = 20) -> DataFrame:
    """(id, other, similarity): the most similar partners of each key (id), from edges (a, b, similarity) read both ways."""
    both = similar.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").union(similar.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return both.join(keys, "id", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def route_elements(routes: DataFrame) -> DataFrame:
    """(kind, id, type, src, dst): the distinct nodes of routes, and the distinct links of their consecutive nodes."""
    name = lambda kind: lambda x: F.concat(F.lit(kind), x.cast("string"))
    mols, rxns = F.transform("molecules", name("m")), F.transform("reaction_ids", name("r"))
    chain = F.flatten(F.zip_with(mols, rxns, lambda m, r: F.filter(F.array(m, r), lambda x: x.isNotNull())))
    rows = routes.select(chain.alias("n"))
    nodes = rows.select(F.explode("n").alias("id")).distinct()
    nodes = nodes.select(F.lit("node").alias("kind"), "id", F.when(F.col("id").startswith("m"), "molecule").otherwise("reaction").alias("type"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    links = rows.select(F.explode(F.zip_with(F.slice("n", F.lit(1), F.size("n") - 1), F.slice("n", F.lit(2), F.size("n") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("e")).select("e.*").distinct()
    return nodes.union(links.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), F.lit("link").alias("type"), "src", "dst"))
