import pytest
from pyspark.sql import functions as F

from molquarry.operators import quality, results, upsert
from molquarry.sources.scratch import discard, settled, written
from molquarry.streaming.microbatch import ingest_microbatch, load_progress, load_status

T = "k long, a string, sources array<string>, stamp int"


def target(spark):
    return spark.createDataFrame([(1, "x", ["s"], 1), (2, None, None, 1), (None, "n", ["s"], 1)], T)


def batch(spark):
    rows = [(1, "new", ["t"], 2, 1), (2, None, ["t"], 2, 2), (2, "late", ["u"], 2, 3), (3, "c", ["t"], 2, 4), (3, "d", ["u"], 2, 5), (None, "m", ["t"], 2, 6)]
    return spark.createDataFrame(rows, T + ", pos int")


def told(df):
    return sorted((tuple(r[c] for c in ("k", "a", "sources", "stamp")) for r in df.collect()), key=str)


def both(f, df, *args):
    """The result, which a second application leaves as it is."""
    once = f(df, *args)
    assert told(f(once, *args)) == told(once)
    return {r[0]: r[1:] for r in told(once)}


def test_upserts(spark):
    t, b = target(spark), batch(spark)
    got = both(upsert.insert_absent, t, b, ["k"], ["pos"])
    assert got == {1: ("x", ["s"], 1), 2: (None, None, 1), None: ("n", ["s"], 1), 3: ("c", ["t"], 2)}
    got = both(upsert.upsert_overwrite, t, b, ["k"], ["a", "stamp"], ["pos"])
    assert got == {1: ("new", ["s"], 2), 2: ("late", None, 2), None: ("m", ["s"], 2), 3: ("d", ["u"], 2)}
    got = both(upsert.enrich_coalesce, t, b.where("pos <> 3"), "k", ["a"], ["stamp"], ["pos"])
    assert got == {1: ("new", ["s"], 2), 2: (None, None, 2), None: ("m", ["s"], 2)}
    got = both(upsert.fill_if_null, t, b, "k", "a", ["pos"])
    assert got[2][0] is None and got[1][0] == "x"
    got = both(upsert.upsert_union_sources, t, b.where("k is not null"), "k", "sources", "stamp", ["pos"])
    assert got == {1: ("x", ["s", "t"], 2), 2: (None, ["t", "u"], 2), None: ("n", ["s"], 1), 3: ("c", ["t", "u"], 2)}
    assert told(upsert.insert_absent(t, b.limit(0), ["k"], ["pos"])) == told(t)


def test_null_keys_do_not_repeat(spark):
    cols = "reaction_id string, kind string, phase string, value double"
    rows = spark.createDataFrame([("r", "temperature", None, 5.0)], cols)
    assert upsert.insert_absent(rows, rows, ["reaction_id", "kind", "phase"], ["value"]).count() == 1


@pytest.mark.parametrize("size", [1, 3, 100])
def test_batches(spark, size):
    ids = [7, 1, 1, 5000, 12, 13, None, 999_999, -4]
    got = {r["batch"]: r["keys"] for r in upsert.batch_keys(spark.createDataFrame([(i,) for i in ids], "k long"), "k", size).collect()}
    want = sorted({i for i in ids if i is not None})
    assert [k for b in sorted(got) for k in got[b]] == want and all(len(v) <= size for v in got.values())
    assert upsert.batch_keys(spark.createDataFrame([], "k long"), "k", size).collect() == []


def test_parents_pending_and_backfill(spark):
    terms = spark.createDataFrame([("a", "b"), ("b", "z"), ("c", None)], "id string, parent string")
    assert {r["id"]: r["parent"] for r in upsert.link_parent(terms, "id", "parent").collect()} == {"a": "b", "b": None, "c": None}
    assert [r["id"] for r in upsert.pending_anti(terms, terms.where("id <> 'c'"), "id").collect()] == ["c"]
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    value = F.when(F.col("k") == 1, "made")
    assert [r["v"] for r in upsert.backfill_derived(df, "v", value).orderBy("k").collect()] == ["made", "x", None]
    assert tuple(upsert.backfill_counts(df, "v", value).first()) == (1, 1)


def test_load_stats(spark):
    rows = spark.createDataFrame([("a", "loaded"), ("b", "skipped"), ("c", "failed"), ("d", "loaded"), ("e", "failed")], "item_id string, status string")
    assert tuple(quality.load_stats(rows).first()) == (2, 1, 2)
    assert [r["item_id"] for r in quality.load_errors(rows, 1).collect()] == ["c"]


def test_citations_and_statistics(spark):
    rows = [(0, "a", ["b", "c"], 80.0), (1, None, None, 90.0), (2, "b", ["d", None], 70.0), (3, "a", [], None)]
    df = spark.createDataFrame(rows, "i int, reaction_id string, sample_reaction_ids array<string>, yield_pct double")
    got = results.citations(df, "i").orderBy("place").collect()
    assert [r["id"] for r in got] == ["a", "b", "c", "d"] and {r["total"] for r in got} == {4}
    assert [r["id"] for r in results.citations(df, "i", cap=2).orderBy("place").collect()] == ["a", "b"]
    stats = results.result_stats(df, ["yield_pct", "absent"]).collect()
    assert [tuple(r) for r in stats] == [("yield_pct", 4, 3, 80.0, 70.0, 90.0)]
    assert tuple(results.result_stats(df.limit(0), ["yield_pct"]).first())[1:3] == (0, 0)
    many = spark.range(200).select(F.col("id").cast("string").alias("reaction_id"), F.col("id").alias("i"))
    assert results.citations(many, "i").agg(F.count("*"), F.max("total")).first()[:] == (50, 200) and results.result_cap(many, [F.asc("i")]).count() == 100


def test_microbatches_resume(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"f{i}"), (0, "again")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest_microbatch(spark, str(tmp_path / "in"), "k long, v string", lambda b: b, ["k"], ["v"], str(tmp_path / "out"))
    assert sorted(r["k"] for r in run().collect()) == [0, 1, 2]
    spark.createDataFrame([(9, "new")], "k long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in run().collect()) == [0, 1, 2, 9]
    assert sorted(r["k"] for r in run().collect()) == [0, 1, 2, 9]


def test_batches_read_no_earlier_rows(spark, tmp_path):
    """Later batches work with the earlier rows out of reach; a replay of the last batch, at any point, changes nothing."""
    out = tmp_path / "out"
    send = lambda *rows: spark.createDataFrame(rows, "k long, j string, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest_microbatch(spark, str(tmp_path / "in"), "k long, j string, v string", lambda b: b, ["k", "j"], ["v"], str(out))
    told = lambda: sorted(map(str, run().collect()))
    send((1, "a", "y"), (1, "a", "x"), (1, None, "z"), (None, None, "n"))
    first = told()
    assert first == sorted(map(str, spark.createDataFrame([(1, "a", "x"), (1, None, "z"), (None, None, "n")], "k long, j string, v string").collect()))
    last = sorted((out / "checkpoint" / "commits").glob("[0-9]*"))[-1]
    last.unlink()  # the batch had written all but its own end
    (out / "checkpoint" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert told() == first
    files = list((out / "rows").glob("part-*"))
    for f in files:
        f.rename(f.with_suffix(".away"))
    send((1, "a", "w"), (2, "a", "new"), (None, None, "m"))
    run()
    fresh = [f for f in (out / "rows").glob("part-*") if f.suffix != ".away"]
    assert [tuple(r) for r in spark.read.parquet(*map(str, fresh)).collect()] == [(2, "a", "new")]
    for f in files:
        f.with_suffix(".away").rename(f)
    assert len(told()) == 4 and len(list((out / "staged").iterdir())) == 1


def test_status_of_a_load(spark, tmp_path):
    rows = [(1, "ok", None), (2, "skipped", None), (3, "failed", "bad value"), (3, "ok", None), (None, "ok", None)]
    for i in range(2):
        spark.createDataFrame([(k, s, e) for k, s, e in rows], "k long, s string, e string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    status = F.when(F.col("s") == "ok", "loaded").otherwise(F.col("s"))
    run = lambda: ingest_microbatch(spark, str(tmp_path / "in"), "k long, s string, e string", lambda b: b.select("k", "s", status.alias("status"), F.col("e").alias("error")), ["k"], ["s"], str(tmp_path / "out"))
    assert sorted((r["k"] or 0) for r in run().collect()) == [0, 1, 3]
    got = load_status(spark, str(tmp_path / "out")).first()
    assert (got["status"], got["read"], got["loaded"], got["skipped"], got["failed"]) == ("completed", 10, 6, 2, 2)
    assert [tuple(e) for e in got["errors"]] == [('{"k":3}', "bad value")] * 2
    progress = load_progress(spark, str(tmp_path / "out")).orderBy("batch_id").collect()
    assert [(r["loaded"], r["loaded_so_far"], r["failed_so_far"]) for r in progress] == [(3, 3, 1), (3, 6, 2)]


def test_failed_load(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no such thing|STREAM"):
        ingest_microbatch(spark, str(tmp_path / "in"), "k long", lambda b: (_ for _ in ()).throw(ValueError("no such thing")), ["k"], ["k"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "status")).first()["status"] == "failed"


def test_settled_keeps_its_result_alone(spark):
    made = []

    def make():
        made.append(written(spark.range(5), "inner"))
        return made[0].where("id > 1")

    table = settled(make, "outer")
    assert sorted(r["id"] for r in table.collect()) == [2, 3, 4]
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0]._written_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    discard(table)


def test_all_citations_are_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("i"), F.concat(F.lit("r"), F.col("id") % 300).alias("reaction_id"))
    first = {}
    for i, r in sorted((x["i"], x["reaction_id"]) for x in df.collect()):
        first.setdefault(r, i)
    want = [r for r, _ in sorted(first.items(), key=lambda x: x[1])]
    got = results.citations(df, "i", cap=None).orderBy("place").collect()
    assert [r["id"] for r in got] == want and [r["place"] for r in got] == list(range(1, 301)) and {r["total"] for r in got} == {300}


def test_small_batches_leave_the_target_in_place(spark, monkeypatch):
    """The same rows with the batch sent to all tasks and with a join that shuffles; only the second moves the target."""
    t, b = target(spark), batch(spark)
    calls = [
        lambda: upsert.upsert_overwrite(t, b, ["k"], ["a", "stamp"], ["pos"]), lambda: upsert.enrich_coalesce(t, b, "k", ["a"], ["stamp"], ["pos"]),
        lambda: upsert.fill_if_null(t, b, "k", "a", ["pos"]), lambda: upsert.upsert_union_sources(t, b.where("k is not null"), "k", "sources", "stamp", ["pos"]),
    ]
    sent = [told(f()) for f in calls]
    plan = upsert.enrich_coalesce(t, b, "k", ["a"], ["stamp"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(upsert, "SENT", 0)
    assert [told(f()) for f in calls] == sent
    monkeypatch.undo()
    twice = t.unionByName(t)  # repeated keys in the target are changed each; nothing is added for them
    assert told(upsert.upsert_overwrite(twice, b, ["k"], ["a", "stamp"], ["pos"]))[0:1] == told(upsert.upsert_overwrite(t, b, ["k"], ["a", "stamp"], ["pos"]))[0:1]
    assert upsert.upsert_overwrite(twice, b, ["k"], ["a"], ["pos"]).count() == 7
    assert told(upsert.upsert_overwrite(t.limit(0), b, ["k"], ["a"], ["pos"])) == told(upsert.one_per_key(b, ["k"], ["pos"], last=True))


def test_pages_of_a_listing(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y double").selectExpr("*", "'x' as _note").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    listing = results.Listing(df, [F.desc_nulls_last("y"), F.asc("id")])
    seen, at = [], 0
    while True:  # each page starts after the last row of the one before
        page = sorted(listing.page(30, at).collect(), key=lambda r: r["place"])
        if not page:
            break
        assert {r["total"] for r in page} == {200} and [r["place"] for r in page] == list(range(at + 1, at + len(page) + 1))
        seen += [(r["id"], r["y"]) for r in page]
        at = page[-1]["place"]
    assert seen == want and listing.page(5, 0).columns == ["id", "y", "_note", "place", "total"]
    assert results.Listing(df.limit(0), [F.asc("id")]).page(10).collect() == []
    deep = listing.page(5, 190)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in deep.replace("SortOrder", "") or "Window" in deep  # only the ranges of the page are ordered


def test_ids_of_a_report(spark):
    rows = [(k, i) for k in ("a", "b") for i in range(0, 50, 1 if k == "a" else 9)] * 2 + [("a", None), (None, 3)]
    got = {(r["k"], r["place"]): r["id"] for r in results.ids_of(spark.createDataFrame(rows, "k string, id long"), "k", "id").collect()}
    assert got == {**{("a", i + 1): i for i in range(50)}, **{("b", n + 1): i for n, i in enumerate(range(0, 50, 9))}}
    assert results.ids_of(spark.createDataFrame([], "k string, id long"), "k", "id").collect() == []


def test_record_of_a_load(spark, tmp_path):
    rows = [(i, ("loaded", "skipped", "failed")[i % 3], f"e{i}" if i % 3 == 2 else None) for i in range(3600)] + [(9999, None, None)]
    df = spark.createDataFrame(rows, "item_id long, status string, error string")
    got = quality.recorded_load(df, str(tmp_path / "a"), "src", "2", {"limit": 10, "none": None}).first()
    assert (got["status"], got["source_name"], got["loader_version"], got["config"]) == ("completed", "src", "2", {"limit": "10"})
    assert (got["read"], got["loaded"], got["skipped"], got["failed"]) == (3601, 1200, 1200, 1200)
    failed = sorted((str(i), e) for i, s, e in rows if s == "failed")
    assert [tuple(x) for x in got["errors"]] == failed[:1000]
    assert spark.read.parquet(str(tmp_path / "a" / "rows")).count() == 3601
    empty = quality.recorded_load(df.limit(0), str(tmp_path / "b"), "src").first()
    assert (empty["read"], empty["errors"], empty["config"]) == (0, [], {})
    with pytest.raises(Exception, match="too bad"):
        quality.recorded_load(df.withColumn("error", F.raise_error(F.lit("too bad"))), str(tmp_path / "c"), "src")
    bad = spark.read.parquet(str(tmp_path / "c" / "record")).first()
    assert bad["status"] == "failed" and "too bad" in bad["errors"][0]["error"]


def test_settings_and_log_of_a_stream(spark, tmp_path):
    spark.range(1200).select(F.col("id").alias("k"), F.lit("x").alias("v")).coalesce(1).write.parquet(str(tmp_path / "in"))
    failing = lambda b: b.select("k", "v", F.lit("failed").alias("status"), F.lit("no").alias("error"))
    ingest_microbatch(spark, str(tmp_path / "in"), "k long, v string", failing, ["k"], ["v"], str(tmp_path / "out"), config={"limit": 3})
    got = load_status(spark, str(tmp_path / "out")).first()
    assert got["config"] == {"limit": "3"} and got["failed"] == 1200 and len(got["errors"]) == 1000
