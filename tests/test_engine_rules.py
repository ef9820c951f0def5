"""Rules of the engine at their edges: what is not evaluated, how deep closures go, what is refused, how draws are spread."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import patterns
from eventloom.operators import catalog, graph, lookup, overlay, paths, ranges
from eventloom.plans import workflow
from eventloom.streaming import boundaries


def test_modules_behind_a_failing_one_are_not_run(spark):
    df = spark.createDataFrame([(1, False), (2, True)], "event long, ok boolean")
    thrower = paths.Entry("thrower", F.lit(True), error=F.when(~F.col("ok"), "Unlisted"))
    got = paths.run_paths(df, {"p": [paths.Entry("first", F.col("ok")), thrower]}, {}).orderBy("event").collect()
    assert [(r.st_p, r.ix_p, r.out_p) for r in got] == [("Fail", 1, ["fail"]), ("Pass", 2, ["pass", "pass"])]
    with pytest.raises(Exception, match="thrower"):
        paths.run_paths(df, {"p": [thrower]}, {}).collect()


def test_selection_over_processes(spark):
    df = spark.createDataFrame([(1, "Pass", "Fail"), (2, "Fail", "Pass"), (3, "Fail", "Exception"), (4, "Fail", "Fail")], "event long, st_A_x string, st_B_y string")
    ids = lambda **k: sorted(r.event for r in df.where(paths.wanted_by_process({"A": ["x"], "B": ["y"]}, "B", **k)).collect())
    assert ids() == [1, 2, 3, 4] and ids(select=["A:x", "y"]) == [1, 2] and ids(select=["A:!x", "exception@y"]) == [2, 3, 4]
    assert ids(select=["A:!x"], reject=["B:exception@*"]) == [2, 4] and ids(select=["7:y"]) == [2]
    with pytest.raises(ValueError, match="unknown processes"):
        paths.wanted_by_process({"A": ["x"]}, "A", ["C:x"])


def test_closure_of_a_long_chain_and_a_cycle(spark):
    n = 300
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)], "child long, parent long")
    got = graph.ancestors(chain)
    assert got.count() == n * (n + 1) // 2 and got.where("ancestor <= child").count() == 0
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "child long, parent long")
    assert graph.ancestors(cycle).count() == 9
    assert graph.ancestors(chain.where("child < 0")).count() == 0


def test_file_name_conversions():
    stats = {"label": "out", "lowest_run": 7, "input_file": "/a/in12.dat"}
    assert patterns.substituted("%l_%04r_%R_%ife_%3#", stats) == "out_0007_-_.dat_%3#"
    assert patterns.substituted("%ifs%n(\\d)%N$1%%.x", stats) == "/a/iN12.dat.x"
    for bad in ("o_%q_3", "%5l", "%tz", "%ifx", "%", "%ifs%a%b", "%ifs%a%b%z%"):
        with pytest.raises(ValueError):
            patterns.substituted(bad, stats)


def test_stream_closes_what_is_open_at_the_end(spark, tmp_path):
    rng = random.Random(5)
    rows, seq = [], 0
    for run in (1, 2):
        for sub in (1, 2, 1, 3):
            for _ in range(rng.randint(1, 4)):
                seq += 1
                rows.append((run, seq, sub, seq * 10, float(seq)))
    items = boundaries.with_flush(spark.createDataFrame(rows, "run long, seq long, subrun long, event long, value double"))
    for k in (0, 1, 2):  # three micro-batches
        items.where(F.floor(F.col("seq") / 7) == k if k < 2 else F.col("seq") >= 14).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = boundaries.run_available(boundaries.close_on_boundary(stream), str(tmp_path / "s")).collect()
    assert sum(r.n_events for r in out) == len(rows) and abs(sum(r.total for r in out) - sum(x[4] for x in rows)) < 1e-9
    assert sorted({(r.run, r.subrun) for r in out}) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)] and len(out) == 8


def test_distinct_draws_are_even(spark):
    size = 100_000
    got = overlay.distinct_within(spark.range(3000), "id", 2, size, seed=3).groupBy("id").agg(F.min("entry").alias("a"), F.max("entry").alias("b")).collect()
    gaps = sorted(r.b - r.a for r in got)
    assert all(0 <= r.a < r.b < size for r in got)
    assert 0.25 * size < gaps[1500] < 0.34 * size  # the median gap of two even draws is 0.293 of the size
    most = overlay.distinct_within(spark.range(50), "id", 9, 10).groupBy("id").agg(F.collect_list("entry").alias("e")).collect()
    assert all(len(set(r.e)) == 9 and r.e == sorted(r.e) and set(r.e) <= set(range(10)) for r in most)
    assert overlay.distinct_within(spark.range(5), "id", 7, 7).count() == 35
    with pytest.raises(ValueError):
        overlay.distinct_within(spark.range(1), "id", 3, 2)


def test_files_for_varying_and_begun_requests(spark):
    rng = random.Random(2)
    counts, sizes = [rng.randint(0, 4) for _ in range(200)], [23, 5, 40]
    want, f, used = [], 0, 6
    for n in counts:
        while used + n > sizes[f]:
            f, used = (f + 1) % 3, 0
        want.append((f, used))
        used += n
    df = spark.createDataFrame(list(enumerate(counts)), "id long, n long")
    assert [(r.file, r.first) for r in overlay.files_for(df, ["id"], "n", sizes, first=6).orderBy("id").collect()] == want
    want, f, used = [], 0, 6
    for _ in counts:
        while used + 2 > sizes[f]:
            f, used = (f + 1) % 3, 0
        want.append((f, used))
        used += 2
    assert [(r.file, r.first) for r in overlay.files_for(df, ["id"], 2, sizes, first=6).orderBy("id").collect()] == want
    with pytest.raises(Exception, match="used up"):
        overlay.files_for(df, ["id"], 2, sizes, wrap=False).collect()


def test_remapping_knows_its_products(spark):
    df = spark.sql("SELECT array(named_struct('product_id', 1, 'key', 4), NULL, named_struct('product_id', 2, 'key', 0)) AS p")
    got = df.select(overlay.remapped(F.col("p"), F.lit(10), overlay.id_map({1: 11, 2: 12})).alias("p")).first().p
    assert [x and (x.product_id, x.key) for x in got] == [(11, 14), None, (12, 10)]
    with pytest.raises(Exception, match="unknown product 2"):
        df.select(overlay.remapped(F.col("p"), F.lit(0), overlay.id_map({1: 11})).alias("p")).collect()
    with pytest.raises(Exception, match="several products"):
        df.select(overlay.same_set(F.col("p")).alias("p")).collect()


def test_put_semantics(spark):
    totals = spark.createDataFrame([(1, 5)], "run long, x long")
    seen = spark.createDataFrame([(1, 1, 4, False), (1, 9, 12, False)], "run long, begin long, end long, whole boolean")
    assert sorted((r.begin, r.end) for r in catalog.put_spanning(totals, ["run"], "fragment", seen).collect()) == [(1, 4), (9, 12)]
    assert catalog.put_spanning(totals, ["run"], "full").first().whole
    with pytest.raises(ValueError):
        catalog.put_spanning(totals, ["run"], "fragment", seen, aggregable=False)
    with pytest.raises(Exception, match="whole run"):
        catalog.put_spanning(totals, ["run"], "ranged", seen.withColumn("whole", F.lit(True))).collect()
    with pytest.raises(Exception, match="valid range"):
        catalog.put_spanning(totals, ["run"], "ranged", seen.where("run = 2")).collect()
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, v string")
    assert sorted(r.v for r in catalog.put(rows, ["k"], "SubRun", "seq").collect()) == ["b", "c"]
    with pytest.raises(Exception, match="put twice"):
        catalog.put(rows, ["k"], "Event", "seq").collect()


def test_single_view_needs_exactly_one(spark):
    base = spark.createDataFrame([(1, "m", "produced", 0, [1, 2]), (1, "m", "present", 0, [3]), (2, "m", "present", 1, [4])], "event long, module_label string, origin string, tier int, items array<int>")
    base = base.withColumns({"available": F.lit(True), "dropped": F.lit(False)})
    view = lambda df: sorted((r.event, r.pos, r.element) for r in catalog.single_view(df, lookup.module_label("m"), ["event"], F.lit(True)).collect())
    assert view(base) == [(1, 0, 1), (1, 1, 2), (2, 0, 4)]
    for bad in (base.unionByName(base), base.unionByName(base.withColumns({"event": F.lit(3).cast("long"), "available": F.lit(False)}))):
        with pytest.raises(Exception, match="exactly one"):
            view(bad)


def test_closed_ranges_flush_and_empty(spark):
    r = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, 9), (2, 0, 4, 6)], "run long, subrun long, begin long, end long")
    e = spark.createDataFrame([(1, 2, 3)], "run long, subrun long, event long")
    seen = lambda ev, **k: [x.seen for x in ranges.closed_ranges(ev, r, **k).orderBy("run", "subrun").collect()]
    assert seen(e) == [True, False, False] and seen(e, flush=True) == [True] * 3 and seen(e.where("run > 5")) == [False] * 3
    assert seen(e.withColumn("event", F.lit(8).cast("long"))) == [True, True, False]


def test_module_graph_without_trigger_paths(spark):
    none = spark.createDataFrame([], "path string, label string, pos long")
    kinds = spark.createDataFrame([("out", "analyzer")], "label string, kind string")
    ends = spark.createDataFrame([("out",)], "label string")
    got = graph.module_graph(none, kinds, spark.createDataFrame([], "label string, on string"), ends, spark.createDataFrame([("out", "p")], "label string, path string")).collect()
    assert [tuple(r) for r in got] == [("out", "input_source", "sync")]


def test_catalog_and_source_options():
    given = {"application_family": "f", "application_version": "v", "group": "g"}
    assert workflow.catalog_metadata({"a": {"data_tier": "t"}}, **given)["a"] == {**given, "data_tier": "t", "stream_name": "a"}
    assert workflow.by_label(["x", "a:b"]) == {"_default": "x", "a": "b"}
    for outputs, options in (({"a": {}}, given), ({"a": {"data_tier": "t"}}, {"group": "g"}), ({"a": {}}, {**given, "tiers": ["b:t"]}), ({"a": {}}, {**given, "tiers": ["a:b:c"]}), ({"a": {}}, {**given, "file_type": "x", "inherit_metadata": "1"})):
        with pytest.raises(ValueError):
            workflow.catalog_metadata(outputs, **options)
    assert workflow.source_options()["max_events"] == 1 and workflow.source_options(file_list=["f1 # one", "", "# none"])["files"] == ["f1"]
    assert workflow.source_options(["a"], start="1:2")["start"] == (1, 2, 1) and workflow.source_options(["a"])["max_events"] == -1
    for bad in ({"files": ["a"], "file_list": ["b"]}, {"skip": -1}, {"start": "x"}):
        with pytest.raises(ValueError):
            workflow.source_options(**bad)
