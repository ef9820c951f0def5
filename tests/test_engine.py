"""The event-stream engine on hand-worked cases, and every query against its SQL."""

import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom import plugins, registry
from eventloom.functions import patterns
from eventloom.functions.tables import ordinal
from eventloom.operators import counting, graph, lookup, overlay, paths, ranges, segments
from eventloom.plans import performance, workflow
from eventloom.sinks import files
from eventloom.sources import events as sources
from eventloom.streaming import boundaries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, sql = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[sql.columns.index(c)]) for c in cols)) for r in sql.fetchall())
    assert mine == theirs


def test_sampling_queries(spark):
    q = registry.queries()
    once = q["mix_without_replacement"](spark, SF)
    assert once.count() == once.select("o_orderkey").distinct().count() > 0
    distinct = q["mix_distinct"](spark, SF)
    assert distinct.groupBy("event_id").agg(F.count_distinct("entry").alias("n")).where("n <> 4").count() == 0
    a, b = (sorted(map(tuple, q["mix_with_replacement"](spark, SF).collect())) for _ in range(2))
    assert a == b and 0 <= min(x[1] for x in a) and max(x[1] for x in a) < 1000


def test_prescaled_selection(spark):
    """20 generated events: evens 10, evens without every fourth 5 (2, 6, 10, 14, 18), rejecting `!evens` and `!odds` 0."""
    n = F.col("event")
    df = paths.run_paths(sources.generated(spark, 20), {"evens": [paths.Entry("e", n % 2 == 0)], "odds": [paths.Entry("o", n % 2 == 1)], "fourths": [paths.Entry("f", n % 4 == 0)]})
    names = ["evens", "odds", "fourths"]
    count = lambda **k: df.where(paths.wanted(names, **k)).count()
    assert [count(), count(select=["evens"]), count(reject=["evens"]), count(select=["odds"], reject=["evens"])] == [20, 10, 10, 10]
    got = df.where(paths.wanted(names, select=["14:evens"], reject=["fourths"])).orderBy("event").collect()
    assert [r.event for r in got] == [2, 6, 10, 14, 18] and count(reject=["!evens", "!odds"]) == 0
    assert [r.event for r in counting.prescale(sources.generated(spark, 20), ["event"], 2).orderBy("event").collect()] == list(range(2, 21, 2))


STATE = {"P": "Pass", "F": "Fail", "X": "Exception", "R": "Ready"}


@pytest.mark.parametrize(("spec", "states", "want"), [
    ("ap2", "FPFX", True), ("ap2", "PXPP", False), ("!aq2", "PPXF", True), ("!aq2", "PPXP", False), ("!aq2", "PPXX", False), ("ap2&noexception", "FPFX", False), ("ap2&noexception", "FPFF", True),
    ("ap*", "PFFF", True), ("!ap*", "FFPP", True), ("!ap*", "FPPP", False), ("!ap*&noexception", "FFXP", False), ("exception@a*", "FFXP", True), ("exception@ap1", "FFXP", False), ("zz*", "PPPP", False), ("a?2", "FPFF", True), ("!ap1", "RFFF", False),
])
def test_selection(spark, spec, states, want):
    names = ["ap1", "ap2", "aq1", "aq2"]
    df = spark.createDataFrame([tuple(STATE[s] for s in states)], ", ".join(f"st_{n} string" for n in names))
    assert df.select(paths.select_events([spec], names)).first()[0] == want


@pytest.mark.parametrize("spec", ["!exception@ap1", "exception@ap1&noexception", "ap1&other", "xexception@ap1", "nope", "!no*"])
def test_bad_selection(spec):
    with pytest.raises(ValueError):
        paths.select_events([spec], ["ap1", "ap2"])


def test_error_policy(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate([None, "A", "B", "C", "D"])], "event long, cat string")
    entries = {"p": [paths.Entry("first", F.lit(True)), paths.Entry("thrower", F.col("event") >= 0, error=F.col("cat")), paths.Entry("last", F.col("event") != 3)]}
    policy = {"A": "IgnoreCompletely", "B": "SkipEvent", "C": "FailModule", "D": "FailPath"}
    got = {r.event: (r.st_p, r.ix_p) for r in paths.run_paths(df, entries, policy).collect()}
    assert got == {0: ("Pass", 3), 1: ("Pass", 3), 2: ("Exception", 1), 3: ("Fail", 3), 4: ("Fail", 2)}
    ends = {r.st_p for r in paths.run_paths(df.where("event <> 3"), entries, policy, end_path=True).collect()}
    assert ends == {"Pass"}
    with pytest.raises(Exception, match="thrower"):
        paths.run_paths(df, entries, {"A": "Rethrow"}).collect()


def test_start_and_ids():
    assert patterns.parse_start("1") == (1, 0, 1) and patterns.parse_start(" 1 : 2 : 3 ") == (1, 2, 3) and patterns.parse_start("4:0") == (4, 0, 1)
    for bad in ("0", "1:4294967295", "4294967295", "a", "1:2:3:4", "", "1:2:0"):
        with pytest.raises(ValueError):
            patterns.parse_start(bad)
    assert str(patterns.InputTag.parse("a:b")) == "a:b" and patterns.PathSpec.parse(" 3 : p ") == patterns.PathSpec("p", 3)
    with pytest.raises(ValueError):
        patterns.match_ids(["1:2"])


def test_rules(spark):
    rows = [("A", "modA", "i1", "PROD", "Event"), ("A", "modA", "i2", "PROD", "Event"), ("A", "modA", "i1", "USER", "SubRun"), ("B", "modB", "", "HLT", "Run")]
    df = spark.createDataFrame([(*r, False, False) for r in rows], "friendly_class string, module_label string, instance string, process string, level string, transient boolean, dropped boolean")
    flags = lambda rules: [r.k for r in df.select(patterns.kept(rules).alias("k")).collect()]
    assert flags(["keep *"]) == [True] * 4 and flags(["drop *"]) == [False] * 4
    assert flags(["keep *", "drop *_*_i2_*"]) == [True, False, True, True] and flags(["keep *_modA_*_* inSubRun"]) == [False, False, True, False]
    for bad in ("beep *", "keep a_b_c", "keep *_*_*_* inFile", "keep *_mo+d_*_*"):
        with pytest.raises(ValueError):
            patterns.kept([bad])


def test_file_names():
    stats = {"lowest_run": 1, "highest_run": 2, "lowest_subrun": 0, "highest_subrun": 3}
    assert patterns.file_name("out/part_%r_%s_%R_%S.root", stats) == "out/part_1_0_2_3.root"
    assert patterns.file_name("out/part_%5R_%2S.root", stats) == "out/part_00002_03.root"
    assert patterns.file_name("%02r_%02s_%R_%S", stats) == "01_00_2_3" and patterns.file_name("%02r_%02s_%R_%S", {}) == "-_-_-_-"
    assert patterns.file_name("%02r_%02s_%R_%S", {"lowest_run": 7, "highest_run": 9, "lowest_subrun": 0, "highest_subrun": None}) == "07_00_9_-"
    counters = {}
    assert [patterns.file_name("left-%02#-right", {}, counters) for _ in range(3)] == [f"left-0{k}-right" for k in range(3)]
    own = {"input_file": "/d/e/in.root", "label": "out", "process": "P", "opened": datetime(2024, 1, 2, 3, 4, 5)}
    assert patterns.file_name("%l_%p_%to_%ifb%ife", own) == "out_P_20240102T030405_in.root" and patterns.file_name("%ifs%in%up%%", own) == "/d/e/up.root"
    with pytest.raises(ValueError):
        patterns.check_counter("plain.root", True)
    counters = {}
    assert [patterns.file_name("x_%r_%#", stats, counters) for _ in range(2)] == ["x_1_0", "x_1_1"]


def fixture_catalog(spark):
    rows = [("many", "int1", "FIRST", 0, "present", 1), ("many", "int2", "FIRST", 0, "present", 2), ("many", "", "FIRST", 0, "present", 3), ("other", "", "FIRST", 0, "present", 4), ("many", "int1", "SECOND", 1, "present", 100), ("many", "int1", "OWN", 2, "produced", 200)]
    df = spark.createDataFrame([(1, *r, True, False, 0) for r in rows], "event long, module_label string, instance string, process string, process_seq int, origin string, value int, available boolean, dropped boolean, tier int")
    return df


def test_lookup(spark):
    c = fixture_catalog(spark)
    one = lambda sel, **k: [r.value for r in lookup.resolve(c, sel, ["event"], **k).collect()]
    tag = lambda t: lookup.by_tag(t, own="OWN")
    assert one(tag("many")) == [3] and one(tag("many:int1")) == [200] and one(tag("many:int1:SECOND")) == [100]
    assert one(tag("many:int1:current_process")) == [200] and one(tag("many:int2:current_process")) == [] and one(tag("many:int2:input_source")) == [2]
    assert one(lookup.module_label("many")) == [200] and one(tag("many:int1"), path_labels=["other"]) == [100]
    with pytest.raises(Exception, match="several products"):
        one(lookup.module_label("many") & lookup.process_name("FIRST"))
    many = lookup.get_many(c, lookup.module_label("many"), ["event"]).orderBy("place").collect()
    assert len(many) == 5 and sum(r.value for r in many) == 306 and many[0].value == 200
    assert lookup.get_many(c, F.lit(True), ["event"]).agg(F.sum("value")).first()[0] == 310
    keys = c.select("event").distinct()
    with pytest.raises(Exception, match="no such product"):
        lookup.require(keys, lookup.resolve(c, lookup.module_label("none"), ["event"]), ["event"]).collect()


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranges(spark):
    given = spark.createDataFrame([(1, 0, 5, 11), (1, 1, 1, 7), (1, 1, 9, 15), (1, 2, 3, 15)], "run long, subrun long, begin long, end long")
    parts = rows_of(ranges.split_at(given, 1, 1, 5), "part", "subrun", "begin", "end")
    assert parts == [(0, 0, 5, 11), (0, 1, 1, 6), (1, 1, 6, 7), (1, 1, 9, 15), (1, 2, 3, 15)]
    assert rows_of(ranges.split_at(given, 1, 1, 5, last_in_subrun=True), "part", "subrun", "begin", "end")[:3] == [(0, 0, 5, 11), (0, 1, 1, 7), (0, 1, 9, 15)]
    events = spark.createDataFrame([(1, s, e) for s in range(3) for e in (1, 2, 3)], "run long, subrun long, event long")
    assert rows_of(ranges.islands(events), "subrun", "begin", "end") == [(0, 1, 4), (1, 1, 4), (2, 1, 4)]
    frag = lambda rows: ranges.guarded_sum(spark.createDataFrame(rows, "k string, run long, subrun long, begin long, end long, v long"), ["k"], "v").collect()
    assert frag([("a", 1, 0, 1, 4, 10), ("a", 1, 0, 1, 4, 10), ("a", 1, 0, 4, 6, 5)])[0].total == 15
    with pytest.raises(Exception, match="overlap"):
        frag([("a", 1, 0, 1, 4, 10), ("a", 1, 0, 3, 6, 5)])
    assert rows_of(ranges.current_range(events, spark.createDataFrame([(1, 0, 1, 2), (1, 0, 3, 9), (1, 0, 5, 9)], "run long, subrun long, begin long, end long")), "subrun", "n_seen") == [(0, 2)]


def test_closing_limits(spark):
    """Runs 1 (subruns 0, 1), 2 (0) and 3 (0), two events of 10 bytes each, in files a, a, b, b; a minute between subruns."""
    rows = [(r, s, e, f, 10, datetime(2020, 1, 1, 0, m)) for r, s, f, m in ((1, 0, "a", 0), (1, 1, "a", 1), (2, 0, "b", 2), (3, 0, "b", 3)) for e in (1, 2)]
    df = spark.createDataFrame(rows, "run long, subrun long, event long, file string, size long, ts timestamp")
    got = lambda *a, **k: [x[2] for x in rows_of(segments.by_criteria(df, *a, **k).select("run", "subrun", "segment").distinct(), "run", "subrun", "segment")]
    assert got(max_runs=1) == [0, 0, 1, 2]  # a run counts where it ends
    assert got(max_subruns=1) == got(max_events=1) == [0, 1, 2, 3] and got(max_events=3) == [0, 0, 1, 1]
    assert got("Run", max_subruns=1) == [0, 0, 1, 2] and got("InputFile", max_files=1) == [0, 0, 1, 1] and got("Job", max_events=1) == [0, 0, 0, 0]
    assert got(max_bytes=30) == [0, 0, 1, 1] and got(max_seconds=60.0) == [0, 0, 1, 1]
    assert segments.by_criteria(df.where("false"), max_events=1).count() == 0
    for bad in ({"max_bytes": 0}, {"max_events": 0}):
        with pytest.raises(ValueError):
            segments.by_criteria(df, **bad)
    with pytest.raises(ValueError):
        segments.by_criteria(df, "Event")


def test_relations(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, run long, subrun long, begin long, end long")
    left = make(("same", 1, 0, 1, 5), ("apart", 1, 0, 1, 5), ("touch", 1, 0, 1, 5), ("over", 1, 0, 1, 5), ("part", 1, 0, 1, 5), ("part", 1, 0, 7, 9), ("subrun", 1, 0, 1, 5), ("only", 1, 0, 1, 5))
    right = make(("same", 1, 0, 1, 5), ("apart", 1, 0, 8, 9), ("touch", 1, 0, 5, 6), ("over", 1, 0, 4, 6), ("part", 1, 0, 1, 5), ("subrun", 1, 1, 1, 5))
    want = {"same": "same", "apart": "disjoint", "touch": "disjoint", "over": "overlapping", "part": "overlapping", "subrun": "disjoint"}
    assert {r.k: r.relation for r in ranges.relation(left, right, ["k"]).collect()} == want


def test_module_totals_with_errors(spark):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, "soft"), (4, "skip")], "event long, err string")
    p = {"a": [paths.Entry("m", F.col("event") < 3, error=F.col("err"))]}
    policy = {"bad": "IgnoreCompletely", "soft": "FailModule", "skip": "SkipEvent"}
    got = paths.module_totals(paths.run_paths(df, p, policy), p, policy)
    assert rows_of(got, "label", "n_visited", "n_run", "n_passed", "n_failed", "n_error") == [("m", 4, 4, 2, 1, 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, 5.0, 0), (1, 0, 2, 6.0, 1), (1, 1, 1, 7.0, 1)], "run long, subrun long, event long, value double, segment long")
    path = str(tmp_path / "out")
    files.write_events(df, path, F.col("value") > 5, ["run", "event"])
    assert rows_of(files.read(spark, path), "segment", "run", "event") == [(1, 1, 1), (1, 1, 2)]
    files.write_tail(path, {"index": files.index(df), "history": spark.createDataFrame([("A", 0)], "process string, seq long")})
    assert rows_of(files.read(spark, path, "history"), "process", "seq") == [("A", 0)]
    runs = files.read(spark, path, "index").where("level = 'Run'")
    assert rows_of(runs, "segment", "run", "entry") == [(0, 1, 0), (1, 1, 0)]
    with pytest.raises(ValueError):
        files.write_tail(path, {"other": df})
    assert files.check_metadata({"a": '"x"'}) == {"a": '"x"'}
    with pytest.raises(ValueError):
        files.check_metadata({"a": "x"})
    kinds = spark.createDataFrame([("raw", "phys"), ("raw", "phys")], "file_type string, run_type string")
    assert rows_of(files.inherited(kinds, ["file_type", "run_type"]), "file_type", "run_type") == [("raw", "phys")]
    with pytest.raises(Exception, match="differ in file_type"):
        files.inherited(kinds.unionByName(spark.createDataFrame([("sim", "phys")], kinds.schema)), ["file_type"]).collect()


def test_workflow():
    base = {"producers": {"p": {}}, "filters": {"f": {}, "g": {}}, "analyzers": {"a": {}, "idle": {}}}
    w = workflow.compile_workflow({"physics": base | {"two": ["p", "!f"], "one": ["g"], "e": ["a", "out"]}, "outputs": {"out": {}}})
    assert w.trigger == [(0, "one", ["g"]), (1, "two", ["p", "!f"])] and w.end == ["a", "out"] and w.unused_modules == ["idle"]
    w = workflow.compile_workflow({"physics": base | {"two": ["p"], "one": ["g"], "trigger_paths": ["@nil", "7:two"], "end_paths": []}})
    assert [(b, n) for b, n, _ in w.trigger] == [(7, "two")] and w.unused_paths == ["one"]
    bad = [{"x": 1}, {"t": ["nope"]}, {"t": ["p", "a"]}, {"t": ["!p"]}, {"t": ["p"], "trigger_paths": ["u"]}, {"e": ["a"], "trigger_paths": ["e"]}, {"t": ["p"], "one": ["g"], "trigger_paths": ["1:t", "1:one"]}]
    for b in bad:
        with pytest.raises(ValueError):
            workflow.compile_workflow({"physics": base | b})
    assert workflow.route_outputs(["out"], ["a.root", "x:b.root"]) == {"out": "a.root", "x": "b.root"}


def test_mixing_parts(spark):
    counts = lambda *ns: spark.createDataFrame(list(enumerate(ns)), "id long, n long")
    assert rows_of(overlay.files_for(counts(3, 3, 3, 2), ["id"], "n", [6, 5]), "id", "file", "first") == [(0, 0, 0), (1, 0, 3), (2, 1, 0), (3, 1, 3)]
    for k in (1, 2, 5):
        same = counts(*[k] * 12)
        assert rows_of(overlay.files_for(same, ["id"], k, [6, 4, 11], 0.9), "id", "file", "first") == rows_of(overlay.files_for(same, ["id"], "n", [6, 4, 11], 0.9), "id", "file", "first")
    with pytest.raises(ValueError):
        overlay.files_for(counts(9), ["id"], 9, [6, 5])
    with pytest.raises(Exception, match="larger than every file"):
        overlay.files_for(counts(9), ["id"], "n", [6, 5]).collect()
    with pytest.raises(Exception, match="used up"):
        overlay.files_for(counts(5, 5), ["id"], 5, [6], wrap=False).collect()
    with pytest.raises(Exception, match="used up"):
        overlay.files_for(counts(5, 5), ["id"], "n", [6], wrap=False).collect()
    draws, second = spark.createDataFrame([("p", 1), ("p", 0), ("p", 5)], "k string, entry long"), spark.createDataFrame([(0, "a"), (1, None)], "entry long, x string")
    assert overlay.gather(draws, second, "k", "x").first()[1] == ["a", None, None] and overlay.gather(draws, second, "k", "x", compact=True).first()[1] == ["a"]
    maps = spark.createDataFrame([("f", 1, 7), ("g", 1, 7), ("g", 2, 8)], "file string, old_id long, new_id long")
    assert rows_of(overlay.check_id_maps(maps), "old_id", "new_id") == [(1, 7), (2, 8)]
    with pytest.raises(Exception, match="differently"):
        overlay.check_id_maps(maps.unionByName(spark.createDataFrame([("h", 2, 9)], maps.schema))).collect()
    df = spark.createDataFrame([({0: "a", 2: "b"}, {0: "c"})], "l map<int,string>, r map<int,string>")
    assert df.select(overlay.shifted_union(F.col("l"), F.col("r"))).first()[0] == {0: "a", 2: "b", 3: "c"}
    with pytest.raises(Exception, match="too few"):
        overlay.consecutive(spark.range(5), ["id"], F.lit(2), 7).collect()
    assert rows_of(ordinal(spark.range(50).repartition(5), [F.desc("id")]), "id", "ordinal")[0] == (0, 50)


def test_graph(spark):
    places = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("c", "q", 0)], "label string, path string, pos long")
    produces = spark.createDataFrame([("a", "K"), ("c", "K")], "label string, class string")
    consumes = spark.createDataFrame([("b", "a", "K"), ("a", "a", "K"), ("b", "c", "K"), ("b", "", "K"), ("c", "input", "K")], "label string, from_label string, class string")
    deps = graph.dependencies(consumes, produces, places)
    assert rows_of(graph.cross_path(deps), "label", "on") == [("b", "c")] and rows_of(graph.out_of_order(deps), "label", "on", "itself") == [("a", "a", True)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "child long, parent long")
    assert graph.ancestors(chain).count() == 210
    lines = [r.line for r in graph.dot(places, "label", "path").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and len(lines) == 5


def test_performance_corner_cases(spark):
    ids = "Run long, SubRun long, Event long, Time double"
    t = spark.createDataFrame([(1, 0, 1, 2.0)], ids)
    module = spark.createDataFrame([(1, 0, 1, 2.0, "p", "m", "Out(WRITE)")], ids + ", Path string, ModuleLabel string, ModuleType string")
    source = t.withColumn("Source", F.lit("s"))
    assert performance.full_events(source, t, module).first().FullTime == 2.0
    assert performance.full_events(source, t, module, union_all=True).first().FullTime == 6.0
    assert performance.read_summary(source.where("false")).first().n == 0
    with pytest.raises(ValueError):
        performance.check_tables(t.where("false"), module)
    old = spark.createDataFrame([("1:2:3", 4.0)], "id string, t double")
    assert performance.migrated(old, "id", {"t": "Time"}).first().asDict() == {"Time": 4.0, "Run": 1, "SubRun": 2, "Event": 3}


def test_plugins(spark):
    reg, seen = plugins.Registry(), []

    @reg.add("filter", "positive")
    def positive(column="v"):
        """Values above 0."""
        return F.col(column) > 0

    assert reg.listing() == [("filter", "positive", "Values above 0.")]
    assert spark.range(-2, 3).where(reg.make("filter", "positive", column="id")).count() == 2
    for k in (1, 2):
        reg.watch("pre_event", lambda k=k: seen.append(k))
        reg.watch("post_event", lambda k=k: seen.append(10 * k))
    reg.emit("pre_event"), reg.emit("post_event")
    assert seen == [1, 2, 20, 10]
    products = plugins.Products()
    products.produces("hits")
    with pytest.raises(ValueError):
        products.put(spark.range(1), "tracks", F.lit(1))
    with pytest.raises(Exception, match="null product"):
        products.put(spark.range(1), "hits", F.lit(None).cast("int")).collect()
    with pytest.raises(ValueError):
        plugins.check_consumes({("a", "")}, {("b", "")}, strict=True)


def read_file(name):
    yield 1, 0, None
    yield None, None, 1
    yield None, None, 2
    yield None, 1, 1


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.root # first\n\n# none\n  b.root\n")
    assert rows_of(sources.file_list(spark, str(tmp_path / "list.txt")), "name") == [("a.root",), ("b.root",)]
    spark.dataSource.register(sources.UserSource)
    df = spark.read.format("eventloom").option("reader", "tests.test_engine:read_file").load("x,y")
    assert rows_of(df, "file", "pos", "run", "subrun", "event")[:4] == [("x", 0, 1, 0, None), ("x", 1, 1, 0, 1), ("x", 2, 1, 0, 2), ("x", 3, 1, 1, 1)] and df.count() == 8
    with pytest.raises(ValueError):
        sources.generated(spark, 5, max_time=1.0)


def test_stream_prescale_counts_across_batches(spark, tmp_path):
    for part in ([1, 2], [3, 4, 5]):
        spark.createDataFrame([("a", n) for n in part] + [("b", part[0])], "k string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = boundaries.run_available(boundaries.stream_prescale(stream, ["k"], "n", 2), str(tmp_path / "run"))
    assert rows_of(out, "k", "n") == [("a", 2), ("a", 4), ("b", 3)]


def test_streaming_boundaries(spark, tmp_path):
    schema = "run long, seq long, subrun long, event long, value double, flush boolean"
    rows = [(1, 1, 0, 1, 1.0, False), (1, 2, 0, 2, 2.0, False), (1, 3, 1, 1, 4.0, False), (1, 4, None, None, None, True), (2, 5, 0, 1, 8.0, False)]
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = boundaries.close_on_boundary(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("closed"), "run", "subrun", "n_events", "total", "begin", "end") == [(1, 0, 2, 3.0, 1, 3), (1, 1, 1, 4.0, 1, 2)]
