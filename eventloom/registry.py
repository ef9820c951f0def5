"""The queries of this library over the common tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.patterns import from_start, kept, match_ids
from eventloom.functions.tables import ordinal, scratch, table
from eventloom.operators import catalog as products
from eventloom.operators import counting, graph, lookup, overlay, paths, ranges, segments
from eventloom.plans import performance, workflow
from eventloom.sinks import files
from eventloom.sources import events as sources
from eventloom.streaming import boundaries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

HEADER = "SELECT *, CAST(day(ts) AS BIGINT) AS run, CAST(hour(ts) AS BIGINT) AS subrun, event_id + 1 AS event FROM events"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def header(spark: SparkSession, d: str) -> DataFrame:
    return sources.headers(table(spark, d, "events"))


# Sources


@query("""SELECT 1 + i // 70 AS run, (i % 70) // 20 AS subrun, 1 + (i % 70) % 20 AS event FROM range(5000) t(i)""")
def id_closed_form(spark, d):
    return sources.generated(spark, 5000, events_in_run=70, events_in_subrun=20)


@query("""SELECT 1 + i // 70 AS run, (i % 70) // 20 AS subrun, 1 + i % 70 AS event FROM range(100, 1100) t(i)""")
def id_continuing(spark, d):
    return sources.generated(spark, 1000, events_in_run=70, events_in_subrun=20, reset_event_on_subrun=False, skip=100)


@query(f"""WITH h AS ({HEADER}) SELECT run, subrun, event FROM h WHERE run > 3 OR run = 3 AND (subrun > 5 OR subrun = 5 AND event >= 10) ORDER BY event_id LIMIT 500 OFFSET 20""")
def estart_skip_limit(spark, d):
    return header(spark, d).where(from_start("3 : 5 : 10")).orderBy("event_id").offset(20).limit(500).select("run", "subrun", "event")


@query(f"""WITH h AS ({HEADER}) SELECT 'Run' AS level, run, CAST(NULL AS BIGINT) AS subrun, CAST(NULL AS BIGINT) AS event FROM h GROUP BY run
UNION ALL SELECT 'SubRun', run, subrun, NULL FROM h GROUP BY run, subrun""")
def processing_mode(spark, d):
    return sources.levels(header(spark, d), "RunsAndSubRuns")


@query(f"""WITH h AS ({HEADER}) SELECT DISTINCT h.run, h.subrun FROM h JOIN h x ON x.run = h.run AND x.subrun = h.subrun AND x.event_type = 'error'""")
def nonempty_subruns(spark, d):
    h = header(spark, d)
    return sources.handled_levels(h.select("run", "subrun").distinct(), h.where("event_type = 'error'"), ["run", "subrun"], empty=False)


ITEMS = """SELECT user_id % 4 AS file, event_id AS pos, CASE WHEN event_id % 50 < 4 THEN 'r' WHEN event_id % 10 < 4 THEN 's' ELSE 'e' END AS kind, event_id // 7 AS number FROM events WHERE user_id % 4 < 4"""


@query(f"""WITH i AS ({ITEMS}), g AS (SELECT *, sum((kind = 'r')::INT) OVER (ORDER BY file, pos) AS g FROM i)
SELECT CAST(file AS BIGINT) AS file, pos, kind, last_value(CASE WHEN kind = 'r' THEN number END IGNORE NULLS) OVER (ORDER BY file, pos) AS run,
last_value(CASE WHEN kind = 's' THEN number END IGNORE NULLS) OVER (PARTITION BY g ORDER BY file, pos) AS subrun, CASE WHEN kind = 'e' THEN number END AS event FROM g""")
def forward_fill(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 50 < 4, "r").when(F.col("event_id") % 10 < 4, "s").otherwise("e")
    items = e.select((F.col("user_id") % 4).alias("file"), F.col("event_id").alias("pos"), kind.alias("kind"), F.floor(F.col("event_id") / 7).alias("number"))
    return sources.forward_filled(items).select("file", "pos", "kind", "run", "subrun", "event")


BROKEN = "SELECT user_id % 5 AS file, event_id AS pos, value, (event_id * 7) % 11 AS run, user_id % 3 AS subrun, event_id % 97 AS event FROM events"


@query(f"""WITH h AS ({BROKEN}), n AS (SELECT *, coalesce(lag(run) OVER w <> run, true) OR coalesce(lag(subrun) OVER w <> subrun, true) AS new FROM h WINDOW w AS (PARTITION BY file ORDER BY pos)),
m AS (SELECT *, new AND sum(new::INT) OVER (PARTITION BY file, run, subrun ORDER BY pos) > 1 AS again, row_number() OVER (PARTITION BY file, run, subrun, event ORDER BY pos) > 1 AS twice FROM n)
SELECT file, pos, 'invalid_id' AS rule FROM m WHERE run = 0 OR event = 0 UNION ALL SELECT file, pos, 'repeated_subrun' FROM m WHERE again UNION ALL SELECT file, pos, 'repeated_event' FROM m WHERE twice""")
def integrity_violations(spark, d):
    e = table(spark, d, "events")
    h = e.select((F.col("user_id") % 5).alias("file"), F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 11).alias("run"), (F.col("user_id") % 3).alias("subrun"), (F.col("event_id") % 97).alias("event"))
    return sources.integrity_violations(h, "file", "pos")


# Filters


@query(f"""WITH h AS ({HEADER}), n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS c FROM h WHERE value > 20) SELECT run, subrun, event FROM n WHERE c % 7 = 3""")
def prescale(spark, d):
    return counting.prescale(header(spark, d), ["event_id"], 7, 3, visited=F.col("value") > 20).select("run", "subrun", "event")


@query(f"""WITH h AS ({HEADER}), n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS c FROM h) SELECT run, subrun, event FROM n WHERE c >= 11 AND (c - 11) % 10 < 4""")
def block_prescale(spark, d):
    return counting.block_prescale(header(spark, d), ["event_id"], 10, 4, 11).select("run", "subrun", "event")


@query("""SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events""")
def global_ordinal(spark, d):
    return ordinal(table(spark, d, "events").select("event_id", "value"), [F.desc("value"), "event_id"], "place").select("event_id", "place")


@query(f"""WITH h AS ({HEADER}) SELECT run, subrun, event, event_type FROM h WHERE run = 3 AND subrun BETWEEN 2 AND 5 OR run IN (7, 9) AND subrun = 1 OR (event BETWEEN 100 AND 130)""")
def event_id_filter(spark, d):
    return header(spark, d).where(match_ids(["3:2-5:*", "7,9:1:*", "*:*:100-130"])).select("run", "subrun", "event", "event_type")


PATHS = ["hi", "buy", "err", "odd"]


def _paths() -> dict[str, list[paths.Entry]]:
    v, t, u = F.col("value"), F.col("event_type"), F.col("user_id")
    category = F.when(t == "error", F.when(u % 3 == 0, "Broken").when(u % 3 == 1, "Skip").otherwise("Minor"))
    return {
        "hi": [paths.Entry("large", v > 50), paths.Entry("even", u % 2 == 0)],
        "buy": [paths.Entry("purchase", t == "purchase")],
        "err": [paths.Entry("small", v > 90, "!"), paths.Entry("check", u % 5 != 0, error=category), paths.Entry("seven", u % 7 < 5)],
        "odd": [paths.Entry("anything", v < 0, "-"), paths.Entry("odd", u % 2 == 0, "!")],
    }


POLICY = {"Broken": "FailPath", "Skip": "SkipEvent", "Minor": "FailModule"}
STATES = f"""WITH h AS ({HEADER}), o AS (SELECT *,
  CASE WHEN event_type <> 'error' THEN CASE WHEN user_id % 5 <> 0 THEN 'pass' ELSE 'fail' END WHEN user_id % 3 = 0 THEN 'failpath' WHEN user_id % 3 = 1 THEN 'exc' ELSE 'pass' END AS c FROM h),
s AS (SELECT *, CASE WHEN value > 50 AND user_id % 2 = 0 THEN 'Pass' ELSE 'Fail' END AS st_hi,
  CASE WHEN event_type = 'purchase' THEN 'Pass' ELSE 'Fail' END AS st_buy,
  CASE WHEN value > 90 THEN 'Fail' WHEN c = 'exc' THEN 'Exception' WHEN c <> 'pass' THEN 'Fail' WHEN user_id % 7 < 5 THEN 'Pass' ELSE 'Fail' END AS st_err,
  CASE WHEN value > 90 THEN 1 WHEN c = 'exc' THEN 1 WHEN c <> 'pass' THEN 2 ELSE 3 END AS ix_err,
  CASE WHEN user_id % 2 = 0 THEN 'Fail' ELSE 'Pass' END AS st_odd FROM o)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    return paths.run_paths(header(spark, d), _paths(), POLICY)


def _selected(spark, d, **spec) -> DataFrame:
    return states(spark, d).where(paths.wanted(PATHS, **spec)).select("run", "subrun", "event")


def _select_sql(where: str) -> str:
    return f"{STATES} SELECT run, subrun, event FROM s WHERE {where}"


@query(f"""{STATES} SELECT event, st_hi, st_buy, st_err, CAST(ix_err AS BIGINT) AS ix_err, st_odd FROM s""")
def path_states(spark, d):
    return states(spark, d).select("event", "st_hi", "st_buy", "st_err", "ix_err", "st_odd")


@query(" UNION ALL ".join(f"""({STATES} SELECT CAST({k} AS BIGINT) AS path_id, '{p}' AS path, count(*) AS n_run, count_if(st_{p} = 'Pass')::BIGINT AS n_passed, count_if(st_{p} = 'Fail')::BIGINT AS n_failed, count_if(st_{p} = 'Exception')::BIGINT AS n_error FROM s)""" for k, p in enumerate(PATHS)))
def trigger_report(spark, d):
    return paths.path_report(states(spark, d), PATHS)


@query(f"""{STATES} SELECT 'err' AS path, place, label, v AS n_visited, p AS n_passed, f AS n_failed, x AS n_error FROM (
SELECT CAST(0 AS BIGINT) AS place, 'small' AS label, count(*) AS v, count_if(value <= 90)::BIGINT AS p, count_if(value > 90)::BIGINT AS f, CAST(0 AS BIGINT) AS x FROM s
UNION ALL SELECT 1, 'check', count_if(value <= 90)::BIGINT, count_if(value <= 90 AND c = 'pass')::BIGINT, count_if(value <= 90 AND c IN ('fail', 'failpath'))::BIGINT, count_if(value <= 90 AND c = 'exc')::BIGINT FROM s
UNION ALL SELECT 2, 'seven', count_if(value <= 90 AND c = 'pass')::BIGINT, count_if(value <= 90 AND c = 'pass' AND user_id % 7 < 5)::BIGINT, count_if(value <= 90 AND c = 'pass' AND user_id % 7 >= 5)::BIGINT, 0 FROM s)""")
def module_report(spark, d):
    p = {"err": _paths()["err"]}
    return paths.module_report(paths.run_paths(header(spark, d), p, POLICY), p)


@query(f"""{STATES} SELECT count(*) AS n_events, count_if(st_hi = 'Pass' OR st_buy = 'Pass')::BIGINT AS n_passed, count_if(NOT (st_hi = 'Pass' OR st_buy = 'Pass'))::BIGINT AS n_failed FROM s""")
def event_totals(spark, d):
    return paths.event_totals(states(spark, d), ["hi", "buy"])


@query(_select_sql("st_hi = 'Pass' OR st_buy = 'Pass'"))
def event_select_positive(spark, d):
    return _selected(spark, d, select=["hi", "b?y"])


@query(_select_sql("st_hi = 'Fail' AND st_buy = 'Fail' AND st_err = 'Fail' AND st_odd = 'Fail'"))
def event_select_negglob(spark, d):
    return _selected(spark, d, select=["!*"])


@query(_select_sql("st_hi = 'Pass' AND st_err <> 'Exception'"))
def event_select_noexception(spark, d):
    return _selected(spark, d, select=["hi & noexception"])


@query(_select_sql("st_err = 'Exception' OR st_buy = 'Fail' AND st_err <> 'Exception'"))
def event_select_exception(spark, d):
    return _selected(spark, d, select=["exception@*", "!buy&noexception"])


@query(_select_sql("st_hi = 'Pass' AND NOT st_buy = 'Pass'"))
def select_reject(spark, d):
    return _selected(spark, d, select=["hi"], reject=["buy"])


@query(_select_sql("user_id % 2 <> 0"))
def path_veto_ignore(spark, d):
    return states(spark, d).where("st_odd = 'Pass'").select("run", "subrun", "event")


# Product catalog: parts stand in for products


CATALOG = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Track' WHEN 1 THEN 'Hit' ELSE 'std::Hit' END AS friendly_class, 'mod' || chr(CAST(65 + p_size % 5 AS INT)) AS module_label,
CASE WHEN p_size % 2 = 0 THEN '' ELSE 'i' || p_size % 3 END AS instance, ['EARLY', 'LATE', 'NOW'][CAST(p_partkey % 7 % 3 AS INT) + 1] AS process, ['Event', 'SubRun', 'Run', 'Results'][CAST(p_partkey % 4 AS INT) + 1] AS level,
p_partkey % 11 = 0 AS transient, p_partkey % 13 = 0 AS dropped, p_partkey % 7 % 3 AS process_seq, CASE WHEN p_partkey % 7 % 3 = 2 THEN 'produced' ELSE 'present' END AS origin, p_partkey % 17 <> 0 AS available, 0 AS tier, p_partkey % 150 AS event FROM part"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    seq = k % 7 % 3
    return table(spark, d, "part").select(
        "p_partkey", F.when(k % 3 == 0, "Track").when(k % 3 == 1, "Hit").otherwise("std::Hit").alias("friendly_class"),
        F.concat(F.lit("mod"), F.char(65 + s % 5)).alias("module_label"), F.when(s % 2 == 0, "").otherwise(F.concat(F.lit("i"), s % 3)).alias("instance"),
        F.element_at(F.array(*map(F.lit, ["EARLY", "LATE", "NOW"])), (seq + 1).cast("int")).alias("process"),
        F.element_at(F.array(*map(F.lit, ["Event", "SubRun", "Run", "Results"])), (k % 4 + 1).cast("int")).alias("level"),
        (k % 11 == 0).alias("transient"), (k % 13 == 0).alias("dropped"), seq.alias("process_seq"), F.when(seq == 2, "produced").otherwise("present").alias("origin"),
        (k % 17 != 0).alias("available"), F.lit(0).alias("tier"), (k % 150).alias("event"),
    )


@query(f"""WITH c AS ({CATALOG}) SELECT p_partkey, (CASE WHEN module_label = 'modB' AND level = 'Run' THEN true WHEN regexp_full_match(friendly_class, '.*Hit') AND process = 'LATE' THEN false ELSE true END) AND NOT transient AND NOT dropped AS kept FROM c""")
def keep_drop_catalog(spark, d):
    return catalog(spark, d).select("p_partkey", kept(["keep *", "drop *Hit_*_*_LATE", "keep *_modB_*_* inRun"]).alias("kept"))


LOOKUP = "module_label IN ('modA', 'modC') AND instance = ''"


ONE_EACH = "SELECT p_partkey % 20 AS event, module_label, instance, process_seq, process, origin, min(p_partkey) AS p_partkey FROM c WHERE available AND NOT dropped GROUP BY ALL"


@query(f"""WITH c AS ({CATALOG}), o AS ({ONE_EACH}), v AS (SELECT * FROM o WHERE {LOOKUP} AND (origin <> 'produced' OR module_label = 'modA')),
r AS (SELECT *, max(process_seq) OVER (PARTITION BY event, module_label) AS m FROM v) SELECT event, module_label, p_partkey, process FROM r WHERE process_seq = m""")
def product_lookup_latest_process(spark, d):
    """Up to three processes have a product of each label and event; on a path that has modA only, the produced ones of modC are not seen."""
    c = catalog(spark, d).where("available AND NOT dropped").withColumn("event", F.col("p_partkey") % 20)
    c = c.groupBy("event", "module_label", "instance", "process_seq", "process", "origin", "tier", "available", "dropped").agg(F.min("p_partkey").alias("p_partkey"))
    sel = lookup.tag_list(["modA", "modC"]) & lookup.instance_name("")
    return lookup.resolve(c, sel, ["event", "module_label"], ["modA"]).select("event", "module_label", "p_partkey", "process")


@query(f"""WITH c AS ({CATALOG}), g AS (SELECT event, module_label, process_seq, max(process) AS process, min(p_partkey) AS p_partkey FROM c WHERE available AND NOT dropped GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY event, module_label ORDER BY process_seq DESC) AS r FROM g) SELECT event, module_label, process, p_partkey FROM r WHERE r = 1""")
def product_lookup_by_label(spark, d):
    c = catalog(spark, d).where("available AND NOT dropped").groupBy("event", "module_label", "process_seq").agg(F.max("process").alias("process"), F.min("p_partkey").alias("p_partkey"))
    c = c.withColumns({"tier": F.lit(0), "available": F.lit(True), "dropped": F.lit(False), "origin": F.lit("present")})
    return lookup.resolve(c, F.lit(True), ["event", "module_label"]).select("event", "module_label", "process", "p_partkey")


@query(f"""WITH c AS ({CATALOG}) SELECT event, p_partkey, row_number() OVER (PARTITION BY event ORDER BY process_seq DESC, module_label, instance, p_partkey) AS place FROM c WHERE friendly_class = 'Track' AND available AND NOT dropped""")
def get_many(spark, d):
    c = catalog(spark, d).withColumn("instance", F.concat("instance", F.lpad(F.col("p_partkey").cast("string"), 0, "")))
    c = c.withColumn("instance", F.struct("instance", "p_partkey"))
    return lookup.get_many(c, F.col("friendly_class") == "Track", ["event"]).select("event", "p_partkey", "place")


ITEMS_SQL = """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS pos, l_partkey FROM lineitem"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))


@query(f"""{ITEMS_SQL}""")
def view_explode(spark, d):
    return lookup.view(_items(spark, d), "items", ["l_orderkey"]).select("l_orderkey", "pos", F.col("element.l_partkey").alias("l_partkey"))


@query(f"""WITH i AS ({ITEMS_SQL}), p AS (SELECT o_orderkey, o_orderkey % 3 AS key FROM orders) SELECT o_orderkey, CAST(p.key AS INT) AS key, l_partkey FROM p LEFT JOIN i ON i.l_orderkey = o_orderkey AND i.pos = p.key""")
def ptr_deref(spark, d):
    elements = lookup.view(_items(spark, d), "items", ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("product_id"), F.col("pos").alias("key"), F.col("element.l_partkey").alias("l_partkey"))
    pointers = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("product_id"), (F.col("o_orderkey") % 3).cast("int").alias("key"))
    return lookup.follow(pointers, elements, ["o_orderkey"]).select("o_orderkey", "key", "l_partkey")


@query("""SELECT DISTINCT l_suppkey AS "left", l_partkey AS "right" FROM lineitem""")
def assns_partner(spark, d):
    return lookup.partner(table(spark, d, "lineitem").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right")).distinct())


@query(f"""WITH h AS ({HEADER}), s AS (SELECT run, subrun, count(*) AS in_subrun FROM h GROUP BY ALL), r AS (SELECT run, min(event) AS first_of_run FROM h GROUP BY ALL) SELECT event, in_subrun, first_of_run FROM h JOIN s USING (run, subrun) JOIN r USING (run)""")
def parent_access(spark, d):
    h = header(spark, d)
    subruns, runs = h.groupBy("run", "subrun").agg(F.count("*").alias("in_subrun")), h.groupBy("run").agg(F.min("event").alias("first_of_run"))
    return products.parents(h.select("run", "subrun", "event"), subruns, runs).select("event", "in_subrun", "first_of_run")


# Ranges and sums


@query(f"""WITH h AS ({HEADER}), e AS (SELECT DISTINCT run, subrun, event FROM h WHERE event % 9 <> 0), g AS (SELECT *, event - row_number() OVER (PARTITION BY run, subrun ORDER BY event) AS g FROM e)
SELECT run, subrun, min(event) AS begin, max(event) + 1 AS "end" FROM g GROUP BY run, subrun, g""")
def islands_ranges(spark, d):
    return ranges.islands(header(spark, d).where("event % 9 <> 0")).select("run", "subrun", "begin", "end")


@query(f"""WITH h AS ({HEADER}) SELECT run, subrun, min(event) AS begin, max(event) + 1 AS "end" FROM h GROUP BY run, subrun""")
def ranges_merged(spark, d):
    h = header(spark, d)
    return ranges.merged(ranges.islands(h.where("event % 2 = 0")).unionByName(ranges.islands(h.where("event % 2 = 1")))).select("run", "subrun", "begin", "end")


@query(f"""WITH h AS ({HEADER}), r AS (SELECT run, subrun, min(event) AS b, max(event) + 1 AS e FROM h GROUP BY run, subrun),
c AS (SELECT *, CASE WHEN run < 5 OR run = 5 AND subrun < 7 THEN e WHEN run = 5 AND subrun = 7 THEN least(e, greatest(b, 1501)) ELSE b END AS m FROM r)
SELECT run, subrun, 0 AS part, b AS begin, m AS "end" FROM c WHERE b < m UNION ALL SELECT run, subrun, 1, m, e FROM c WHERE m < e""")
def split_ranges(spark, d):
    return ranges.split_at(ranges.merged(ranges.islands(header(spark, d))), 5, 7, 1500)


FRAGMENTS = f"""SELECT event_type AS kind, run, subrun, min(event) AS b, max(event) + 1 AS e, sum(value) AS v FROM ({HEADER}) GROUP BY ALL"""


@query(f"""WITH f AS ({FRAGMENTS}) SELECT kind, run, round(sum(v), 4) AS total, CAST(sum(e - b) AS BIGINT) AS n_events FROM f GROUP BY kind, run""")
def overlap_guard_sum(spark, d):
    f = header(spark, d).groupBy(F.col("event_type").alias("kind"), "run", "subrun").agg(F.min("event").alias("begin"), (F.max("event") + 1).alias("end"), F.sum("value").alias("v"))
    twice = f.unionByName(f.where("run % 2 = 0"))  # a fragment that comes twice counts once
    return ranges.guarded_sum(twice, ["kind"], "v").withColumn("total", F.round("total", 4))


@query("""SELECT o_orderstatus, list_transform([sum(o_orderkey % 5), sum(o_orderkey % 7), sum(o_custkey % 3)], lambda x: CAST(x AS BIGINT)) AS v FROM orders GROUP BY o_orderstatus""")
def array_sum(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 7, F.col("o_custkey") % 3).alias("v"))
    return ranges.sum_arrays(o, ["o_orderstatus"], "v")


# Output files


SEGMENTS = f"WITH h AS ({HEADER}), s AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 700 AS segment FROM h)"


@query(f"{SEGMENTS} SELECT event, segment FROM s")
def segment_by_max_events(spark, d):
    return segments.by_events(header(spark, d), ["event_id"], 700).select("event", "segment")


@query(f"""{SEGMENTS} SELECT segment, count(*) AS n_events, min(run) AS lowest_run, max(run) AS highest_run, arg_min(subrun, event_id) AS lowest_subrun, arg_max(subrun, event_id) AS highest_subrun,
min(event) AS lowest_event, max(event) AS highest_event, count(DISTINCT (run, subrun)) AS n_subruns FROM s GROUP BY segment""")
def file_stats(spark, d):
    return segments.file_stats(segments.by_events(header(spark, d), ["event_id"], 700))


@query(f"""{SEGMENTS} SELECT segment, round(sum(value), 4) AS total, count_if(event_type = 'error')::BIGINT AS n_errors FROM s GROUP BY segment""")
def results_per_segment(spark, d):
    s = segments.by_events(header(spark, d), ["event_id"], 700)
    return segments.results(s, {"total": F.round(F.sum("value"), 4), "n_errors": F.count_if(F.col("event_type") == "error").cast("long")})


@query(f"""WITH RECURSIVE h AS ({HEADER}), g AS (SELECT run, subrun, count(*) AS n, row_number() OVER (ORDER BY run, subrun) AS k FROM h GROUP BY run, subrun),
r AS (SELECT k, 0 AS segment, n AS acc FROM g WHERE k = 1 UNION ALL SELECT g.k, CASE WHEN r.acc >= 300 THEN r.segment + 1 ELSE r.segment END, CASE WHEN r.acc >= 300 THEN g.n ELSE r.acc + g.n END FROM r JOIN g ON g.k = r.k + 1)
SELECT run, subrun, CAST(segment AS BIGINT) AS segment FROM r JOIN g USING (k)""")
def segment_by_subrun_granularity(spark, d):
    return segments.by_criteria(header(spark, d), "SubRun", max_events=300).select("run", "subrun", "segment").distinct()


@query(f"""{SEGMENTS}, l AS (SELECT DISTINCT segment, run, subrun FROM s) SELECT segment, run, subrun, row_number() OVER (PARTITION BY run, subrun ORDER BY segment) > 1 AS is_repeat FROM l""")
def level_carry_over(spark, d):
    return segments.carry_over(segments.by_events(header(spark, d), ["event_id"], 700), ["run", "subrun"])


# Mixing


@query("""WITH p AS (SELECT event_id, event_id % 4 AS n, sum(event_id % 4) OVER (ORDER BY event_id) - event_id % 4 AS at_ FROM events)
SELECT event_id, CAST((at_ + 17 + unnest(range(0, n))) % (SELECT count(*) FROM part) AS BIGINT) AS entry FROM p""")
def mix_sequential(spark, d):
    size = table(spark, d, "part").count()
    return overlay.consecutive(table(spark, d, "events").select("event_id"), ["event_id"], F.col("event_id") % 4, size, 17, wrap=True)


#: A number in [0, 1) from the MD5 of a text, as overlay.uniform() has it.
UNIFORM = "(('0x' || md5({})[1:13])::UBIGINT::DOUBLE / 4503599627370496.0)"
ENTRIES = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS entry FROM orders"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The secondary stream: orders by key, counted from 0."""
    return ordinal(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "_n").select("o_orderkey", (F.col("_n") - 1).alias("entry"))


@query(f"""WITH s AS ({ENTRIES}), z AS (SELECT count(*) AS size FROM orders), p AS (SELECT event_id, unnest(range(1, 4)) AS d FROM events),
e AS (SELECT event_id, d, CAST(floor({UNIFORM.format("'5:' || event_id || ':' || d")} * size) AS BIGINT) AS entry FROM p, z)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY entry, d) - 1 AS INT) AS place, entry, o_orderkey FROM e JOIN s USING (entry)""")
def mix_with_replacement(spark, d):
    second = _entries(spark, d)
    draws = overlay.with_replacement(table(spark, d, "events").select("event_id"), "event_id", 3, second.count(), seed=5)
    return draws.join(second, "entry").select("event_id", "place", "entry", "o_orderkey")


@query(f"""WITH s AS ({ENTRIES}), z AS (SELECT count(*) AS size FROM orders), p AS (SELECT event_id, unnest(range(1, 137)) AS d FROM events),
e AS (SELECT event_id, d, CAST(floor({UNIFORM.format("'5:' || event_id || ':' || d")} * size) AS BIGINT) AS entry FROM p, z),
f AS (SELECT event_id, entry, min(d) AS d FROM e GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d) AS k FROM f)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY entry) - 1 AS INT) AS place, entry, o_orderkey FROM n JOIN s USING (entry) WHERE k <= 4""")
def mix_distinct(spark, d):
    second = _entries(spark, d)
    draws = overlay.distinct_within(table(spark, d, "events").select("event_id"), "event_id", 4, second.count(), seed=5)
    return draws.join(second, "entry").select("event_id", "place", "entry", "o_orderkey")


@query(f"""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY {UNIFORM.format("'9:' || o_orderkey")}, o_orderkey) - 1 AS entry FROM orders),
p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS entry FROM events) SELECT event_id, entry, o_orderkey FROM p JOIN s USING (entry)""")
def mix_without_replacement(spark, d):
    second = overlay.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=9)
    dealt = overlay.consecutive(table(spark, d, "events").select("event_id"), ["event_id"], F.lit(1), second.count())
    return dealt.join(second, "entry").select("event_id", "entry", "o_orderkey")


LISTS = """WITH i AS (SELECT l_orderkey // 5 AS g, l_orderkey % 5 AS k, list(l_partkey ORDER BY l_partkey, l_suppkey) AS xs FROM lineitem GROUP BY ALL),
p AS (SELECT g, k, xs, sum(len(xs)) OVER (PARTITION BY g ORDER BY k) - len(xs) AS off FROM i WHERE k <> 2)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    g, k = F.floor(F.col("l_orderkey") / 5).alias("g"), (F.col("l_orderkey") % 5).alias("k")
    each = table(spark, d, "lineitem").groupBy(g, k).agg(F.array_sort(F.collect_list("l_partkey")).alias("xs"))
    each = each.withColumn("xs", F.when(F.col("k") != 2, F.col("xs")))
    return each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "xs"))), lambda s: s["xs"]).alias("xs"))


@query(f"""{LISTS} SELECT g, flatten(list(xs ORDER BY k)) AS flat, list(CAST(off AS INT) ORDER BY k) AS offsets FROM p GROUP BY g""")
def flatten_offsets(spark, d):
    return _lists(spark, d).where(F.exists("xs", lambda x: x.isNotNull())).select("g", overlay.flattened(F.col("xs")).alias("flat"), overlay.offsets(F.col("xs")).alias("offsets"))


@query(f"""{LISTS} SELECT g, k, CAST(off AS BIGINT) AS key, CAST(70 + 10 * (k % 3) AS INT) AS product_id FROM p WHERE len(xs) > 0""")
def ptr_remap(spark, d):
    xs = _lists(spark, d).select("g", F.filter(F.transform("xs", lambda x, i: F.struct(i.alias("k"), x.alias("x"))), lambda s: s["x"].isNotNull()).alias("ps"), overlay.offsets(F.col("xs")).alias("off"))
    each = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 5).alias("g"), (F.col("l_orderkey") % 5).alias("k")).distinct().where("k <> 2")
    place = F.row_number().over(_by("g", "k")) - 1
    each = each.withColumn("n", place).join(xs.select("g", "off"), "g")
    pointers = overlay.same_set(F.array(F.struct((F.col("k") % 3 + 7).cast("int").alias("product_id"), F.lit(0).alias("key"))))
    ids = overlay.id_map({7: 70, 8: 80, 9: 90})
    return each.select("g", "k", F.inline(overlay.remapped(pointers, F.get("off", F.col("n")), ids))).select("g", "k", F.col("key").cast("long").alias("key"), "product_id")


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


# Provenance and dependencies


EDGES = """SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, a, k, b, p in (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")):
        e = table(spark, d, t).select(F.concat(F.lit(a), F.col(k)).alias("child"), F.concat(F.lit(b), F.col(p)).alias("parent"))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.ancestor) SELECT * FROM c""")
def prov_closure(spark, d):
    return graph.ancestors(_edges(spark, d)).select("child", "ancestor")


@query(f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.ancestor),
k AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey <> 2) SELECT child, ancestor FROM c WHERE ancestor NOT IN (SELECT id FROM k)""")
def prov_missing(spark, d):
    have = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    have = have.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))).unionByName(table(spark, d, "region").where("r_regionkey <> 2").select(F.concat(F.lit("r"), "r_regionkey").alias("id")))
    return graph.missing(graph.ancestors(_edges(spark, d)), have, "id")


@query(f"""SELECT DISTINCT parent, child FROM ({EDGES})""")
def parent_child_map(spark, d):
    return graph.children(_edges(spark, d))


PLACES = "SELECT 'p' || p_partkey AS label, 'path' || p_partkey % 20 AS path, p_partkey // 20 AS pos FROM part"
NEEDS = f"""WITH l AS ({PLACES}), n AS (SELECT 'p' || p_partkey AS label, 'p' || (p_partkey * 3 + p_size) % (SELECT count(*) FROM part) AS on_ FROM part),
d AS (SELECT l.path, l.label, l.pos, on_, h.pos AS on_pos FROM n JOIN l USING (label) LEFT JOIN l h ON h.label = on_ AND h.path = l.path WHERE on_ IN (SELECT label FROM l))"""


def _deps(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    k, n = F.col("p_partkey"), part.count()
    places = part.select(F.concat(F.lit("p"), k).alias("label"), F.concat(F.lit("path"), k % 20).alias("path"), F.floor(k / 20).alias("pos"))
    consumes = part.select(F.concat(F.lit("p"), k).alias("label"), F.concat(F.lit("p"), (k * 3 + F.col("p_size")) % n).alias("from_label"), F.lit("any").alias("class"))
    produces = part.select(F.concat(F.lit("p"), k).alias("label"), F.lit("any").alias("class"))
    return graph.dependencies(consumes, produces, places)


@query(f"""{NEEDS} SELECT path, label, on_ AS "on" FROM d WHERE on_pos IS NULL""")
def cross_path_violations(spark, d):
    return graph.cross_path(_deps(spark, d))


@query(f"""{NEEDS} SELECT path, label, on_ AS "on", label = on_ AS itself FROM d WHERE on_pos >= pos""")
def order_violations(spark, d):
    return graph.out_of_order(_deps(spark, d))


# Time and memory tables


PERF = """WITH h AS (SELECT CAST(day(ts) AS BIGINT) AS Run, CAST(hour(ts) AS BIGINT) AS SubRun, event_id + 1 AS Event, event_type, user_id, round(value, 3) AS v FROM events),
TimeSource AS (SELECT Run, SubRun, Event, 'Reader' AS Source, round(v / 10, 3) AS Time FROM h), TimeEvent AS (SELECT Run, SubRun, Event, v AS Time FROM h),
TimeModule AS (SELECT Run, SubRun, Event, event_type AS Path, 'm' || user_id % 5 AS ModuleLabel, CASE WHEN user_id % 3 = 0 THEN 'Out(WRITE)' WHEN user_id % 3 = 1 THEN 'Filter' ELSE 'Out(write)' END AS ModuleType, v AS Time FROM h),
EventInfo AS (SELECT 'PreProcessEvent' AS Step, Run, SubRun, Event, v AS RSS, 2 * v AS Vsize FROM h UNION ALL SELECT 'PostProcessEvent', Run, SubRun, Event, round(v * (1 + Event % 7 / 10.0) - 1, 3), round(v * 2.5, 3) FROM h WHERE Event % 11 <> 0),
ModuleInfo AS (SELECT 'PreProcessModule' AS Step, Run, SubRun, Event, Path, ModuleLabel, ModuleType, Time AS RSS, 2 * Time AS Vsize FROM TimeModule UNION ALL
  SELECT 'PostProcessModule', Run, SubRun, Event, Path, ModuleLabel, ModuleType, round(Time * (1 + Event % 7 / 10.0) - 1, 0), round(Time * 2.5, 0) FROM TimeModule),
Full_ AS (SELECT Run, SubRun, Event, sum(Time) AS FullTime FROM (SELECT Run, SubRun, Event, Time FROM TimeEvent UNION SELECT Run, SubRun, Event, Time FROM TimeModule WHERE ModuleType ILIKE '%(write)' UNION SELECT Run, SubRun, Event, Time FROM TimeSource) GROUP BY ALL)"""


class Perf:
    def __init__(self, spark: SparkSession, d: str):
        h = header(spark, d).select(F.col("run").alias("Run"), F.col("subrun").alias("SubRun"), F.col("event").alias("Event"), "event_type", "user_id", F.round("value", 3).alias("v"))
        u = F.col("user_id")
        kind = F.when(u % 3 == 0, "Out(WRITE)").when(u % 3 == 1, "Filter").otherwise("Out(write)")
        ids = ["Run", "SubRun", "Event"]
        self.source = h.select(*ids, F.lit("Reader").alias("Source"), F.round(F.col("v") / 10, 3).alias("Time"))
        self.event = h.select(*ids, F.col("v").alias("Time"))
        self.module = h.select(*ids, F.col("event_type").alias("Path"), F.concat(F.lit("m"), u % 5).alias("ModuleLabel"), kind.alias("ModuleType"), F.col("v").alias("Time"))
        grown = lambda c, digits: F.round(F.col(c) * (1 + F.col("Event") % 7 / F.lit(10.0)) - 1, digits)
        pre = h.select(F.lit("PreProcessEvent").alias("Step"), *ids, F.col("v").alias("RSS"), (2 * F.col("v")).alias("Vsize"))
        self.event_info = pre.unionByName(h.where("Event % 11 <> 0").select(F.lit("PostProcessEvent").alias("Step"), *ids, grown("v", 3).alias("RSS"), F.round(F.col("v") * 2.5, 3).alias("Vsize")))
        m = ["Path", "ModuleLabel", "ModuleType"]
        pre = self.module.select(F.lit("PreProcessModule").alias("Step"), *ids, *m, F.col("Time").alias("RSS"), (2 * F.col("Time")).alias("Vsize"))
        self.module_info = pre.unionByName(self.module.select(F.lit("PostProcessModule").alias("Step"), *ids, *m, grown("Time", 0).alias("RSS"), F.round(F.col("Time") * 2.5, 0).alias("Vsize")))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes])


def perf_query(name: str, sql: str, f: Callable[[Perf], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, d: rounded(f(Perf(spark, d)))
    _SQL[name] = f"{PERF} {sql}"


_TIMES = "round(min({0}), 4) AS min_s, round(avg({0}), 4) AS avg_s, round(max({0}), 4) AS max_s, count(*) AS n"
_DELTA = "SELECT a.Run, a.SubRun, a.Event, b.{0} - a.{0} AS Delta FROM EventInfo a JOIN EventInfo b USING (Run, SubRun, Event) WHERE a.Step = 'PreProcessEvent' AND b.Step = 'PostProcessEvent'"
_MDELTA = "SELECT Path, ModuleLabel, ModuleType, Run, SubRun, Event, b.{0} - a.{0} AS Delta FROM ModuleInfo a JOIN ModuleInfo b USING (Path, ModuleLabel, ModuleType, Run, SubRun, Event) WHERE a.Step = 'PreProcessModule' AND b.Step = 'PostProcessModule'"
_TOP = "SELECT Path, ModuleLabel, ModuleType, Run, SubRun, Event, round({0}, 4) AS {0} FROM (SELECT *, rank() OVER (PARTITION BY Path, ModuleLabel ORDER BY {0} DESC) AS r FROM {1}) WHERE r <= 3 AND {0} > 0"
_POST = "(SELECT * FROM ModuleInfo WHERE Step = 'PostProcessModule')"

perf_query("q01_event_summary", f"SELECT 'Full Event' AS label, {_TIMES.format('FullTime')} FROM Full_", lambda p: performance.event_summary(p.source, p.event, p.module))
perf_query("q02_max_events", "SELECT Run, SubRun, Event, round(FullTime, 4) AS FullTime FROM (SELECT * FROM Full_ ORDER BY FullTime DESC, Run, SubRun, Event LIMIT 5)", lambda p: performance.slowest_events(p.source, p.event, p.module))
perf_query("q03_module_summary", f"SELECT Path, ModuleLabel, ModuleType, {_TIMES.format('Time')} FROM TimeModule GROUP BY ALL", lambda p: performance.module_summary(p.module))
perf_query("q04_read_summary", f"SELECT min(Source) AS Source, {_TIMES.format('Time')} FROM TimeSource", lambda p: performance.read_summary(p.source))
for _n, _v in (("q05_max_delta_rss_events", "RSS"), ("q06_max_delta_vsize_events", "Vsize")):
    perf_query(_n, f"SELECT Run, SubRun, Event, round(Delta, 4) AS Delta FROM ({_DELTA.format(_v)}) ORDER BY Delta DESC, Run, SubRun, Event LIMIT 5", lambda p, v=_v: performance.top_event_deltas(p.event_info, v))
for _n, _v in (("q07_max_delta_rss_modules", "RSS"), ("q08_max_delta_vsize_modules", "Vsize")):
    perf_query(_n, _TOP.format("Delta", f"({_MDELTA.format(_v)})"), lambda p, v=_v: performance.top_module_deltas(p.module_info, v))
for _n, _v in (("q09_max_rss_events", "RSS"), ("q10_max_vsize_events", "Vsize")):
    perf_query(_n, f"SELECT Run, SubRun, Event, round({_v}, 4) AS {_v} FROM EventInfo WHERE Step = 'PostProcessEvent' ORDER BY {_v} DESC, Run, SubRun, Event LIMIT 5", lambda p, v=_v: performance.top_events(p.event_info, v))
for _n, _v in (("q11_max_rss_modules", "RSS"), ("q12_max_vsize_modules", "Vsize")):
    perf_query(_n, _TOP.format(_v, _POST), lambda p, v=_v: performance.top_module_values(p.module_info, v))
perf_query("q13_peak_summary", "SELECT 'Peak virtual memory (MB)' AS Description, round(max(Vsize), 4) AS Value FROM EventInfo UNION ALL SELECT 'Peak resident set size (MB)', round(max(RSS), 4) FROM EventInfo", lambda p: performance.peak_usage(p.event_info).select("Description", "Value"))
perf_query("time_statistics", "SELECT Path, ModuleLabel, ModuleType, round(min(Time), 4) AS min_v, round(avg(Time), 4) AS mean_v, round(max(Time), 4) AS max_v, round(median(Time), 4) AS median_v, round(sqrt(avg(Time * Time)), 4) AS rms_v, round(stddev_pop(Time), 4) AS sd_v, count(*) AS n FROM TimeModule GROUP BY ALL", lambda p: performance.statistics(p.module, ["Path", "ModuleLabel", "ModuleType"], "Time"))
perf_query("full_event_times", "SELECT Run, SubRun, Event, round(FullTime, 4) AS FullTime FROM Full_", lambda p: performance.full_events(p.source, p.event, p.module))


FULL_CATALOG = f"""SELECT *, friendly_class || 's' AS "type", p_partkey AS product_id, CASE WHEN available THEN p_partkey * 10 END AS size FROM ({CATALOG})"""


def full_catalog(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    return c.withColumns({"type": F.concat("friendly_class", F.lit("s")), "product_id": F.col("p_partkey"), "size": F.when(F.col("available"), F.col("p_partkey") * 10)})


@query(f"""WITH c AS ({FULL_CATALOG}) SELECT level, process, count(*) AS n_total, count_if(available)::BIGINT AS n_present, count_if(NOT available)::BIGINT AS n_missing, CAST(sum(CASE WHEN available THEN size END) AS BIGINT) AS size FROM c GROUP BY ALL""")
def product_listing(spark, d):
    return products.totals(products.listing(full_catalog(spark, d)))


@query(f"""WITH c AS ({FULL_CATALOG}) SELECT level, process, process_seq, module_label, instance, "type", friendly_class, product_id, size, available AS present FROM c WHERE available""")
def product_details(spark, d):
    return products.listing(full_catalog(spark, d), only_present=True)


@query(f"""WITH c AS ({FULL_CATALOG}), f AS (SELECT *, CASE WHEN available THEN '  ' ELSE '- ' END AS mark FROM c) SELECT level, process_seq, mark || rpad(process, 10, ' ') || ' ' || rpad(module_label, 16, ' ') || ' ' || rpad(instance, 10, ' ') || ' ' ||
rpad("type", 24, ' ') || ' ' || rpad(product_id::VARCHAR, 10, ' ') || ' ' || coalesce(size::VARCHAR, '-') AS line FROM f""")
def product_lines(spark, d):
    return products.printed(products.listing(full_catalog(spark, d)))


@query(f"""WITH c AS ({CATALOG}), t AS (SELECT DISTINCT event, process_seq, module_label, instance, process FROM c WHERE friendly_class = 'Hit')
SELECT event, module_label || ':' || instance || ':' || process AS tag, row_number() OVER (PARTITION BY event ORDER BY process_seq DESC, module_label, instance) AS place FROM t""")
def product_tags(spark, d):
    return products.tags(catalog(spark, d), F.col("friendly_class") == "Hit", ["event"])


@query(f"""WITH i AS ({ITEMS_SQL}), n AS (SELECT *, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n FROM i) SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN pos ELSE n - 1 - pos END AS pos, l_partkey FROM n""")
def single_view(spark, d):
    """Even orders have a container in the primary file, all orders one in the secondary file, in reverse; a third kind cannot be viewed."""
    fixed = {"available": F.lit(True), "dropped": F.lit(False), "origin": F.lit("present"), "module_label": F.lit("m")}
    items = _items(spark, d).withColumns({**fixed, "kind": F.lit("Item")})
    rows = lookup.tiers(items.where("l_orderkey % 2 = 0"), items.withColumn("items", F.reverse("items"))).unionByName(items.withColumns({"kind": F.lit("Other"), "tier": F.lit(0)}))
    return products.single_view(rows, lookup.module_label("m"), ["l_orderkey"], F.col("kind") == "Item").select("l_orderkey", "pos", F.col("element.l_partkey").alias("l_partkey"))


STATUS = "['present', 'dummy', 'neverCreated', NULL]"
PARTS = f"""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, ['Event', 'SubRun', 'Run'][l_partkey % 3 + 1] AS level, l_suppkey % 7 = 0 AS dropped, l_linenumber % 2 = 0 AS produced, {STATUS}[l_orderkey % 4 + 1] AS status FROM lineitem"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return li.withColumns({
        "level": pick(["Event", "SubRun", "Run"], F.col("l_partkey") % 3), "dropped": F.col("l_suppkey") % 7 == 0, "produced": F.col("l_linenumber") % 2 == 0,
        "status": pick(["present", "dummy", "neverCreated", None], F.col("l_orderkey") % 4),
    })


@query(f"""WITH p AS ({PARTS}), c AS (SELECT *, max(coalesce(status = 'present', false)) OVER (PARTITION BY l_partkey, l_suppkey) AND level <> 'Event' AS after FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN dropped THEN false WHEN status IS NULL THEN after AND NOT produced WHEN level <> 'Event' AND NOT after THEN status = 'present' ELSE status IN ('present', 'dummy') END AS available FROM c""")
def availability(spark, d):
    return products.with_availability(_parts(spark, d), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "available")


@query(f"""WITH h AS ({HEADER}), e AS (SELECT DISTINCT run, subrun, event FROM h WHERE event % 9 <> 0), g AS (SELECT *, event - row_number() OVER (PARTITION BY run, subrun ORDER BY event) AS g FROM e),
r AS (SELECT run, subrun, min(event) AS begin, max(event) + 1 AS "end" FROM g GROUP BY run, subrun, g), p AS (SELECT run, count(*) AS total FROM h GROUP BY run)
SELECT run, total, false AS whole, begin, "end" FROM p JOIN r USING (run) UNION ALL SELECT run, total, true, NULL, NULL FROM p""")
def put_run_products(spark, d):
    h = header(spark, d)
    totals = h.groupBy("run").agg(F.count("*").alias("total"))
    seen = ranges.islands(h.where("event % 9 <> 0")).withColumn("whole", F.lit(False)).drop("subrun")
    cols = ["run", "total", "whole", "begin", "end"]
    return products.put_spanning(totals, ["run"], products.FRAGMENT, seen).select(*cols).unionByName(products.put_spanning(totals, ["run"], products.FULL).select(*cols))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def put_replaced(spark, d):
    return products.put(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "Run", "event_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b""")
def process_history(spark, d):
    return products.adjacent_unique(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(f"""WITH c AS ({CATALOG}) SELECT p_partkey, friendly_class <> 'Track' AND NOT transient AND NOT dropped AS kept, friendly_class = 'Track' AND NOT transient AND NOT dropped AS newly_dropped FROM c""")
def newly_dropped(spark, d):
    return products.newly_dropped(catalog(spark, d), kept(["keep *", "drop Track_*_*_*"])).select("p_partkey", "kept", "newly_dropped")


@query(f"""WITH c AS ({CATALOG}) SELECT event, p_partkey, module_label, instance, process FROM c WHERE module_label = 'modA' AND instance = '' AND available AND NOT dropped
UNION ALL SELECT p_partkey % 150, p_partkey + 1000000, 'emulated', '', 'SOURCE' FROM part""")
def inserted_products(spark, d):
    c = catalog(spark, d)
    rows = products.inserted(c.withColumn("p_partkey", F.col("p_partkey") + 1_000_000), "emulated", "SOURCE", 3)
    sel = lookup.tag_list(["modA", "emulated"]) & lookup.instance_name("")
    return c.unionByName(rows).where(sel & lookup.visible(None) & F.col("available")).select("event", "p_partkey", "module_label", "instance", "process")


# Limits, module totals, relations


@query(f"""WITH h AS ({HEADER}), l AS (SELECT *, dense_rank() OVER (ORDER BY run, subrun) AS k FROM h), e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM l WHERE k <= 40) SELECT run, subrun, event FROM e WHERE n <= 300""")
def processing_limits(spark, d):
    return sources.limited(header(spark, d), ["event_id"], max_events=300, max_subruns=40).select("run", "subrun", "event")


@query(f"""WITH h AS ({HEADER}), v AS (SELECT event % 2 = 0 AS c1, value > 30 AS c2 FROM h), n AS (SELECT count(*) AS n, count_if(c1) AS a, count_if(NOT c1) AS b, count_if(c2) AS c, count_if(c1 AND c2) AS ac FROM v)
SELECT 'even' AS label, 2 * n AS n_visited, n AS n_run, CAST(a AS BIGINT) AS n_passed, CAST(b AS BIGINT) AS n_failed, CAST(0 AS BIGINT) AS n_error FROM n
UNION ALL SELECT 'large', CAST(a AS BIGINT), CAST(a AS BIGINT), CAST(ac AS BIGINT), CAST(a - ac AS BIGINT), CAST(0 AS BIGINT) FROM n""")
def module_totals(spark, d):
    even, large = paths.Entry("even", F.col("event") % 2 == 0), F.col("value") > 30
    p = {"a": [even, paths.Entry("large", large)], "b": [paths.Entry("even", even.condition, "!")]}
    return paths.module_totals(paths.run_paths(header(spark, d), p), p)


RANGES = "SELECT user_id % 50 AS kind, run, subrun, min(event) AS b, max(event) + 1 AS e FROM h WHERE {} GROUP BY ALL"


@query(f"""WITH h AS ({HEADER}), l AS ({RANGES.format("event % 5 < 3")}), r AS ({RANGES.format("event % 5 > 1")}), lk AS (SELECT DISTINCT kind FROM l), rk AS (SELECT DISTINCT kind FROM r),
x AS (SELECT kind, count(*) AS n, count_if(l.b = r.b AND l.e = r.e) AS s FROM l JOIN r USING (kind, run, subrun) WHERE l.b < r.e AND r.b < l.e GROUP BY kind),
c AS (SELECT kind, (SELECT count(*) FROM l WHERE l.kind = lk.kind) AS nl, (SELECT count(*) FROM r WHERE r.kind = lk.kind) AS nr FROM lk JOIN rk USING (kind))
SELECT kind, CASE WHEN s = nl AND s = nr THEN 'same' WHEN n > 0 THEN 'overlapping' ELSE 'disjoint' END AS relation FROM c LEFT JOIN x USING (kind)""")
def range_relations(spark, d):
    h = header(spark, d).withColumn("kind", F.col("user_id") % 50)
    of = lambda rows: rows.groupBy("kind", "run", "subrun").agg(F.min("event").alias("begin"), (F.max("event") + 1).alias("end"))
    return ranges.relation(of(h.where("event % 5 < 3")), of(h.where("event % 5 > 1")), ["kind"])


# More of output files


@query(f"""WITH RECURSIVE h AS ({HEADER}), q AS (SELECT run, subrun, count(*) AS n FROM h GROUP BY run, subrun), g AS (SELECT *, row_number() OVER (ORDER BY run, subrun) AS k, CAST(lead(run) OVER (ORDER BY run, subrun) IS DISTINCT FROM run AS INT) AS ends FROM q),
r AS (SELECT k, 0 AS segment, n AS acc, 1 AS subs, ends AS runs FROM g WHERE k = 1 UNION ALL SELECT g.k, CASE WHEN c THEN segment + 1 ELSE segment END, CASE WHEN c THEN g.n ELSE acc + g.n END, CASE WHEN c THEN 1 ELSE subs + 1 END, CASE WHEN c THEN g.ends ELSE runs + g.ends END
FROM (SELECT *, acc >= 800 OR subs >= 30 OR runs >= 1 AS c FROM r) r JOIN g ON g.k = r.k + 1) SELECT run, subrun, CAST(segment AS BIGINT) AS segment FROM r JOIN g USING (k)""")
def segment_by_several_limits(spark, d):
    return segments.by_criteria(header(spark, d), "SubRun", max_events=800, max_subruns=30, max_runs=1).select("run", "subrun", "segment").distinct()


FILE_STATS = f"{SEGMENTS}, f AS (SELECT segment, arg_min(run, (run, subrun, event)) AS r, arg_max(run, (run, subrun, event)) AS top FROM s GROUP BY segment)"


@query(f"""{FILE_STATS}, n AS (SELECT segment, 'out_r' || lpad(r::VARCHAR, 4, '0') || '_' || top AS f FROM f) SELECT segment, f || '_' || lpad((row_number() OVER (PARTITION BY f ORDER BY segment) - 1)::VARCHAR, 2, '0') || '.dat' AS name FROM n""")
def file_names(spark, d):
    stats = segments.file_stats(segments.by_events(header(spark, d), ["event_id"], 700))
    return segments.file_names(stats, "%l_r%04r_%R_%02#.dat", label="out")


@query(f"""{SEGMENTS} SELECT segment, '{{"tier":"reco","n_events":"' || count(*) || '"}}' AS metadata FROM s GROUP BY segment""")
def file_metadata(spark, d):
    stats = segments.file_stats(segments.by_events(header(spark, d), ["event_id"], 700)).select("segment", "n_events")
    return segments.metadata(stats, {"tier": "raw"}, {"tier": "reco"})


@query(f"""{SEGMENTS} SELECT run, subrun, event, value, segment FROM s WHERE event_type = 'click'""")
def output_round_trip(spark, d):
    path = scratch(spark, "output")
    files.write_events(segments.by_events(header(spark, d), ["event_id"], 700), path, F.col("event_type") == "click", ["run", "subrun", "event", "value"])
    return files.read(spark, path).withColumn("segment", F.col("segment").cast("long"))


@query(f"""{SEGMENTS}, l AS (SELECT segment, 'Event' AS level, run, subrun, event FROM s UNION ALL (SELECT DISTINCT segment, 'SubRun', run, subrun, NULL FROM s) UNION ALL (SELECT DISTINCT segment, 'Run', run, NULL, NULL FROM s))
SELECT *, row_number() OVER (PARTITION BY segment, level ORDER BY run, subrun, event) - 1 AS entry FROM l""")
def file_index(spark, d):
    return files.index(segments.by_events(header(spark, d), ["event_id"], 700))


# More of mixing


#: Three secondary files: orders by their key modulo 3, and how many entries each has.
FILES = "z AS (SELECT count_if(o_orderkey % 3 = 0) AS s0, count_if(o_orderkey % 3 = 1) AS s1, count_if(o_orderkey % 3 = 2) AS s2 FROM orders)"


def _sizes(spark: SparkSession, d: str) -> list[int]:
    r = table(spark, d, "orders").agg(*[F.count_if(F.col("o_orderkey") % 3 == k).alias(f"s{k}") for k in range(3)]).first()
    return [r.s0, r.s1, r.s2]


@query(f"""WITH {FILES}, o AS (SELECT *, CAST(floor({overlay.random_start(11)!r} * s0) AS BIGINT) AS off FROM z), c AS (SELECT *, (s0 - off) // 3 AS b0, s0 // 3 AS f0, s1 // 3 AS f1, s2 // 3 AS f2 FROM o),
p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, c.* FROM events, c), q AS (SELECT *, k >= b0 + f1 + f2 AS again FROM p),
r AS (SELECT *, CASE WHEN again THEN (k - b0 - f1 - f2) % (f0 + f1 + f2) ELSE k END AS j, CASE WHEN again THEN f0 ELSE b0 END AS c0 FROM q)
SELECT event_id, CASE WHEN j < c0 THEN 0 WHEN j < c0 + f1 THEN 1 ELSE 2 END::BIGINT AS file, CAST(CASE WHEN j < c0 THEN 3 * j + CASE WHEN again THEN 0 ELSE off END WHEN j < c0 + f1 THEN 3 * (j - c0) ELSE 3 * (j - c0 - f1) END AS BIGINT) AS first FROM r""")
def mix_random_start(spark, d):
    return overlay.from_random_start(table(spark, d, "events").select("event_id"), ["event_id"], 3, _sizes(spark, d), seed=11)


@query(f"""WITH {FILES}, c AS (SELECT CAST(floor(s0 * 0.5 / 3) AS BIGINT) AS f0, CAST(floor(s1 * 0.5 / 3) AS BIGINT) AS f1, CAST(floor(s2 * 0.5 / 3) AS BIGINT) AS f2 FROM z),
p AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % (f0 + f1 + f2) AS k, c.* FROM events, c)
SELECT event_id, CASE WHEN k < f0 THEN 0 WHEN k < f0 + f1 THEN 1 ELSE 2 END::BIGINT AS file, CAST(3 * CASE WHEN k < f0 THEN k WHEN k < f0 + f1 THEN k - f0 ELSE k - f0 - f1 END AS BIGINT) AS first FROM p""")
def mix_files(spark, d):
    return overlay.files_for(table(spark, d, "events").select("event_id"), ["event_id"], 3, _sizes(spark, d), coverage=50)


@query(f"""WITH RECURSIVE {FILES}, p AS (SELECT event_id, event_id % 4 AS n, row_number() OVER (ORDER BY event_id) AS k FROM events),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS file, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS event_id
UNION ALL SELECT k, f, CASE WHEN f = file THEN used ELSE 0 END, CASE WHEN f = file THEN used ELSE 0 END + n, event_id FROM (SELECT p.k, p.n, p.event_id, r.file, r.used, CASE WHEN r.used + p.n > [s0, s1, s2][r.file + 1] THEN (r.file + 1) % 3 ELSE r.file END AS f FROM r JOIN p ON p.k = r.k + 1, z))
SELECT event_id, file, first FROM r WHERE k > 0""")
def mix_files_varying(spark, d):
    primaries = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("n"))
    return overlay.files_for(primaries, ["event_id"], "n", _sizes(spark, d)).select("event_id", "file", "first")


MIXED = """WITH p AS (SELECT event_id, event_id % 4 AS n, sum(event_id % 4) OVER (ORDER BY event_id) - event_id % 4 AS at_ FROM events), m AS (SELECT event_id, unnest(range(0, n)) AS i, at_ FROM p),
e AS (SELECT event_id, CAST((at_ + i) % (SELECT count(*) FROM part) AS BIGINT) AS entry FROM m), s AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS entry FROM part)"""


def _draws(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = ordinal(table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey"], "_n").withColumn("entry", F.col("_n") - 1).drop("_n")
    return overlay.consecutive(table(spark, d, "events").select("event_id"), ["event_id"], F.col("event_id") % 4, table(spark, d, "part").count(), wrap=True), part


@query(f"""{MIXED} SELECT event_id, CAST(sum(CASE WHEN p_size % 7 <> 0 THEN p_size END) AS BIGINT) AS total, CAST(count(CASE WHEN p_size % 7 <> 0 THEN 1 END) AS BIGINT) AS n FROM e JOIN s USING (entry) GROUP BY event_id HAVING n > 0""")
def mix_gather(spark, d):
    draws, part = _draws(spark, d)
    lists = overlay.gather(draws, part.withColumn("x", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("long"))), "event_id", "x", compact=True)
    out = overlay.mixed(lists, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b), F.size("products") > 0)
    return out.where("mixed IS NOT NULL").select("event_id", F.col("mixed").alias("total"), F.size("products").cast("long").alias("n"))


@query(f"""{MIXED} SELECT event_id, entry, s_name FROM e JOIN s USING (entry) LEFT JOIN supplier ON s_suppkey = p_size""")
def mix_parent_products(spark, d):
    draws, part = _draws(spark, d)
    parents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_size"), "s_name")
    return overlay.with_parents(draws, part, parents, ["p_size"]).select("event_id", "entry", "s_name")


# Secondary files, reports over provenance, streams, old tables


@query(f"""WITH c AS ({CATALOG}), t AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS t FROM c WHERE module_label = 'modC' AND available AND NOT dropped), m AS (SELECT *, min(t) OVER (PARTITION BY event) AS best FROM t)
SELECT event, p_partkey, CAST(t AS BIGINT) AS file FROM m WHERE t = best""")
def secondary_files(spark, d):
    c = catalog(spark, d)
    rows = lookup.tiers(c.where("p_partkey % 4 > 1"), c.where("p_partkey % 4 = 0"), c.where("p_partkey % 4 = 1"))
    return lookup.get_many(rows, lookup.module_label("modC"), ["event"]).select("event", "p_partkey", F.col("tier").cast("long").alias("file"))


@query(f"""WITH c AS ({CATALOG}) SELECT p_partkey, module_label, process FROM c WHERE available AND NOT dropped AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def provenance_report(spark, d):
    resolved = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return graph.provenances(catalog(spark, d), resolved=resolved).select("p_partkey", "module_label", "process")


@query("""WITH p AS (SELECT l_orderkey AS event, l_linenumber AS id, 'mod' || l_suppkey % 5 AS m FROM lineitem) SELECT DISTINCT event, m AS source, CAST(id AS VARCHAR) AS target, 'makes' AS kind FROM p
UNION ALL SELECT DISTINCT event, CAST(id - 1 AS VARCHAR), m, 'reads' FROM p WHERE id > 1""")
def data_flow(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("product_id"), F.concat(F.lit("mod"), F.col("l_suppkey") % 5).alias("module_label"))
    edges = p.where("product_id > 1").select("event", F.col("product_id").alias("child"), (F.col("product_id") - 1).alias("parent"))
    return graph.data_flow(p, edges)


@query(f"""{NEEDS} SELECT '  "' || label || '" -> "' || on_ || '" [label="path:' || path || '"];' AS line FROM d UNION ALL SELECT 'digraph {{' UNION ALL SELECT '}}'""")
def dependency_dot(spark, d):
    return graph.dot(_deps(spark, d).withColumn("kind", F.concat(F.lit("path:"), "path")), "label", "on", "kind")


@query(f"""WITH h AS ({HEADER}), n AS (SELECT *, (lag(subrun) OVER w IS DISTINCT FROM subrun)::INT AS b FROM h WINDOW w AS (PARTITION BY run ORDER BY event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY event_id) AS g FROM n) SELECT run, subrun, count(*) AS n_events, round(sum(value), 4) AS total, min(event) AS begin, max(event) + 1 AS "end" FROM g GROUP BY run, subrun, g""")
def stream_boundaries(spark, d):
    """The items of an input that ends, with a flush item at the end of each run, read as a stream."""
    items = boundaries.with_flush(header(spark, d).select("run", F.col("event_id").alias("seq"), "subrun", "event", "value"))
    path = scratch(spark, "items")
    items.write.parquet(path)
    stream = spark.readStream.schema(items.schema).parquet(path)
    return boundaries.run_available(boundaries.close_on_boundary(stream), scratch(spark, "stream")).withColumn("total", F.round("total", 4))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 3 = 1""")
def stream_prescale(spark, d):
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_id")
    return boundaries.run_available(boundaries.stream_prescale(rows, ["user_id"], "event_id", 3, 1), scratch(spark, "stream"))


@query(f"""WITH h AS ({HEADER}) SELECT run AS "Run", subrun AS "SubRun", event AS "Event", value AS "Time" FROM h""")
def migrated_times(spark, d):
    old = header(spark, d).select(F.concat_ws(":", "run", "subrun", "event").alias("id"), F.col("value").alias("FullTime"))
    return performance.migrated(old, "id", {"FullTime": "Time"})


# Selections over processes, statistics of files, graphs of jobs, what a reader or a job's configuration gives


@query(_select_sql("(st_hi = 'Pass' OR st_buy = 'Pass' AND st_hi <> 'Exception' AND st_buy <> 'Exception' OR st_err = 'Exception') AND NOT st_odd = 'Pass'"))
def event_select_process(spark, d):
    p = _paths()
    df = paths.run_paths(header(spark, d), {k: p[k] for k in ("hi", "buy")}, POLICY, process="HLT")
    df = paths.run_paths(df, {k: p[k] for k in ("err", "odd")}, POLICY, process="RECO")
    keep = paths.wanted_by_process({"HLT": ["hi", "buy"], "RECO": ["err", "odd"]}, "RECO", ["HLT:hi", "HLT:b*&noexception", "exception@e*"], ["odd"])
    return df.where(keep).select("run", "subrun", "event")


@query(f"""WITH h AS ({HEADER}) SELECT event, CASE WHEN value > 50 THEN CASE WHEN event_type = 'error' THEN 'Exception' ELSE 'Pass' END ELSE 'Fail' END AS st_p, CASE WHEN value > 50 AND event_type = 'error' THEN 1 ELSE CASE WHEN value > 50 THEN 2 ELSE 1 END END::BIGINT AS ix_p FROM h""")
def path_short_circuit(spark, d):
    """The module behind a failing one is not run: its category is not in the policy where it would fail, and would be raised again."""
    v, t = F.col("value"), F.col("event_type")
    category = F.when(v <= 50, "Unlisted").when(t == "error", "Skip")
    p = {"p": [paths.Entry("large", v > 50), paths.Entry("thrower", F.lit(True), error=category)]}
    return paths.run_paths(header(spark, d), p, {"Skip": "SkipEvent"}).select("event", "st_p", "ix_p")


@query(f"""WITH s AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 700 AS segment, '/in/f' || user_id % 3 AS file FROM ({HEADER})), a AS (SELECT segment, min((run, subrun)) AS lo, max((run, subrun)) AS hi FROM s GROUP BY segment),
b AS (SELECT s.*, lo, hi, min(ts) OVER (PARTITION BY s.segment, run) AS rt, min(ts) OVER (PARTITION BY s.segment, run, subrun) AS st FROM s JOIN a USING (segment))
SELECT segment, count(*) AS n_events, min(run) AS lowest_run, max(run) AS highest_run, arg_min(subrun, (run, subrun, event)) AS lowest_subrun, arg_max(subrun, (run, subrun, event)) AS highest_subrun, arg_min(event, (run, subrun, event)) AS lowest_event, arg_max(event, (run, subrun, event)) AS highest_event,
count(DISTINCT (run, subrun)) AS n_subruns, min(ts) AS opened, max(ts) AS closed, min(CASE WHEN (run, subrun) = lo THEN rt END) AS lowest_run_time, min(CASE WHEN (run, subrun) = hi THEN rt END) AS highest_run_time, min(CASE WHEN (run, subrun) = lo THEN st END) AS lowest_subrun_time,
min(CASE WHEN (run, subrun) = hi THEN st END) AS highest_subrun_time, list_sort(list(DISTINCT replace(file, '/in/', ''))) AS parents FROM b GROUP BY segment""")
def file_statistics(spark, d):
    s = segments.by_events(header(spark, d), ["event_id"], 700).withColumn("file", F.concat(F.lit("/in/f"), F.col("user_id") % 3))
    return segments.file_statistics(s)


@query(f"""WITH h AS ({HEADER}), r AS (SELECT run, subrun, min(event) AS begin, max(event) + 1 AS "end" FROM h GROUP BY ALL), l AS (SELECT max((run, subrun, event)) AS e FROM h WHERE value > 60)
SELECT run, subrun, begin, "end", (run, subrun, "end" - 1) <= e AS seen FROM r, l""")
def closed_ranges(spark, d):
    h = header(spark, d)
    return ranges.closed_ranges(h.where("value > 60"), h.groupBy("run", "subrun").agg(F.min("event").alias("begin"), (F.max("event") + 1).alias("end")))


@query(f"""WITH h AS ({HEADER}), e AS (SELECT run, subrun, event, event - row_number() OVER (PARTITION BY run, subrun ORDER BY event) AS g FROM h WHERE event % 9 <> 0), r AS (SELECT run, subrun, min(event) AS begin FROM e GROUP BY run, subrun, g),
l AS (SELECT run, subrun, max(event) AS last FROM h WHERE event_type = 'click' GROUP BY ALL) SELECT run, subrun, last, count_if(begin <= last)::BIGINT AS n_seen FROM r JOIN l USING (run, subrun) GROUP BY ALL""")
def current_range(spark, d):
    h = header(spark, d)
    return ranges.current_range(h.where("event_type = 'click'"), ranges.islands(h.where("event % 9 <> 0")))


READS = """SELECT user_id % 5 AS file, event_id AS pos, event_id % 97 <> 96 AS more, CASE WHEN event_id % 40 < 5 THEN event_id // 40 % 9 END AS new_run, CASE WHEN event_id % 8 < 3 THEN event_id // 8 % 6 END AS new_subrun,
CASE WHEN event_id % 8 < 3 THEN event_id // 40 % 9 END AS subrun_run, CASE WHEN event_id % 3 <> 0 THEN event_id % 501 END AS new_event, CASE WHEN event_id % 3 <> 0 THEN event_id // 40 % 9 END AS event_run, CASE WHEN event_id % 3 <> 0 THEN event_id // 8 % 6 END AS event_subrun FROM events"""


@query(f"""WITH i AS ({READS}), w AS (SELECT *, last_value(new_run IGNORE NULLS) OVER b AS r0, last_value(CASE WHEN new_subrun IS NOT NULL THEN subrun_run END IGNORE NULLS) OVER b AS sr0, last_value(new_subrun IGNORE NULLS) OVER b AS s0 FROM i WINDOW b AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, coalesce(new_run, r0) AS run, CASE WHEN new_subrun IS NOT NULL THEN subrun_run ELSE sr0 END AS fr, CASE WHEN new_subrun IS NOT NULL THEN new_subrun ELSE s0 END AS fs, new_run IS NOT NULL OR new_subrun IS NOT NULL OR new_event IS NOT NULL AS anything FROM w)
SELECT file, pos, rule FROM (SELECT file, pos, unnest([CASE WHEN more AND NOT anything THEN 'nothing_new' END, CASE WHEN NOT more AND anything THEN 'data_at_end' END, CASE WHEN more AND run IS NULL THEN 'no_run' END, CASE WHEN more AND fs IS NULL THEN 'no_subrun' END, CASE WHEN more AND new_run = r0 THEN 'same_run' END,
CASE WHEN more AND new_subrun = s0 AND subrun_run = sr0 THEN 'same_subrun' END, CASE WHEN more AND r0 IS NOT NULL AND s0 IS NOT NULL AND new_run IS NOT NULL AND new_subrun IS NULL AND new_event IS NOT NULL THEN 'event_without_subrun' END, CASE WHEN more AND subrun_run <> run THEN 'run_mismatch' END,
CASE WHEN more AND (event_run <> fr OR event_subrun <> fs) THEN 'subrun_mismatch' END, CASE WHEN more AND (new_run = 0 OR new_event = 0) THEN 'invalid_id' END]) AS rule FROM c) WHERE rule IS NOT NULL""")
def stream_violations(spark, d):
    i, whole = F.col("event_id"), lambda n, m: F.floor(F.col("event_id") / n).cast("long") % m
    run, sub, some = whole(40, 9), whole(8, 6), i % 3 != 0
    items = table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("file"), i.alias("pos"), (i % 97 != 96).alias("more"), F.when(i % 40 < 5, run).alias("new_run"), F.when(i % 8 < 3, sub).alias("new_subrun"), F.when(i % 8 < 3, run).alias("subrun_run"),
        F.when(some, i % 501).alias("new_event"), F.when(some, run).alias("event_run"), F.when(some, sub).alias("event_subrun"),
    )
    return sources.stream_violations(items)


GRAPH = f"""WITH l AS ({PLACES}), k AS (SELECT 'p' || p_partkey AS label, p_size % 3 = 0 AS f FROM part), n AS (SELECT DISTINCT 'p' || p_partkey AS a, 'p' || (p_partkey * 3 + p_size) % (SELECT count(*) FROM part) AS b FROM part),
x AS (SELECT path, label, lag(label) OVER w AS p0, lead(label) OVER w AS n0, last_value(CASE WHEN f THEN label END IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f0 FROM l JOIN k USING (label) WINDOW w AS (PARTITION BY path ORDER BY pos)),
g AS (SELECT a AS source, b AS target, 'prod' AS kind FROM n UNION SELECT label, p0, 'path:' || path FROM x WHERE p0 IS NOT NULL UNION SELECT label, 'input_source', 'source:' || path FROM x WHERE p0 IS NULL UNION SELECT label, f0, 'filter:' || path FROM x WHERE f0 IS NOT NULL
UNION SELECT 'TriggerResults', label, 'sync' FROM x WHERE n0 IS NULL UNION SELECT 'end' || s_suppkey, 'TriggerResults', 'sync' FROM supplier UNION SELECT 'end' || s_suppkey, 'TriggerResults', 'filter:path' || s_suppkey % 20 FROM supplier WHERE s_suppkey % 4 = 0)"""


def _module_graph(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    k, n, label = F.col("p_partkey"), part.count(), F.concat(F.lit("p"), "p_partkey").alias("label")
    places = part.select(label, F.concat(F.lit("path"), k % 20).alias("path"), F.floor(k / 20).alias("pos"))
    kinds = part.select(label, F.when(F.col("p_size") % 3 == 0, "filter").otherwise("producer").alias("kind"))
    needs = part.select(label, F.concat(F.lit("p"), (k * 3 + F.col("p_size")) % n).alias("on"))
    ends = supplier.select(F.concat(F.lit("end"), "s_suppkey").alias("label"))
    selects = supplier.where("s_suppkey % 4 = 0").select(F.concat(F.lit("end"), "s_suppkey").alias("label"), F.concat(F.lit("path"), F.col("s_suppkey") % 20).alias("path"))
    return graph.module_graph(places, kinds, needs, ends, selects)


@query(f"{GRAPH} SELECT * FROM g")
def module_graph(spark, d):
    return _module_graph(spark, d)


@query(f"""{GRAPH} SELECT '  "' || source || '" -> "' || target || '" [label="' || kind || '" ' || CASE split_part(kind, ':', 1) WHEN 'prod' THEN 'style=bold' WHEN 'filter' THEN 'color=red' WHEN 'path' THEN 'style=solid' ELSE 'style=dashed' END || '];' AS line FROM g UNION ALL SELECT 'digraph {{' UNION ALL SELECT '}}'""")
def module_graph_dot(spark, d):
    return graph.dot(_module_graph(spark, d), "source", "target", "kind", graph.edge_style(F.col("kind")))


IDS = "SELECT 'n' || n_nationkey AS id, n_nationkey AS k FROM nation UNION ALL SELECT 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, o_orderkey FROM orders"


@query(f"""WITH RECURSIVE i AS ({IDS}), p AS (SELECT id, k % 5 <> 0 AS available, k % 7 <> 0 AS prov, k % 11 <> 0 AS mapped, k % 13 <> 0 AS described FROM i WHERE k % 17 <> 3), e AS ({EDGES}), s AS (SELECT id FROM p WHERE available AND prov),
c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.ancestor), u AS (SELECT DISTINCT ancestor AS id FROM c WHERE child IN (SELECT id FROM s)), seen AS (SELECT id FROM p WHERE NOT available OR prov)
SELECT DISTINCT id, 'no_provenance' AS kind FROM p WHERE available AND NOT prov UNION SELECT id, 'not_in_map' FROM (SELECT id FROM s UNION SELECT id FROM u) WHERE id NOT IN (SELECT id FROM p WHERE mapped)
UNION SELECT id, 'not_in_event' FROM u WHERE id NOT IN (SELECT id FROM seen) UNION SELECT id, 'not_described' FROM (SELECT id FROM u UNION SELECT id FROM seen) WHERE id NOT IN (SELECT id FROM p WHERE described)""")
def prov_missing_kinds(spark, d):
    ids = None
    for name, letter, key in (("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("orders", "o", "o_orderkey")):
        rows = table(spark, d, name).select(F.concat(F.lit(letter), key).alias("id"), F.col(key).alias("k"))
        ids = rows if ids is None else ids.unionByName(rows)
    p = ids.where("k % 17 <> 3")
    return graph.missing_kinds(p.select("id", F.expr("k % 5 <> 0").alias("available"), F.expr("k % 7 <> 0").alias("has_provenance")), _edges(spark, d), p.where("k % 11 <> 0").select("id"), p.where("k % 13 <> 0").select("id"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS side, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS key, count(*) FILTER (WHERE o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, CAST(key + CASE WHEN side = 1 THEN n ELSE 0 END AS INT) AS key, o_orderkey AS value FROM o""")
def map_union(spark, d):
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderkey"))))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(side(0).alias("a"), side(1).alias("b"))
    keyed = lambda c: F.map_from_entries(F.transform(c, lambda x, i: F.struct(i.alias("key"), x.alias("value"))))
    return lists.select("o_custkey", F.explode(overlay.shifted_union(keyed("a"), keyed("b"))).alias("key", "value"))


@query("SELECT DISTINCT l_partkey AS old_id, 2 * l_partkey + 1 AS new_id FROM lineitem")
def id_maps(spark, d):
    return overlay.check_id_maps(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("file"), F.col("l_partkey").alias("old_id"), (2 * F.col("l_partkey") + 1).alias("new_id")))


@query(f"""{SEGMENTS} SELECT 'index' AS section, count(*) AS n FROM (SELECT DISTINCT segment, run, subrun, event FROM s UNION ALL SELECT DISTINCT segment, run, subrun, NULL FROM s UNION ALL SELECT DISTINCT segment, run, NULL, NULL FROM s)
UNION ALL SELECT 'history', count(*) FROM (SELECT DISTINCT event_type FROM s) UNION ALL SELECT 'metadata', count(DISTINCT segment) FROM s""")
def output_sections(spark, d):
    s, path = segments.by_events(header(spark, d), ["event_id"], 700), scratch(spark, "output")
    stats = segments.file_stats(s).select("segment", "n_events")
    files.write_tail(path, {"metadata": segments.metadata(stats, {"tier": "raw"}), "index": files.index(s), "history": s.select("event_type").distinct()})
    return files.read(spark, path, "index").agg(F.lit("index").alias("section"), F.count("*").alias("n")).unionByName(files.read(spark, path, "history").agg(F.lit("history").alias("section"), F.count("*").alias("n"))).unionByName(files.read(spark, path, "metadata").agg(F.lit("metadata").alias("section"), F.count("*").alias("n")))


@query(f"""WITH h AS ({HEADER}) SELECT run, subrun, event, true AS is_real, 'Data' AS kind, to_timestamp(event * 60)::TIMESTAMP AS ts FROM h""")
def timestamped_principals(spark, d):
    return sources.principals(header(spark, d).select("run", "subrun", "event")).withColumn("ts", F.timestamp_seconds(F.col("event") * 60))


perf_query("time_report", """, a AS (SELECT 'Full event' AS name, FullTime AS Time FROM Full_ UNION ALL SELECT 'source:' || Source || '(read)', Time FROM TimeSource UNION ALL SELECT Path || ':' || ModuleLabel || ':' || ModuleType, Time FROM TimeModule)
SELECT name, round(min(Time), 4) AS min_v, round(avg(Time), 4) AS mean_v, round(max(Time), 4) AS max_v, round(median(Time), 4) AS median_v, round(sqrt(avg(Time * Time)), 4) AS rms_v, round(stddev_pop(Time), 4) AS sd_v, count(*) AS n FROM a GROUP BY name""", lambda p: performance.time_report(p.source, p.event, p.module))
perf_query("module_list", "SELECT DISTINCT Path, ModuleLabel, ModuleType FROM TimeModule", lambda p: performance.modules(p.module))

JOB = {
    "process_name": "RECO",
    "physics": {
        "producers": {"hits": {}, "tracks": {}}, "filters": {"good": {}, "spare": {}}, "analyzers": {"plots": {}}, "trigger_paths": ["1:main", "side"], "end_paths": ["out"],
        "main": ["hits", "!good", "tracks"], "side": ["hits"], "out": ["plots", "write"], "idle": ["spare"],
    },
    "outputs": {"write": {}},
}


@query("""SELECT * FROM (VALUES ('trigger_path', '1:main', 'hits !good tracks'), ('trigger_path', '1:side', 'hits'), ('end_path', 'end_path', 'plots write'), ('module', 'good', 'filters'), ('module', 'hits', 'producers'), ('module', 'plots', 'analyzers'),
('module', 'tracks', 'producers'), ('module', 'write', 'outputs'), ('unused_path', 'idle', ''), ('unused_module', 'spare', '')) t(what, name, value)""".replace("1:side", "2:side"))
def workflow_summary(spark, d):
    job = {**JOB, "physics": {**JOB["physics"], "trigger_paths": ["1:main", "2:side"]}}
    return spark.createDataFrame(workflow.compile_workflow(job).summary("full"), "what string, name string, value string")


@query("""SELECT * FROM (VALUES ('a', 'data_tier', 'reco'), ('a', 'stream_name', 'a'), ('a', 'group', 'g'), ('b', 'data_tier', 'raw'), ('b', 'stream_name', 'special'), ('b', 'group', 'g')) t(output, key, value)""")
def catalog_options(spark, d):
    found = workflow.catalog_metadata({"a": {}, "b": {"stream_name": "x"}}, ["a:reco", "raw"], ["b:special"], application_family="f", application_version="v", group="g")
    rows = [(o, k, v) for o, values in found.items() for k, v in values.items() if k in ("data_tier", "stream_name", "group")]
    return spark.createDataFrame(rows, "output string, key string, value string")
