"""Module dependencies and provenance as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.tables import materialize


def dependencies(consumes: DataFrame, produces: DataFrame, places: DataFrame) -> DataFrame:
    """(path, label, pos, on, on_pos): what each module of a path needs from modules of this process.

    A need names its producer, or is any earlier producer of the class where from_label is empty. A producer that is on no path here is
    the input source and gives no edge; one that is on another path only has a null on_pos.
    """
    need = consumes.join(places, "label").withColumnRenamed("from_label", "on")
    named = need.where("on <> ''").join(places.select(F.col("label").alias("on")).distinct(), "on", "left_semi")
    here = places.select("path", F.col("label").alias("on"), F.col("pos").alias("on_pos"))
    named = named.join(here, ["path", "on"], "left").select("path", "label", "pos", "on", "on_pos")
    makers = places.join(produces, "label").select("path", F.col("label").alias("on"), F.col("pos").alias("on_pos"), "class")
    many = need.where("on = ''").drop("on").join(makers, ["path", "class"]).where("on_pos < pos").select("path", "label", "pos", "on", "on_pos")
    return named.unionByName(many).distinct()


def cross_path(deps: DataFrame) -> DataFrame:
    """Modules that need a module which is not on their path."""
    return deps.where("on_pos IS NULL").select("path", "label", "on")


def out_of_order(deps: DataFrame) -> DataFrame:
    """Modules that need one at the same or a later place; `itself` marks a module that needs its own product."""
    return deps.where("on_pos >= pos").select("path", "label", "on", (F.col("label") == F.col("on")).alias("itself"))


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor): the transitive closure by doubling, whatever its depth; cycles are followed once.

    After round i all pairs of up to 2^i links are known. A pair of more links, up to twice as many, begins with one that became known
    in that round, so only those are joined, and rounds go on until one finds nothing new. Each round is cut from its lineage.
    """
    known = new = materialize(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct())
    while not new.isEmpty():
        step = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_up"))
        found = new.join(step, "ancestor").select("child", F.col("_up").alias("ancestor")).distinct()
        new = materialize(found.join(known, ["child", "ancestor"], "left_anti"))
        known = known.unionByName(new)
    return known


MISSING = ("no_provenance", "not_in_map", "not_in_event", "not_described")


def missing_kinds(products: DataFrame, edges: DataFrame, mapped: DataFrame, described: DataFrame) -> DataFrame:
    """(id, kind) of what a provenance check misses, each once.

    no_provenance: available products without one; not_in_map: available products, and ancestors of those with a provenance, that the
    map of provenances does not hold; not_in_event: ancestors that are no product of the event with a provenance of its own or not
    available; not_described: ancestors and products without a description. products: id, available, has_provenance; edges: child,
    parent; mapped and described: id.
    """
    there = products.where("available")
    bare = there.where("NOT has_provenance").select("id")
    sound = there.where("has_provenance").select("id")
    up = ancestors(edges).join(sound.withColumnRenamed("id", "child"), "child", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    seen = products.where("NOT available OR has_provenance").select("id").distinct()
    kinds = {
        "no_provenance": bare, "not_in_map": sound.unionByName(up).join(mapped, "id", "left_anti"),
        "not_in_event": up.join(seen, "id", "left_anti"), "not_described": up.unionByName(seen).join(described, "id", "left_anti"),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.select("id", F.lit(kind).alias("kind")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


SOURCE, RESULTS = "input_source", "TriggerResults"


def module_graph(places: DataFrame, kinds: DataFrame, needs: DataFrame, ends: DataFrame, selects: DataFrame) -> DataFrame:
    """(source, target, kind): what each module of a job waits for.

    places: path, label, pos; kinds: label, kind (filter and others); needs: label, on; ends: the labels of the end path; selects: label,
    path (an end-path module's selections). Kinds of edges: prod, path:<path> (the module before), source:<path> (a path's first module),
    filter:<path> (the last filter before, and selections), sync (results after the last modules, the end path after the results).
    """
    w = Window.partitionBy("path").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = places.join(kinds, "label", "left").withColumns({
        "_before": F.lag("label").over(w), "_after": F.lead("label").over(w), "_filter": F.last(F.when(F.col("kind") == "filter", F.col("label")), ignorenulls=True).over(before),
    })
    edge = lambda df, u, v, kind: df.select(u.alias("source"), v.alias("target"), kind.alias("kind"))
    label, of = F.col("label"), lambda kind: F.concat(F.lit(f"{kind}:"), F.col("path"))
    # With no trigger path there are no results, and the end path waits for the source.
    some = not places.isEmpty()
    chosen = selects.join(ends, "label", "left_semi").where(F.lit(some))
    parts = [
        edge(needs, label, F.col("on"), F.lit("prod")), edge(p.where("_before IS NOT NULL"), label, F.col("_before"), of("path")),
        edge(p.where("_before IS NULL"), label, F.lit(SOURCE), of("source")), edge(p.where("_filter IS NOT NULL"), label, F.col("_filter"), of("filter")),
        edge(p.where("_after IS NULL"), F.lit(RESULTS), label, F.lit("sync")), edge(ends, label, F.lit(RESULTS if some else SOURCE), F.lit("sync")),
        edge(chosen, label, F.lit(RESULTS), of("filter")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def edge_style(kind: Column) -> Column:
    """How an edge of module_graph() is drawn."""
    name = F.split(kind, ":")[0]
    return F.when(name == "prod", "style=bold").when(name == "filter", "color=red").when(name == "path", "style=solid").otherwise("style=dashed")


def missing(closure: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ancestors that are not among the present products."""
    return closure.join(present.select(F.col(key).alias("ancestor")), "ancestor", "left_anti").select("child", "ancestor")


def provenances(catalog: DataFrame, present_only: bool = True, resolved: DataFrame | None = None) -> DataFrame:
    """Catalog rows to report: present ones, and only those of a set of resolved products (keys in common) if one is given."""
    rows = catalog.where("available AND NOT dropped") if present_only else catalog
    return rows if resolved is None else rows.join(resolved, resolved.columns, "left_semi")


def data_flow(products: DataFrame, edges: DataFrame) -> DataFrame:
    """(event, source, target, kind): a module makes a product, and a product is read by the module that makes its child.

    products: event, product_id, module_label; edges: event, child, parent.
    """
    made = products.select("event", F.col("module_label").alias("source"), F.col("product_id").cast("string").alias("target"), F.lit("makes").alias("kind"))
    maker = products.select("event", F.col("product_id").alias("child"), "module_label")
    read = edges.join(maker, ["event", "child"]).select("event", F.col("parent").cast("string").alias("source"), F.col("module_label").alias("target"), F.lit("reads").alias("kind"))
    return made.unionByName(read).distinct()


def children(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """parent -> child, each once."""
    return edges.select(parent, child).distinct()


def dot(edges: DataFrame, source: str, target: str, label: str | None = None, style: Column | None = None) -> DataFrame:
    """The lines of a digraph, in order; edges stay distributed until they are written. style: attributes of an edge."""
    named = F.concat(F.lit('label="'), F.col(label), F.lit('"')) if label else None
    attributes = [a for a in (named, style) if a is not None]
    text = F.concat(F.lit('  "'), F.col(source), F.lit('" -> "'), F.col(target), F.lit('"'), F.concat(F.lit(" ["), F.concat_ws(" ", *attributes), F.lit("]")) if attributes else F.lit(""), F.lit(";"))
    lines = edges.select(text.alias("line"), F.lit(1).alias("place")).distinct()
    ends = edges.sparkSession.createDataFrame([("digraph {", 0), ("}", 2)], "line string, place int")
    return lines.unionByName(ends).orderBy("place", "line").select("line")
