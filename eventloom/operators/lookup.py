"""Product lookup by label, instance and process: newest process first, one match, visibility by path; many matches; views and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.patterns import InputTag, glob_regex

CURRENT, INPUT = "current_process", "input_source"


def module_label(x: str) -> Column:
    return F.col("module_label") == x


def instance_name(x: str) -> Column:
    return F.col("instance") == x


def process_name(x: str) -> Column:
    """An empty name or `*` is any process."""
    return F.lit(True) if x in ("", "*") else F.col("process").rlike(f"^(?:{glob_regex(x)})$")


def tag_list(tags: list[str]) -> Column:
    """Any of the tags; here an empty instance or process is a wildcard."""
    one = lambda t: module_label(t.label) & (instance_name(t.instance) if t.instance else F.lit(True)) & process_name(t.process)
    return reduce(Column.__or__, [one(InputTag.parse(t)) for t in tags], F.lit(False))


def origin(process: str, own: str) -> Column:
    """Special process names: own products only, inputs only, or both if empty."""
    if not process:
        return F.lit(True)
    return F.col("origin") == "produced" if process in (CURRENT, own) else F.col("origin") == "present"


def by_tag(tag: InputTag | str, own: str = "") -> Column:
    """Exact label and instance; an empty instance is the empty one."""
    t = InputTag.parse(tag) if isinstance(tag, str) else tag
    named = F.lit(True) if t.process in ("", CURRENT, INPUT) else F.col("process") == t.process
    return module_label(t.label) & instance_name(t.instance) & named & origin(t.process, own)


def visible(path_labels: list[str] | None) -> Column:
    """On a path, products of this process are seen only from modules of that path; dropped products never."""
    seen = F.lit(True) if path_labels is None else (F.col("origin") != "produced") | F.col("module_label").isin(path_labels)
    return seen & ~F.coalesce(F.col("dropped"), F.lit(False))


def tiers(primary: DataFrame, *secondaries: DataFrame) -> DataFrame:
    """One catalog over the primary file and the secondary files in their order, as tiers 0, 1, ...: lookups stop at the first with a hit."""
    return reduce(DataFrame.unionByName, [c.withColumn("tier", F.lit(k)) for k, c in enumerate((primary, *secondaries))])


def resolve(catalog: DataFrame, selector: Column, keys: list[str], path_labels: list[str] | None = None) -> DataFrame:
    """The one product for each key: available, visible, of the newest process that has one.

    Catalog rows need process_seq (greater is newer), available, dropped, origin and tier (0 produced or primary file, then secondary
    files in order). Two matches in that process raise an error; keys without a match have no row.
    """
    rows = catalog.where(selector & visible(path_labels) & F.col("available"))
    best = Window.partitionBy(*keys).orderBy("tier", F.desc("process_seq"))
    same = Window.partitionBy(*keys, "tier", "process_seq")
    first = rows.withColumns({"_rank": F.dense_rank().over(best), "_n": F.count("*").over(same)}).where("_rank = 1")
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("several products of one process match")).cast("boolean")).otherwise(True)
    return first.where(checked).drop("_rank", "_n")


def require(keys_df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """found, or an error where a key has no product."""
    out = keys_df.join(found.withColumn("_hit", F.lit(True)), keys, "left")
    return out.where(F.when(F.col("_hit").isNull(), F.raise_error(F.lit("no such product")).cast("boolean")).otherwise(True)).drop("_hit")


def get_many(catalog: DataFrame, selector: Column, keys: list[str], path_labels: list[str] | None = None) -> DataFrame:
    """All matches of the first tier that has any, newest process first (column `place` from 1)."""
    rows = catalog.where(selector & visible(path_labels) & F.col("available"))
    rows = rows.withColumn("_t", F.min("tier").over(Window.partitionBy(*keys))).where("tier = _t").drop("_t")
    order = Window.partitionBy(*keys).orderBy(F.desc("process_seq"), "module_label", "instance")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def view(df: DataFrame, collection: str, keys: list[str]) -> DataFrame:
    """The elements of a collection with their place from 0."""
    return df.select(*keys, F.posexplode(collection).alias("pos", "element"))


def follow(pointers: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Dereferences (product_id, key) pointers: an equi-join on event, product and place; null pointers stay without a target."""
    return pointers.join(elements, [*keys, "product_id", "key"], "left")


def partner(associations: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """An association seen from its other side."""
    return associations.withColumnsRenamed({left: "_l", right: left}).withColumnRenamed("_l", right)
