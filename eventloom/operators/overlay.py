"""Mixing: entries of a secondary stream sampled for each primary event, flattened, with references moved along."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.tables import in_order, materialize, ordinal, running_sum


def uniform(*keys, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys: the same on every run, partitioning and engine (52 bits of it)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def consecutive(primaries: DataFrame, order: list, n: Column, size: int, start: Column | int = 0, wrap: bool = False) -> DataFrame:
    """(primary columns, entry): each primary takes the next n entries of the secondary stream; entry counts from 0.

    Entries are dealt by a running sum over the primaries. A primary for which too few are left raises an error, unless wrap.
    """
    p = running_sum(primaries.withColumn("_take", n.cast("long")), order, "_take", "_sum")
    at = F.col("_sum") + (F.lit(start) if isinstance(start, int) else start)
    p = p.withColumn("_at", at).where("_take > 0").withColumn("entry", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_take") - 1)))
    short = F.when(F.col("entry") >= size, F.raise_error(F.lit("too few secondary events")).cast("boolean")).otherwise(True)
    p = p.withColumn("entry", F.pmod("entry", F.lit(size))) if wrap else p.where(short)
    return p.drop("_take", "_sum", "_at")


def with_replacement(primaries: DataFrame, key: str, n: int, size: int, seed: int = 0) -> DataFrame:
    """(primary columns, place, entry): n entries each, drawn evenly and with repeats, in rising order (place from 0)."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: F.floor(uniform(key, d, seed=seed) * size).cast("long"))
    return primaries.select("*", F.posexplode(F.array_sort(draws)).alias("place", "entry"))


def distinct_within(primaries: DataFrame, key: str, n: int, size: int, seed: int = 0) -> DataFrame:
    """(primary columns, place, entry): n different entries for each primary, every set of them as likely, in rising order (place from 0).

    Entries are drawn evenly and one that came before is drawn again. Where more than half of the stream is wanted, those to leave out
    are drawn instead.
    """
    if n > size:
        raise ValueError("more entries than the stream has")
    few = min(n, size - n)
    # At least every other draw is new, so that so many draws are too few with a probability of less than 2^-60.
    draws = F.sequence(F.lit(1), F.lit(4 * few + 120))
    none = F.array().cast("array<bigint>")

    def draw(have: Column, d: Column) -> Column:
        entry = F.floor(uniform(key, d, seed=seed) * size).cast("long")
        return F.when((F.size(have) < few) & ~F.array_contains(have, entry), F.concat(have, F.array(entry))).otherwise(have)

    got = F.aggregate(draws, none, draw)
    df = primaries.withColumn("_got", F.when(F.size(got) == few, got).otherwise(F.raise_error(F.lit("too few draws")).cast("array<bigint>")))
    if few < n:
        df = df.withColumn("_got", F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), "_got"))
    return df.select("*", F.posexplode(F.array_sort("_got")).alias("place", "entry")).drop("_got")


def shuffled(secondary: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The stream with `entry` numbered in a hash order, for use without replacement by consecutive()."""
    return ordinal(secondary, [uniform(F.col(key), seed=seed), F.col(key)], "entry").withColumn("entry", F.col("entry") - 1)


def random_start(seed: int) -> float:
    """A place in the stream, as a share of its size, for a sequential walk from a drawn start."""
    return random.Random(seed).random()


def from_random_start(primaries: DataFrame, order: list, n: int | str, sizes: list[int], seed: int = 0, wrap: bool = True) -> DataFrame:
    """files_for() from a drawn entry of the first file; the files after it, and it when its turn comes again, are begun at their start."""
    return files_for(primaries, order, n, sizes, wrap=wrap, first=int(random_start(seed) * sizes[0]))


def files_for(primaries: DataFrame, order: list, n: int | str, sizes: list[int], coverage: float = 1.0, wrap: bool = True, first: int = 0) -> DataFrame:
    """Adds file and first (entry): a request never spans files; a file is left when a request does not fit.

    coverage over 1 is a percentage. first: the entry at which the first file is begun, the first time only. With one n for all primaries
    the place follows from the primary's ordinal; with a column of counts the counts alone pass one task as a stream, as every place
    depends on the one before, and are joined back.
    """
    share = coverage / 100 if coverage > 1 else coverage
    room = [s * share for s in sizes]
    if isinstance(n, int):
        fits = [int(r // n) for r in room]
        if n < 1 or not any(fits):
            raise ValueError("a request is larger than every file, or empty")
        begun = [max(0, int((room[0] - first) // n)), *fits[1:]]
        rows = ordinal(primaries, order, "_n").withColumn("_k", F.col("_n") - 1)
        over = F.when(F.col("_k") >= sum(begun), F.raise_error(F.lit("the secondary files are used up")).cast("boolean")).otherwise(True)
        again = F.col("_k") >= sum(begun)
        rows = rows.where(F.lit(True) if wrap else over).withColumns({"_k": F.when(again, F.pmod(F.col("_k") - sum(begun), F.lit(sum(fits)))).otherwise(F.col("_k")), "_again": again})

        def place(counts: list[int], start: int) -> Column:
            ends = F.array(*[F.lit(e).cast("long") for e in itertools.accumulate(counts)])
            file = F.size(F.filter(ends, lambda e: e <= F.col("_k"))).cast("long")
            before = F.when(file > 0, F.get(ends, (file - 1).cast("int"))).otherwise(0)
            return F.struct(file.alias("file"), ((F.col("_k") - before) * n + F.when(file == 0, start).otherwise(0)).cast("long").alias("first"))

        rows = rows.withColumn("_at", F.when(F.col("_again"), place(fits, 0)).otherwise(place(begun, first)))
        return rows.withColumns({"file": F.col("_at.file"), "first": F.col("_at.first")}).drop("_n", "_k", "_again", "_at")

    def deal(batches):
        f, used = 0, first
        for pdf in batches:
            out = []
            for k in pdf["n"]:
                if all(k > r for r in room):
                    raise ValueError("a request is larger than every file")
                while used + k > room[f]:
                    f, used = f + 1, 0
                    if f == len(room):
                        if not wrap:
                            raise ValueError("the secondary files are used up")
                        f = 0
                out.append((f, used))
                used += int(k)
            yield pdf[["_n"]].assign(file=[x[0] for x in out], first=[x[1] for x in out])

    rows = materialize(ordinal(primaries, order, "_n"))
    dealt = in_order(rows.select("_n", F.col(n).cast("long").alias("n")), ["_n"], deal, "_n long, file long, first long")
    return rows.join(dealt, "_n").drop("_n")


def gather(draws: DataFrame, secondary: DataFrame, key: str, product: str, compact: bool = False) -> DataFrame:
    """(key, products): the products of a primary's entries by entry; missing ones are null, or left out if compact."""
    rows = draws.select(key, "entry").join(secondary.select("entry", F.col(product).alias("_x")), "entry", "left")
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "_x"))), lambda s: s["_x"]).alias("products"))
    return lists.withColumn("products", F.array_compact("products")) if compact else lists


def mixed(gathered: DataFrame, mix: Callable[[Column], Column], wanted: Column | None = None) -> DataFrame:
    """Adds mixed: the combination of the products where it is wanted (null elsewhere: nothing is put)."""
    value = mix(F.col("products"))
    return gathered.withColumn("mixed", value if wanted is None else F.when(wanted, value))


def with_parents(draws: DataFrame, secondary: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Each entry with the run or subrun row of its secondary event; a parent comes once for each entry, not once in all."""
    return draws.join(secondary.select("entry", *keys), "entry").join(parents, keys, "left")


def check_id_maps(maps: DataFrame) -> DataFrame:
    """(old_id, new_id) over all secondary files (rows file, old_id, new_id); an id that two files map differently is an error."""
    one = maps.groupBy("old_id").agg(F.min("new_id").alias("new_id"), F.max("new_id").alias("_other"))
    bad = F.when(F.col("new_id") != F.col("_other"), F.raise_error(F.lit("secondary files map an id differently")).cast("boolean")).otherwise(True)
    return one.where(bad).drop("_other")


def flattened(xs: Column) -> Column:
    """The non-null arrays of xs, one after the other."""
    return F.flatten(F.filter(xs, lambda a: a.isNotNull()))


def offsets(xs: Column) -> Column:
    """Where each non-null array of xs begins in flattened(xs)."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, a: F.struct((acc["sum"] + F.size(a)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(F.filter(xs, lambda a: a.isNotNull()), zero, add, lambda acc: acc["out"])


def remapped(pointers: Column, offset: Column, product: Column) -> Column:
    """Pointers (product_id, key) moved by an offset to a new product; null pointers stay null.

    product: the new id of all of them, or a map from old to new ids; a product that the map does not know is an error.
    """

    def to(p: Column) -> Column:
        return F.coalesce(F.try_element_at(product, p["product_id"]), F.raise_error(F.concat(F.lit("unknown product "), p["product_id"].cast("string"))).cast("int"))

    mapped = product_is_map(product)
    return F.transform(pointers, lambda p: F.when(p.isNotNull() & p["key"].isNotNull(), F.struct((to(p) if mapped else product).alias("product_id"), (p["key"] + offset).alias("key"))))


def product_is_map(product: Column) -> bool:
    """Whether a new product is given as id_map()."""
    return getattr(product, "_ids", False)


def id_map(ids: dict[int, int]) -> Column:
    """Old to new product ids, for remapped()."""
    out = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    out._ids = True
    return out


def same_set(pointers: Column) -> Column:
    """Pointers of one collection, which have to be of one product; an error otherwise."""
    ids = F.array_distinct(F.transform(F.filter(pointers, lambda p: p.isNotNull()), lambda p: p["product_id"]))
    return F.when(F.size(ids) <= 1, pointers).otherwise(F.raise_error(F.lit("pointers of one collection are of several products")))


def shifted_union(left: Column, right: Column) -> Column:
    """Maps with integer keys joined, the right one's keys moved past the left one's."""
    delta = F.coalesce(F.array_max(F.map_keys(left)) + 1, F.lit(0))
    moved = F.transform(F.map_entries(right), lambda e: F.struct((e["key"] + delta).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.concat(F.map_entries(left), moved))
