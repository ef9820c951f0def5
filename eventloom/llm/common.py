"""What the operators of this package share: shared-folder tables, checked broadcasts, hot-group splitting, components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows of a few fixed-width columns.
BROADCAST_ROWS = 200_000
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. A local session without one gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Spark's own setting: shuffle files are removed when the query that wrote them ends, not when the driver happens to collect garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    release: the shuffles of this write leave the disk with its end; nothing but the table is read afterwards.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if was is None else spark.conf.set(RELEASE, was)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a materialised side that is broadcast if its counted rows are within the bound, and shuffled otherwise."""
    return left.join(F.broadcast(small) if small.count() <= rows else small, on, how)


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", hot: int = 1_000_000) -> DataFrame:
    """Joins with a materialised side that has each key once. Keys with over `hot` rows on the left are joined apart, by broadcast: there
    are few of them, and their rows stay where they are; the rest are shuffled by key."""
    key = [key] if isinstance(key, str) else key
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    many = materialize(left.groupBy(*key).count().where(F.col("count") > hot).select(*key))
    if many.isEmpty():
        return left.join(right, key, how)
    apart = join_small(left, many, key, "left_semi")
    rest = join_small(left, many, key, "left_anti")
    return rest.join(right, key, how).unionByName(join_small(apart, materialize(join_small(right, many, key, "left_semi")), key, how))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds _k_id (the id, null as the least long) and _k_rid (a hash of id and text). Rows equal in both are one document and get one verdict."""
    return docs.withColumns({"_k_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_k_rid": F.xxhash64(F.col(id_col), F.col(text_col))})


def carry(*needed: str, exact: bool = False) -> Callable:
    """For functions of docs: columns that they do not need pass them under working names, so that no name can clash.

    They come back under their own names; one that has the name of a result column is replaced by it. exact: the result has just the
    columns of docs. Names that begin with _k_ are reserved.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = {c: f"_k_x{i}" for i, c in enumerate(docs.columns) if c not in needed}
            out = f(docs.withColumnsRenamed(names), *args, **options)
            if exact:
                return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
            results = [c for c in out.columns if c not in names.values() and c not in docs.columns or c in needed]
            results += [c for c in out.columns if c in names]
            kept = [F.col(v).alias(c) for c, v in names.items() if c not in results]
            return out.select(*results, *kept)

        return run

    return wrap


def split_hot(rows: DataFrame, key: str, ident: str, block: int = 1000) -> DataFrame:
    """Deals the rows of each key into cells of a block or two each, so that each pair of rows of a key meets in exactly one cell.

    Adds cell (long, the new grouping key) and block (int: pairs of a cell are compared within a block if all rows of the cell have
    it, else only across blocks). Keys with at most `block` rows keep one cell. A key with n rows gets n * ceil(n / block) rows.
    """
    hot = materialize(rows.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("_nb")))
    rows = join_small(rows, hot, [key], "left")
    own = F.when(F.col("_nb").isNull(), 0).otherwise(F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    rows = rows.withColumn("block", own).withColumn("_j", F.explode(F.when(F.col("_nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1))))
    pair = F.xxhash64(key, F.least("block", "_j"), F.greatest("block", "_j"))
    return rows.withColumn("cell", F.when(F.col("_nb").isNull(), F.col(key)).otherwise(pair)).drop("_nb", "_j")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root): each node of the undirected edges with the smallest node reachable, by alternating large and small stars.

    Every round is a pair of aggregations and joins over the edges; nothing is gathered for a node. Rounds go on until nothing changes (the
    square of the logarithm of the nodes at most); more than `rounds` are an error, never a partial result. Self-loops and repeats
    are harmless; no edges give no rows.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    was = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
