"""Helpers that the operators of this package share: shared-folder tables, checked broadcasts, components."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a lookup side counts as small; every use multiplies it by a bounded row width.
SMALL_ROWS = 200_000

_own_dir: list[str] = []


def ship(name: str) -> None:
    """Have the module's functions pickled by value, so that executors need no installed copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, a temporary folder takes its place if all runs on one machine, as in tests; a cluster must name
    one, for its executors see no other.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-formline-"))
    return "file://" + _own_dir[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/formline-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._formline_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_formline_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Run both collectors between the phases of a long job, so that Spark drops shuffle files nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A group that holds more than this share of all rows is joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the table of their groups, one row per key, that gives each group's number of rows.

    Groups over ``HOT_SHARE`` of all rows, a bounded number, are joined by broadcast, so that no task gets all rows of
    one group; the rest go through a sort-merge join. ``how`` is inner or left.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > max(1, int(total * HOT_SHARE)))
    far = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(far.join(groups.hint("merge"), key, how))


def join_sized(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """``join_groups``, but a plain join if the groups have ``SMALL_ROWS`` rows at most in all: so few can't overload a task."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    return rows.join(groups, key) if total <= SMALL_ROWS else join_groups(rows, groups, key, size)


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with what ``groups`` has for their key, null where it has none: by broadcast if it has ``SMALL_ROWS`` rows at most, else by ``join_groups``."""
    if groups.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    return join_groups(rows, groups, key, size, "left")


def running_totals(cells: DataFrame, keys: list[str], cell: str, value: str, step: int = 1024) -> DataFrame:
    """``cells``, a row per key and cell number, with ``ahead``: the sum of ``value`` over the key's lower cells.

    Sums run in two levels, over blocks of ``step`` cells and inside a block, so that a task that orders a key's blocks
    gets one row for ``step`` cells.
    """
    block = F.floor(F.col(cell) / step).cast("long")
    cells = cells.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_blocks_ahead"))
    inside = Window.partitionBy(*keys, "_block").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = cells.join(blocks, on).withColumn("ahead", F.col("_inside") + F.col("_blocks_ahead"))
    return out.drop("_block", "_b", "_inside", "_blocks_ahead", *(f"_k{i}" for i in range(len(keys))))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as (node, component); component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change, which they do at the latest when
    each node hangs on its component's smallest; the number of rounds follows the logarithm of a component's size. A
    step is a grouped minimum that is joined back; a node with many edges doesn't bring them into one task. Edges with
    a null end are left out; nodes without edges have no row; an empty input gives an empty result.
    """
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    n = now.count()

    def with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
        """Few edges can't overload a task, however many one node has."""
        return edges.join(low, "u") if n <= SMALL_ROWS else join_groups(edges, low, "u", "edges")

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("edges"))
        large = with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges"))
        step = with_low(down, low)
        step = step.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(step.select("u", F.col("m").alias("v")))
        after = materialise(step.where("u <> v").distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        release(down)
        release(now)
        now, n = after, mark["n"]
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark


def labels(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(mid, component): a name that members share only if links join them, the smallest member within ``rounds`` links.

    Not all members of a component need get one name, which costs comparisons but no link; it takes ``rounds`` passes,
    however long a component's chains are.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "both")
    now = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("links"))
    for _ in range(rounds - 1):
        now = materialise(now, "labels")
        met = join_sized(both, now.withColumnRenamed("u", "v"), "v", "links").groupBy("u").agg(F.min("low").alias("near"))
        now = now.join(met, "u").select("u", F.least("low", "near").alias("low"), "links")
    out = materialise(now.select(F.col("u").alias("mid"), F.col("low").alias("component")), "labels")
    release(both)
    return out
