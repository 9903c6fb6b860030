"""Joins over time and with checks: as-of, interval, strict cardinality, canonical keys, pairs inside a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days of an entity's history that one task orders at most.
SLICE_DAYS = 30


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """``df`` dealt by its keys to so many tasks, as joins and groupings by them take it; as Spark sees fit without a number."""
    return df if tasks is None else df.repartition(tasks, *keys)


def _slice(ts: str, days: int | None) -> Column:
    """The slice of history that a time lies in; one for all times without ``days``. A null time has a slice of its own."""
    return F.lit(0) if days is None else F.floor(F.datediff(F.col(ts), F.lit("1970-01-01")) / days).cast("int")


def _with_slices(rows: DataFrame, slices: DataFrame, cols: Sequence[str]) -> DataFrame:
    named = slices.select(F.col("_by").alias("_sb"), F.col("_slice").alias("_ss"), *cols)
    return rows.join(named, F.col("_by").eqNullSafe(F.col("_sb")) & F.col("_slice").eqNullSafe(F.col("_ss")), "left").drop("_sb", "_ss")


def asof_join(
    left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, cols: Sequence[str], strict: bool = False, tolerance_days: int | None = None, slice_days: int | None = SLICE_DAYS
) -> DataFrame:
    """For each left row the latest right row of its entity at or, if ``strict``, before its time.

    An entity's history is cut into slices of ``slice_days``. Both sides go through one shuffle by entity and slice and
    one sort by time; what a slice begins with, the last right row of those before it, is carried from slice to slice
    over one row per slice. So neither a pair of rows that isn't a match nor a whole long history lies in one task.

    Right columns are null where nothing matches or the match is older than ``tolerance_days``. Of right rows at one
    time the largest, column by column, counts. Left rows with a null entity or time stay, without a match.
    """
    kept = left.columns
    a = left.select(F.struct(*kept).alias("_l"), F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(0 if strict else 1).alias("_side"))
    b = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull())
    b = b.select(F.struct(F.col(right_ts).alias("_rts"), *cols).alias("_r"), F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(1 if strict else 0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_slice", _slice("_ts", slice_days))
    w = Window.partitionBy("_by", "_slice").orderBy("_ts", "_side", F.col("_r")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    if slice_days is not None:
        ends = both.groupBy("_by", "_slice").agg(F.max("_r").alias("_end"))
        earlier = Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_before", F.when(F.col("_slice").isNotNull(), F.last("_end", ignorenulls=True).over(earlier)))
        found = _with_slices(found, ends, ["_before"]).withColumn("_m", F.coalesce("_m", "_before"))
    if tolerance_days is not None:
        fresh = F.datediff(F.col("_ts"), F.col("_m._rts")) <= tolerance_days
        found = found.withColumn("_m", F.when(fresh, F.col("_m")))
    return found.select("_l.*", F.col("_m._rts").alias(f"asof_{right_ts}"), *(F.col(f"_m.{c}").alias(c) for c in cols))


def interval_agg_join(left: DataFrame, right: DataFrame, by: str, lo: str, hi: str, ts: str, row: Sequence[str], aggs: Sequence[Column], max_days: int | None = None) -> DataFrame:
    """For each left row, aggregates of its entity's right rows with lo < ts < hi.

    ``row`` identifies a left row. An equi-join on the entity with the range as its residual, then one aggregation; left
    rows without right rows stay, with what the aggregates make of nothing.
    """
    r = right.select(F.col(by).alias("_by"), F.col(ts).alias("_rt"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in (by, ts)))
    inside = (F.col(by) == F.col("_by")) & (F.col("_rt") > F.col(lo)) & (F.col("_rt") < F.col(hi))
    if max_days is not None:
        inside = inside & (F.datediff(F.col(hi), F.col("_rt")) <= max_days)
    return left.join(r, inside, "left").groupBy(*row).agg(*aggs)


def between_agg_join(
    left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, row: Sequence[str], aggs: Sequence[Column], max_days: int | None = None, slice_days: int | None = SLICE_DAYS
) -> DataFrame:
    """For each left row, aggregates of its entity's right rows strictly between the entity's previous left row and it.

    Such intervals don't overlap, so each right row belongs to the next left row at most: a sort by time and one by
    falling time inside slices of ``slice_days`` find the left rows about it, each frame growing by a row at a time, and
    what lies beyond a slice is carried over one row per slice. Then one aggregation; no pair is made that isn't
    counted. Columns of the right side are named ``r_`` and their name; left rows without right rows stay.
    """
    a = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*row).alias("_row"))
    kept = [c for c in right.columns if c not in (by, right_ts)]
    b = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull())
    b = b.select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*(F.col(c).alias(f"r_{c}") for c in kept)).alias("_r"))
    both = a.where(F.col("_by").isNotNull() & F.col("_ts").isNotNull()).unionByName(b, allowMissingColumns=True).withColumn("_slice", _slice("_ts", slice_days))
    both = both.withColumn("_mark", F.when(F.col("_side") == 0, F.struct("_ts", "_row")))
    inside, past = Window.partitionBy("_by", "_slice"), (Window.unboundedPreceding, -1)
    up, down = inside.orderBy("_ts", "_side", "_row"), inside.orderBy(F.desc("_ts"), F.desc("_side"), F.desc("_row"))
    met = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(up.rowsBetween(*past))).withColumn("_next", F.last("_mark", ignorenulls=True).over(down.rowsBetween(*past)))
    met = met.where("_side = 1")
    if slice_days is not None:
        ends = both.groupBy("_by", "_slice").agg(F.min("_mark").alias("_first_mark"), F.max("_mark").alias("_last_mark"))
        slices = Window.partitionBy("_by")
        ends = ends.withColumn("_ahead", F.last("_first_mark", ignorenulls=True).over(slices.orderBy(F.desc("_slice")).rowsBetween(*past)))
        ends = ends.withColumn("_behind", F.last("_last_mark", ignorenulls=True).over(slices.orderBy("_slice").rowsBetween(*past)))
        met = _with_slices(met, ends, ["_ahead", "_behind"]).withColumn("_next", F.coalesce("_next", "_ahead")).withColumn("_last", F.coalesce("_last", "_behind"))
    between = (F.col("_next._ts") > F.col("_ts")) & F.coalesce(F.col("_last._ts") < F.col("_ts"), F.lit(True))
    if max_days is not None:
        between = between & (F.datediff("_next._ts", "_ts") <= max_days)
    found = met.where(between).select("_next._row.*", "_r.*")
    none = [F.lit(None).cast(found.schema[f"r_{c}"].dataType).alias(f"r_{c}") for c in kept]
    return left.select(*row, *none).unionByName(found).groupBy(*row).agg(*aggs)


def strict_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """A left join that may not multiply rows: fails if the right side repeats a key."""
    if check and right.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError(f"the right side repeats a key of {list(on)}")
    return left.join(right, list(on), "left")


def canonical_key(df: DataFrame, name: str, code: str, out: str) -> DataFrame:
    """Adds one key for a name and its code: the code, else the code that the name mostly has, else the name."""
    seen = df.where(F.col(code).isNotNull()).groupBy(name, code).count()
    w = Window.partitionBy(name).orderBy(F.desc("count"), code)
    best = seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(name, F.col(code).alias("_code"))
    return df.join(best, name, "left").withColumn(out, F.coalesce(code, "_code", name)).drop("_code")


def pairs(df: DataFrame, group: str, member: str, cols: Sequence[str]) -> DataFrame:
    """Unordered pairs of a group's members, i < j, with ``cols`` of both as c_i and c_j."""
    a = df.select(group, F.col(member).alias("i"), *(F.col(c).alias(f"{c}_i") for c in cols))
    b = df.select(group, F.col(member).alias("j"), *(F.col(c).alias(f"{c}_j") for c in cols))
    return a.join(b, group).where("i < j")


def fill_from(df: DataFrame, source: DataFrame, on: Sequence[str], col: str, tasks: int | None = None) -> DataFrame:
    """Fills nulls of ``col`` from the first source row, by value, of the same key; both sides go to ``tasks``."""
    one = dealt(source, on, tasks).groupBy(*on).agg(F.min(col).alias("_fill"))
    return dealt(df, on, tasks).join(one, list(on), "left").withColumn(col, F.coalesce(col, "_fill")).drop("_fill")


def skip_seen(candidates: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the ledger lacks."""
    return candidates.join(ledger.select(key), key, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key of both tables, the latest; ties go to the new table."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
