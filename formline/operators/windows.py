"""Windows over entities and groups. ``keys`` name an entity, ``order`` its events in time, ``group`` one contest.

Where a frame must exclude the whole current event and not just the current row, ``order`` is one integer column that
numbers events and the frame is RANGE; siblings of an entity in one event then never see each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import scalars

Keys = str | Sequence[str]


def _list(x: Keys) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def before(keys: Keys, order: str):
    """All events of the entity before the current one."""
    return Window.partitionBy(*_list(keys)).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)


def rows(keys: Keys, order: Keys, start: int, end: int):
    """Rows of the entity from ``start`` to ``end`` relative to the current one, in a total order."""
    return Window.partitionBy(*_list(keys)).orderBy(*_list(order)).rowsBetween(start, end)


def ordered(keys: Keys, order: Keys):
    return Window.partitionBy(*_list(keys)).orderBy(*_list(order))


def prior_rate(df: DataFrame, keys: Keys, order: Keys, label: str, out: str, strict: bool = True, when: Column | None = None) -> DataFrame:
    """Adds ``out``, the mean of ``label`` over the entity's earlier events, and ``out_n``, their number.

    ``strict`` excludes all rows of the current event, else only later rows in the order do. With ``when`` only rows
    for which it holds count. Null without earlier rows.
    """
    w = before(keys, _list(order)[0]) if strict else rows(keys, order, Window.unboundedPreceding, -1)
    counted = F.lit(1) if when is None else F.when(when, 1)
    n = F.coalesce(F.sum(counted).over(w), F.lit(0))
    total = F.sum(F.col(label) if when is None else F.when(when, F.col(label))).over(w)
    return df.withColumn(f"{out}_n", n).withColumn(out, F.when(F.col(f"{out}_n") > 0, total / F.col(f"{out}_n")))


def prior_roll(df: DataFrame, keys: Keys, order: Keys, col: str, n: int, out: str, fn=F.avg, least: int = 1) -> DataFrame:
    """Adds ``fn`` of ``col`` over the last ``n`` rows before the current one; null with fewer than ``least`` values."""
    w = rows(keys, order, -n, -1)
    value = fn(col).over(w)
    return df.withColumn(out, value if least <= 1 else F.when(F.count(col).over(w) >= least, value))


def lagged(df: DataFrame, keys: Keys, order: Keys, cols: Sequence[str], n: int = 1, prefix: str = "prev_") -> DataFrame:
    w = ordered(keys, order)
    return df.withColumns({f"{prefix}{c}": F.lag(c, n).over(w) for c in cols})


def career(df: DataFrame, keys: Keys, order: Keys, day: str, season: str) -> DataFrame:
    """Adds career_run_number, days_since_debut, days_since_last_run and seasons_active (earlier seasons raced)."""
    w = ordered(keys, order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_new", (~F.col(season).eqNullSafe(F.lag(season).over(w))).cast("int"))
    return df.withColumns({
        "career_run_number": F.row_number().over(w) - 1,
        "days_since_debut": F.datediff(day, F.min(day).over(Window.partitionBy(*_list(keys)))),
        "days_since_last_run": F.datediff(day, F.lag(day).over(w)),
        "seasons_active": F.sum("_new").over(up_to) - 1,
    }).drop("_new")


def expanding_z(df: DataFrame, keys: Keys, order: Keys, col: str, out: str, inclusive: bool = True, least: int = 2, sign: int = 1) -> DataFrame:
    """Adds how many standard deviations ``col`` lies from its mean so far; 0 with fewer than ``least`` values."""
    w = rows(keys, order, Window.unboundedPreceding, 0 if inclusive else -1)
    sd = F.stddev_samp(col).over(w)
    z = sign * (F.col(col) - F.avg(col).over(w)) / sd
    return df.withColumn(out, F.when((F.count(col).over(w) >= least) & (sd > 0), z).otherwise(0.0))


def global_expanding_z(df: DataFrame, day: str, cols: Sequence[str], least: int = 500, clip: float = 5.0, prefix: str = "z_") -> DataFrame:
    """Adds z-scores by mean and deviation over all rows of earlier days, clipped; 0 with fewer than ``least`` rows.

    Rows are first reduced to sums per day; the running window then runs over days, never over raw rows.
    """
    sums = df.groupBy(day).agg(*(e for c in cols for e in (F.count(c).alias(f"{c}_n"), F.sum(F.col(c).cast("double")).alias(f"{c}_s"), F.sum(F.col(c).cast("double") ** 2).alias(f"{c}_q"))))
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(day, *(F.sum(f"{c}_{x}").over(w).alias(f"_{c}_{x}") for c in cols for x in "nsq"))
    df = df.join(past, day, "left")
    for c in cols:
        n, s, q = (F.col(f"_{c}_{x}") for x in "nsq")
        sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - s / n) / sd))
        df = df.withColumn(f"{prefix}{c}", F.coalesce(F.when((n >= least) & (sd > 0), z), F.lit(0.0)))
    return df.drop(*(f"_{c}_{x}" for c in cols for x in "nsq"))


def shrunk_bias(df: DataFrame, keys: Keys, order: str, label: str, expected: str, k: float, out: str) -> DataFrame:
    """Adds (earlier hits + k) / (earlier expected hits + k) - 1, strictly before the current event."""
    w = before(keys, order)
    hits, due = F.coalesce(F.sum(label).over(w), F.lit(0)), F.coalesce(F.sum(expected).over(w), F.lit(0.0))
    return df.withColumn(out, (hits + k) / (due + k) - 1)


def share(df: DataFrame, group: Keys, value: Column, out: str) -> DataFrame:
    """Adds each row's share of the group's sum; null where the sum is 0."""
    df = df.withColumn("_v", value)
    total = F.sum("_v").over(Window.partitionBy(*_list(group)))
    return df.withColumn(out, F.when(total != 0, F.col("_v") / total)).drop("_v")


def softmax(df: DataFrame, group: Keys, eta: str, out: str) -> DataFrame:
    """Adds the group's softmax of ``eta``, stable for large values."""
    w = Window.partitionBy(*_list(group))
    df = df.withColumn("_e", F.exp(F.col(eta) - F.max(eta).over(w)))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def renormalise(df: DataFrame, group: Keys, p: str, out: str | None = None) -> DataFrame:
    """Scales ``p`` to sum to 1 in each group; a group that sums to 0 stays as it is."""
    total = F.sum(p).over(Window.partitionBy(*_list(group)))
    return df.withColumn(out or p, F.when(total > 0, F.col(p) / total).otherwise(F.col(p)))


def blend(df: DataFrame, group: Keys, model: str, market: str, weight: float, out: str, normalise: bool = True) -> DataFrame:
    """Adds (1 - weight) * model + weight * market; a missing market counts as the model."""
    mixed = (1 - weight) * F.col(model) + weight * F.coalesce(F.col(market), F.col(model))
    df = df.withColumn(out, mixed)
    return renormalise(df, group, out) if normalise else df


def top_k(df: DataFrame, group: Keys, order: Sequence[Column | str], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must be total for the result to be determined."""
    name = rank or "_r"
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*_list(group)).orderBy(*order))).where(F.col(name) <= k)
    return df if rank else df.drop(name)


def last_folds(df: DataFrame, fold: str, n: int) -> DataFrame:
    """Rows of the ``n`` latest folds; folds are ranked among themselves, not row by row."""
    names = df.select(fold).distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc(fold)))).where(F.col("_r") <= n)
    return df.join(names.select(fold), fold, "left_semi")


def dedup(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k(df, keys, order, 1)


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """All rows; columns that one side lacks are null there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of ``a``, those also in ``b``, and their ratio."""
    left, right = a.select(key).distinct(), b.select(key).distinct().withColumn("_in", F.lit(1))
    joined = left.join(right, key, "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count("_in").alias("n_shared"))
    return joined.withColumn("ratio", F.when(F.col("n_keys") > 0, F.col("n_shared") / F.col("n_keys")))


def trial_metrics(df: DataFrame, batch: Keys, time: str, result: Column, easy: Column) -> DataFrame:
    """Adds a side event's margin to its batch's best, its rank among timed rows in [0, 1], failed and easy flags."""
    w = Window.partitionBy(*_list(batch))
    n, rank = F.count(time).over(w), F.rank().over(w.orderBy(F.col(time).asc_nulls_last()))
    df = df.withColumns({"_n": n, "_r": F.when(F.col(time).isNotNull(), rank), "_b": F.min(time).over(w)})
    return df.withColumns({
        "bt_margin": F.when(F.col(time).isNotNull(), F.greatest(F.col(time) - F.col("_b"), F.lit(0.0))),
        "bt_rank": F.when(F.col("_r").isNotNull(), F.when(F.col("_n") > 1, (F.col("_r") - 1) / (F.col("_n") - 1)).otherwise(0.0)),
        "bt_failed": result,
        "bt_easy": (F.coalesce(F.col("_r") == 1, F.lit(False)) & easy).cast("double"),
    }).drop("_n", "_r", "_b")


def position_ratio(df: DataFrame, batch: Keys, positions: str, last: str, out: str) -> DataFrame:
    """Adds the last of a side event's running positions and its share of the batch's size; null where it is no number."""
    df = df.withColumn(last, scalars.last_position(F.col(positions)))
    return df.withColumn(out, F.col(last) / F.count(F.lit(1)).over(Window.partitionBy(*_list(batch))))


def ntile_ranged(df: DataFrame, by: Keys, value: str, tie: str, last: str, n: int, out: str, ranges: int = 64) -> DataFrame:
    """Adds the ``n``-tile of each row in its group's order by ``value``, ``tie`` and ``last``, as ``ntile`` would give it.

    ``tie`` is a number. Rows are counted by value and by equal ranges of ``tie`` first; a row's place is its place
    inside such a cell and the counts of the cells before, so that no task orders a whole group. ``value`` should have
    few distinct values, such as prices of a scale.
    """
    keys = _list(by)
    low, high = df.agg(F.min(tie), F.max(tie)).first()
    cell = F.lit(0) if low is None or low == high else F.floor((F.col(tie) - low) * ranges / (high - low + 1)).cast("int")
    df = df.withColumn("_cell", cell)
    cells = df.groupBy(*keys, value, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    ahead = F.sum("_n").over(w.orderBy(value, "_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).withColumn("_all", F.sum("_n").over(w)).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, value, "_cell").orderBy(tie, last))
    df = df.withColumn("_place", place).join(cells, [*keys, value, "_cell"]).withColumn("_place", F.col("_place") + F.col("_ahead") - 1)
    size, more = F.floor(F.col("_all") / n), F.col("_all") % n
    long = more * (size + 1)  # rows in the tiles that are one row longer
    tile = F.when(F.col("_place") < long, F.floor(F.col("_place") / (size + 1))).otherwise(more + F.floor((F.col("_place") - long) / F.greatest(size, F.lit(1))))
    return df.withColumn(out, (tile + 1).cast("int")).drop("_cell", "_ahead", "_all", "_place")
