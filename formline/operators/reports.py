"""Evaluation: policies, sweeps, buckets, calibration, ranking metrics, bootstraps and equity curves."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators import scans
from formline.operators.draws import CHUNK, poisson_counts


def bet_summary(df: DataFrame, by: Sequence[str], stake: str, profit: str, won: str | None = None) -> DataFrame:
    """Bets, hit rate, staked, profit, return on turnover and Sharpe ratio of returns, per group."""
    aggs = [F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("staked"), F.sum(profit).alias("profit")]
    if won:
        aggs.append(F.avg(F.col(won).cast("double")).alias("hit_rate"))
    each = F.col(profit) / F.col(stake)
    aggs += [F.avg(each).alias("_m"), F.stddev_samp(each).alias("_s")]
    df = df.groupBy(*by).agg(*aggs)
    return df.withColumns({"roi": F.when(F.col("staked") > 0, F.col("profit") / F.col("staked")).otherwise(0.0), "sharpe": F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s")).otherwise(0.0)}).drop("_m", "_s")


def threshold_report(df: DataFrame, metric: str, thresholds: Sequence[float], by: Sequence[str], stake: str, profit: str, won: str) -> DataFrame:
    """The bet summary for each threshold that the metric reaches; a bet counts under every threshold it clears."""
    cleared = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(metric) >= t)
    return bet_summary(df.withColumn("threshold", F.explode(cleared)), [*by, "threshold"], stake, profit, won)


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bucket [edge, next) that a value lies in, from 0; null below the first edge."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(value >= e, F.lit(i)).otherwise(out)
    return out


def bucket_report(df: DataFrame, col: str, edges: Sequence[float], aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("bucket", bucket(F.col(col), edges)).where("bucket is not null").groupBy(*by, "bucket").agg(*aggs)


def leave_one_out(df: DataFrame, fold: str, stake: str, profit: str) -> DataFrame:
    """Return on turnover of all folds but one, for each fold."""
    per = df.groupBy(fold).agg(F.sum(stake).alias("_s"), F.sum(profit).alias("_p"))
    everything = Window.partitionBy()
    rest_s, rest_p = F.sum("_s").over(everything) - F.col("_s"), F.sum("_p").over(everything) - F.col("_p")
    return per.select(fold, F.when(rest_s > 0, rest_p / rest_s).alias("roi_without"))


def group_log_loss(df: DataFrame, group: Sequence[str], p: str, won: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over groups with a winner of the mean negative log of its winners' chances."""
    log = F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.col(p))))
    per = df.groupBy(*by, *group).agg(F.sum(F.col(won) * log).alias("_l"), F.sum(won).alias("_w")).where("_w > 0")
    return per.groupBy(*by).agg((-F.avg(F.col("_l") / F.col("_w"))).alias("log_loss"), F.count(F.lit(1)).alias("groups"))


def group_log_losses(df: DataFrame, group: Sequence[str], ps: Mapping[str, str], won: str, name: str = "model") -> DataFrame:
    """(log_loss, groups, ``name``): ``group_log_loss`` of each of the named columns of chances; rows are grouped once for all."""
    logs = {n: F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.col(p)))) for n, p in ps.items()}
    per = df.groupBy(*group).agg(F.sum(won).alias("_w"), *(F.sum(F.col(won) * log).alias(f"_l{i}") for i, log in enumerate(logs.values()))).where("_w > 0")
    one = per.agg(F.count(F.lit(1)).alias("groups"), *((-F.avg(F.col(f"_l{i}") / F.col("_w"))).alias(f"_l{i}") for i in range(len(logs))))
    cells = F.array(*(F.struct(F.col(f"_l{i}").alias("log_loss"), F.lit(n).alias(name)) for i, n in enumerate(logs)))
    return one.select("groups", F.explode(cells).alias("_c")).select("_c.log_loss", "groups", f"_c.{name}")


def pointwise_loss(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and log-loss of single chances."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(loss).alias("binary_log_loss"))


def hit_rate(df: DataFrame, group: Sequence[str], p: str, won: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of groups with a winner whose likeliest member won; ties go to the lowest ``tie``."""
    top = F.max_by(F.struct(won), F.struct(F.col(p), -F.col(tie)))
    per = df.groupBy(*by, *group).agg(top[won].alias("_hit"), F.sum(won).alias("_w")).where("_w > 0")
    return per.groupBy(*by).agg(F.avg((F.col("_hit") > 0).cast("double")).alias("hit_rate"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean forecast, observed rate and count in equal-width bins; empty bins have no row."""
    no = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1)))
    per = df.withColumn("bin", no).groupBy(*by, "bin").agg(F.avg(p).alias("pred_mean"), F.avg(F.col(y).cast("double")).alias("obs_rate"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("bin_mid", (F.col("bin") + 0.5) / bins)


def ece_mce(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, weighted by rows, and largest gap of calibration bins."""
    gap = F.abs(F.col("pred_mean") - F.col("obs_rate"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def mean_rank(col: str, group: Sequence[str]) -> Column:
    """Rank in the group, ties at their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(col)) + (F.count(F.lit(1)).over(w.partitionBy(*group, col)) - 1) / 2


def spearman_by_group(df: DataFrame, group: Sequence[str], a: str, b: str, by: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Mean over groups of the rank correlation of two columns; groups where either doesn't vary are left out."""
    ranked = df.withColumn("_ra", mean_rank(a, group)).withColumn("_rb", mean_rank(b, group))
    x, y = F.col("_ra"), F.col("_rb")
    per = ranked.groupBy(*by, *group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"), F.sum(x * y).alias("_xy")
    )
    vx, vy = F.col("_n") * F.col("_xx") - F.col("_x") ** 2, F.col("_n") * F.col("_yy") - F.col("_y") ** 2
    rho = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(vx * vy)
    per = per.where(F.col("_n") >= least).where((vx > 0) & (vy > 0)).withColumn("_rho", rho)
    return per.groupBy(*by).agg(F.avg("_rho").alias("spearman"), F.count(F.lit(1)).alias("groups"))


def auc(df: DataFrame, p: str, y: str, by: Sequence[str] = (), ranges: int = 256) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at half.

    Rows are first counted per distinct score. Scores fall into ``ranges`` of about as many rows each; running counts
    go over the ranges' sums and inside a range, so that no task orders all scores of a group.
    """
    per = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n")).withColumn("_neg", F.col("_n") - F.col("_pos"))
    edges = sorted(set(df.approxQuantile(p, [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    per = per.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(p))) if edges else F.lit(0))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.groupBy(*by, "_range").agg(F.sum("_neg").alias("_sum"))
    ahead = ahead.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_range").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(ahead, [*by, "_range"])
    per = per.withColumn("_won", F.col("_pos") * (F.col("_ahead") + F.col("_below") + F.col("_neg") / 2))
    total = F.sum("_pos") * F.sum("_neg")
    return per.groupBy(*by).agg(F.when(total > 0, F.sum("_won") / total).alias("auc"))


#: Groups of one partition whose sums per replicate are held at a time.
HELD_GROUPS = 256


def block_bootstrap(df: DataFrame, block: str, num: str, den: str, replicates: int = 1000, seed: int = 0, by: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of sum(num) / sum(den) over replicates in which each block counts a random number of times.

    Rows are summed per block. A block's counts are Poisson draws of mean 1, read from four hex digits each of the MD5
    of seed, eight replicates and block, so any engine can redraw them. Drawing needs no order, number or join of the
    blocks: each is drawn where it is, a batch of blocks at a time and once for all groups of the batch, and a partition
    sends one pair of sums per group and replicate.
    """
    per = df.groupBy(*by, block).agg(F.sum(num).cast("double").alias("_num"), F.sum(den).cast("double").alias("_den"))
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = per.select(*by, key.alias("_by"), F.col(block).cast("string").alias("_block"), "_num", "_den")
    schema = T.StructType([*per.select(*by).schema.fields, T.StructField("_r", T.IntegerType()), T.StructField("_n", T.DoubleType()), T.StructField("_d", T.DoubleType())])
    names = [*by, "_r", "_n", "_d"]

    def drawn(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[str, tuple[list[pa.Array], np.ndarray]] = {}

        def sums() -> Iterable[pa.RecordBatch]:
            for keys, total in held.values():
                cells = [k.take(pa.array(np.zeros(replicates, np.int32))) for k in keys]
                cells += [pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(total[i], mask=total[2 + i] == 0) for i in range(2))]
                yield pa.RecordBatch.from_arrays(cells, names=names)
            held.clear()

        for batch in batches:
            blocks, groups = batch.column("_block").dictionary_encode("encode"), batch.column("_by").dictionary_encode()
            which, group = blocks.indices.to_numpy(), groups.indices.to_numpy()
            values = [(v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0.0).to_numpy()) for v in (batch.column("_num"), batch.column("_den"))]
            texts, labels = blocks.dictionary.to_pylist(), groups.dictionary.to_pylist()
            order = np.lexsort((group, which))
            for at in range(0, len(texts), CHUNK):
                counts = poisson_counts(texts[at : at + CHUNK], seed, replicates)
                mine = order[np.searchsorted(which[order], at) : np.searchsorted(which[order], at + CHUNK)]
                for g in np.unique(group[mine]):
                    now = mine[group[mine] == g]
                    if labels[g] not in held:
                        held[labels[g]] = [batch.column(k).slice(int(now[0]), 1) for k in by], np.zeros((4, replicates))
                    total = held[labels[g]][1]
                    total[:2] += np.stack([v[now] for _, v in values]) @ counts[which[now] - at].astype(float)
                    total[2:] += [[known[now].any()] for known, _ in values]
                if len(held) > HELD_GROUPS:
                    yield from sums()
        yield from sums()

    sums = rows.mapInArrow(drawn, schema).groupBy(*by, "_r").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d")).where("_d > 0")
    ratio = sums.withColumn("_ratio", F.col("_n") / F.col("_d"))
    return ratio.groupBy(*by).agg(
        F.percentile("_ratio", low).alias("lo"), F.percentile("_ratio", high).alias("hi"), F.avg((F.col("_ratio") > 0).cast("double")).alias("share_positive"),
    ).withColumn("crosses_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))


#: Half the share of ranks about the middle whose values are counted one by one; approximate ranks are five times finer.
MIDDLE = 0.0005


def medians(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """The exact middle, the lower of two, of each value's numbers per group; a group without any has no row.

    Approximate ranks give two values about the middle. All rows up to the lower one are a single count, and only values
    between them, a thousandth of all ranks, are counted one by one and put in order.
    """
    cells = F.array(*(F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()))
    rows = df.select(*by, F.explode(cells).alias("_x")).select(*by, "_x.*").where("_v IS NOT NULL")
    keys = [*by, "_name"]
    ends = rows.groupBy(*keys).agg(F.percentile_approx("_v", [0.5 - MIDDLE, 0.5 + MIDDLE], 10_000).alias("_ends"), F.count(F.lit(1)).alias("_all"))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"), "_all")
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    near = rows.join(ends, on).where(F.col("_v") <= F.col("_high")).withColumn("_v", F.greatest("_v", "_low"))
    seen = near.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = seen.withColumn("_upto", upto).where(2 * F.col("_upto") >= F.col("_all"))
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in values))


#: Days that one task of a running total orders at most.
BLOCK_DAYS = 60


def equity_curve(df: DataFrame, day: str, pnl: str) -> DataFrame:
    """Profit per day, its running sum, the running peak (0 at least) and the drawdown from it; days are summed first, then whole blocks of days."""
    per = df.groupBy(day).agg(F.sum(pnl).alias("pnl")).withColumn("_at", F.unix_date(F.col(day).cast("date")))
    return scans.path_so_far(per, [], "_at", BLOCK_DAYS, "pnl").drop("_at")


def curve_summary(curve: DataFrame, bankroll: float) -> DataFrame:
    """Days, final equity, largest drawdown, daily Sharpe ratio and mean log growth of a fixed bank."""
    growth = F.log(F.greatest(F.lit(1e-9), 1 + F.col("pnl") / bankroll))
    return curve.agg(
        F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("profit"), F.max("drawdown").alias("max_drawdown"),
        F.when(F.stddev_samp("pnl") > 0, F.avg("pnl") / F.stddev_samp("pnl")).otherwise(0.0).alias("daily_sharpe"), F.avg(growth).alias("log_growth"),
    )


def ruin_probability(curve: DataFrame, day: str, pnl: str, bankroll: float, floor: float, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Share of resampled day sequences in which wealth falls below ``floor`` times the bank.

    Days are numbered in blocks. A replicate draws as many days as there are, with replacement; its path is cut into
    blocks too, each a summary (sum, lowest prefix), and the summaries merge, so no task orders a whole path.
    """
    days = curve.select(F.unix_date(F.col(day).cast("date")).alias("_d"), F.log(F.greatest(F.lit(1e-9), 1 + F.col(pnl) / bankroll)).alias("_g"))
    numbered = scans.sums_so_far(days, [], "_d", BLOCK_DAYS, {"_i": F.lit(1)}).select(F.col("_i").cast("long").alias("_i"), "_g")
    total = days.agg(F.count(F.lit(1)).alias("_n"))  # one row
    draws = numbered.select("_i").join(F.broadcast(total)).select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_r").cast("string"), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.select("_r", F.col("_i").alias("_at"), F.pmod(h, F.col("_n")).alias("_i")).join(numbered, "_i")
    low = scans.path_summary(draws, ["_r"], "_at", BLOCK_DAYS * 8, "_g")
    return low.agg(F.avg((F.col("lowest") < F.log(F.lit(floor))).cast("double")).alias("ruin_probability"), F.count(F.lit(1)).alias("replicates"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of each pair of columns as (a, b, corr), in one pass."""
    named = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(named)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(named)))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def target_encoding(df: DataFrame, key: str, label: str, train: Column, out: str) -> DataFrame:
    """Adds the mean label of the key over training rows, the mean over all of them where the key has none."""
    per = df.where(train).groupBy(key).agg(F.avg(label).alias(out))
    whole = df.where(train).agg(F.avg(label)).first()[0]
    return df.join(per, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(whole)))


def chosen_threshold(report: DataFrame, least: int) -> DataFrame:
    """The threshold with the best return among those with ``least`` bets; ties go to the lower one."""
    return report.where(F.col("bets") >= least).agg(F.max_by("threshold", F.struct("roi", -F.col("threshold"))).alias("threshold"))
