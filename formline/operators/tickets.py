"""Official payouts and ticket reports: lookups, settlement, thresholds chosen and held, rules side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import payout
from formline.operators import joins, reports, windows


def payout_lookup(dividends: DataFrame, group: str, pool: str, name: str, member: str = "saddle") -> DataFrame:
    """(group, member, name): the smallest payout of the pool for each single member.

    Combinations that are no whole number, such as refunds, and missing payouts are left out.
    """
    rows = dividends.where(F.col("pool") == pool).select(group, F.trim("combination").try_cast("int").alias(member), F.col("payout").cast("double").alias("_p"))
    return rows.where(F.col(member).isNotNull() & F.col("_p").isNotNull()).groupBy(group, member).agg(F.min("_p").alias(name))


def with_payouts(df: DataFrame, dividends: DataFrame, group: str, pools: dict[str, str], member: str = "saddle") -> DataFrame:
    """``df`` with a column of payouts for each pool, null where none was paid; rows are neither lost nor repeated.

    The pools are put side by side by one aggregation, so that there is one join.
    """
    named = F.trim("combination").try_cast("int")
    sides = [F.min(F.when(F.col("pool") == p, F.col("payout").cast("double"))).alias(c) for c, p in pools.items()]
    side = dividends.where(F.col("pool").isin(*pools.values())).select(group, named.alias(member), "pool", "payout")
    side = side.where(F.col(member).isNotNull()).groupBy(group, member).agg(*sides)
    return df.join(side, [group, member], "left")


def pair_payouts(dividends: DataFrame, group: str, pool: str) -> DataFrame:
    """(group, i, j, payout) of a pool's paid pairs, i < j; combinations that aren't two numbers are left out."""
    two = F.array_sort(F.transform(F.split("combination", ","), lambda x: F.trim(x).try_cast("int")))
    rows = dividends.where(F.col("pool") == pool).select(group, two.alias("_c"), F.col("payout").cast("double").alias("payout"))
    rows = rows.where((F.size("_c") == 2) & F.forall("_c", lambda x: x.isNotNull()))
    return rows.groupBy(group, F.col("_c")[0].alias("i"), F.col("_c")[1].alias("j")).agg(F.min("payout").alias("payout"))


def top_pairs(df: DataFrame, group: str, member: str, order: Sequence[Column | str], k: int, paid: DataFrame) -> DataFrame:
    """All pairs of each group's first ``k`` members as tickets, with the payout of those that were paid.

    Only groups with a full choice of ``k`` and with any payout count: the others can be neither bought nor settled.
    """
    top = windows.top_k(df.select(group, member, *(c for c in df.columns if c not in (group, member))), group, order, k)
    full = top.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select(group)
    top = top.join(full, group, "left_semi").join(paid.select(group), group, "left_semi")
    return joins.pairs(top, group, member, []).join(paid, [group, "i", "j"], "left")


def ticket_report(tickets: DataFrame, group: str, by: Sequence[str] = (), stake: float = 10.0) -> DataFrame:
    """Groups, tickets, wins, groups with a win, staked, returned, profit and return on turnover."""
    per = tickets.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_t"), F.count("payout").alias("_w"), F.coalesce(F.sum("payout"), F.lit(0.0)).alias("_r"))
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("_t").alias("tickets"), F.sum("_w").alias("wins"), F.sum((F.col("_w") > 0).cast("long")).alias("groups_with_win"),
        (F.sum("_t") * stake).alias("staked"), (F.sum("_r") * stake / 10).alias("returned"),
    )
    return out.withColumn("profit", F.col("returned") - F.col("staked")).withColumn("roi", F.when(F.col("staked") > 0, F.col("profit") / F.col("staked")))


def rules_side_by_side(df: DataFrame, rules: dict[str, tuple[str, Sequence[float]]], stake: str, profit: str, won: str) -> DataFrame:
    """One report over the same candidates for several rules, each a column and thresholds that it must reach."""

    def met(rule: str, c: str, thresholds: Sequence[float]) -> Column:
        cleared = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(c) >= t)
        return F.transform(cleared, lambda t: F.struct(F.lit(rule).alias("rule"), t.alias("threshold")))

    cells = [met(rule, c, ts) for rule, (c, ts) in rules.items()]
    rows = df.withColumn("_x", F.explode(F.concat(*cells))).select("*", "_x.*")
    return reports.bet_summary(rows, ["rule", "threshold"], stake, profit, won)


def locked_threshold(df: DataFrame, fold: Column, metric: str, thresholds: Sequence[float], least: int, stake: str, profit: str, won: str) -> DataFrame:
    """The report of later bets at the threshold that did best on earlier ones.

    Bets for which ``fold`` holds choose the threshold, the best return with ``least`` bets, ties to the lower; the others
    are settled at it. Without such a threshold the result is empty.
    """
    report = reports.threshold_report(df.where(fold), metric, thresholds, [], stake, profit, won)
    best = reports.chosen_threshold(report, least)
    later = df.where(~fold).join(F.broadcast(best), F.col(metric) >= F.col("threshold"))  # one row
    return reports.bet_summary(later, ["threshold"], stake, profit, won)


def group_then_mean(df: DataFrame, group: Sequence[str], stake: str, profit: str, by: Sequence[str] = ()) -> DataFrame:
    """Return on turnover over all bets beside the mean of each group's own return."""
    per = df.groupBy(*by, *group).agg(F.sum(stake).alias("_s"), F.sum(profit).alias("_p"))
    return per.groupBy(*by).agg((F.sum("_p") / F.sum("_s")).alias("bet_roi"), F.avg(F.col("_p") / F.col("_s")).alias("group_roi"), F.count(F.lit(1)).alias("n_groups"))


def payout_ratio(df: DataFrame, actual: str, theoretical: str, won: str, by: Sequence[str] = ()) -> DataFrame:
    """Medians of the payouts of won bets, of their theoretical prices and of the two's ratio, the lower of two middles."""
    rows = df.where((F.col(won) > 0) & (F.col(actual) > 0) & (F.col(theoretical) > 0)).withColumn("_q", F.col(actual) / 10 / F.col(theoretical))
    n = rows.groupBy(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(by))).agg(F.count(F.lit(1)).alias("n"))
    mids = reports.medians(rows, {"actual": F.col(actual) / 10, "theoretical": F.col(theoretical), "ratio": F.col("_q")}, by)
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)), F.lit(True))
    return mids.join(n, on).select(*mids.columns, "n")


def uniform_baseline(df: DataFrame, group: str, p: str, won: str, thresholds: Sequence[float], stake: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Bets where the model's chance exceeds 1 / n by a threshold, settled at the fair price n of a field of n."""
    df = df.withColumn("_n", F.count(F.lit(1)).over(windows.Window.partitionBy(group)))
    df = df.withColumn("_edge", F.round(F.col(p) - 1 / F.col("_n"), 9)).withColumn("_s", F.lit(float(stake)))
    df = df.withColumn("_p", F.when(F.col(won) > 0, stake * (F.col("_n") - 1)).otherwise(-stake).cast("double"))
    return reports.threshold_report(df, "_edge", thresholds, by, "_s", "_p", won)


def threshold_intervals(df: DataFrame, block: str, metric: str, thresholds: Sequence[float], stake: str, profit: str, won: str, price: str, by: Sequence[str] = (), replicates: int = 1000) -> DataFrame:
    """The threshold report with the mean price of the bets and a bootstrap interval of the return over blocks."""
    cleared = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(metric) >= t)
    rows = df.withColumn("threshold", F.explode(cleared))
    keys = [*by, "threshold"]
    mean = rows.groupBy(*keys).agg(F.avg(price).alias("mean_price"))
    ends = reports.block_bootstrap(rows, block, profit, stake, replicates, 0, keys)
    return reports.bet_summary(rows, keys, stake, profit, won).join(mean, keys).join(ends, keys, "left")


def place_settled(df: DataFrame, stake: float, placed: str, payout_col: str) -> DataFrame:
    return df.withColumn("stake", F.lit(stake)).withColumn("profit", payout.place_profit(F.lit(stake), F.col(placed), F.col(payout_col)))
