"""Stake sizing inside a group of exclusive outcomes, caps, rounding, rebates and policy grids."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import payout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Days of one partition whose losing stakes are held at a time.
HELD_DAYS = 10_000


def kelly_exclusive(df: DataFrame, group: Sequence[str], p: str, price: str, tie: str, out: str, gate: Column | None = None) -> DataFrame:
    """Adds the stake fractions that maximise the mean log of wealth when one member of a group wins at most.

    In order of expected value, each prefix of the group has a reserve R = (1 - sum p) / (1 - sum 1/price), and its
    members the fractions p - R / price. Of the prefixes in which all fractions are positive the one of the largest
    mean log of wealth is taken, the shortest of equals; running sums over the group give it without a loop. ``gate``
    leaves members out altogether.
    """
    valid = (F.col(p) > 0) & (F.col(price) > 1)
    valid = F.coalesce(valid if gate is None else valid & gate, F.lit(False))
    w = Window.partitionBy(*group, "_v").orderBy(F.desc("_ev"), tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_v", valid).withColumn("_ev", F.col(p) * F.col(price))
    log = F.when(F.col("_v"), F.col(p) * F.log("_ev"))
    df = df.withColumns({"_sp": F.sum(p).over(upto), "_sb": F.sum(1 / F.col(price)).over(upto), "_sl": F.sum(log).over(upto), "_t": F.row_number().over(w)})
    room = 1 - F.col("_sb")
    df = df.withColumn("_r", F.when(F.col("_v") & (room > 1e-12) & (1 - F.col("_sp") > 1e-12), (1 - F.col("_sp")) / room))
    fits = F.col("_ev") >= F.col("_r") - 1e-12 * F.col(price)
    df = df.withColumn("_g", F.when(F.col("_v") & fits, F.col("_sl") + (1 - F.col("_sp")) * F.log("_r")))
    best = F.max(F.when(F.col("_g") > 1e-15, F.struct(F.col("_g").alias("g"), (-F.col("_t")).alias("t"), F.col("_r").alias("r")))).over(Window.partitionBy(*group))
    df = df.withColumn("_b", best)
    stake = F.when(F.col("_v") & F.col("_b").isNotNull() & (F.col("_t") <= -F.col("_b.t")), F.greatest(F.lit(0.0), F.col(p) - F.col("_b.r") / F.col(price)))
    return df.withColumn(out, F.coalesce(stake, F.lit(0.0))).drop("_v", "_ev", "_sp", "_sb", "_sl", "_t", "_r", "_g", "_b")


def expected_log_wealth(df: DataFrame, group: Sequence[str], f: str, p: str, price: str) -> DataFrame:
    """Mean log of wealth of each group's stakes; null where they use up the bank."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_cash", 1 - F.sum(f).over(w))
    win = F.when(F.col(f) > 0, F.col(p) * F.log(F.when(F.col("_cash") > 0, F.col("_cash") + F.col(f) * F.col(price))))
    some = F.sum(F.when(F.col(f) > 0, F.col(p)).otherwise(0.0))
    lost = F.greatest(F.lit(0.0), 1 - some) * F.log(F.when(F.max("_cash") > 0, F.max("_cash")))
    return df.groupBy(*group).agg((F.coalesce(F.sum(win), F.lit(0.0)) + lost).alias("log_wealth"))


def cap(df: DataFrame, keys: Sequence[str], stake: str, limit: Column | float) -> DataFrame:
    """Scales stakes down in proportion so that no group's sum exceeds the limit."""
    limit = F.lit(limit) if isinstance(limit, (int, float)) else limit
    total = F.sum(stake).over(Window.partitionBy(*keys))
    return df.withColumn(stake, F.when(total > limit, F.col(stake) * limit / total).otherwise(F.col(stake)))


def cap_days(df: DataFrame, day: str, stake: str, limit: Column | float) -> DataFrame:
    """``cap`` for days, which hold many races: their sums are found first and joined, so that no task holds a day's rows."""
    limit = F.lit(limit) if isinstance(limit, (int, float)) else limit
    per = df.groupBy(F.col(day).alias("_day")).agg(F.sum(stake).alias("_total"))  # a row per day: 36,525 a century
    df = df.join(F.broadcast(per), F.col(day).eqNullSafe(F.col("_day")))
    return df.withColumn(stake, F.when(F.col("_total") > limit, F.col(stake) * limit / F.col("_total")).otherwise(F.col(stake))).drop("_day", "_total")


def cap_and_round(df: DataFrame, race: Sequence[str], day: Sequence[str], stake: str, bank: Column | float, race_cap: float = 0.10, day_cap: float = 0.25, unit: float = 10.0, least: float = 10.0) -> DataFrame:
    """Caps per race, then per day, then rounds to legal stakes; ``desired`` keeps the stake before rounding."""
    bank = F.lit(float(bank)) if isinstance(bank, (int, float)) else bank
    df = cap(cap(df, race, stake, race_cap * bank), day, stake, day_cap * bank)
    return df.withColumn("desired", F.col(stake)).withColumn(stake, payout.round_stake(F.col(stake), unit, least))


def rebates(df: DataFrame, keys: Sequence[str], stake: str, won: str, rate: float, threshold: float) -> DataFrame:
    """Losing turnover per key, whether it passes the threshold, and the credit on what lies above."""
    per = df.groupBy(*keys).agg(F.sum(F.when(F.col(won) > 0, 0.0).otherwise(F.col(stake))).alias("losing"))
    return per.withColumns({"triggered": F.col("losing") > threshold, "credit": payout.rebate(F.col("losing"), rate, threshold)})


@dataclass(frozen=True)
class Policy:
    name: str
    method: str  # flat, fraction, kelly or exclusive
    size: float  # cash, share of the bank, or part of the full stake


def policy_grid(parts: Sequence[float] = (0.05, 0.10, 0.25, 0.50), flat: float = 10.0, fraction: float = 0.02) -> list[Policy]:
    """Flat and fixed-fraction stakes, and full and partial stakes by either solver."""
    grid = [Policy("flat", "flat", flat), Policy("fixed_fraction", "fraction", fraction)]
    for method in ("kelly", "exclusive"):
        grid += [Policy(f"{method}_{size:g}", method, size) for size in (1.0, *parts)]
    return grid


def _swept(df: DataFrame, race: Sequence[str], day: str, p: str, price: str, won: str, tie: str, grid: Sequence[Policy], banks: Sequence[float], threshold: float) -> tuple[DataFrame, list[tuple[str, float]], list[tuple[str, float, int]]]:
    """Each bet with its race's and its day's sums, the shares (column, size) of the bank, and the (policy, bank, share) of each cell of the sweep.

    Under fixed banks a stake and its caps are shares of the bank, the same for all banks but where a policy stakes flat
    cash, and a policy's share is its size times one of three columns; so a race needs three sums. The days' sums of all
    shares are found first and joined, so that no task holds a day's bets.
    """
    gate = payout.clears(F.col(p), F.col(price), threshold)
    df = kelly_exclusive(df, race, p, price, tie, "_x", gate).withColumn("_k", F.when(gate, payout.kelly(F.col(p), F.col(price))).otherwise(0.0)).where(gate).withColumn("_o", F.lit(1.0))
    w = Window.partitionBy(*race)
    df = df.select(F.col(day).alias("_day"), price, won, "_k", "_x", "_o", *(F.sum(c).over(w).alias(f"_t{c}") for c in ("_k", "_x", "_o")))
    shares: dict[tuple[str, float], int] = {}
    cells = []
    for g in grid:
        for b in banks:
            what = {"flat": ("_o", g.size / b), "fraction": ("_o", g.size), "kelly": ("_k", g.size), "exclusive": ("_x", g.size)}[g.method]
            cells.append((g.name, float(b), shares.setdefault(what, len(shares))))
    capped = [F.when(size * F.col(f"_t{c}") > 0.10, F.col(c) * 0.10 / F.col(f"_t{c}")).otherwise(size * F.col(c)) for c, size in shares]
    days = df.groupBy(F.col("_day").alias("_on")).agg(*(F.sum(s).alias(f"_d{i}") for i, s in enumerate(capped)))  # a row per day: 36,525 a century
    df = df.join(F.broadcast(days), F.col("_day").eqNullSafe(F.col("_on")))
    bets = df.select(F.col("_day").alias(day), F.col(price).cast("double").alias(price), F.coalesce(F.col(won) > 0, F.lit(False)).alias(won), *(c for c in df.columns if c[:2] in ("_k", "_x", "_o", "_t", "_d") and c not in ("_day", "_on")))
    return bets, list(shares), cells


def _held(batch: pa.RecordBatch, shares: Sequence[tuple[str, float]]) -> list[np.ndarray]:
    """Each share of the bank after the race's and the day's cap."""
    col = {n: batch.column(n).to_numpy() for n in batch.schema.names if n.startswith("_")}
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, (c, size) in enumerate(shares):
            s = np.where(size * col[f"_t{c}"] > 0.10, col[c] * 0.10 / col[f"_t{c}"], size * col[c])
            out.append(np.where(col[f"_d{i}"] > 0.25, s * 0.25 / col[f"_d{i}"], s))
    return out


def _placed(share: np.ndarray, bank: float) -> tuple[np.ndarray, np.ndarray]:
    """Desired stakes, to a millionth, and stakes as they would be placed: whole tens, ten at least."""
    desired = np.floor(share * bank * 1e6 + 0.5) / 1e6
    stake = np.floor(desired / 10 + 0.5) * 10
    return desired, np.where((desired >= 10) & (stake >= 10), stake, 0.0)


def stake_sweep(df: DataFrame, race: Sequence[str], day: str, p: str, price: str, won: str, tie: str, grid: Sequence[Policy], banks: Sequence[float], threshold: float = 0.05) -> DataFrame:
    """One row per policy and bank: bets, staked, profit, return, and the share of desired stakes lost to rounding.

    Banks are fixed, so every policy and bank is settled in one pass, each over whole batches of bets; a partition sends
    sums alone.
    """
    df, shares, cells = _swept(df, race, day, p, price, won, tie, grid, banks, threshold)

    def settled(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, rows = np.zeros((len(cells), 4)), 0
        for batch in batches:
            gain = np.where(batch.column(won).to_numpy(zero_copy_only=False), batch.column(price).to_numpy() - 1, -1.0)
            rows += len(gain)
            held = _held(batch, shares)
            for k, (_, bank, i) in enumerate(cells):
                desired, stake = _placed(held[i], bank)
                total[k] += np.count_nonzero(stake), stake.sum(), stake @ gain, desired.sum()
        if rows:
            names, bets = [n for n, _, _ in cells], total[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([b for _, b, _ in cells]), pa.array(bets), *(pa.array(total[:, c]) for c in (1, 2, 3))], names=["policy", "bank", "bets", "staked", "profit", "desired"])

    sums = df.drop(day).mapInArrow(settled, "policy string, bank double, bets long, staked double, profit double, desired double")
    out = sums.groupBy("policy", "bank").agg(*(F.sum(c).alias(c) for c in ("bets", "staked", "profit", "desired")))
    return out.withColumns({
        "roi": F.when(F.col("staked") > 0, F.col("profit") / F.col("staked")).otherwise(0.0),
        "lost_to_rounding": F.when(F.col("desired") > 0, (F.col("desired") - F.col("staked")) / F.col("desired")).otherwise(0.0),
    })


def rebate_days(df: DataFrame, race: Sequence[str], day: str, p: str, price: str, won: str, tie: str, grid: Sequence[Policy], banks: Sequence[float], rate: float = 0.10, least: float = 10_000.0, threshold: float = 0.05) -> DataFrame:
    """(policy, bank, days, rebate_days, credit) of a sweep: days with bets, days whose losing turnover passes ``least``, and the credit on what lies above.

    Losing stakes are summed by day inside each batch of bets, for all policies and banks at once.
    """
    df, shares, cells = _swept(df, race, day, p, price, won, tie, grid, banks, threshold)

    def lost(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def told() -> Iterable[pa.RecordBatch]:
            for at in [*held]:
                n, losing = held.pop(at)
                bet = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(bet), kind), pa.array(bet.astype(np.int32)), pa.array(losing[bet])], names=[day, "_cell", "losing"])

        for batch in batches:
            days = batch.column(day).dictionary_encode("encode")
            at, names, kind = days.indices.to_numpy(), days.dictionary.to_pylist(), days.dictionary.type
            off = ~batch.column(won).to_numpy(zero_copy_only=False)
            now, share = np.zeros((2, len(cells), len(names))), _held(batch, shares)
            for k, (_, bank, i) in enumerate(cells):
                _, stake = _placed(share[i], bank)
                now[0, k], now[1, k] = np.bincount(at, stake > 0, len(names)), np.bincount(at, stake * off, len(names))
            for j, name in enumerate(names):
                held[name] = held[name] + now[:, :, j] if name in held else now[:, :, j].copy()
            if len(held) > HELD_DAYS:
                yield from told()
        yield from told()

    name = [F.lit(n) for n, _, _ in cells], [F.lit(b) for _, b, _ in cells]
    rows = df.drop(price).mapInArrow(lost, f"`{day}` {df.schema[day].dataType.simpleString()}, _cell int, losing double")
    per = rows.groupBy("_cell", day).agg(F.sum("losing").alias("losing"))
    out = per.groupBy("_cell").agg(F.count(F.lit(1)).alias("days"), F.sum((F.col("losing") > least).cast("long")).alias("rebate_days"), F.sum(payout.rebate(F.col("losing"), rate, least)).alias("credit"))
    return out.select(F.array(*name[0])[F.col("_cell")].alias("policy"), F.array(*name[1])[F.col("_cell")].alias("bank"), "days", "rebate_days", "credit")
