"""Price snapshots: ingest, deduplication at pool grain, latest prices, drift before a cutoff and resonance.

The functions take batch and streaming frames alike where Spark allows: ``latest_price`` and ``implied_gap`` are
aggregations that a stream updates, ``drift_stream`` is ``price_drift`` and the ranks of ``resonance`` as keyed state with
event-time timers. Windows over groups need batch frames.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formline.sources.feeds import odds_pools

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_snapshots(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def dedup_snapshots(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "30 minutes") -> DataFrame:
    """Of snapshots with one key the first to arrive; of several at one time, that of the smallest hash of its values.

    On a stream the state of a key is dropped once the watermark, ``delay`` behind the latest time seen, has passed it.
    """
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    w = Window.partitionBy(*keys).orderBy(ts, F.xxhash64(*df.columns))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pool_prices(df: DataFrame, doc: str, ts: str, delay: str = "30 minutes") -> DataFrame:
    """Typed prices of raw documents: pools are deduplicated by race, pool and update time, then exploded."""
    pools = dedup_snapshots(odds_pools(df, doc), ["race_no", "pool_type", "last_update_time"], ts, delay)
    rows = pools.withColumn("node", F.explode("nodes"))
    return rows.select(ts, "race_no", "pool_type", F.col("node.combString").alias("comb"), F.col("node.oddsValue").try_cast("double").alias("odds"))


def append_parquet(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Appends a stream to a table; ``availableNow=True`` works off what is there and stops."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    out = out.partitionBy(*by) if by else out
    return out.trigger(**(trigger or {"availableNow": True})).start()


def latest_price(df: DataFrame, keys: Sequence[str], ts: str, price: str) -> DataFrame:
    """The last price per key; a stream in update mode keeps one row of state per key."""
    return df.groupBy(*keys).agg(F.max_by(price, ts).alias(price), F.max(ts).alias(ts))


def price_drift(df: DataFrame, keys: Sequence[str], group: Sequence[str], ts: str, price: str, off: str, lags: Sequence[int] = (5, 3, 1), steam: float = -0.1) -> DataFrame:
    """Open, close and log drift per key, its drift in the last minutes, against the group's median, and flags.

    ``off`` is the group's cutoff; later snapshots never count. drift_<m> compares the close with the last price at or
    before m minutes to the cutoff. ``steam`` marks a fall below the median's; ``reversal`` a last-minutes move against
    the whole one.
    """
    seen = df.where(F.col(ts) <= F.col(off))
    at = {m: F.max_by(price, F.when(F.col(ts) <= F.col(off) - F.make_interval(mins=F.lit(m)), F.col(ts))) for m in lags}
    per = seen.groupBy(*group, *[k for k in keys if k not in group]).agg(
        F.min_by(price, ts).alias("open"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("snapshots"), *(c.alias(f"_at{m}") for m, c in at.items())
    )
    log = lambda a, b: F.when((a > 0) & (b > 0), F.log(b / a))
    per = per.withColumn("drift", log(F.col("open"), F.col("close")))
    per = per.withColumns({f"drift_{m}": log(F.col(f"_at{m}"), F.col("close")) for m in lags}).drop(*(f"_at{m}" for m in lags))
    field = F.median("drift").over(Window.partitionBy(*group))
    per = per.withColumn("drift_vs_field", F.col("drift") - field)
    last = F.col(f"drift_{min(lags)}")
    return per.withColumns({
        "steam": F.coalesce(F.col("drift_vs_field") <= steam, F.lit(False)).cast("int"),
        "reversal": F.coalesce((last * F.col("drift")) < 0, F.lit(False)).cast("int"),
    })


def _drift_rows(members: list, held: np.ndarray, lags: Sequence[int], steam: float) -> pd.DataFrame:
    """A group's rows from its members' state: (open, close, snapshots, last price before each lag), NaN where none."""

    def log(a, b):
        with np.errstate(all="ignore"):
            return np.where((a > 0) & (b > 0), np.log(b / a), np.nan)

    out = pd.DataFrame({"open": held[:, 0], "close": held[:, 1], "snapshots": held[:, 2].astype(np.int64), "drift": log(held[:, 0], held[:, 1])}, index=range(len(members)))
    for i, m in enumerate(lags):
        out[f"drift_{m}"] = log(held[:, 3 + i], held[:, 1])
    out["drift_vs_field"] = out["drift"] - out["drift"].median()
    out["steam"] = (out["drift_vs_field"] <= steam).astype(np.int32)
    out["reversal"] = (out[f"drift_{min(lags)}"] * out["drift"] < 0).astype(np.int32)
    order = pd.DataFrame({"close": -out["close"], "drift": out["drift"].round(9), "member": members})
    for name, by in (("strength_rank", ["close", "member"]), ("drift_rank", ["drift", "member"])):
        out.loc[order.sort_values(by, na_position="last", kind="stable").index, name] = np.arange(1, len(out) + 1)
    return out.astype({"strength_rank": np.int32, "drift_rank": np.int32})


def drift_stream(df: DataFrame, group: str, member: str, ts: str, price: str, off: str, lags: Sequence[int] = (5, 3, 1), steam: float = -0.1, delay: str = "30 minutes") -> DataFrame:
    """What ``price_drift`` gives, with strength_rank and drift_rank of the group, from a running stream of snapshots.

    A group's members are keyed state, a fixed few numbers each: first and last price, the last price at or before each
    lag, and how many snapshots. An event-time timer stands at the group's cut-off ``off``; when the watermark, ``delay``
    behind the latest time seen, passes it, the group's rows are emitted, once, and its state expires. Snapshots may
    come in any order; repeats of a member's time count once, the first to arrive (their keys are kept as long as the
    watermark allows); later ones than the cut-off never count; what arrives after the timer is dropped.
    Rows with a null group, member, time, price or cut-off are left out.
    """
    whole = df.where(" AND ".join(f"{c} IS NOT NULL" for c in (group, member, ts, price, off)))
    once = whole.withWatermark(ts, delay).dropDuplicatesWithinWatermark([group, member, ts])
    rows = once.select(group, member, ts, F.unix_micros(ts).alias("_at"), F.col(price).cast("double").alias("_price"), F.unix_micros(F.col(off).cast("timestamp")).alias("_off"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    made = f"{group} {kinds[group]}, {member} {kinds[member]}, open double, close double, snapshots long, drift double, {''.join(f'drift_{m} double, ' for m in lags)}drift_vs_field double, steam int, reversal int, strength_rank int, drift_rank int"
    width = 6 + 2 * len(lags)  # open, its time, close, its time, snapshots, unused; then a price and its time per lag
    names = [x.split(" ")[0] for x in made.split(", ")]

    def step(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            members, flat, _ = state.get
            held = np.array(flat, float).reshape(-1, width)
            out = _drift_rows(list(members), np.column_stack([held[:, 0], held[:, 2], held[:, 4], held[:, 6::2]]), lags, steam)
            out[group], out[member] = key[0], list(members)
            state.remove()
            yield out[names]
            return
        members, flat, cut = state.get if state.exists else ([], [], 0)
        held = {m: list(flat[i * width : (i + 1) * width]) for i, m in enumerate(members)}
        for part in parts:
            cut = max(cut, int(part["_off"].max()))
            for m, at, value in zip(part[member].tolist(), part["_at"].tolist(), part["_price"].tolist(), strict=True):
                if at > cut:
                    continue
                mine = held.setdefault(m, [value, float(at), value, float(at), 0.0, 0.0] + [float("nan"), float("-inf")] * len(lags))
                mine[4] += 1
                if at < mine[1]:
                    mine[0], mine[1] = value, float(at)
                if at > mine[3]:
                    mine[2], mine[3] = value, float(at)
                for i, lag in enumerate(lags):
                    if mine[7 + 2 * i] < at <= cut - lag * 60_000_000:
                        mine[6 + 2 * i], mine[7 + 2 * i] = value, float(at)
        if held and cut // 1000 > state.getCurrentWatermarkMs():
            state.update((list(held), [v for mine in held.values() for v in mine], cut))
            state.setTimeoutTimestamp(cut // 1000)

    return rows.groupBy(group).applyInPandasWithState(step, made, f"members array<{kinds[member]}>, held array<double>, cut long", "append", "EventTimeTimeout")


def implied_gap(df: DataFrame, keys: Sequence[str], pool: str, price: str, win: str, place: str) -> DataFrame:
    """Win and place chances implied by prices, side by side, and the place chance over the win chance."""
    per = df.groupBy(*keys).agg(F.max(F.when(F.col(pool) == win, 1 / F.col(price))).alias("p_win"), F.max(F.when(F.col(pool) == place, 1 / F.col(price))).alias("p_place"))
    return per.withColumn("place_over_win", F.when(F.col("p_win") > 0, F.col("p_place") / F.col("p_win")))


def resonance(df: DataFrame, group: Sequence[str], member: str, strength: Column, drift: Column, k: int = 3) -> DataFrame:
    """Members among both the ``k`` strongest and the ``k`` whose price fell most of their group."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"strength_rank": F.row_number().over(w.orderBy(strength.desc_nulls_last(), member)), "drift_rank": F.row_number().over(w.orderBy(drift.asc_nulls_last(), member))})
    return ranked.where((F.col("strength_rank") <= k) & (F.col("drift_rank") <= k))
