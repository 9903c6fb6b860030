"""Places and combinations: closed-form chances in the first places, pairs, trios and box tickets."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.payout import exacta_free
from formline.operators.joins import pairs


def place_chances(df: DataFrame, group: str, member: str, p: str, k: int = 3) -> DataFrame:
    """Adds p1 to pk, the chance of each place up to the third when places are drawn in turn by win chance, and topk.

    Second place is p_i times the sum over others of p_a / (1 - p_a): two sums over the group. Third place needs each
    ordered pair of others once, a self-join inside the group, and then sums over rows and columns of those pairs.
    A place beyond the size of the group has chance 0.
    """
    w = Window.partitionBy(group)
    df = df.withColumn("_h", F.col(p) / F.greatest(1 - F.col(p), F.lit(1e-12)))
    df = df.withColumn("p1", F.col(p)).withColumn("p2", F.col(p) * (F.sum("_h").over(w) - F.col("_h")))
    total = F.col("p1") + (F.col("p2") if k >= 2 else F.lit(0.0))
    if k >= 3:
        a = df.select(group, F.col(member).alias("_a"), F.col(p).alias("_pa"), F.col("_h").alias("_ha"))
        b = df.select(group, F.col(member).alias("_b"), F.col(p).alias("_pb"))
        cell = F.col("_ha") * F.col("_pb") / (1 - F.col("_pa") - F.col("_pb"))
        cells = a.join(b, group).where("_a <> _b").withColumn("_m", F.when(F.col("_pa") + F.col("_pb") < 1 - 1e-12, cell).otherwise(0.0))
        ends = cells.select(group, F.explode(F.array("_a", "_b")).alias(member), "_m").groupBy(group, member).agg(F.sum("_m").alias("_mine"))
        df = df.join(ends, [group, member], "left")
        whole = F.coalesce(F.sum("_mine").over(w), F.lit(0.0)) / 2
        df = df.withColumn("p3", F.col(p) * (whole - F.coalesce("_mine", F.lit(0.0)))).drop("_mine")
        total = total + F.coalesce("p3", F.lit(0.0))
    return df.withColumn("top_k", F.least(F.lit(1.0), total)).drop("_h")


def pair_chances(df: DataFrame, group: str, member: str, ps: Sequence[str]) -> DataFrame:
    """Pairs i < j with the chance, for each column of ``ps``, that they fill the first two places."""
    out = pairs(df, group, member, ps)
    return out.select(group, "i", "j", *(exacta_free(F.col(f"{p}_i"), F.col(f"{p}_j")).alias(f"q_{p}") for p in ps))


def pair_place_chances(df: DataFrame, group: str, member: str, p: str) -> DataFrame:
    """Pairs i < j with the chance that both are among the first three, in closed form per third member.

    In a group of two both fill the first two places.
    """
    two = pairs(df, group, member, [p])
    third = df.select(group, F.col(member).alias("k"), F.col(p).alias("pk"))
    t = two.join(third, group).where("k <> i and k <> j")
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    x, y, z = F.col(f"{p}_i"), F.col(f"{p}_j"), F.col("pk")

    def run(a: Column, b: Column, c: Column) -> Column:
        rest = 1 - a - b
        return F.when(rest > 1e-12, a * b / F.greatest(1 - a, F.lit(1e-12)) * c / rest).otherwise(0.0)

    orders = [(x, y, z), (y, x, z), (x, z, y), (y, z, x), (z, x, y), (z, y, x)]
    total = run(*orders[0])
    for o in orders[1:]:
        total = total + run(*o)
    placed = t.groupBy(group, "i", "j").agg(F.sum(total).alias("both_placed"))
    pair = two.join(size.where("_size = 2"), group).select(group, "i", "j", exacta_free(x, y).alias("both_placed"))
    return placed.unionByName(pair)


def winning_pair(df: DataFrame, group: str, member: str, rank: str) -> DataFrame:
    """The sorted members of the first two places of each group that has both."""
    top = df.where(F.col(rank) <= 2).groupBy(group).agg(F.sort_array(F.collect_list(member)).alias("pair"))
    return top.where(F.size("pair") == 2)


def box_tickets(df: DataFrame, group: str, member: str, pick_rank: str, finish: str, boxes: Sequence[tuple[str, int, int]], unit: float = 10.0) -> DataFrame:
    """For each box (name, k places, n picks): groups, hits and cost; a box hits if the first k are all picked."""
    out = None
    for name, k, n in boxes:
        win = F.array_compact(F.collect_set(F.when(F.col(finish) <= k, F.col(member))))
        picks = F.array_compact(F.collect_set(F.when(F.col(pick_rank) <= n, F.col(member))))
        per = df.groupBy(group).agg(win.alias("win"), picks.alias("picks"), F.count(F.lit(1)).alias("field")).where(F.col("field") >= n)
        hit = (F.size("win") == k) & (F.size(F.array_except("win", "picks")) == 0)
        part = per.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))
        part = part.select(F.lit(name).alias("box"), "groups", "hits", (F.col("groups") * comb(n, k) * unit).alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out


def impute_market(df: DataFrame, group: str, known: str, model: str, out: str) -> DataFrame:
    """Adds market chances from payouts known for some members: those get 1 / payout, and what the group lacks of 1
    goes to the others in proportion to the model, evenly without one; then each group is scaled to 1."""
    w = Window.partitionBy(group)
    have = F.when(F.col(known) > 0, 1 / F.col(known))
    df = df.withColumn("_k", have)
    rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("_k").over(w), F.lit(0.0)))
    open_model = F.sum(F.when(F.col("_k").isNull(), F.col(model))).over(w)
    n_open = F.count(F.when(F.col("_k").isNull(), 1)).over(w)
    filled = F.coalesce("_k", F.when(open_model > 0, rest * F.coalesce(F.col(model), F.lit(0.0)) / open_model).otherwise(rest / n_open))
    df = df.withColumn("_f", filled)
    total = F.sum("_f").over(w)
    return df.withColumn(out, F.when(total > 0, F.col("_f") / total).otherwise(1 / F.count(F.lit(1)).over(w))).drop("_k", "_f")
