"""Data-quality jobs: duplicate keys, key verification, coverage, label audits, registries and guards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Feature:
    name: str
    type: str
    role: str  # id, meta, fundamental, market, label or canary
    group: str = ""


def conform(df: DataFrame, registry: Sequence[Feature], version: str, order: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared columns, typed, absent ones null, with the version that made them."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.type).alias(f.name) for f in registry]
    out = df.select(*cols, F.lit(version).alias("feature_version"))
    return out.orderBy(*order) if order else out


def select_features(registry: Sequence[Feature], roles: Iterable[str] = ("fundamental",), groups: Iterable[str] | None = None, without: str | None = None) -> list[str]:
    """Names by role and group; a market column is never a fundamental one, whatever its group."""
    roles, groups = set(roles), None if groups is None else set(groups)
    return [f.name for f in registry if f.role in roles and (groups is None or f.group in groups) and not (without and without in f.name)]


def guard_columns(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    """The frame itself, or an error if it has a column that is known only after the event."""
    bad = sorted(set(df.columns) & set(forbidden))
    if bad:
        raise ValueError(f"outcome columns among the features: {bad}")
    return df


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat: rows, distinct rows, and whether the rows differ."""
    rest = [c for c in df.columns if c not in keys]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest)) if rest else F.lit(1)).alias("n_distinct"))
    return per.where("n_rows > 1").withColumn("differ", F.col("n_distinct") > 1)


def missing_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing_rate) for each column, in one pass."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in cols))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def coverage(all_rows: DataFrame, some_rows: DataFrame, key: str, by: str) -> DataFrame:
    """Per ``by``: distinct keys, those that the other table has, and those that it lacks."""
    have = some_rows.select(key).distinct().withColumn("_in", F.lit(1))
    per = all_rows.select(key, by).distinct().join(have, key, "left").groupBy(by)
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.count("_in").alias("n_covered"), F.sum(F.col("_in").isNull().cast("long")).alias("n_missing"))


def key_match_rate(winners: DataFrame, paid: DataFrame, group: str, names: Sequence[str], combo: str) -> DataFrame:
    """How often the winning combination by each candidate key is the one paid: (key, groups, matched, rate).

    ``winners`` has a column per candidate key, ``paid`` one combination per group.
    """
    both = winners.join(paid.select(group, F.col(combo).alias("_paid")), group)
    cells = F.array(*(F.struct(F.lit(n).alias("key"), (F.col(n) == F.col("_paid")).cast("long").alias("hit")) for n in names))
    per = both.select(F.explode(cells).alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.count(F.lit(1)).alias("groups"), F.sum("x.hit").alias("matched"))
    return per.withColumn("rate", F.col("matched") / F.col("groups"))


def confusion(df: DataFrame, flag: str, truth: str) -> DataFrame:
    return df.groupBy(flag, truth).agg(F.count(F.lit(1)).alias("n"))


def late_rows(df: DataFrame, known: str, event: str) -> DataFrame:
    """Rows whose feature date lies after the event's; a safe table has none."""
    return df.where(F.col(known) > F.col(event))


def assert_not_after(df: DataFrame, known: str, event: str) -> DataFrame:
    if late_rows(df, known, event).limit(1).count():
        raise ValueError(f"{known} lies after {event}")
    return df


def typed(fields: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))
