"""Training sets from labels and feature tables: strict joins that count what they lose and refuse what they may not do."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from formline.operators.joins import dealt
from formline.operators.quality import guard_columns


@dataclass(frozen=True)
class Part:
    """A feature table: its name, its key columns in the base, the columns it gives, and how far it may fall short.

    ``day`` names the date on which a row was known; it must not lie after the base's. ``least_match`` is the share of
    base rows that must find a row, ``most_lost`` the share of the part's keys that may find none.
    """

    name: str
    df: DataFrame
    on: Sequence[str]
    cols: Sequence[str]
    day: str | None = None
    least_match: float = 0.0
    most_lost: float = 1.0


class Refused(ValueError):
    """A training set that breaches its rules; ``report`` has the counts."""

    def __init__(self, breaches: list[str], report: dict[str, int]):
        super().__init__("; ".join(breaches))
        self.breaches, self.report = breaches, report


def _reduced(p: Part) -> DataFrame:
    """One row per key of a part, the least by its columns, with how many there were; rows with a null in the key go."""
    rows = p.df.where(" AND ".join(f"{c} IS NOT NULL" for c in p.on))
    day = [F.col(p.day).cast("date").alias("_d")] if p.day else []
    one = rows.groupBy(*p.on).agg(F.min(F.struct(*p.cols, *day)).alias("_one"), F.count(F.lit(1)).alias(f"_n_{p.name}"))
    return one.select(*p.on, f"_n_{p.name}", *(F.col(f"_one.{c}").alias(c) for c in p.cols), *([F.col("_one._d").alias(f"_d_{p.name}")] if p.day else []))


def matched(base: DataFrame, key: Sequence[str], day: str, parts: Sequence[Part], tasks: int | None = None) -> DataFrame:
    """The base full-joined with every part, one row of it per key, and marks: in the base, repeats, days.

    A part's column may not be one that the base or another part has, other than its key. Only rows of the base with a
    whole key meet a part. All others, as keys that an earlier part lost, pass by it spread over the tasks, of which
    there are ``tasks`` if that is given.
    """
    taken = set(base.columns)
    for p in parts:
        clash = sorted(taken & set(p.cols))
        if clash:
            raise ValueError(f"{p.name} gives columns that are there already: {clash}")
        taken |= set(p.cols)
    df = base.withColumn("_in", F.lit(True)).join(base.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies")), list(key), "left")
    named = list(dict.fromkeys([*key, *(c for p in parts for c in p.on)]))
    for p in parts:
        asks = F.expr(" AND ".join(["_in IS NOT NULL", *(f"{c} IS NOT NULL" for c in p.on)]))
        by = F.xxhash64(*(c for c in named if c in df.columns))
        left = df.withColumn("_at", F.when(asks, F.lit(1).cast("long")).otherwise(-F.pmod(by, F.lit(1_000_000))))
        right = _reduced(p).withColumn("_at", F.least(F.col(f"_n_{p.name}"), F.lit(1).cast("long")))
        on = [*p.on, "_at"]
        df = dealt(left, on, tasks).join(dealt(right, on, tasks), on, "full").drop("_at")
    return df.withColumn("_day", F.col(day).cast("date"))


def counts(parts: Sequence[Part]) -> dict[str, Column]:
    """Of a matched table: base rows, those whose key repeats, and per part the rows matched, missing, repeated and late, and the keys lost."""
    here = F.coalesce(F.col("_in"), F.lit(False))

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    out = {"rows": n(here), "base_repeated": n(here & (F.coalesce(F.col("_copies"), F.lit(1)) > 1))}
    for p in parts:
        met = F.col(f"_n_{p.name}").isNotNull()
        late = F.coalesce(F.col(f"_d_{p.name}") > F.col("_day"), F.lit(False)) if p.day else F.lit(False)
        out |= {f"{p.name}_matched": n(here & met), f"{p.name}_missing": n(here & ~met), f"{p.name}_repeated": n(here & met & (F.col(f"_n_{p.name}") > 1)), f"{p.name}_late": n(here & met & late), f"{p.name}_lost": n(~here & met)}
    return out


def breaches(report: dict[str, int], parts: Sequence[Part]) -> list[str]:
    """What a report has that may not be."""
    out = [f"{report['base_repeated']} base rows repeat their key"] if report["base_repeated"] else []
    for p in parts:
        got = {k: report[f"{p.name}_{k}"] for k in ("matched", "missing", "repeated", "late", "lost")}
        if got["repeated"]:
            out.append(f"{p.name} repeats the key of {got['repeated']} rows")
        if got["late"]:
            out.append(f"{got['late']} rows of {p.name} were known after the event")
        if report["rows"] and got["matched"] < p.least_match * report["rows"]:
            out.append(f"{p.name} has {got['matched']} of {report['rows']} rows")
        if got["lost"] > p.most_lost * (got["matched"] + got["lost"]):
            out.append(f"{got['lost']} keys of {p.name} meet no row")
    return out


def report(df: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """(part, matched, missing, repeated, late, lost): a row per part of a matched table, from one aggregation."""
    one = df.agg(*(c.alias(k) for k, c in counts(parts).items()))
    kinds = ("matched", "missing", "repeated", "late", "lost")
    cells = F.array(*(F.struct(F.lit(p.name).alias("part"), *(F.col(f"{p.name}_{k}").alias(k) for k in kinds)) for p in parts))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def training_rows(df: DataFrame, base: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """The base's rows of a matched table with the parts' columns, null where a part has none."""
    return df.where("_in").select(*base.columns, *(c for p in parts for c in p.cols))


def write_training_set(base: DataFrame, key: Sequence[str], day: str, parts: Sequence[Part], path: str, forbidden: Iterable[str] = ()) -> dict[str, int]:
    """Writes the training set and gives its counts, which are taken while it is written; raises ``Refused`` on a breach.

    Rows go to a staging folder beside ``path`` and only take its place if nothing was breached, so a refused or lost
    run leaves what was there. ``forbidden`` names outcome columns that no part may give.
    """
    for p in parts:
        guard_columns(p.df.select(*p.cols), forbidden)
    seen = Observation()
    whole = matched(base, key, day, parts).observe(seen, *(c.alias(k) for k, c in counts(parts).items()))
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    spark = base.sparkSession
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        training_rows(whole, base, parts).write.parquet(staged)
        got = {k: int(v) for k, v in seen.get.items()}
        found = breaches(got, parts)
        if found:
            raise Refused(found, got)
        fs.delete(at(path), True)
        if not fs.rename(at(staged), at(path)):
            raise OSError(f"{staged} could not take the place of {path}")
        return got
    finally:
        fs.delete(at(staged), True)
