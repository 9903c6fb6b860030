"""More of an entity's history: ages, running styles, lagged summaries, dimension attributes, medians so far, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators import reports, windows


def age_at_event(df: DataFrame, keys: windows.Keys, day: str, birth_year: str, origin: str, young: Sequence[str], ages: tuple[int, int] = (3, 4)) -> DataFrame:
    """Adds age_at_race and age_imputed: by the known birth year, else as if the entity was so old in its first year.

    ``ages`` are the usual ages at the first event for an origin in ``young`` and for any other.
    """
    first = F.min(F.year(day)).over(Window.partitionBy(*([keys] if isinstance(keys, str) else keys)))
    guess = first - F.when(F.col(origin).isin(*young), ages[0]).otherwise(ages[1])
    return df.withColumns({"age_imputed": F.col(birth_year).isNull().cast("int"), "age_at_race": (F.year(day) - F.coalesce(F.col(birth_year), guess)).cast("double")})


def side_event_fills(df: DataFrame, n_between: str, gap: str, fresh_days: int = 60) -> DataFrame:
    """0 where there was no side event, and a flag for a first start after a long gap with one; no gap counts as long."""
    df = df.withColumn(n_between, F.coalesce(F.col(n_between).cast("double"), F.lit(0.0)))
    return df.withColumn("first_up_trial", ((F.coalesce(F.col(gap), F.lit(999)) >= fresh_days) & (F.col(n_between) > 0)).cast("double"))


def running_style(df: DataFrame, positions: str, field: str, keys: windows.Keys, order: windows.Keys, early: float = 0.3, late: float = 0.6, n: int = 3) -> DataFrame:
    """Adds early_pct, style (E, P or S) and the mean early_pct of the last ``n`` runs.

    ``positions`` is text such as ``3 4 1``; its first third, rounded down, gives the early position, which is null if
    that is empty or a token is no number.
    """
    parts = F.split(F.trim(positions), r"\s+")
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    head = F.slice(numbers, 1, F.greatest(F.floor(F.size(parts) * 0.33).cast("int"), F.lit(0)))
    mean = F.aggregate(head, F.lit(0.0), lambda s, x: s + x) / F.size(head)
    known = (F.size(head) > 0) & F.forall(numbers, lambda x: x.isNotNull())
    df = df.withColumn("early_pct", F.when(known, mean / F.col(field)))
    df = df.withColumn("style", F.when(F.col("early_pct") >= late, "S").when(F.col("early_pct") <= early, "E").when(F.col("early_pct").isNotNull(), "P"))
    return windows.prior_roll(df, keys, order, "early_pct", n, f"habitual_early_pct_{n}")


def lagged_summaries(df: DataFrame, keys: windows.Keys, order: windows.Keys, cols: Sequence[str]) -> DataFrame:
    """Adds each column of the entity's previous row as c_lag1, the number of earlier rows and whether there are any."""
    w = windows.ordered(keys, order)
    df = df.withColumns({f"{c}_lag1": F.lag(c).over(w) for c in cols})
    df = df.withColumn("history_count", F.row_number().over(w) - 1)
    return df.withColumn("has_history", (F.col("history_count") > 0).cast("int"))


def leak_share(df: DataFrame, col: str, lag: str) -> DataFrame:
    """The share of rows whose value equals the lagged one; near 1 it would give a column away that wasn't lagged."""
    return df.agg(F.avg(F.coalesce(F.col(col) == F.col(lag), F.lit(False)).cast("double")).alias("leak_share"), F.count(F.lit(1)).alias("n"))


def with_dimension(df: DataFrame, dimension: DataFrame, on: Sequence[str], order: Sequence[Column | str], cols: Sequence[str], fill: dict[str, object] | None = None) -> DataFrame:
    """``df`` with columns of the dimension's first row per key, in ``order``; nulls filled, no row lost or repeated."""
    one = windows.dedup(dimension, list(on), order).select(*on, *cols)
    out = df.join(one, list(on), "left")
    return out.fillna(fill) if fill else out


def flag_days(df: DataFrame, days: DataFrame, day: str, out: str) -> DataFrame:
    """1 on days that the list has, else 0; a day that it has twice counts once."""
    known = days.select(F.col(day)).distinct().withColumn("_on", F.lit(1))
    return df.join(known, day, "left").withColumn(out, F.coalesce("_on", F.lit(0))).drop("_on")


def _split_cells(values: DataFrame, asked: DataFrame, day: str, fan: int) -> tuple[DataFrame, DataFrame]:
    """One step of ``median_so_far``: cells of values cut into at most ``fan`` + 2 parts, and each rank moved to the part that it falls in."""
    points = F.array(*(F.lit(i / fan) for i in range(1, fan)))
    edges = values.groupBy("_cell").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", points, 10_000).alias("_at"))
    edges = edges.select("_cell", F.array_sort(F.array_distinct(F.concat(F.array("_low", "_high"), "_at"))).alias("_edges"))
    values = values.join(edges, "_cell").withColumn("_sub", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    counts = values.groupBy("_cell", "_sub", day).agg(F.sum("_n").alias("_n")).withColumn("_ask", F.lit(None).cast("int"))
    wanted = asked.join(edges, "_cell").select("_cell", F.explode(F.sequence(F.lit(0), F.size("_edges") - 1)).alias("_sub"), day, F.lit(0).cast("long").alias("_n"), "_ask", "_k")
    both = counts.withColumn("_k", F.lit(None).cast("long")).unionByName(wanted)
    before = Window.partitionBy("_cell", "_sub").orderBy(F.col(day), F.col("_ask").isNull(), "_ask").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_c", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_ask IS NOT NULL")
    upto = F.sum("_c").over(Window.partitionBy(day, "_ask").orderBy("_sub"))
    found = found.withColumn("_upto", upto).where("_upto >= _k AND _upto - _c < _k")
    place = F.concat_ws(".", "_cell", F.col("_sub").cast("string"))
    asked = found.select(place.alias("_cell"), day, "_ask", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"))
    return values.withColumn("_cell", place).drop("_sub"), asked


def median_so_far(df: DataFrame, day: str, col: str, out: str, width: float | None = None, least: int = 200, fan: int = 64) -> DataFrame:
    """Fills nulls of ``col`` with the exact median of all values of earlier days, 0 with fewer than ``least``.

    Every day asks for the two middle ranks of the values before it. Values are summed by day and value, and cut into
    cells by quantiles; running counts per cell and day, of cells that hold a rank, tell which cell it falls in, and
    that one is cut again, until it holds one value. A step makes a row per day and cell of a fixed number of them, so
    neither the range of the values nor an outlier counts, and the steps follow the logarithm of the distinct values.
    With ``width`` values are taken to its multiples first. NaN counts as null.
    """
    v = F.col(col).cast("double")
    v = F.when(~F.isnan(v), v)
    df = df.withColumn("_x", v if width is None else F.round(v / width) * width)
    values = df.where("_x IS NOT NULL").groupBy(day, F.col("_x").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_cell", F.lit("0"))
    per = df.groupBy(day).agg(F.count("_x").alias("_n"))
    seen = per.select(day, F.coalesce(F.sum("_n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_seen"))  # a row per day
    ranks = F.array(F.struct(F.lit(0).alias("_ask"), F.floor((F.col("_seen") + 1) / 2).cast("long").alias("_k")), F.struct(F.lit(1).alias("_ask"), (F.floor(F.col("_seen") / 2) + 1).cast("long").alias("_k")))
    asked = seen.where(F.col("_seen") >= max(least, 1)).select(day, F.explode(ranks).alias("_r")).select(F.lit("0").alias("_cell"), day, "_r._ask", "_r._k")
    spark, kind = df.sparkSession, df.schema[day].dataType.simpleString()
    held, fills = [], []
    while rows := asked.collect():  # two per day at most
        asked = spark.createDataFrame(rows, f"_cell string, {day} {kind}, _ask int, _k long")
        values = values.join(F.broadcast(asked.select("_cell").distinct()), "_cell", "left_semi").persist()
        held.append(values)
        single = values.groupBy("_cell").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_low = _high").select("_cell", F.col("_low").alias("_fill"))
        done = {r["_cell"]: r["_fill"] for r in single.collect()}  # of cells that hold a rank: two per day at most
        fills += [(r[day], done[r["_cell"]]) for r in rows if r["_cell"] in done]
        rest = [r for r in rows if r["_cell"] not in done]
        if not rest:
            break
        values, asked = _split_cells(values, spark.createDataFrame(rest, asked.schema), day, fan)
    for t in held:
        t.unpersist()
    table = spark.createDataFrame(fills, f"{day} {kind}, _fill double").groupBy(day).agg(F.avg("_fill").alias("_fill"))
    return df.join(table, day, "left").withColumn(out, F.coalesce("_x", "_fill", F.lit(0.0))).drop("_fill", "_x")


def coverage_by_period(events: DataFrame, covered: DataFrame, key: Sequence[str], period: Column) -> DataFrame:
    """Per period: events, those covered, rows that cover them, rows per covered event, and the share covered."""
    rows = covered.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    all_ = events.select(*key, period.alias("period")).distinct().join(rows, list(key), "left")
    out = all_.groupBy("period").agg(F.count(F.lit(1)).alias("events"), F.count("_rows").alias("covered"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"))
    return out.withColumns({"rows_per_event": F.when(F.col("covered") > 0, F.col("n_rows") / F.col("covered")), "share": F.col("covered") / F.col("events")})


def mean_by_group(df: DataFrame, groups: dict[str, Column], value: str) -> DataFrame:
    """Mean and count of ``value`` by each of several groupings at once, as (grouping, level, mean, n); null levels are left out."""
    cells = F.array(*(F.struct(F.lit(n).alias("grouping"), c.cast("string").alias("level")) for n, c in groups.items()))
    rows = df.select(F.col(value).alias("_v"), F.explode(cells).alias("x")).select("_v", "x.*").where("level is not null")
    return rows.groupBy("grouping", "level").agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))


def repeated_members(sources: dict[str, DataFrame], key: Sequence[str], entity: str) -> DataFrame:
    """Keys that several rows of a source share, with their entities, as (source, key columns, n, entities)."""
    out = None
    for name, df in sources.items():
        per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("entities")).where("n > 1").withColumn("source", F.lit(name))
        out = per if out is None else out.unionByName(per)
    return out


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``, with ``n_rows``, how many rows had the key."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"n_rows": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(*(F.desc(c) for c in order)))})
    return ranked.where("_r = 1").drop("_r")


def clean_prices(df: DataFrame, price: str, needed: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Rows with a valid price and all that is ``needed``; nulls of ``fill`` become their column's exact median over these rows, the lower of two."""
    ok = df.where(F.col(price) > 1).dropna(subset=list(needed))
    mids = reports.medians(ok, {c: F.col(c) for c in fill}).first()
    return ok.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(mids[c])) for c in fill})


def attach_counted(df: DataFrame, side: DataFrame, on: Sequence[str], mark: str, by: Sequence[str]) -> DataFrame:
    """Per group: rows, rows that the side has too, and those that it lacks; ``mark`` is a side column that is never null."""
    rows = df.join(side.select(*on, mark).groupBy(*on).agg(F.min(mark).alias(mark)), list(on), "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count(mark).alias("matched"), (F.count(F.lit(1)) - F.count(mark)).alias("unmatched"))


def drop_sets(columns: Sequence[str], sets: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """For each named set the columns without it, in their order; a name that isn't there is an error."""
    for name, gone in sets.items():
        missing = set(gone) - set(columns)
        if missing:
            raise ValueError(f"{name} drops columns that are not there: {sorted(missing)}")
    return {name: [c for c in columns if c not in set(gone)] for name, gone in sets.items()}
