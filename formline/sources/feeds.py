"""JSON and CSV feeds to rows: cards, price pools, price histories, track work, holidays, climate series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import clean_text

#: The layout of the feeds.
ODDS = """struct<data:struct<raceMeetings:array<struct<date:string,venueCode:string,pmPools:array<struct<id:string,status:string,sellStatus:string,
oddsType:string,lastUpdateTime:string,leg:struct<number:int,races:array<int>>,
oddsNodes:array<struct<combString:string,oddsValue:string,hotFavourite:boolean,oddsDropValue:double>>>>>>>>"""
CARD = """struct<data:struct<raceMeetings:array<struct<date:string,venueCode:string,races:array<struct<no:string,distance:string,
runners:array<struct<no:string,standbyNo:string,status:string,name_en:string,horse:struct<id:string>,barrierDrawNumber:string,handicapWeight:string,currentWeight:string,currentRating:string,
jockey:struct<code:string>,trainer:struct<code:string>>>>>>>>>"""
TRACK = "struct<page:int,next:int,Records:array<struct<Horse:string,Trainer:string,Type:string,Racecourse_Track:string,Workouts:string,Gear:string>>>"
HOLIDAYS = "struct<vcalendar:array<struct<vevent:array<struct<dtstart:array<string>,summary:string>>>>>"


def rows_from_json(df: DataFrame, col: str, schema: str, *paths: str) -> DataFrame:
    """Parses ``col`` and explodes one nested array after another; each path starts from the element before it.

    Other columns stay. Elements are columns x1, x2, ...; malformed documents give no rows.
    """
    out = df.withColumn("x0", F.from_json(F.regexp_replace(F.col(col), "^﻿", ""), schema))
    for i, path in enumerate(paths):
        out = out.withColumn(f"x{i + 1}", F.explode(f"x{i}.{path}"))
    return out


def odds_rows(df: DataFrame, col: str) -> DataFrame:
    """(race_no, pool_type, last_update_time, comb, odds, hot_favourite) for each price of each pool."""
    pools = odds_pools(df, col)
    rows = pools.withColumn("node", F.explode("nodes"))
    price = F.col("node.oddsValue").try_cast("double")
    return rows.select(*df.columns, "race_no", "pool_type", "last_update_time", F.col("node.combString").alias("comb"), price.alias("odds"), F.col("node.hotFavourite").alias("hot_favourite"))


def odds_pools(df: DataFrame, col: str) -> DataFrame:
    """One row per pool with its price nodes still nested: the grain at which snapshots repeat."""
    rows = rows_from_json(df, col, ODDS, "data.raceMeetings", "pmPools")
    number = F.coalesce(F.get(F.col("x2.leg.races"), F.lit(0)), F.col("x2.leg.number"))
    return rows.select(*df.columns, number.alias("race_no"), F.col("x2.oddsType").alias("pool_type"), F.col("x2.lastUpdateTime").alias("last_update_time"), F.col("x2.oddsNodes").alias("nodes"))


def card_rows(df: DataFrame, col: str) -> DataFrame:
    """Declared runners of a card: race_no, saddle, horse_id, draw, weights, rating, connections."""
    rows = rows_from_json(df, col, CARD, "data.raceMeetings", "races", "runners")
    r = F.col("x3")
    return rows.where(F.lower(F.coalesce(r["status"], F.lit("declared"))) == "declared").select(
        F.col("x1.date").try_cast("date").alias("race_date"), F.col("x1.venueCode").alias("venue"), F.col("x2.no").try_cast("int").alias("race_no"), F.col("x2.distance").try_cast("int").alias("distance_m"),
        r["no"].try_cast("int").alias("saddle"), r["horse"]["id"].alias("horse_id"), r["name_en"].alias("horse_name"), r["barrierDrawNumber"].try_cast("int").alias("draw"),
        r["handicapWeight"].try_cast("double").alias("actual_weight"), r["currentWeight"].try_cast("double").alias("declared_weight"), r["currentRating"].try_cast("int").alias("rating"),
        r["jockey"]["code"].alias("jockey_code"), r["trainer"]["code"].alias("trainer_code"),
    )


def track_rows(df: DataFrame, col: str) -> DataFrame:
    """Work-outs of paged documents, those without a name left out."""
    rows = rows_from_json(df, col, TRACK, "Records")
    r = F.col("x1")
    name = clean_text(r["Horse"])
    return rows.select(*df.columns, F.col("x0.page").alias("page"), name.alias("horse_name"), clean_text(r["Trainer"]).alias("trainer"), r["Type"].alias("kind"), r["Racecourse_Track"].alias("track"), r["Workouts"].alias("workouts"), r["Gear"].alias("gear")).where("horse_name <> ''")


def holiday_rows(df: DataFrame, col: str) -> DataFrame:
    """(date, name) of calendar events, malformed ones left out."""
    rows = rows_from_json(df, col, HOLIDAYS, "vcalendar", "vevent")
    day = F.try_to_timestamp(F.get(F.col("x2.dtstart"), F.lit(0)), F.lit("yyyyMMdd")).cast("date")
    return rows.select(day.alias("date"), F.col("x2.summary").alias("name")).where("date is not null")


def last_prices(df: DataFrame, col: str, ts: str) -> DataFrame:
    """(race, runner, price) of the latest history document, a map of maps."""
    latest = df.agg(F.max_by(col, ts).alias("doc")).select(F.from_json("doc", "map<string,map<string,string>>").alias("m"))
    races = latest.select(F.explode("m").alias("race", "prices"))
    return races.select(F.col("race").try_cast("int").alias("race_no"), F.explode("prices").alias("runner", "price")).select("race_no", F.col("runner").try_cast("int").alias("saddle"), F.col("price").try_cast("double").alias("odds"))


def climate_rows(lines: DataFrame, series: Column) -> DataFrame:
    """(date, series, value) of lines ``year,month,day,value``; starred and other values that are no numbers go."""
    p = F.split("value", ",")
    part = lambda i: F.trim(F.get(p, F.lit(i)))
    day = F.make_date(part(0).try_cast("int"), part(1).try_cast("int"), part(2).try_cast("int"))
    ok = part(1).try_cast("int").between(1, 12) & part(2).try_cast("int").between(1, 31)
    return lines.where(ok).select(day.alias("date"), series.alias("series"), part(3).try_cast("double").alias("reading")).where("reading is not null and date is not null")


def climate_table(rows: DataFrame) -> DataFrame:
    """One row per date with mean, max and min; dates that only one series has stay."""
    return rows.groupBy("date").pivot("series", ["mean", "max", "min"]).agg(F.first("reading", ignorenulls=True))
