"""Contests and entries from the order tables: a race is an order, a runner one of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import payout, scalars
from formline.operators.joins import dealt
from formline.operators.windows import share, softmax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task gets about, where they are dealt by race or entity.
TASK_ROWS = 200_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks share the lines, so that one holds no more of larger tables; the files' footers give their number.

    None where Spark's own number of partitions is over four times that: a join would not go below it.
    """
    n = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))
    return n if 4 * n >= int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per runner with its race's context and its outcome.

    ``ord`` numbers races in time, one number per race, so RANGE frames over it exclude a whole race. Lines are dealt by
    race once, to ``tasks``, for the join with its order and all that follows inside a race.
    """
    n = tasks(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("race_date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("race_class"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("trainer"))
    li = table(spark, sf_dir, "lineitem")
    df = dealt(li.join(p, li.l_partkey == p.p_partkey), ["l_orderkey"], n).join(dealt(o, ["o_orderkey"], n), F.col("l_orderkey") == F.col("o_orderkey"))
    race = Window.partitionBy("race")
    df = df.select(
        F.col("o_orderkey").alias("race"), "race_date", "race_class", "trainer", F.col("l_partkey").alias("horse"), F.col("l_suppkey").alias("jockey"),
        F.col("l_linenumber").alias("draw"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("going"), F.col("l_linestatus").alias("surface"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
    )
    df = df.withColumn("saddle", F.row_number().over(race.orderBy("draw", "horse", "jockey", "price")))
    df = df.withColumns({"finish_pos": F.row_number().over(race.orderBy(F.desc("price"), "saddle")), "field_size": F.count(F.lit(1)).over(race).cast("int")})
    distance = (1000 + 200 * F.pmod(F.col("race"), F.lit(7))).cast("int")
    df = df.withColumns({
        "ord": (F.datediff("race_date", F.lit("1995-01-01")).cast("long") * 1_000_000_000 + F.col("race")),
        "season": scalars.season_label(F.col("race_date")), "distance": distance, "win_odds": 1 + F.col("weight"),
        "n_places": scalars.paid_places(F.col("field_size")), "won": (F.col("finish_pos") == 1).cast("int"), "time_s": distance / (15 + F.col("disc") * 10),
    })
    return df.withColumns({
        "placed": (F.col("finish_pos") <= F.col("n_places")).cast("int"), "speed": F.col("distance") / F.col("time_s"), "dist_band": (F.floor(F.col("distance") / 200) * 200).cast("int"),
        "draw_rel": F.col("draw") / F.col("field_size"), "payout": 10 * F.col("win_odds"),
    })


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with a market chance and a model chance."""
    df = share(runners(spark, sf_dir), "race", payout.implied(F.col("win_odds")), "p_market")
    df = df.withColumn("eta", F.col("tax") * 10 + F.col("price") / 100000)
    return softmax(df, "race", "eta", "p_model").withColumn("p_blend", 0.5 * F.col("p_model") + 0.5 * F.col("p_market"))


#: The same tables in SQL.
RUNNERS_SQL = """
base AS (SELECT o_orderkey AS race, CAST(o_orderdate AS DATE) AS race_date, CAST(substr(o_orderpriority, 1, 1) AS INT) AS race_class, p_brand AS trainer,
    l_partkey AS horse, l_suppkey AS jockey, l_linenumber AS draw, l_quantity AS weight, l_returnflag AS going, l_linestatus AS surface,
    l_extendedprice AS price, l_discount AS disc, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY draw, horse, jockey, price) AS saddle, count(*) OVER (PARTITION BY race) AS field_size FROM base),
placed0 AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY price DESC, saddle) AS finish_pos,
    CAST(date_diff('day', DATE '1995-01-01', race_date) AS BIGINT) * 1000000000 + race AS ord,
    year(race_date) - CASE WHEN month(race_date) < 9 THEN 1 ELSE 0 END AS sy, 1000 + 200 * (race % 7) AS distance, 1 + weight AS win_odds,
    CASE WHEN field_size >= 7 THEN 3 WHEN field_size >= 5 THEN 2 ELSE 0 END AS n_places FROM numbered),
runners AS (SELECT *, CAST(sy AS VARCHAR) || '-' || lpad(CAST((sy + 1) % 100 AS VARCHAR), 2, '0') AS season,
    CASE WHEN finish_pos = 1 THEN 1 ELSE 0 END AS won, CASE WHEN finish_pos <= n_places THEN 1 ELSE 0 END AS placed, distance / (15 + disc * 10) AS time_s,
    distance / (distance / (15 + disc * 10)) AS speed, CAST(floor(distance / 200.0) * 200 AS INT) AS dist_band, draw / CAST(field_size AS DOUBLE) AS draw_rel, 10 * win_odds AS payout
  FROM placed0)"""
PRICED_SQL = RUNNERS_SQL + """,
shared AS (SELECT *, (1 / win_odds) / sum(1 / win_odds) OVER (PARTITION BY race) AS p_market, tax * 10 + price / 100000 AS eta FROM runners),
exped AS (SELECT *, exp(eta - max(eta) OVER (PARTITION BY race)) AS e FROM shared),
modelled AS (SELECT *, e / sum(e) OVER (PARTITION BY race) AS p_model FROM exped),
priced AS (SELECT *, 0.5 * p_model + 0.5 * p_market AS p_blend FROM modelled)"""
