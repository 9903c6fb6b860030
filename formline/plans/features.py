"""Registered queries: features as of each event, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import scalars
from formline.operators import joins, scans, windows
from formline.plans.spine import RUNNERS_SQL, priced, runners, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


KEY = ["race", "saddle"]
#: Span of ``ord`` that is a day.
DAY = 1_000_000_000
W = f"WITH {RUNNERS_SQL} "
HORSE = "PARTITION BY horse ORDER BY ord, saddle"


@query(W + f"""SELECT race, saddle, row_number() OVER h - 1 AS career_run_number, date_diff('day', min(race_date) OVER (PARTITION BY horse), race_date) AS days_since_debut,
 date_diff('day', lag(race_date) OVER h, race_date) AS days_since_last_run, CAST(sum(fresh) OVER h - 1 AS BIGINT) AS seasons_active
 FROM (SELECT *, CASE WHEN season IS DISTINCT FROM lag(season) OVER h THEN 1 ELSE 0 END AS fresh FROM runners WINDOW h AS ({HORSE})) WINDOW h AS ({HORSE})""")
def career_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.career(runners(spark, sf_dir), "horse", ["ord", "saddle"], "race_date", "season")
    return df.select(*KEY, "career_run_number", "days_since_debut", "days_since_last_run", "seasons_active")


@query(W + f"""SELECT race, saddle, round(avg(finish_pos) OVER f, 6) AS avg_finish_last3, round(avg(disc) OVER f, 6) AS avg_lbw_last3, round(avg(speed) OVER f, 6) AS recent_speed
 FROM runners WINDOW f AS ({HORSE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def recent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir)
    for col, out in (("finish_pos", "avg_finish_last3"), ("disc", "avg_lbw_last3"), ("speed", "recent_speed")):
        df = windows.prior_roll(df, "horse", ["ord", "saddle"], col, 3, out)
    return df.select(*KEY, r6("avg_finish_last3"), r6("avg_lbw_last3"), r6("recent_speed"))


def _rate(label: str, by: str) -> str:
    frame = f"(PARTITION BY {by} ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) OVER {frame} > 0 THEN round(sum({label}) OVER {frame} / CAST(count(*) OVER {frame} AS DOUBLE), 6) END"


@query(W + f"""SELECT race, saddle, {_rate('won', 'horse')} AS win_rate_prior, {_rate('placed', 'horse')} AS place_rate_prior, {_rate('placed', 'horse, dist_band')} AS dist_match_rate,
 {_rate('placed', 'horse, going')} AS going_match_rate FROM runners""")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir)
    for keys, label, out in (("horse", "won", "win_rate_prior"), ("horse", "placed", "place_rate_prior"), (["horse", "dist_band"], "placed", "dist_match_rate"), (["horse", "going"], "placed", "going_match_rate")):
        df = windows.prior_rate(df, keys, "ord", label, out)
    return df.select(*KEY, *(r6(c) for c in ("win_rate_prior", "place_rate_prior", "dist_match_rate", "going_match_rate")))


def _n(by: str) -> str:
    return f"count(*) OVER (PARTITION BY {by} ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(W + f""", coded AS (SELECT *, CASE WHEN draw % 2 = 0 THEN 'T' || substr(trainer, 7) END AS code FROM runners),
 seen AS (SELECT trainer, code, row_number() OVER (PARTITION BY trainer ORDER BY count(*) DESC, code) AS r FROM coded WHERE code IS NOT NULL GROUP BY trainer, code),
 keyed AS (SELECT c.*, coalesce(c.code, s.code, c.trainer) AS tkey FROM coded c LEFT JOIN seen s ON c.trainer = s.trainer AND s.r = 1)
 SELECT race, saddle, {_rate('won', 'jockey')} AS jockey_win_rate, {_n('jockey')} AS jockey_runs_prior, tkey AS trainer_key, {_rate('won', 'tkey')} AS trainer_win_rate, {_n('tkey')} AS trainer_runs_prior FROM keyed""")
def connection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir).withColumn("code", F.when(F.col("draw") % 2 == 0, F.concat(F.lit("T"), F.expr("substr(trainer, 7)"))))
    df = joins.canonical_key(df, "trainer", "code", "trainer_key")
    df = windows.prior_rate(df, "jockey", "ord", "won", "jockey_win_rate")
    df = scans.prior_rate(df, ["trainer_key"], "ord", DAY, "won", "trainer_win_rate")
    return df.select(*KEY, r6("jockey_win_rate"), F.col("jockey_win_rate_n").alias("jockey_runs_prior"), "trainer_key", r6("trainer_win_rate"), F.col("trainer_win_rate_n").alias("trainer_runs_prior"))


@query(W + f""", lagged AS (SELECT *, CASE WHEN race_class - lag(race_class) OVER ({HORSE}) > 0 THEN 1 ELSE 0 END AS is_drop FROM runners),
 rated AS (SELECT *, sum(CASE WHEN is_drop = 1 THEN won END) OVER t AS w, sum(CASE WHEN is_drop = 1 THEN 1 END) OVER t AS n FROM lagged
  WINDOW t AS (PARTITION BY trainer ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT race, saddle, is_drop, round(is_drop * coalesce(w / CAST(n AS DOUBLE), 0.0), 6) AS drop_x_trsr FROM rated""")
def class_drop_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.lagged(runners(spark, sf_dir), "horse", ["ord", "saddle"], ["race_class"])
    df = df.withColumn("is_drop", F.coalesce((F.col("race_class") - F.col("prev_race_class") > 0).cast("int"), F.lit(0)))
    df = scans.prior_rate(df.select(*KEY, "trainer", "ord", "won", "is_drop"), ["trainer"], "ord", DAY, "won", "drop_rate", F.col("is_drop") == 1)
    return df.select(*KEY, "is_drop", F.round(F.col("is_drop") * F.coalesce("drop_rate", F.lit(0.0)), 6).alias("drop_x_trsr"))


@query(W + f""", f AS (SELECT *, weight - lag(weight) OVER h AS bw_chg, weight - avg(weight) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bw_vs_avg,
  date_diff('day', lag(race_date) OVER h, race_date) AS gap, weight - avg(weight) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bw_vs_ma3,
  CASE WHEN count(weight) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 2 THEN stddev_samp(weight) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS bw_std3,
  weight / avg(weight) OVER (PARTITION BY race) - 1 AS bw_vs_field FROM runners WINDOW h AS ({HORSE}))
 SELECT race, saddle, bw_chg, round(bw_vs_avg, 6) AS bw_vs_avg, CASE WHEN bw_chg > 8 AND gap > 45 THEN 1 ELSE 0 END AS bw_up_fresh, CASE WHEN bw_chg IS NULL THEN NULL WHEN bw_chg < 0 THEN -bw_chg ELSE 0.0 END AS bw_drop,
  round(bw_vs_ma3, 6) AS bw_vs_ma3, round(bw_std3, 6) AS bw_std3, round(bw_vs_field, 6) AS bw_vs_field FROM f""")
def weight_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = "horse", ["ord", "saddle"]
    df = windows.lagged(runners(spark, sf_dir), keys, order, ["weight", "race_date"])
    df = df.withColumn("all_mean", F.avg("weight").over(windows.rows(keys, order, windows.Window.unboundedPreceding, -1)))
    df = windows.prior_roll(windows.prior_roll(df, keys, order, "weight", 3, "ma3"), keys, order, "weight", 3, "bw_std3", F.stddev_samp, 2)
    df = df.withColumn("bw_chg", F.col("weight") - F.col("prev_weight")).withColumn("field_mean", F.avg("weight").over(windows.ordered("race", ["race"])))
    fresh = (F.col("bw_chg") > 8) & (F.datediff("race_date", "prev_race_date") > 45)
    return df.select(
        *KEY, "bw_chg", F.round(F.col("weight") - F.col("all_mean"), 6).alias("bw_vs_avg"), F.coalesce(fresh.cast("int"), F.lit(0)).alias("bw_up_fresh"), F.when(F.col("bw_chg") < 0, -F.col("bw_chg")).when(F.col("bw_chg").isNotNull(), 0.0).alias("bw_drop"),
        F.round(F.col("weight") - F.col("ma3"), 6).alias("bw_vs_ma3"), r6("bw_std3"), F.round(F.col("weight") / F.col("field_mean") - 1, 6).alias("bw_vs_field"),
    )


@query(W + f"""SELECT race, saddle, weight - lag(weight, 3) OVER h AS rating_trend3, race_class - lag(race_class) OVER h AS class_move, finish_pos - lag(finish_pos) OVER h AS finish_change,
 distance - lag(distance) OVER h AS distance_change, round(avg(race_class) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - race_class, 6) AS class_advantage,
 CAST(max(won) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS INT) AS won_last3 FROM runners WINDOW h AS ({HORSE})""")
def rating_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = "horse", ["ord", "saddle"]
    df = windows.lagged(runners(spark, sf_dir), keys, order, ["race_class", "finish_pos", "distance"])
    df = windows.lagged(df, keys, order, ["weight"], 3, "third_")
    df = windows.prior_roll(windows.prior_roll(df, keys, order, "race_class", 3, "class_mean"), keys, order, "won", 3, "won_last3", F.max)
    return df.select(
        *KEY, (F.col("weight") - F.col("third_weight")).alias("rating_trend3"), (F.col("race_class") - F.col("prev_race_class")).alias("class_move"), (F.col("finish_pos") - F.col("prev_finish_pos")).alias("finish_change"),
        (F.col("distance") - F.col("prev_distance")).alias("distance_change"), F.round(F.col("class_mean") - F.col("race_class"), 6).alias("class_advantage"), "won_last3",
    )


@query(W + f"SELECT race, saddle, {_rate('won', 'jockey, trainer')} AS pair_rate, {_n('jockey, trainer')} AS pair_runs, {_rate('won', 'horse, distance')} AS distance_rate, {_rate('won', 'horse, surface')} AS surface_rate FROM runners")
def composite_key_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir)
    for keys, out in ((["jockey", "trainer"], "pair_rate"), (["horse", "distance"], "distance_rate"), (["horse", "surface"], "surface_rate")):
        df = windows.prior_rate(df, keys, "ord", "won", out)
    return df.select(*KEY, r6("pair_rate"), F.col("pair_rate_n").alias("pair_runs"), r6("distance_rate"), r6("surface_rate"))


@query(W + """SELECT race, saddle, CASE WHEN count(won) OVER j >= 20 THEN round(avg(won) OVER j, 6) END AS jockey_form_200 FROM runners
 WINDOW j AS (PARTITION BY jockey ORDER BY ord, saddle ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)""")
def rolling_form_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.prior_roll(runners(spark, sf_dir), "jockey", ["ord", "saddle"], "won", 200, "jockey_form_200", least=20).select(*KEY, r6("jockey_form_200"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to five split rows per runner, as many as its race has sections."""
    df = runners(spark, sf_dir).select("race", "saddle", "horse", "ord", "distance", "disc", "tax", "finish_pos", F.explode(F.sequence(F.lit(1), (3 + F.col("race") % 3).cast("int"))).alias("section"))
    return df.withColumn("split", 20 + F.col("disc") * F.col("section") + F.col("tax")).withColumn("position", F.pmod(F.col("saddle") * F.col("section") + F.col("finish_pos"), F.lit(9)) + 1)


SPLITS_SQL = RUNNERS_SQL + """,
splits AS (SELECT race, saddle, horse, ord, distance, disc, tax, finish_pos, section, 20 + disc * section + tax AS split, (saddle * section + finish_pos) % 9 + 1 AS position FROM runners, (VALUES (1), (2), (3), (4), (5)) s(section) WHERE section <= 3 + race % 3)"""
SUMMARY_SQL = SPLITS_SQL + """,
summary AS (SELECT race, saddle, any_value(horse) AS horse, any_value(ord) AS ord, any_value(distance) AS distance, any_value(finish_pos) AS finish_pos, arg_max(split, section) AS last_split, arg_min(split, section) AS first_split,
  min(split) AS min_split, avg(split) AS mean_split, stddev_samp(split) AS std_split, arg_min(position, section) - arg_max(position, section) AS position_gain, arg_max(position, section) AS last_position, arg_min(position, section) AS early_position, count(*) AS nsec
  FROM splits GROUP BY race, saddle)"""


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).groupBy("race", "saddle").agg(
        *(F.first(c).alias(c) for c in ("horse", "ord", "distance", "finish_pos")), F.max_by("split", "section").alias("last_split"), F.min_by("split", "section").alias("first_split"), F.min("split").alias("min_split"),
        F.avg("split").alias("mean_split"), F.stddev_samp("split").alias("std_split"), (F.min_by("position", "section") - F.max_by("position", "section")).alias("position_gain"),
        F.max_by("position", "section").alias("last_position"), F.min_by("position", "section").alias("early_position"), F.count(F.lit(1)).alias("nsec"),
    )


@query(f"WITH {SUMMARY_SQL} SELECT race, saddle, round(last_split, 6) AS last_split, round(min_split, 6) AS min_split, round(mean_split, 6) AS mean_split, round(std_split, 6) AS std_split, CAST(position_gain AS BIGINT) AS position_gain, nsec FROM summary")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_table(spark, sf_dir).select(*KEY, r6("last_split"), r6("min_split"), r6("mean_split"), r6("std_split"), F.col("position_gain").cast("long").alias("position_gain"), "nsec")


PACE_SQL = SUMMARY_SQL + """,
race_pace AS (SELECT race, any_value(ord) AS ord, any_value(distance) AS distance, max(nsec) AS nsec, min(first_split) AS lead_split FROM summary GROUP BY race),
pressed AS (SELECT *, CASE WHEN count(lead_split) OVER p >= 2 AND stddev_samp(lead_split) OVER p > 1e-12 THEN round(-(lead_split - avg(lead_split) OVER p) / stddev_samp(lead_split) OVER p, 9) ELSE 0.0 END AS pace_press
  FROM race_pace WINDOW p AS (PARTITION BY distance, nsec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paced AS (SELECT s.*, pace_press, round(median(last_split) OVER (PARTITION BY s.race) - last_split, 9) AS late_rel FROM summary s JOIN pressed USING (race)),
flagged AS (SELECT *, late_rel * (1 + least(greatest(pace_press, 0), 2.5)) AS pace_close, CASE WHEN pace_press > 0.4 AND early_position <= 3 AND finish_pos <= 3 THEN 1 ELSE 0 END AS led_held,
  CASE WHEN finish_pos >= 6 AND late_rel >= 0.35 AND pace_press > 0 THEN 1 ELSE 0 END AS hidden FROM paced)"""


def pace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pace of each race against races of its distance and number of sections so far, itself included, and each runner's
    closing against its field. Without a comparable race the pace is neutral, 0."""
    s = split_table(spark, sf_dir)
    race = s.groupBy("race").agg(F.first("ord").alias("ord"), F.first("distance").alias("distance"), F.max("nsec").alias("nsec"), F.min("first_split").alias("lead_split"))
    race = scans.expanding_z(race, ["distance", "nsec"], "ord", DAY, "lead_split", "pace_press", sign=-1).select("race", F.round("pace_press", 9).alias("pace_press"))
    df = s.join(race, "race").withColumn("late_rel", F.round(F.median("last_split").over(windows.Window.partitionBy("race")) - F.col("last_split"), 9))
    return df.withColumns({
        "pace_close": F.col("late_rel") * (1 + F.least(F.greatest(F.col("pace_press"), F.lit(0.0)), F.lit(2.5))),
        "led_held": ((F.col("early_position") <= 3) & (F.col("finish_pos") <= 3) & (F.col("pace_press") > 0.4)).cast("int"),
        "hidden": ((F.col("finish_pos") >= 6) & (F.col("late_rel") >= 0.35) & (F.col("pace_press") > 0)).cast("int"),
    })


@query(f"WITH {PACE_SQL} SELECT race, saddle, round(pace_press, 6) AS pace_press, round(late_rel, 6) AS late_rel, round(pace_close, 6) AS pace_close, led_held, hidden FROM flagged")
def pace_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pace_table(spark, sf_dir).select(*KEY, r6("pace_press"), r6("late_rel"), r6("pace_close"), "led_held", "hidden")


@query(f"""WITH {PACE_SQL} SELECT race, saddle, round(avg(late_rel) OVER h, 6) AS late_rel3, round(avg(pace_close) OVER h, 6) AS pace_close3, CAST(sum(led_held) OVER h AS BIGINT) AS led_held3, CAST(sum(hidden) OVER h AS BIGINT) AS hidden_hp3,
 round(max(late_rel) OVER h, 6) AS late_best, round(lag(mean_split) OVER (PARTITION BY horse ORDER BY ord, saddle), 6) AS prev_mean_split FROM flagged WINDOW h AS (PARTITION BY horse ORDER BY ord, saddle ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def pace_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = "horse", ["ord", "saddle"]
    df = pace_table(spark, sf_dir)
    for col, out, fn in (("late_rel", "late_rel3", F.avg), ("pace_close", "pace_close3", F.avg), ("led_held", "led_held3", F.sum), ("hidden", "hidden_hp3", F.sum), ("late_rel", "late_best", F.max)):
        df = windows.prior_roll(df, keys, order, col, 4, out, fn)
    df = windows.lagged(df, keys, order, ["mean_split"])
    return df.select(*KEY, r6("late_rel3"), r6("pace_close3"), "led_held3", "hidden_hp3", r6("late_best"), r6("prev_mean_split"))


def _sum(expr: str) -> str:
    return f"coalesce(sum({expr}) OVER (PARTITION BY distance, draw ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(W + f"SELECT race, saddle, round(({_sum('won')} + 20.0) / ({_sum('1.0 / field_size')} + 20.0) - 1, 6) AS draw_bias, round((({_sum('placed')} + 60.0) / ({_sum('3.0 / field_size')} + 60.0) - 1) * (field_size - 12), 6) AS draw_place_bias FROM runners")
def draw_bias_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir).withColumn("due", 1.0 / F.col("field_size")).withColumn("due3", 3.0 / F.col("field_size"))
    df = scans.shrunk_bias(df, ["distance", "draw"], "ord", DAY, {"draw_bias": ("won", "due", 20.0), "place_bias": ("placed", "due3", 60.0)})
    return df.select(*KEY, r6("draw_bias"), F.round(F.col("place_bias") * (F.col("field_size") - 12), 6).alias("draw_place_bias"))


@query(W + """, d AS (SELECT race_date, count(weight) AS n, sum(weight) AS s, sum(weight * weight) AS q FROM runners GROUP BY race_date),
 past AS (SELECT race_date, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM d WINDOW w AS (ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT race, saddle, round(CASE WHEN n >= 500 THEN greatest(-5.0, least(5.0, (weight - s / n) / sqrt((q - s * s / n) / (n - 1)))) ELSE 0.0 END, 6) AS z_weight FROM runners JOIN past USING (race_date)""")
def global_expanding_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.global_expanding_z(runners(spark, sf_dir), "race_date", ["weight"]).select(*KEY, r6("z_weight"))


EVENTS_SQL = """WITH target AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), side AS (SELECT user_id, ts, value FROM events WHERE event_type = 'signup')"""


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("side_ts"), F.col("value").alias("side_value"))


@query(EVENTS_SQL + """ SELECT t.event_id, date_diff('day', CAST(s.ts AS DATE), CAST(t.ts AS DATE)) AS days_since, CASE WHEN date_diff('day', CAST(s.ts AS DATE), CAST(t.ts AS DATE)) <= 60 THEN 1 ELSE 0 END AS recent
 FROM target t ASOF LEFT JOIN side s ON t.user_id = s.user_id AND t.ts >= s.ts""")
def days_since_side_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, side = _events(spark, sf_dir)
    df = joins.asof_join(target, side, "user_id", "ts", "side_ts", ["side_value"])
    days = F.datediff("ts", "asof_side_ts")
    return df.select("event_id", days.alias("days_since"), F.coalesce((days <= 60).cast("int"), F.lit(0)).alias("recent"))


@query(EVENTS_SQL + """ SELECT t.event_id, CASE WHEN date_diff('day', CAST(s.ts AS DATE), CAST(t.ts AS DATE)) <= 5 THEN s.value END AS side_value FROM target t ASOF LEFT JOIN side s ON t.user_id = s.user_id AND t.ts > s.ts""")
def latest_side_event_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, side = _events(spark, sf_dir)
    return joins.asof_join(target, side, "user_id", "ts", "side_ts", ["side_value"], strict=True, tolerance_days=5).select("event_id", "side_value")


@query(EVENTS_SQL + """, spans AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '1970-01-01') AS prev FROM target)
 SELECT t.event_id, count(s.value) AS n_between, max(s.value) AS max_between FROM spans t LEFT JOIN side s ON t.user_id = s.user_id AND s.ts > t.prev AND s.ts < t.ts AND date_diff('day', CAST(s.ts AS DATE), CAST(t.ts AS DATE)) <= 365 GROUP BY t.event_id""")
def side_events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, side = _events(spark, sf_dir)
    aggs = [F.count("r_side_value").alias("n_between"), F.max("r_side_value").alias("max_between")]
    return joins.between_agg_join(target, side, "user_id", "ts", "side_ts", ["event_id"], aggs, max_days=365)


@query(W + """, t AS (SELECT race, saddle, CASE WHEN draw = 4 THEN NULL ELSE time_s END AS t, surface, going FROM runners),
 r AS (SELECT *, count(t) OVER (PARTITION BY race) AS n, CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY race ORDER BY t NULLS LAST) END AS r, min(t) OVER (PARTITION BY race) AS b FROM t)
 SELECT race, saddle, round(t - b, 6) AS bt_margin, round(CASE WHEN r IS NULL THEN NULL WHEN n > 1 THEN (r - 1) / CAST(n - 1 AS DOUBLE) ELSE 0.0 END, 6) AS bt_rank,
 CASE WHEN surface = 'F' THEN 1.0 ELSE 0.0 END AS bt_failed, CASE WHEN r = 1 AND going = 'A' THEN 1.0 ELSE 0.0 END AS bt_easy FROM r""")
def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir).withColumn("t", F.when(F.col("draw") != 4, F.col("time_s")))
    result = F.when(F.col("surface") == "F", "Failed").otherwise("Passed")
    comment = F.when(F.col("going") == "A", "Won easily").otherwise("ran on")
    df = windows.trial_metrics(df, "race", "t", scalars.trial_failed(result), scalars.trial_easy(comment))
    return df.select(*KEY, r6("bt_margin"), r6("bt_rank"), "bt_failed", "bt_easy")


@query(W + """, e AS (SELECT * FROM runners WHERE season < '1999-00'), per AS (SELECT jockey, avg(won) AS rate FROM e GROUP BY jockey)
 SELECT race, saddle, round(coalesce(rate, (SELECT avg(won) FROM e)), 6) AS jockey_code_rate FROM runners LEFT JOIN per USING (jockey)""")
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formline.operators.reports import target_encoding as encode

    return encode(runners(spark, sf_dir), "jockey", "won", F.col("season") < "1999-00", "jockey_code_rate").select(*KEY, r6("jockey_code_rate"))


@query(W + """, known AS (SELECT * FROM runners WHERE race_date < DATE '2001-01-01'), card AS (SELECT * FROM runners WHERE race_date >= DATE '2001-01-01'),
 u AS (SELECT race, saddle, horse, ord, won, weight, 0 AS forward FROM known UNION ALL SELECT race, saddle, horse, ord, NULL, weight, 1 FROM card)
 SELECT race, saddle, runs_prior, wins_prior, prev_weight FROM (SELECT *, count(*) OVER h AS runs_prior, CAST(sum(won) OVER h AS BIGINT) AS wins_prior, lag(weight) OVER (PARTITION BY horse ORDER BY ord, saddle) AS prev_weight FROM u
  WINDOW h AS (PARTITION BY horse ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE forward = 1""")
def upcoming_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a card to come: its rows, without outcomes, run through the windows after the history."""
    df = runners(spark, sf_dir).select("race", "race_date", "saddle", "horse", "ord", "weight", "won")
    known, card = df.where("race_date < '2001-01-01'"), df.where("race_date >= '2001-01-01'").drop("won")
    both = windows.union_by_name(known.withColumn("forward", F.lit(0)), card.withColumn("forward", F.lit(1)))
    w = windows.before("horse", "ord")
    both = both.withColumns({"runs_prior": F.count(F.lit(1)).over(w), "wins_prior": F.sum("won").over(w)})
    return windows.lagged(both, "horse", ["ord", "saddle"], ["weight"]).where("forward = 1").select(*KEY, "runs_prior", "wins_prior", "prev_weight")


@query(f"""WITH {RUNNERS_SQL}, known AS (SELECT avg(weight) AS m, stddev_samp(weight) AS s FROM runners WHERE race_date < DATE '2001-01-01'),
 h AS (SELECT *, avg(weight) OVER (PARTITION BY horse ORDER BY ord, saddle ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w3 FROM runners), z AS (SELECT h.*, coalesce((w3 - m) / s, 0.0) AS z, 1 / win_odds AS imp FROM h, known WHERE race_date >= DATE '2001-01-01'),
 e AS (SELECT *, exp(z) AS e FROM z), p AS (SELECT race, saddle, e / sum(e) OVER (PARTITION BY race) - imp / sum(imp) OVER (PARTITION BY race) AS surprise FROM e)
 SELECT race, saddle, round(surprise, 6) AS surprise FROM p ORDER BY abs(round(surprise, 6)) DESC, race, saddle LIMIT 50""")
def market_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty runners of the card whose model chance lies farthest from the market's."""
    df = windows.prior_roll(runners(spark, sf_dir), "horse", ["ord", "saddle"], "weight", 3, "w3")
    m, s = df.where("race_date < '2001-01-01'").agg(F.avg("weight"), F.stddev_samp("weight")).first()
    df = df.where("race_date >= '2001-01-01'").withColumn("eta", F.coalesce((F.col("w3") - F.lit(m)) / F.lit(s), F.lit(0.0)))
    df = windows.share(windows.softmax(df, "race", "eta", "p"), "race", 1 / F.col("win_odds"), "q")
    df = df.select(*KEY, F.round(F.col("p") - F.col("q"), 6).alias("surprise"))
    return df.orderBy(F.abs("surprise").desc(), "race", "saddle").limit(50)


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, o_orderpriority AS p FROM orders)
 SELECT o_orderkey, isodow(d) - 1 AS day_of_week, month(d) AS month_no, CASE WHEN month(d) >= 9 THEN year(d) || '-' || lpad(CAST((year(d) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(d) - 1) || '-' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') END AS season,
 CASE WHEN v < 10 THEN 0.0 ELSE floor(v / 10 + 0.5) * 10 END AS stake, (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '-' || CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 1000000) / 1000000.0::DOUBLE AS canary,
 CAST(substr(p, 1, 1) AS INT) AS class_no FROM t JOIN orders USING (o_orderkey)""")
def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formline.functions import payout

    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", F.weekday("d").alias("day_of_week"), F.month("d").alias("month_no"), scalars.season_label(F.col("d")).alias("season"), payout.round_stake(F.col("o_totalprice")).alias("stake"),
                    scalars.noise(F.col("o_orderkey"), F.col("o_custkey")).alias("canary"), scalars.first_int(F.col("o_orderpriority")).alias("class_no"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT k, CASE k % 5 WHEN 0 THEN 0.3 WHEN 1 THEN 0.75 WHEN 2 THEN 0.0 WHEN 3 THEN NULL ELSE (k % 7) + 0.5 END::DOUBLE AS lengths, CASE WHEN k % 4 = 0 THEN NULL ELSE round((k % 3) * 60 + (k % 60) + (k % 100) / 100.0, 2) END::DOUBLE AS seconds,
 CASE WHEN k % 6 = 0 THEN NULL ELSE 1000 + k % 900 END AS whole, d AS day_dmy, CASE WHEN k % 3 = 0 THEN NULL ELSE d END AS day_ymd, CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 4.5 WHEN 2 THEN NULL ELSE 1 + k % 5 END::DOUBLE AS class_ord,
 CASE WHEN k % 4 = 3 THEN NULL ELSE k % 4 END::DOUBLE AS going, CASE WHEN k % 2 = 0 THEN k % 13 ELSE -(k % 13) END AS rail, least(k % 14, k % 11) || '+' || greatest(k % 14, k % 11) AS pair, CASE WHEN k % 5 = 0 THEN NULL ELSE 'HK_2020_A' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS entity,
 k % 5 <> 0 AS entity_ok, CASE WHEN k % 3 = 0 THEN 'AWT' ELSE 'TURF' END AS surface, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'A' ELSE 'C+3' END AS course, k % 9 AS last_position, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS failed FROM o""")
def parsed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages write them, made from each order's key and day, and read back by the token functions."""
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    number = lambda x: x.cast("string")
    lbw = F.when(k % 5 == 0, " nk ").when(k % 5 == 1, "3/4").when(k % 5 == 2, "-").when(k % 5 == 3, "huh").otherwise(F.concat(number(k % 7), F.when(k % 2 == 0, "-1/2").otherwise("½")))
    clock = F.when(k % 4 == 0, "--").otherwise(F.concat(number(k % 3), F.when(k % 4 == 1, ":").otherwise("."), F.lpad(number(k % 60), 2, "0"), F.lit("."), F.lpad(number(k % 100), 2, "0")))
    whole = F.when(k % 6 == 0, "none").otherwise(F.concat(F.lit("about 1,"), F.lpad(number(k % 900), 3, "0"), F.lit(" m")))
    grade = F.when(k % 4 == 0, "Group One").when(k % 4 == 1, "GRIFFIN").when(k % 4 == 2, "open").otherwise(F.concat(F.lit("Class "), number(1 + k % 5)))
    going = F.when(k % 4 == 0, " firm").when(k % 4 == 1, "good ").when(k % 4 == 2, "soft").otherwise("wet")
    rail = F.concat(F.when(k % 2 == 0, "C +").otherwise("C -"), number(k % 13))
    link = F.when(k % 5 == 0, "/horse?id=1").otherwise(F.concat(F.lit("/horse?x=1&HorseId=HK_2020_A"), F.lpad(number(k % 1000), 3, "0"), F.lit("&y=2")))
    course = F.when(k % 4 == 0, "TURF").when(k % 4 == 1, 'TURF - "A" COURSE').otherwise('TURF - "C + 3" COURSE')
    entity = scalars.entity_id(link, "horseid")
    pair = scalars.combination_pair(F.concat(number(k % 14), F.lit(", "), number(k % 11)))
    return o.select(
        "k", scalars.lengths(lbw).alias("lengths"), F.round(scalars.seconds(clock), 2).alias("seconds"), scalars.first_int(whole).alias("whole"), scalars.day_of(F.date_format("d", "d/M/yyyy")).alias("day_dmy"),
        scalars.day_of(F.when(k % 3 == 0, "13/13/13/13").otherwise(F.date_format("d", "yyyy/M/d"))).alias("day_ymd"), scalars.class_ord(grade).alias("class_ord"), scalars.going_ord(going, ("FIRM", "GOOD", "SOFT")).alias("going"),
        scalars.rail_offset(rail).alias("rail"), F.concat_ws("+", F.get(pair, F.lit(0)).cast("string"), F.get(pair, F.lit(1)).cast("string")).alias("pair"), entity.alias("entity"), F.coalesce(scalars.valid_horse_id(entity), F.lit(False)).alias("entity_ok"),
        scalars.surface_of(F.when(k % 3 == 0, "Sha Tin all weather").otherwise("Happy Valley")).alias("surface"), scalars.course_token(course).alias("course"), scalars.last_position(F.concat(F.lit("3 4 "), number(k % 9))).alias("last_position"),
        scalars.trial_failed(F.when(k % 3 == 0, "Required to re-trial").otherwise(number(k))).alias("failed"),
    )
