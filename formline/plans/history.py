"""Registered queries: more features as of each event, dimensions and audits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import history, joins, text, windows
from formline.plans.features import EVENTS_SQL, HORSE, KEY, PACE_SQL, SUMMARY_SQL, W, _events, pace_table, r6, split_table
from formline.plans.spine import runners, table, tasks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(W + """, b AS (SELECT *, CASE WHEN horse % 3 = 0 THEN 1985 + horse % 10 END AS birth_year, CASE WHEN horse % 4 = 0 THEN 'PPG' WHEN horse % 4 = 1 THEN 'ISG' ELSE 'PP' END AS origin FROM runners)
 SELECT race, saddle, CASE WHEN birth_year IS NULL THEN 1 ELSE 0 END AS age_imputed, CAST(year(race_date) - coalesce(birth_year, min(year(race_date)) OVER (PARTITION BY horse) - CASE WHEN origin IN ('PPG', 'ISG') THEN 3 ELSE 4 END) AS DOUBLE) AS age_at_race FROM b""")
def age_at_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("horse")
    df = runners(spark, sf_dir).withColumn("birth_year", F.when(h % 3 == 0, 1985 + h % 10)).withColumn("origin", F.when(h % 4 == 0, "PPG").when(h % 4 == 1, "ISG").otherwise("PP"))
    return history.age_at_event(df, "horse", "race_date", "birth_year", "origin", ("PPG", "ISG")).select(*KEY, "age_imputed", "age_at_race")


@query(EVENTS_SQL + """, spans AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM target),
 n AS (SELECT t.event_id, any_value(date_diff('day', CAST(t.prev AS DATE), CAST(t.ts AS DATE))) AS gap, count(s.value) AS n FROM spans t LEFT JOIN side s ON t.user_id = s.user_id AND s.ts > coalesce(t.prev, TIMESTAMP '1970-01-01') AND s.ts < t.ts AND date_diff('day', CAST(s.ts AS DATE), CAST(t.ts AS DATE)) <= 365 GROUP BY t.event_id)
 SELECT event_id, n::DOUBLE AS n_between, CASE WHEN coalesce(gap, 999) >= 5 AND n > 0 THEN 1.0 ELSE 0.0 END AS first_up_trial FROM n""")
def side_event_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, side = _events(spark, sf_dir)
    n = joins.between_agg_join(target, side, "user_id", "ts", "side_ts", ["event_id"], [F.count("r_side_value").alias("n_between")], max_days=365)
    gaps = windows.lagged(target, "user_id", ["ts", "event_id"], ["ts"]).select("event_id", F.datediff("ts", "prev_ts").alias("gap"))
    return history.side_event_fills(gaps.join(n, "event_id", "left"), "n_between", "gap", 5).select("event_id", "n_between", "first_up_trial")


@query(f"""WITH {PACE_SQL}, p AS (SELECT *, (late_rel - avg(late_rel) OVER (PARTITION BY race)) AS late_dev FROM flagged)
 SELECT race, saddle, round(avg(late_rel) OVER h, 6) AS late_rel_mean3, round(max(late_rel) OVER h, 6) AS late_rel_best3, round(avg(late_dev) OVER h, 6) AS late_dev_mean3, round(avg(position_gain) OVER h, 6) AS pos_gain_mean3, CAST(sum(hidden) OVER h AS BIGINT) AS hidden_cnt3,
 row_number() OVER (PARTITION BY horse ORDER BY ord, saddle) - 1 AS sec_hist FROM p WINDOW h AS ({HORSE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def split_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = "horse", ["ord", "saddle"]
    df = pace_table(spark, sf_dir).withColumn("late_dev", F.col("late_rel") - F.avg("late_rel").over(windows.Window.partitionBy("race")))
    for col, out, fn in (("late_rel", "late_rel_mean3", F.avg), ("late_rel", "late_rel_best3", F.max), ("late_dev", "late_dev_mean3", F.avg), ("position_gain", "pos_gain_mean3", F.avg), ("hidden", "hidden_cnt3", F.sum)):
        df = windows.prior_roll(df, keys, order, col, 3, out, fn)
    df = df.withColumn("sec_hist", F.row_number().over(windows.ordered(keys, order)) - 1)
    return df.select(*KEY, *(r6(c) for c in ("late_rel_mean3", "late_rel_best3", "late_dev_mean3", "pos_gain_mean3")), "hidden_cnt3", "sec_hist")


@query(f"""WITH {SUMMARY_SQL} SELECT race, saddle, round((last_split - avg(last_split) OVER (PARTITION BY race)) / nullif(CASE WHEN stddev_samp(last_split) OVER (PARTITION BY race) > 1e-9 THEN stddev_samp(last_split) OVER (PARTITION BY race) END, 0), 6) AS late_z FROM summary""")
def late_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each runner's last split against its race's mean, in its race's deviations; null where all are alike."""
    w = windows.Window.partitionBy("race")
    df = split_table(spark, sf_dir).withColumn("sd", F.stddev_samp("last_split").over(w)).withColumn("late_z", (F.col("last_split") - F.avg("last_split").over(w)) / F.when(F.col("sd") > 1e-9, F.col("sd")))
    return df.select(*KEY, r6("late_z"))


LAGS = ("last_split", "min_split", "mean_split", "std_split", "position_gain", "last_position", "first_split", "nsec")


@query(f"WITH {SUMMARY_SQL} SELECT race, saddle, " + ", ".join(f"round(lag({c}) OVER h, 6) AS {c}_lag1" for c in LAGS) + f", row_number() OVER h - 1 AS history_count, CASE WHEN row_number() OVER h > 1 THEN 1 ELSE 0 END AS has_history FROM summary WINDOW h AS ({HORSE})")
def split_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = history.lagged_summaries(split_table(spark, sf_dir), "horse", ["ord", "saddle"], LAGS)
    return df.select(*KEY, *(r6(f"{c}_lag1") for c in LAGS), "history_count", "has_history")


@query(f"WITH {SUMMARY_SQL}, l AS (SELECT last_split, lag(last_split) OVER ({HORSE}) AS g FROM summary) SELECT round(avg(CASE WHEN last_split = g THEN 1.0 ELSE 0.0 END), 6) AS leak_share, count(*) AS n FROM l")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = history.lagged_summaries(split_table(spark, sf_dir), "horse", ["ord", "saddle"], ["last_split"])
    return history.leak_share(df, "last_split", "last_split_lag1").select(r6("leak_share"), "n")


STYLE_SQL = W + f""", raw AS (SELECT *, CASE WHEN draw = 5 THEN NULL ELSE (saddle + finish_pos) % 9 + 1 END AS a FROM runners),
 st AS (SELECT *, a / CAST(field_size AS DOUBLE) AS early_pct FROM raw), styled AS (SELECT *, CASE WHEN early_pct >= 0.6 THEN 'S' WHEN early_pct <= 0.3 THEN 'E' WHEN early_pct IS NOT NULL THEN 'P' END AS style FROM st) """


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running positions as text: an early one, two later ones; a stray token where the draw is 5."""
    early = F.when(F.col("draw") == 5, "x").otherwise((F.pmod(F.col("saddle") + F.col("finish_pos"), F.lit(9)) + 1).cast("string"))
    df = runners(spark, sf_dir).withColumn("positions", F.concat_ws(" ", early, "saddle", "finish_pos", "saddle"))
    return history.running_style(df, "positions", "field_size", "horse", ["ord", "saddle"])


@query(STYLE_SQL + f"SELECT race, saddle, round(early_pct, 6) AS early_pct, style, round(avg(early_pct) OVER ({HORSE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS habitual_early_pct_3 FROM styled")
def running_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _styled(spark, sf_dir).select(*KEY, r6("early_pct"), "style", r6("habitual_early_pct_3"))


@query(STYLE_SQL + f""", m AS (SELECT *, race_class - lag(race_class) OVER ({HORSE}) AS cm, weight - lag(weight) OVER ({HORSE}) AS wd FROM styled),
 u AS (SELECT 'style' AS "grouping", style AS level, finish_pos FROM m UNION ALL SELECT 'class_move', CASE WHEN cm > 0 THEN 'down' WHEN cm < 0 THEN 'up' WHEN cm = 0 THEN 'same' END, finish_pos FROM m
  UNION ALL SELECT 'weight_trend', CASE WHEN wd < 0 THEN 'decreased' WHEN wd > 0 THEN 'increased' WHEN wd = 0 THEN 'same' END, finish_pos FROM m)
 SELECT "grouping", level, round(avg(finish_pos), 6) AS mean, count(*) AS n FROM u WHERE level IS NOT NULL GROUP BY 1, 2""")
def mean_placing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean placing by running style, class movement and weight trend."""
    df = windows.lagged(_styled(spark, sf_dir), "horse", ["ord", "saddle"], ["race_class", "weight"])
    cm, wd = F.col("race_class") - F.col("prev_race_class"), F.col("weight") - F.col("prev_weight")
    groups = {"style": F.col("style"), "class_move": F.when(cm > 0, "down").when(cm < 0, "up").when(cm == 0, "same"), "weight_trend": F.when(wd < 0, "decreased").when(wd > 0, "increased").when(wd == 0, "same")}
    return history.mean_by_group(df, groups, "finish_pos").select("grouping", "level", r6("mean"), "n")


@query(W + """, v AS (SELECT race, saddle, race_date, CASE WHEN draw = 4 THEN NULL ELSE weight END AS w FROM runners), h AS (SELECT race_date, w, count(*) AS n FROM v WHERE w IS NOT NULL GROUP BY 1, 2),
 x AS (SELECT d.race_date, h.w, sum(h.n) AS n FROM (SELECT DISTINCT race_date FROM v) d JOIN h ON h.race_date < d.race_date GROUP BY 1, 2), y AS (SELECT *, sum(n) OVER (PARTITION BY race_date ORDER BY w) AS upto, sum(n) OVER (PARTITION BY race_date) AS total FROM x),
 f AS (SELECT race_date, max(total) AS seen, (min(w) FILTER (WHERE upto >= floor((total + 1) / 2)) + min(w) FILTER (WHERE upto >= floor(total / 2) + 1)) / 2 AS m FROM y GROUP BY race_date)
 SELECT race, saddle, coalesce(w, CASE WHEN seen >= 200 THEN m ELSE 0.0 END, 0.0)::DOUBLE AS weight_filled FROM v LEFT JOIN f USING (race_date)""")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing weights filled with the median of all earlier days' weights."""
    df = runners(spark, sf_dir).withColumn("w", F.when(F.col("draw") != 4, F.col("weight")))
    return history.median_so_far(df, "race_date", "w", "weight_filled", 1.0).select(*KEY, "weight_filled")


@query(W + """, c AS (SELECT race, count(*) AS n FROM runners WHERE surface = 'O' AND disc > 0.03 GROUP BY race), e AS (SELECT DISTINCT race, date_trunc('month', race_date)::DATE AS period FROM runners)
 SELECT period, count(*) AS events, count(n) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, round(sum(n) / CAST(count(n) AS DOUBLE), 6) AS rows_per_event, round(count(n) / CAST(count(*) AS DOUBLE), 6) AS share FROM e LEFT JOIN c USING (race) GROUP BY period""")
def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month the races that have timed rows, and how many."""
    df = runners(spark, sf_dir)
    out = history.coverage_by_period(df, df.where("surface = 'O' and disc > 0.03"), ["race"], F.trunc("race_date", "month"))
    return out.select("period", "events", "covered", "n_rows", r6("rows_per_event"), r6("share"))


@query(W + f""", form AS (SELECT horse, race_class AS fc, rating FROM (SELECT horse, race_class, weight AS rating, row_number() OVER (PARTITION BY horse, race_class ORDER BY ord, saddle) AS r FROM runners WHERE draw <> 2) WHERE r = 1)
 SELECT race, saddle, coalesce(form.rating, weight) AS rating, coalesce(form.rating, weight) - lag(coalesce(form.rating, weight), 3) OVER (PARTITION BY runners.horse ORDER BY ord, saddle) AS rating_change3, p_size AS size, coalesce(p_type, 'none') AS kind
 FROM runners LEFT JOIN form ON runners.horse = form.horse AND race_class = fc LEFT JOIN part ON runners.horse = p_partkey""")
def dimension_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating from the form table, first row per key, else the card's; the horse's own attributes beside it."""
    df = runners(spark, sf_dir)
    form = df.where("draw <> 2").select("horse", "race_class", F.col("weight").alias("form_rating"), "ord", "saddle")
    df = history.with_dimension(df, form, ["horse", "race_class"], ["ord", "saddle"], ["form_rating"])
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("horse"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    df = history.with_dimension(df, part, ["horse"], ["size", "kind"], ["size", "kind"], {"kind": "none"})
    df = df.withColumn("rating", F.coalesce("form_rating", "weight"))
    df = windows.lagged(df, "horse", ["ord", "saddle"], ["rating"], 3, "third_")
    return df.select(*KEY, "rating", (F.col("rating") - F.col("third_rating")).alias("rating_change3"), "size", "kind")


@query("""WITH wx AS (SELECT d, v FROM (SELECT CAST(ts AS DATE) AS d, value AS v, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1), hol AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE value > 99)
 SELECT event_id, wx.v AS weather, CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END AS is_holiday FROM events e LEFT JOIN wx ON CAST(e.ts AS DATE) = wx.d LEFT JOIN hol ON CAST(e.ts AS DATE) = hol.d""")
def day_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's first reading, and whether the day is on a list."""
    e = table(spark, sf_dir, "events").withColumn("day_no", F.col("ts").cast("date"))
    df = history.with_dimension(e.select("event_id", "day_no"), e.withColumnRenamed("value", "weather"), ["day_no"], ["ts", "event_id"], ["weather"])
    return history.flag_days(df, e.where("value > 99"), "day_no", "is_holiday").select("event_id", "weather", "is_holiday")


@query("""SELECT 'lines' AS source, l_orderkey AS race, l_linenumber AS saddle, count(*) AS n, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1
 UNION ALL SELECT 'returned', l_orderkey, l_linenumber, count(*), count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2, 3 HAVING count(*) > 1""")
def repeated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that several entries of a race share, in the whole table and in a part of it."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_linenumber").alias("saddle"), F.col("l_partkey").alias("horse"), "l_returnflag")
    return history.repeated_members({"lines": li, "returned": li.where("l_returnflag = 'R'")}, ["race", "saddle"], "horse").select("source", "race", "saddle", "n", "entities")


@query("""WITH d AS (SELECT doc_id, source, lower(text) AS t FROM documents WHERE text IS NOT NULL AND trim(text) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS r FROM d),
 n AS (SELECT doc_id, source, len(regexp_extract_all(t2, '[^\\p{L}\\p{N}_]the[^\\p{L}\\p{N}_]')) + len(regexp_extract_all(t2, '[^\\p{L}\\p{N}_]and[^\\p{L}\\p{N}_]')) AS n_first, len(regexp_extract_all(t2, '[^\\p{L}\\p{N}_]que[^\\p{L}\\p{N}_]')) AS n_second
  FROM (SELECT *, '  ' || regexp_replace(t, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || '  ' AS t2 FROM k WHERE r = 1))
 SELECT doc_id, n_first, n_second, lag(n_first) OVER (PARTITION BY source ORDER BY doc_id) AS n_first_lag1, lag(n_second) OVER (PARTITION BY source ORDER BY doc_id) AS n_second_lag1 FROM n""")
def text_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of text signals per entry that has a text, each beside those of its entity's previous entry."""
    d = table(spark, sf_dir, "documents").where("text is not null and trim(text) <> ''").select("doc_id", "source", F.lower("text").alias("text"))
    counts = text.phrase_counts(F.col("text"), {"n_first": ("the", "and"), "n_second": ("que",)})
    df = windows.dedup(d, "doc_id", ["text"]).select("doc_id", "source", *(c.alias(n) for n, c in counts.items()))
    df = history.lagged_summaries(df, "source", ["doc_id"], ["n_first", "n_second"])
    return df.select("doc_id", "n_first", "n_second", "n_first_lag1", "n_second_lag1")


@query(W + """, t AS (SELECT race, saddle, race_date, CASE WHEN draw = 3 THEN NULL ELSE race_date + 1 END AS feature_date FROM runners)
 SELECT count(*) AS n_rows, count(feature_date) AS n_dated, CAST(sum(CASE WHEN feature_date > race_date THEN 1 ELSE 0 END) AS BIGINT) AS n_late, round(avg(CASE WHEN feature_date IS NULL THEN 1.0 ELSE 0.0 END), 6) AS undated FROM t""")
def late_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have a feature from after their event, and how many have none."""
    df = runners(spark, sf_dir).withColumn("feature_date", F.when(F.col("draw") != 3, F.date_add("race_date", 1)))
    late = F.sum(F.coalesce((F.col("feature_date") > F.col("race_date")).cast("long"), F.lit(0)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("feature_date").alias("n_dated"), late.alias("n_late"), F.round(F.avg(F.col("feature_date").isNull().cast("double")), 6).alias("undated"))


@query("""SELECT race, saddle, horse, n_rows FROM (SELECT l_orderkey AS race, l_linenumber AS saddle, l_partkey AS horse, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""")
def last_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per number of a race, the last, with how many there were."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race"), F.col("l_linenumber").alias("saddle"), F.col("l_partkey").alias("horse"), "l_suppkey", "l_extendedprice")
    return history.keep_last(li, ["race", "saddle"], ["horse", "l_suppkey", "l_extendedprice"]).select("race", "saddle", "horse", "n_rows")


@query(W + """, b AS (SELECT race, saddle, win_odds - 2 AS price, CASE WHEN draw = 4 THEN NULL ELSE weight END AS w, CASE WHEN draw = 6 THEN NULL ELSE jockey END AS j FROM runners), ok AS (SELECT * FROM b WHERE price > 1 AND j IS NOT NULL)
 SELECT race, saddle, price, coalesce(w, (SELECT quantile_disc(w, 0.5) FROM ok))::DOUBLE AS w FROM ok""")
def clean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with a valid price and a jockey, missing weights at the median."""
    df = runners(spark, sf_dir).select(*KEY, (F.col("win_odds") - 2).alias("price"), F.when(F.col("draw") != 4, F.col("weight")).alias("w"), F.when(F.col("draw") != 6, F.col("jockey")).alias("j"))
    return history.clean_prices(df, "price", ["j"], ["w"]).select(*KEY, "price", "w")


@query(W + """, s AS (SELECT DISTINCT race, saddle FROM runners WHERE disc > 0.02) SELECT season, count(*) AS n_rows, count(s.race) AS matched, count(*) - count(s.race) AS unmatched FROM runners r LEFT JOIN s ON r.race = s.race AND r.saddle = s.saddle GROUP BY season""")
def unmatched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per season the runners that a set of predictions has and lacks."""
    df = runners(spark, sf_dir)
    side = df.where("disc > 0.02").select(*KEY, F.lit(1).alias("known"))
    return history.attach_counted(df, side, KEY, "known", ["season"])


@query(W + """, lost AS (SELECT race, saddle, horse, draw, win_odds, finish_pos, CASE WHEN draw % 2 = 0 THEN race_date END AS d FROM runners), src AS (SELECT horse, draw, win_odds, finish_pos, min(race_date) AS f FROM runners GROUP BY 1, 2, 3, 4)
 SELECT race, saddle, coalesce(d, f) AS race_date FROM lost JOIN src USING (horse, draw, win_odds, finish_pos)""")
def restored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing dates from another table by a key of several columns, its first date where it has several."""
    df = runners(spark, sf_dir)
    lost = df.withColumn("race_date", F.when(F.col("draw") % 2 == 0, F.col("race_date")))
    return joins.fill_from(lost, df, ["horse", "draw", "win_odds", "finish_pos"], "race_date", tasks(spark, sf_dir)).select(*KEY, "race_date")


@query("""WITH p AS (SELECT user_id, arg_max(1 + value, ts) AS odds FROM events WHERE event_type = 'view' GROUP BY 1) SELECT e.event_id, p.odds AS live_odds, CASE WHEN p.odds IS NULL THEN 1 ELSE 0 END AS unpriced FROM events e LEFT JOIN p USING (user_id) WHERE event_type = 'purchase'""")
def card_with_live_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's entries with the last price of each, and whether there was one."""
    from formline.streaming import snapshots

    e = table(spark, sf_dir, "events")
    prices = snapshots.latest_price(e.where("event_type = 'view'").select("user_id", "ts", (1 + F.col("value")).alias("live_odds")), ["user_id"], "ts", "live_odds")
    card = joins.strict_left_join(e.where("event_type = 'purchase'").select("event_id", "user_id"), prices.drop("ts"), ["user_id"])
    return card.select("event_id", "live_odds", F.col("live_odds").isNull().cast("int").alias("unpriced"))
