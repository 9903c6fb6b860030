"""Registered queries: payouts, tickets, thresholds and baselines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import payout
from formline.operators import combos, reports, tickets, windows
from formline.plans.betting import CURVE, EV, KEY, P, SETTLED, SUMMARY, W, _curve, places_sql, r6, settled
from formline.plans.spine import priced, runners

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def dividends(df: DataFrame) -> DataFrame:
    """A table of payouts (race, pool, combination, payout) as pages give it: text combinations, gaps and refunds.

    Every seventh race lacks its WIN payout, every eleventh its pair, every tenth has a refund line.
    """
    race, saddle = F.col("race"), F.col("saddle").cast("string")
    each = F.array(
        F.when((F.col("won") == 1) & (race % 7 != 0), F.struct(F.lit("WIN").alias("pool"), F.concat(F.lit(" "), saddle).alias("combination"), (10 * F.col("win_odds")).cast("double").alias("payout"))),
        F.when(F.col("placed") == 1, F.struct(F.lit("PLACE").alias("pool"), saddle.alias("combination"), (10 + F.col("weight") * 2).cast("double").alias("payout"))),
        F.when((F.col("won") == 1) & (race % 10 == 0), F.struct(F.lit("WIN").alias("pool"), F.lit("refund").alias("combination"), F.lit(10.0).alias("payout"))),
    )
    singles = df.select("race", F.explode(F.array_compact(each)).alias("x")).select("race", "x.*")
    top = df.where("finish_pos <= 2").groupBy("race").agg(F.max("saddle").alias("a"), F.min("saddle").alias("b"), F.sum("win_odds").alias("o"), F.count(F.lit(1)).alias("n"))
    pairs = top.where("n = 2 and race % 11 <> 0").select("race", F.lit("QUINELLA").alias("pool"), F.concat_ws(",", "a", "b").alias("combination"), (5 * F.col("o")).cast("double").alias("payout"))
    return singles.unionByName(pairs)


DIV = """, dividends AS (SELECT race, 'WIN' AS pool, ' ' || saddle AS combination, 10.0::DOUBLE * win_odds AS payout FROM runners WHERE won = 1 AND race % 7 <> 0
 UNION ALL SELECT race, 'PLACE', CAST(saddle AS VARCHAR), (10 + weight * 2)::DOUBLE FROM runners WHERE placed = 1 UNION ALL SELECT race, 'WIN', 'refund', 10.0 FROM runners WHERE won = 1 AND race % 10 = 0
 UNION ALL SELECT race, 'QUINELLA', max(saddle) || ',' || min(saddle), 5.0 * sum(win_odds) FROM runners WHERE finish_pos <= 2 AND race % 11 <> 0 GROUP BY race HAVING count(*) = 2),
 paid AS (SELECT race, CAST(split_part(combination, ',', 2) AS INT) AS i, CAST(split_part(combination, ',', 1) AS INT) AS j, payout FROM dividends WHERE pool = 'QUINELLA'),
 single AS (SELECT race, pool, TRY_CAST(trim(combination) AS INT) AS saddle, min(payout) AS payout FROM dividends WHERE pool <> 'QUINELLA' AND TRY_CAST(trim(combination) AS INT) IS NOT NULL GROUP BY 1, 2, 3)"""


@query(W + DIV + " SELECT race, saddle, payout AS win_div FROM single WHERE pool = 'WIN'")
def payout_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.payout_lookup(dividends(runners(spark, sf_dir)), "race", "WIN", "win_div")


@query(W + DIV + """ SELECT r.race, r.saddle, w.payout AS win_div, p.payout AS place_div, CASE WHEN won = 1 THEN CASE WHEN w.payout > 0 THEN w.payout - 10 ELSE 10 * win_odds - 10 END ELSE -10.0 END AS win_profit,
 CASE WHEN placed = 1 THEN CASE WHEN p.payout > 0 THEN p.payout - 10 ELSE 0.0 END ELSE -10.0 END AS place_profit
 FROM runners r LEFT JOIN single w ON r.race = w.race AND r.saddle = w.saddle AND w.pool = 'WIN' LEFT JOIN single p ON r.race = p.race AND r.saddle = p.saddle AND p.pool = 'PLACE'""")
def settled_by_payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every runner with its payouts, and what a bet on it to win or to place returns."""
    df = runners(spark, sf_dir)
    df = tickets.with_payouts(df, dividends(df), "race", {"win_div": "WIN", "place_div": "PLACE"})
    win, place = payout.win_profit(F.lit(10.0), F.col("won"), F.col("win_div"), F.col("win_odds")), payout.place_profit(F.lit(10.0), F.col("placed"), F.col("place_div"))
    return df.select(*KEY, "win_div", "place_div", win.cast("double").alias("win_profit"), place.alias("place_profit"))


@query(P + DIV + places_sql("p_model") + f""", t AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(least(1.0, p_model + p2 + p3), 9) DESC, saddle) AS r FROM places)
 SELECT season, {SUMMARY} FROM (SELECT season, 10.0::DOUBLE AS stake, CASE WHEN placed = 1 THEN CASE WHEN p.payout > 0 THEN p.payout - 10 ELSE 0.0 END ELSE -10.0 END AS profit
  FROM t LEFT JOIN single p ON t.race = p.race AND t.saddle = p.saddle AND p.pool = 'PLACE' WHERE r = 1) GROUP BY season""")
def model_place_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each race's likeliest runner to place by the model, settled by the official place payout."""
    df = combos.place_chances(priced(spark, sf_dir), "race", "saddle", "p_model")
    picks = windows.top_k(df, "race", [F.round("top_k", 9).desc(), "saddle"])
    picks = tickets.with_payouts(picks, dividends(runners(spark, sf_dir)), "race", {"place_div": "PLACE"})
    out = reports.bet_summary(tickets.place_settled(picks, 10.0, "placed", "place_div"), ["season"], "stake", "profit", "placed")
    return out.select("season", "bets", "staked", r6("profit"), r6("roi"))


TOP4 = P + DIV + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(p_model, 9) DESC, saddle) AS r FROM priced) WHERE r <= 4),
 full4 AS (SELECT race FROM top GROUP BY race HAVING count(*) = 4 AND race IN (SELECT race FROM paid)),
 tk AS (SELECT a.race, date_trunc('month', a.race_date)::DATE AS month_start, a.saddle AS i, b.saddle AS j, p.payout FROM top a JOIN top b ON a.race = b.race AND a.saddle < b.saddle LEFT JOIN paid p ON p.race = a.race AND p.i = a.saddle AND p.j = b.saddle WHERE a.race IN (SELECT race FROM full4)),
 per AS (SELECT month_start, race, count(*) AS t, count(payout) AS w, coalesce(sum(payout), 0.0) AS r FROM tk GROUP BY month_start, race) """


def _top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir)
    paid = tickets.pair_payouts(dividends(runners(spark, sf_dir)), "race", "QUINELLA")
    made = tickets.top_pairs(df, "race", "saddle", [F.round("p_model", 9).desc(), "saddle"], 4, paid)
    return made.join(df.select("race", F.trunc("race_date", "month").alias("month_start")).distinct(), "race")


@query(TOP4 + "SELECT race, t AS tickets, w AS wins, t * 10.0::DOUBLE AS staked, r AS returned, round((r - t * 10) / (t * 10), 6) AS roi FROM per")
def top4_pairs_by_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tickets per race: all pairs of the model's first four, with official payouts."""
    out = tickets.ticket_report(_top4(spark, sf_dir).withColumn("_race", F.col("race")), "_race", ["race"])
    return out.select("race", "tickets", "wins", "staked", "returned", r6("roi"))


@query(TOP4 + "SELECT month_start, count(*) AS n_groups, CAST(sum(t) AS BIGINT) AS tickets, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS groups_with_win, sum(t) * 10.0::DOUBLE AS staked, round(sum(r), 6) AS returned, round((sum(r) - sum(t) * 10) / (sum(t) * 10), 6) AS roi FROM per GROUP BY month_start")
def top4_pairs_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tickets.ticket_report(_top4(spark, sf_dir), "race", ["month_start"])
    return out.select("month_start", "n_groups", "tickets", "wins", "groups_with_win", "staked", r6("returned"), r6("roi"))


PAIR_BETS = P + DIV + """, q AS (SELECT a.race, a.season, a.saddle AS i, b.saddle AS j, a.p_model * b.p_model * (1 / (1 - a.p_model) + 1 / (1 - b.p_model)) AS qm, a.p_market * b.p_market * (1 / (1 - a.p_market) + 1 / (1 - b.p_market)) AS qk
  FROM priced a JOIN priced b ON a.race = b.race AND a.saddle < b.saddle),
 pb AS (SELECT q.*, round(qm - qk, 9) AS edge, round(qm * 0.825 / qk, 9) AS ev_ratio, 0.825 / qk AS price, CASE WHEN paid.payout IS NULL THEN 0 ELSE 1 END AS won, 10.0::DOUBLE AS stake, coalesce(paid.payout, 0.0) - 10 AS profit, paid.payout
  FROM q LEFT JOIN paid USING (race, i, j) WHERE race IN (SELECT race FROM paid)) """


def pair_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of every race with a paid one: chances, edge, value ratio and settlement by the official payout."""
    df = priced(spark, sf_dir)
    paid = tickets.pair_payouts(dividends(runners(spark, sf_dir)), "race", "QUINELLA")
    q = combos.pair_chances(df, "race", "saddle", ["p_model", "p_market"]).join(paid.select("race"), "race", "left_semi").join(paid, ["race", "i", "j"], "left")
    q = q.join(df.select("race", "season").distinct(), "race")
    return q.withColumns({
        "edge": F.round(F.col("q_p_model") - F.col("q_p_market"), 9), "price": 0.825 / F.col("q_p_market"), "ev_ratio": F.round(F.col("q_p_model") * 0.825 / F.col("q_p_market"), 9),
        "won": F.col("payout").isNotNull().cast("int"), "stake": F.lit(10.0), "profit": F.coalesce("payout", F.lit(0.0)) - 10,
    })


@query(PAIR_BETS + """, u AS (SELECT 'edge' AS rule, t.t::DOUBLE AS threshold, pb.* FROM pb JOIN (VALUES (0.0), (0.02), (0.05)) t(t) ON edge >= t.t UNION ALL SELECT 'ev_ratio', t.t::DOUBLE, pb.* FROM pb JOIN (VALUES (1.0), (1.1), (1.3)) t(t) ON ev_ratio >= t.t)
 SELECT rule, threshold, count(*) AS bets, round(avg(won), 6) AS hit_rate, sum(stake) AS staked, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi FROM u GROUP BY rule, threshold""")
def edge_against_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference and ratio as filters on the same pairs."""
    out = tickets.rules_side_by_side(pair_bets(spark, sf_dir), {"edge": ("edge", (0.0, 0.02, 0.05)), "ev_ratio": ("ev_ratio", (1.0, 1.1, 1.3))}, "stake", "profit", "won")
    return out.select("rule", "threshold", "bets", r6("hit_rate"), "staked", r6("profit"), r6("roi"))


@query(PAIR_BETS + "SELECT season, t.t::DOUBLE AS threshold, count(*) AS bets, sum(stake) AS staked, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi FROM pb JOIN (VALUES (0.0), (0.01), (0.03), (0.05)) t(t) ON edge >= t.t GROUP BY season, t.t")
def pair_edge_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with an edge, by season and threshold, settled by official payouts."""
    out = reports.threshold_report(pair_bets(spark, sf_dir), "edge", [0.0, 0.01, 0.03, 0.05], ["season"], "stake", "profit", "won")
    return out.select("season", "threshold", "bets", "staked", r6("profit"), r6("roi"))


LOCK = (-0.02, -0.01, 0.0, 0.01, 0.02, 0.03)


@query(PAIR_BETS + f""", v AS (SELECT t.t::DOUBLE AS threshold, count(*) AS n, sum(profit) / sum(stake) AS roi FROM pb JOIN (VALUES {", ".join(f"({t})" for t in LOCK)}) t(t) ON edge >= t.t WHERE season < '1999-00' GROUP BY t.t),
 best AS (SELECT threshold FROM v WHERE n >= 200 ORDER BY roi DESC, threshold LIMIT 1) SELECT threshold, count(*) AS bets, round(avg(won), 6) AS hit_rate, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi FROM pb, best WHERE season >= '1999-00' AND edge >= threshold GROUP BY threshold""")
def locked_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that did best on the earlier seasons, held on the later ones."""
    out = tickets.locked_threshold(pair_bets(spark, sf_dir), F.col("season") < "1999-00", "edge", LOCK, 200, "stake", "profit", "won")
    return out.select("threshold", "bets", r6("hit_rate"), r6("profit"), r6("roi"))


@query(PAIR_BETS + ", per AS (SELECT season, race, sum(stake) AS s, sum(profit) AS p FROM pb WHERE edge >= 0 GROUP BY season, race) SELECT season, round(sum(p) / sum(s), 6) AS bet_roi, round(avg(p / s), 6) AS group_roi, count(*) AS n_groups FROM per GROUP BY season")
def race_then_mean_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.group_then_mean(pair_bets(spark, sf_dir).where("edge >= 0"), ["race"], "stake", "profit", ["season"]).select("season", r6("bet_roi"), r6("group_roi"), "n_groups")


@query(PAIR_BETS + ", w AS (SELECT season, payout / 10 AS a, price AS t, payout / 10 / price AS q FROM pb WHERE won = 1) SELECT season, round(quantile_disc(a, 0.5), 6) AS actual, round(quantile_disc(t, 0.5), 6) AS theoretical, round(quantile_disc(q, 0.5), 6) AS ratio, count(*) AS n FROM w GROUP BY season")
def payout_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official against theoretical payouts of the winning pairs."""
    return tickets.payout_ratio(pair_bets(spark, sf_dir), "payout", "price", "won", ["season"]).select("season", r6("actual"), r6("theoretical"), r6("ratio"), "n")


@query(P + """, b AS (SELECT *, round(p_model - 1.0::DOUBLE / field_size, 9) AS edge, 10.0::DOUBLE AS stake, CASE WHEN won = 1 THEN 10.0 * (field_size - 1) ELSE -10.0 END AS profit FROM priced)
 SELECT t.t::DOUBLE AS threshold, count(*) AS bets, round(avg(won), 6) AS hit_rate, sum(stake) AS staked, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi FROM b JOIN (VALUES (0.0), (0.02), (0.05), (0.1)) t(t) ON edge >= t.t GROUP BY t.t""")
def uniform_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model gains over a uniform prior at its fair prices."""
    out = tickets.uniform_baseline(priced(spark, sf_dir), "race", "p_model", "won", [0.0, 0.02, 0.05, 0.1])
    return out.select("threshold", "bets", r6("hit_rate"), "staked", r6("profit"), r6("roi"))


@query(EV + """, t AS (SELECT e.*, v.t::DOUBLE AS threshold FROM e JOIN (VALUES (0.0), (0.05), (0.1), (0.2)) v(t) ON ev >= v.t), b AS (SELECT threshold, race, sum(profit) AS num, sum(stake) AS den FROM t GROUP BY 1, 2),
 m AS (SELECT *, md5('0-' || q || '-' || race) AS h FROM b, range(0, 125) g(q)), u AS (SELECT threshold, q * 8 + j AS r, num, den, ('0x' || substr(h, j * 4 + 1, 4))::INT AS u FROM m, range(0, 8) g(j)),
 s AS (SELECT threshold, r, sum(w * num) / sum(w * den) AS x FROM (SELECT *, (u >= 24109)::INT + (u >= 48218)::INT + (u >= 60273)::INT + (u >= 64291)::INT + (u >= 65296)::INT + (u >= 65497)::INT + (u >= 65530)::INT AS w FROM u) GROUP BY 1, 2),
 ci AS (SELECT threshold, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM s GROUP BY threshold), rep AS (SELECT threshold, count(*) AS bets, avg(win_odds) AS mp, sum(profit) / sum(stake) AS roi FROM t GROUP BY threshold)
 SELECT threshold, bets, round(mp, 6) AS mean_price, round(roi, 6) AS roi, round(lo, 6) AS lo, round(hi, 6) AS hi, lo <= 0 AND hi >= 0 AS crosses_zero FROM rep JOIN ci USING (threshold)""")
def threshold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets by expected value, with their mean price and a bootstrap interval of the return."""
    df = settled(priced(spark, sf_dir)).withColumn("ev", F.round(F.col("p_model") * F.col("win_odds") - 1, 9))
    out = tickets.threshold_intervals(df, "race", "ev", [0.0, 0.05, 0.1, 0.2], "stake", "profit", "won", "win_odds")
    return out.select("threshold", "bets", r6("mean_price"), r6("roi"), r6("lo"), r6("hi"), "crosses_zero")


@query(EV + """, s AS (SELECT race, saddle, season, ev, p_model, win_odds, round(p_model - 1 / win_odds, 9) AS raw_edge FROM e WHERE ev > 0)
 SELECT race, saddle, round(ev, 6) AS ev, round(raw_edge, 6) AS raw_edge, row_number() OVER (PARTITION BY season ORDER BY ev DESC, race, saddle) AS rank_in_season FROM s QUALIFY rank_in_season <= 100""")
def value_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best bets of each season by expected value, with the raw edge over the price."""
    df = priced(spark, sf_dir).withColumn("ev", F.round(F.col("p_model") * F.col("win_odds") - 1, 9)).where("ev > 0").withColumn("raw_edge", F.round(F.col("p_model") - 1 / F.col("win_odds"), 9))
    top = windows.top_k(df, "season", [F.desc("ev"), "race", "saddle"], 100, "rank_in_season")
    return top.select(*KEY, r6("ev"), r6("raw_edge"), "rank_in_season")


@query(CURVE + """, d AS (SELECT *, greatest(0.0, max(equity) OVER (ORDER BY race_date)) - equity AS dd FROM c)
 SELECT count(*) AS days, round(sum(pnl), 6) AS profit, round(max(dd), 6) AS max_drawdown, round(avg(pnl) / stddev_samp(pnl), 6) AS daily_sharpe, round(avg(ln(greatest(1e-9, 1 + pnl / 100000.0))), 9) AS log_growth FROM d""")
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.curve_summary(_curve(spark, sf_dir), 100_000.0)
    return out.select("days", r6("profit"), r6("max_drawdown"), r6("daily_sharpe"), F.round("log_growth", 9).alias("log_growth"))


@query(EV + """, t AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(p_model, 9) DESC, saddle) AS rm, row_number() OVER (PARTITION BY race ORDER BY win_odds, saddle) AS rk FROM e),
 u AS (SELECT season, 'model' AS picks, stake, profit, won FROM t WHERE rm = 1 UNION ALL SELECT season, 'market', stake, profit, won FROM t WHERE rk = 1)
 SELECT season, picks, count(*) AS bets, round(avg(won), 6) AS hit_rate, round(sum(profit) / sum(stake), 6) AS roi FROM u GROUP BY season, picks""")
def model_against_market_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's first choice of each race beside the market's, by season."""
    df = settled(priced(spark, sf_dir))
    picks = windows.union_by_name(
        windows.top_k(df, "race", [F.round("p_model", 9).desc(), "saddle"]).withColumn("picks", F.lit("model")), windows.top_k(df, "race", ["win_odds", "saddle"]).withColumn("picks", F.lit("market"))
    )
    return reports.bet_summary(picks, ["season", "picks"], "stake", "profit", "won").select("season", "picks", "bets", r6("hit_rate"), r6("roi"))


@query(W + DIV + f" SELECT race_class, {SUMMARY} FROM (SELECT race_class, {SETTLED} FROM runners WHERE win_odds < 6 AND race IN (SELECT race FROM single WHERE pool = 'WIN')) GROUP BY race_class")
def settled_races_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-priced runners of races whose winner was paid, by class."""
    df = runners(spark, sf_dir)
    paid = tickets.payout_lookup(dividends(df), "race", "WIN", "win_div").select("race")
    out = reports.bet_summary(settled(df).where("win_odds < 6").join(paid, "race", "left_semi"), ["race_class"], "stake", "profit", "won")
    return out.select("race_class", "bets", "staked", r6("profit"), r6("roi"))


@query(W + """, d AS (SELECT race, any_value(n_places) AS n, sum(weight) AS gross, sum(CASE WHEN placed = 1 THEN weight END) AS onp FROM runners GROUP BY race)
 SELECT r.race, r.saddle, round(CASE WHEN r.weight > 0 AND d.n >= 1 THEN greatest(10.0, 10 * (gross * 0.825::DOUBLE) / d.n / r.weight) ELSE 0.0 END, 6) AS place_dividend FROM runners r JOIN d USING (race) WHERE placed = 1""")
def place_pool_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a place pool in proportion to ``weight`` would pay each placed runner."""
    df = runners(spark, sf_dir).withColumn("gross", F.sum("weight").over(windows.Window.partitionBy("race"))).where("placed = 1")
    return df.select(*KEY, F.round(payout.place_dividend(F.col("gross"), F.col("weight"), F.col("n_places"), 0.175), 6).alias("place_dividend"))
