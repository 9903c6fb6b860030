"""Registered queries: markets, policies, metrics, stakes, combinations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import payout
from formline.operators import combos, reports, staking, windows
from formline.plans.spine import PRICED_SQL, RUNNERS_SQL, priced, runners

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


W = f"WITH {RUNNERS_SQL} "
P = f"WITH {PRICED_SQL} "
KEY = ["race", "saddle"]


def settled(df: DataFrame, stake: float = 10.0) -> DataFrame:
    return df.withColumn("stake", F.lit(stake)).withColumn("profit", payout.win_profit(F.lit(stake), F.col("won"), F.col("payout"), F.col("win_odds")))


SETTLED = "10.0::DOUBLE AS stake, CASE WHEN won = 1 THEN 10.0::DOUBLE * payout / 10 - 10.0 ELSE -10.0 END AS profit"
SUMMARY = "count(*) AS bets, sum(stake) AS staked, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi"


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    return reports.bet_summary(df, by, "stake", "profit", "won").select(*by, "bets", "staked", r6("profit"), r6("roi"))


@query(W + f""", m AS (SELECT *, (1 / win_odds) / sum(1 / win_odds) OVER (PARTITION BY race) AS p FROM runners), t AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY p DESC, saddle) AS r FROM m)
 SELECT season, {SUMMARY} FROM (SELECT season, {SETTLED} FROM t WHERE r = 1) GROUP BY season""")
def top_pick_roi_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's favourite of each race, settled and summed by season."""
    df = windows.share(runners(spark, sf_dir), "race", payout.implied(F.col("win_odds")), "p")
    return summary(settled(windows.top_k(df, "race", [F.desc("p"), "saddle"])), ["season"])


@query(P + "SELECT race, saddle, round(p_market, 6) AS p_market, round(p_model, 6) AS p_model, round(0.5 * p_model + 0.5 * p_market, 6) AS p_blend, round(p_model * win_odds - 1, 6) AS ev FROM priced")
def market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.blend(priced(spark, sf_dir), "race", "p_model", "p_market", 0.5, "p_blend")
    return df.select(*KEY, r6("p_market"), r6("p_model"), r6("p_blend"), F.round(payout.expected_value(F.col("p_model"), F.col("win_odds")), 6).alias("ev"))


def places_sql(p: str) -> str:
    """Tables h (with h) and places (race, saddle, p2, p3) by the column ``p``; what a field is too small for is 0."""
    return f""", h AS (SELECT *, {p} / greatest(1 - {p}, 1e-12) AS h FROM priced),
 c AS (SELECT a.race, a.saddle AS a, b.saddle AS b, CASE WHEN a.{p} + b.{p} < 1 - 1e-12 THEN a.h * b.{p} / (1 - a.{p} - b.{p}) ELSE 0.0 END AS m FROM h a JOIN h b ON a.race = b.race AND a.saddle <> b.saddle),
 tot AS (SELECT race, sum(m) AS m FROM c GROUP BY race), mine AS (SELECT race, s, sum(m) AS m FROM (SELECT race, a AS s, m FROM c UNION ALL SELECT race, b, m FROM c) GROUP BY race, s),
 places AS (SELECT h.*, {p} * (sum(h) OVER (PARTITION BY h.race) - h) AS p2, {p} * (coalesce(tot.m, 0.0) - coalesce(mine.m, 0.0)) AS p3 FROM h LEFT JOIN tot ON h.race = tot.race LEFT JOIN mine ON h.race = mine.race AND h.saddle = mine.s)"""


@query(P + places_sql("p_market") + " SELECT race, saddle, round(p2, 6) AS p2, round(p3, 6) AS p3, round(least(1.0, p_market + p2 + p3), 6) AS top_k FROM places")
def place_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = combos.place_chances(priced(spark, sf_dir), "race", "saddle", "p_market")
    return df.select(*KEY, r6("p2"), r6("p3"), r6("top_k"))


@query(P + """, h AS (SELECT *, p_market / greatest(1 - p_market, 1e-12) AS h FROM priced) SELECT race, saddle, round((1 - 0.175) / least(1.0, p_market + p_market * (sum(h) OVER (PARTITION BY race) - h)), 6) AS place_line FROM h""")
def constructed_place_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = combos.place_chances(priced(spark, sf_dir), "race", "saddle", "p_market", k=2)
    return df.select(*KEY, F.round((1 - 0.175) / F.col("top_k"), 6).alias("place_line"))


PAIRS = P + """, pr AS (SELECT a.race, a.season, a.saddle AS i, b.saddle AS j, a.p_model * b.p_model * (1 / (1 - a.p_model) + 1 / (1 - b.p_model)) AS q_p_model, a.p_market * b.p_market * (1 / (1 - a.p_market) + 1 / (1 - b.p_market)) AS q_p_market
  FROM priced a JOIN priced b ON a.race = b.race AND a.saddle < b.saddle), win AS (SELECT race, min(saddle) AS i, max(saddle) AS j FROM runners WHERE finish_pos <= 2 GROUP BY race HAVING count(*) = 2) """


@query(PAIRS + "SELECT race, i, j, round(q_p_model, 6) AS q_p_model, round(q_p_market, 6) AS q_p_market FROM pr")
def pair_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir)
    return combos.pair_chances(df, "race", "saddle", ["p_model", "p_market"]).select("race", "i", "j", r6("q_p_model"), r6("q_p_market"))


def _runs(order: str) -> str:
    a, b, c = (f"{x}.p_market" for x in order)
    return f"CASE WHEN 1 - {a} - {b} > 1e-12 THEN {a} * {b} / greatest(1 - {a}, 1e-12) * {c} / (1 - {a} - {b}) ELSE 0.0 END"


@query(P + f""", f AS (SELECT race, saddle, p_market, field_size FROM priced) SELECT x.race, x.saddle AS i, y.saddle AS j, round(sum({' + '.join(map(_runs, ('xyz', 'yxz', 'xzy', 'yzx', 'zxy', 'zyx')))}), 6) AS both_placed
 FROM f x JOIN f y ON x.race = y.race AND x.saddle < y.saddle JOIN f z ON z.race = x.race AND z.saddle <> x.saddle AND z.saddle <> y.saddle GROUP BY 1, 2, 3
 UNION ALL SELECT x.race, x.saddle, y.saddle, round(x.p_market * y.p_market * (1 / (1 - x.p_market) + 1 / (1 - y.p_market)), 6) FROM f x JOIN f y ON x.race = y.race AND x.saddle < y.saddle WHERE x.field_size = 2""")
def pair_place_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combos.pair_place_chances(priced(spark, sf_dir), "race", "saddle", "p_market").select("race", "i", "j", r6("both_placed"))


@query(PAIRS + """, b AS (SELECT pr.*, 0.825 / q_p_market AS price, q_p_model * 0.825 / q_p_market - 1 AS ev, CASE WHEN win.i IS NOT NULL THEN 1 ELSE 0 END AS won FROM pr LEFT JOIN win USING (race, i, j)),
 s AS (SELECT *, 10.0::DOUBLE AS stake, CASE WHEN won = 1 THEN 10 * price - 10 ELSE -10.0 END AS profit FROM b), t AS (SELECT s.*, v.t AS threshold FROM s JOIN (VALUES (0.0), (0.05), (0.1), (0.2)) v(t) ON round(ev, 9) >= v.t)
 SELECT threshold::DOUBLE AS threshold, count(*) AS bets, CAST(sum(won) AS BIGINT) AS wins, round(sum(profit) / sum(stake), 6) AS roi FROM t GROUP BY threshold""")
def pair_edge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs backed at a constructed price where the model sees an edge, settled by the first two home."""
    df = priced(spark, sf_dir)
    win = combos.winning_pair(runners(spark, sf_dir), "race", "saddle", "finish_pos").select("race", F.col("pair")[0].alias("i"), F.col("pair")[1].alias("j"), F.lit(1).alias("won"))
    q = combos.pair_chances(df, "race", "saddle", ["p_model", "p_market"]).join(win, ["race", "i", "j"], "left").fillna(0, ["won"])
    q = q.withColumn("price", 0.825 / F.col("q_p_market")).withColumn("ev", F.round(F.col("q_p_model") * F.col("price") - 1, 9))
    q = q.withColumn("stake", F.lit(10.0)).withColumn("profit", F.when(F.col("won") == 1, 10 * F.col("price") - 10).otherwise(-10.0))
    out = reports.threshold_report(q, "ev", [0.0, 0.05, 0.1, 0.2], [], "stake", "profit", "won")
    return out.select("threshold", "bets", F.round(F.col("hit_rate") * F.col("bets")).cast("long").alias("wins"), r6("roi"))


@query(P + """, k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(p_model, 9) DESC, saddle) AS pick FROM priced),
 b AS (SELECT * FROM (VALUES ('quinella', 2, 3, 3), ('trio', 3, 5, 10), ('first4', 4, 6, 15)) v(box, k, n, combos)),
 per AS (SELECT box, race, any_value(combos) AS combos, count(*) FILTER (WHERE finish_pos <= b.k) AS nw, count(*) FILTER (WHERE finish_pos <= b.k AND pick <= b.n) AS hit, any_value(b.k) AS k FROM k, b WHERE field_size >= b.n GROUP BY box, race)
 SELECT box, count(*) AS "groups", CAST(sum(CASE WHEN hit = k AND nw = k THEN 1 ELSE 0 END) AS BIGINT) AS hits, sum(combos) * 10.0::DOUBLE AS cost FROM per GROUP BY box""")
def box_ticket_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("pick", F.row_number().over(Window.partitionBy("race").orderBy(F.round("p_model", 9).desc(), "saddle")))
    return combos.box_tickets(df, "race", "saddle", "pick", "finish_pos", [("quinella", 2, 3), ("trio", 3, 5), ("first4", 4, 6)])


@query(P + f""", pol AS (SELECT 'model_win' AS policy, season, won, payout FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(p_model, 9) DESC, saddle) AS r FROM priced) WHERE r = 1
  UNION ALL SELECT 'canary_win', season, won, payout FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY md5(race || '-' || saddle), saddle) AS r FROM priced) WHERE r = 1
  UNION ALL SELECT 'blend_win', season, won, payout FROM priced WHERE round(p_blend * win_odds - 1, 9) >= 0.05)
 SELECT policy, {SUMMARY} FROM (SELECT policy, {SETTLED} FROM pol) GROUP BY policy""")
def policy_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(priced(spark, sf_dir))
    picks = windows.union_by_name(
        windows.top_k(df, "race", [F.round("p_model", 9).desc(), "saddle"]).withColumn("policy", F.lit("model_win")),
        windows.top_k(df, "race", [F.md5(F.concat_ws("-", "race", "saddle")), "saddle"]).withColumn("policy", F.lit("canary_win")),
        df.where(F.round(F.col("p_blend") * F.col("win_odds") - 1, 9) >= 0.05).withColumn("policy", F.lit("blend_win")),
    )
    return summary(picks, ["policy"])


EV = P + f", e AS (SELECT *, round(p_model * win_odds - 1, 9) AS ev, {SETTLED} FROM priced) "


@query(EV + f", t AS (SELECT e.*, v.t AS threshold FROM e JOIN (VALUES (-0.2), (0.0), (0.05), (0.1), (0.2)) v(t) ON ev >= v.t) SELECT season, threshold::DOUBLE AS threshold, {SUMMARY} FROM t GROUP BY season, threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(priced(spark, sf_dir)).withColumn("ev", F.round(F.col("p_model") * F.col("win_odds") - 1, 9))
    out = reports.threshold_report(df, "ev", [-0.2, 0.0, 0.05, 0.1, 0.2], ["season"], "stake", "profit", "won")
    return out.select("season", "threshold", "bets", "staked", r6("profit"), r6("roi"))


@query(EV + f", t AS (SELECT *, CASE WHEN win_odds >= 40 THEN 7 WHEN win_odds >= 30 THEN 6 WHEN win_odds >= 20 THEN 5 WHEN win_odds >= 15 THEN 4 WHEN win_odds >= 10 THEN 3 WHEN win_odds >= 5 THEN 2 WHEN win_odds >= 3 THEN 1 WHEN win_odds >= 1 THEN 0 END AS bucket FROM e) SELECT bucket, {SUMMARY} FROM t WHERE bucket IS NOT NULL GROUP BY bucket")
def odds_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(priced(spark, sf_dir)).withColumn("bucket", reports.bucket(F.col("win_odds"), [1, 3, 5, 10, 15, 20, 30, 40])).where("bucket is not null")
    return summary(df, ["bucket"])


@query(EV + f"SELECT date_trunc('month', race_date)::DATE AS month_start, {SUMMARY} FROM e GROUP BY 1")
def monthly_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(settled(priced(spark, sf_dir)).withColumn("month_start", F.trunc("race_date", "month")), ["month_start"])


@query(EV + """, g AS (SELECT *, round(p_model - p_market, 9) AS edge FROM e), b AS (SELECT *, CASE WHEN edge >= 0.1 THEN 4 WHEN edge >= 0.05 THEN 3 WHEN edge >= 0 THEN 2 WHEN edge >= -0.05 THEN 1 WHEN edge >= -1 THEN 0 END AS bucket FROM g)
 SELECT bucket, count(*) AS n, round(avg(won), 6) AS actual, round(avg(p_model), 6) AS model, round(avg(p_market), 6) AS market, round(sum(profit) / sum(stake), 6) AS roi FROM b GROUP BY bucket""")
def edge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(priced(spark, sf_dir)).withColumn("edge", F.round(F.col("p_model") - F.col("p_market"), 9))
    aggs = [F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(a) for c, a in (("won", "actual"), ("p_model", "model"), ("p_market", "market"))), F.round(F.sum("profit") / F.sum("stake"), 6).alias("roi")]
    return reports.bucket_report(df, "edge", [-1, -0.05, 0, 0.05, 0.1], aggs)


@query(EV + ", s AS (SELECT season, sum(stake) AS s, sum(profit) AS p FROM e GROUP BY season) SELECT season, round((sum(p) OVER () - p) / (sum(s) OVER () - s), 6) AS roi_without FROM s")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leave_one_out(settled(priced(spark, sf_dir)), "season", "stake", "profit").select("season", r6("roi_without"))


@query(W + """, q AS (SELECT *, ntile(4) OVER (PARTITION BY season ORDER BY win_odds, race, saddle) AS quartile, CASE WHEN draw <= 2 THEN 'low' WHEN draw <= 4 THEN 'mid' ELSE 'high' END AS band FROM runners)
 SELECT season, quartile, band, count(*) AS n, round(avg(won), 6) AS win_rate FROM q GROUP BY season, quartile, band""")
def odds_quartile_by_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.ntile_ranged(runners(spark, sf_dir), "season", "win_odds", "race", "saddle", 4, "quartile")
    band = F.when(F.col("draw") <= 2, "low").when(F.col("draw") <= 4, "mid").otherwise("high")
    return df.groupBy("season", "quartile", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("won"), 6).alias("win_rate"))


@query(P + """, g AS (SELECT season, race, sum(won * ln(greatest(1e-12, least(1.0, p_model)))) / sum(won) AS l FROM priced GROUP BY season, race HAVING sum(won) > 0) SELECT season, round(-avg(l), 6) AS log_loss, count(*) AS "groups" FROM g GROUP BY season""")
def group_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_log_loss(priced(spark, sf_dir), ["race"], "p_model", "won", ["season"]).select("season", r6("log_loss"), "groups")


@query(P + """, b AS (SELECT season, avg((p_model - won) * (p_model - won)) AS brier, -avg(won * ln(greatest(1e-12, least(1 - 1e-12, p_model))) + (1 - won) * ln(1 - greatest(1e-12, least(1 - 1e-12, p_model)))) AS l FROM priced GROUP BY season),
 t AS (SELECT season, avg(CASE WHEN won = 1 THEN 1.0 ELSE 0.0 END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY round(p_model, 9) DESC, saddle) AS r FROM priced) WHERE r = 1 GROUP BY season)
 SELECT season, round(brier, 6) AS brier, round(l, 6) AS binary_log_loss, round(hit, 6) AS hit_rate FROM b JOIN t USING (season)""")
def brier_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("p_r", F.round("p_model", 9))
    a = reports.pointwise_loss(df, "p_model", "won", ["season"])
    b = reports.hit_rate(df, ["race"], "p_r", "won", "saddle", ["season"])
    return a.join(b, "season").select("season", r6("brier"), r6("binary_log_loss"), r6("hit_rate"))


BINS = P + ', b AS (SELECT CAST(greatest(0, least(9, floor(round(p_model, 9) * 10))) AS INT) AS bin, avg(round(p_model, 9)) AS pred_mean, avg(won) AS obs_rate, count(*) AS n FROM priced GROUP BY 1) '


@query(BINS + "SELECT bin, round(pred_mean, 6) AS pred_mean, round(obs_rate, 6) AS obs_rate, n, (bin + 0.5) / 10.0::DOUBLE AS bin_mid FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("p", F.round("p_model", 9))
    return reports.calibration_bins(df, "p", "won").select("bin", r6("pred_mean"), r6("obs_rate"), "n", "bin_mid")


@query(BINS + "SELECT round(sum(n * abs(pred_mean - obs_rate)) / sum(n), 6) AS ece, round(max(abs(pred_mean - obs_rate)), 6) AS mce FROM b")
def ece_mce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("p", F.round("p_model", 9))
    return reports.ece_mce(reports.calibration_bins(df, "p", "won")).select(r6("ece"), r6("mce"))


@query(P + """, v AS (SELECT race, season, round(p_model, 9) AS a, finish_pos AS b FROM priced), r AS (SELECT race, season, rank() OVER (PARTITION BY race ORDER BY a) + (count(*) OVER (PARTITION BY race, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY race ORDER BY b) + (count(*) OVER (PARTITION BY race, b) - 1) / 2.0 AS y FROM v),
 g AS (SELECT season, race, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY season, race) SELECT season, round(avg(rho), 6) AS spearman, count(*) AS "groups" FROM g WHERE n >= 2 AND rho IS NOT NULL AND NOT isnan(rho) GROUP BY season""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("p", F.round("p_model", 9))
    return reports.spearman_by_group(df, ["race"], "p", "finish_pos", ["season"]).select("season", r6("spearman"), "groups")


@query(P + """, v AS (SELECT season, won, rank() OVER (PARTITION BY season ORDER BY round(p_model, 9)) + (count(*) OVER (PARTITION BY season, round(p_model, 9)) - 1) / 2.0 AS r FROM priced)
 SELECT season, round((sum(CASE WHEN won = 1 THEN r END) - sum(won) * (sum(won) + 1) / 2.0) / (sum(won) * (count(*) - sum(won))), 6) AS auc FROM v GROUP BY season""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.auc(priced(spark, sf_dir).withColumn("p", F.round("p_model", 9)), "p", "won", ["season"]).select("season", r6("auc"))


@query(EV + """, b AS (SELECT season, race, sum(profit) AS num, sum(stake) AS den FROM e GROUP BY season, race), m AS (SELECT *, md5('0-' || q || '-' || race) AS h FROM b, range(0, 125) g(q)),
 u AS (SELECT season, q * 8 + j AS r, num, den, ('0x' || substr(h, j * 4 + 1, 4))::INT AS u FROM m, range(0, 8) g(j)),
 s AS (SELECT season, r, sum(w * num) / sum(w * den) AS x FROM (SELECT *, (u >= 24109)::INT + (u >= 48218)::INT + (u >= 60273)::INT + (u >= 64291)::INT + (u >= 65296)::INT + (u >= 65497)::INT + (u >= 65530)::INT AS w FROM u) GROUP BY season, r)
 SELECT season, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM s GROUP BY season""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.block_bootstrap(settled(priced(spark, sf_dir)), "race", "profit", "stake", 1000, 0, ["season"])
    return out.select("season", r6("lo"), r6("hi"), r6("share_positive"))


CURVE = EV + ", day AS (SELECT race_date, sum(profit) AS pnl FROM (SELECT * FROM e WHERE ev >= 0.05) GROUP BY race_date), c AS (SELECT *, sum(pnl) OVER w AS equity FROM day WINDOW w AS (ORDER BY race_date)) "


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(priced(spark, sf_dir)).where(F.round(F.col("p_model") * F.col("win_odds") - 1, 9) >= 0.05)
    return reports.equity_curve(df, "race_date", "profit")


@query(CURVE + "SELECT race_date, round(pnl, 6) AS pnl, round(equity, 6) AS equity, round(greatest(0.0, max(equity) OVER (ORDER BY race_date)) - equity, 6) AS drawdown FROM c")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("race_date", r6("pnl"), r6("equity"), r6("drawdown"))


@query(CURVE + """, g AS (SELECT ln(greatest(1e-9, 1 + pnl / 100000.0)) AS g, row_number() OVER (ORDER BY race_date) - 1 AS i, count(*) OVER () AS n FROM day),
 d AS (SELECT r, g.i AS place, ('0x' || substr(md5('0-' || r || '-' || g.i), 1, 8))::BIGINT % n AS i FROM g, range(0, 1000) v(r)), p AS (SELECT r, sum(gg) OVER (PARTITION BY r ORDER BY place) AS w FROM (SELECT d.r AS r, d.place AS place, g.g AS gg FROM d JOIN g ON d.i = g.i)),
 l AS (SELECT r, min(w) AS low FROM p GROUP BY r) SELECT round(avg(CASE WHEN low < ln(0.9) THEN 1.0 ELSE 0.0 END), 6) AS ruin_probability, count(*) AS replicates FROM l""")
def ruin_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ruin_probability(_curve(spark, sf_dir), "race_date", "pnl", 100_000.0, 0.9, 1000).select(r6("ruin_probability"), "replicates")


@query(EV + "SELECT race, saddle, round(CASE WHEN p_blend * win_odds > 1 THEN least(1.0, (p_blend * win_odds - 1) / (win_odds - 1)) ELSE 0.0 END, 6) AS fraction FROM e")
def kelly_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(*KEY, F.round(payout.kelly(F.col("p_blend"), F.col("win_odds")), 6).alias("fraction"))


#: The sums of each prefix in value order; the best prefix; the fractions that it gives.
EXCLUSIVE = P + """, v AS (SELECT *, p_blend * win_odds AS ev0 FROM priced WHERE round(p_blend * win_odds - 1, 9) >= 0.05), s AS (SELECT *, sum(p_blend) OVER w AS sp, sum(1 / win_odds) OVER w AS sb, sum(p_blend * ln(ev0)) OVER w AS sl, row_number() OVER w AS t FROM v WINDOW w AS (PARTITION BY race ORDER BY ev0 DESC, saddle ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, CASE WHEN 1 - sb > 1e-12 AND 1 - sp > 1e-12 THEN (1 - sp) / (1 - sb) END AS res FROM s), g AS (SELECT *, CASE WHEN ev0 >= res - 1e-12 * win_odds THEN sl + (1 - sp) * ln(res) END AS g FROM r),
 best AS (SELECT race, t AS bt, res AS bres FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY g DESC, t) AS k FROM g WHERE g > 1e-15) WHERE k = 1),
 frac AS (SELECT p.*, CASE WHEN g.t <= best.bt THEN greatest(0.0, p.p_blend - bres / p.win_odds) ELSE 0.0 END AS fraction FROM priced p LEFT JOIN g ON p.race = g.race AND p.saddle = g.saddle LEFT JOIN best ON p.race = best.race) """


def _exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir)
    gate = F.round(F.col("p_blend") * F.col("win_odds") - 1, 9) >= 0.05
    return staking.kelly_exclusive(df, ["race"], "p_blend", "win_odds", "saddle", "fraction", gate)


@query(EXCLUSIVE + "SELECT race, saddle, round(fraction, 6) AS fraction FROM frac")
def kelly_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exclusive(spark, sf_dir).select(*KEY, r6("fraction"))


STAKES = EXCLUSIVE + """, a AS (SELECT *, 0.25 * fraction * 100000.0 AS s0 FROM frac), b AS (SELECT *, CASE WHEN sum(s0) OVER (PARTITION BY race) > 10000.0 THEN s0 * 10000.0 / sum(s0) OVER (PARTITION BY race) ELSE s0 END AS s1 FROM a),
 c AS (SELECT *, CASE WHEN sum(s1) OVER (PARTITION BY race_date) > 25000.0 THEN s1 * 25000.0 / sum(s1) OVER (PARTITION BY race_date) ELSE s1 END AS desired0 FROM b), d AS (SELECT *, round(desired0, 6) AS desired FROM c),
 st AS (SELECT *, CASE WHEN desired >= 10 THEN floor(desired / 10 + 0.5) * 10 ELSE 0.0 END AS stake FROM d) """


def _stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _exclusive(spark, sf_dir).withColumn("stake", 0.25 * F.col("fraction") * 100_000.0)
    df = staking.cap_days(staking.cap(df, ["race"], "stake", 10_000.0), "race_date", "stake", 25_000.0)
    return df.withColumn("desired", F.round("stake", 6)).withColumn("stake", payout.round_stake(F.col("desired")))


@query(STAKES + "SELECT race, saddle, desired, stake FROM st WHERE desired > 0")
def capped_rounded_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter stakes of the exclusive solver under a race and a day cap, rounded to legal multiples."""
    return _stakes(spark, sf_dir).where("desired > 0").select(*KEY, "desired", "stake")


@query(STAKES + ", l AS (SELECT race_date, sum(CASE WHEN won = 1 THEN 0.0 ELSE stake END) AS losing FROM st GROUP BY race_date) SELECT race_date, round(losing, 6) AS losing, losing > 10000 AS triggered, round(CASE WHEN losing > 10000 THEN 0.1 * (losing - 10000) ELSE 0.0 END, 6) AS credit FROM l")
def rebate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staking.rebates(_stakes(spark, sf_dir), ["race_date"], "stake", "won", 0.1, 10_000.0).select("race_date", r6("losing"), "triggered", r6("credit"))


GRID = staking.policy_grid((0.05, 0.10, 0.25, 0.35, 0.50))
BANKS = (1_000.0, 10_000.0, 100_000.0, 1_000_000.0)
GRID_SQL = ", ".join(f"('{g.name}', '{g.method}', {g.size}::DOUBLE)" for g in GRID)


@query(EXCLUSIVE + f""", k AS (SELECT race, race_date, win_odds, won, fraction AS x, CASE WHEN p_blend * win_odds > 1 THEN least(1.0, (p_blend * win_odds - 1) / (win_odds - 1)) ELSE 0.0 END AS k FROM frac WHERE p_blend > 0 AND win_odds > 1 AND p_blend * win_odds - 1 >= 0.05),
 c AS (SELECT k.*, policy, bank, CASE method WHEN 'flat' THEN size / bank WHEN 'fraction' THEN size WHEN 'kelly' THEN size * k ELSE size * x END AS s FROM k, (VALUES {GRID_SQL}) g(policy, method, size), (VALUES {", ".join(f"({b}::DOUBLE)" for b in BANKS)}) b(bank)),
 rt AS (SELECT *, sum(s) OVER (PARTITION BY policy, bank, race) AS t FROM c), rc AS (SELECT * REPLACE (CASE WHEN t > 0.10 THEN s * 0.10 / t ELSE s END AS s) FROM rt),
 d AS (SELECT *, sum(s) OVER (PARTITION BY policy, bank, race_date) AS td FROM rc), d1 AS (SELECT *, round(CASE WHEN td > 0.25 THEN s * 0.25 / td ELSE s END * bank, 6) AS desired FROM d),
 z AS (SELECT *, CASE WHEN desired >= 10 AND floor(desired / 10 + 0.5) * 10 >= 10 THEN floor(desired / 10 + 0.5) * 10 ELSE 0.0 END AS stake FROM d1)
 SELECT policy, bank, CAST(sum(CASE WHEN stake > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bets, round(sum(stake), 2) AS staked, round(sum(CASE WHEN won = 1 THEN stake * (win_odds - 1) ELSE -stake END), 2) AS profit, round(sum(desired), 2) AS desired,
  round(CASE WHEN sum(stake) > 0 THEN sum(CASE WHEN won = 1 THEN stake * (win_odds - 1) ELSE -stake END) / sum(stake) ELSE 0.0 END, 6) AS roi, round(CASE WHEN sum(desired) > 0 THEN (sum(desired) - sum(stake)) / sum(desired) ELSE 0.0 END, 6) AS lost_to_rounding FROM z GROUP BY policy, bank""")
def stake_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen policies over four banks in one pass."""
    out = staking.stake_sweep(priced(spark, sf_dir), ["race"], "race_date", "p_blend", "win_odds", "won", "saddle", GRID, BANKS)
    return out.select("policy", "bank", "bets", *(F.round(c, 2).alias(c) for c in ("staked", "profit", "desired")), r6("roi"), r6("lost_to_rounding"))


@query(EXCLUSIVE + ", w AS (SELECT *, 1 - sum(fraction) OVER (PARTITION BY race) AS cash FROM frac), x AS (SELECT race, coalesce(sum(CASE WHEN fraction > 0 THEN p_blend * ln(cash + fraction * win_odds) END), 0.0) + greatest(0.0, 1 - sum(CASE WHEN fraction > 0 THEN p_blend ELSE 0.0 END)) * ln(max(cash)) AS l FROM w GROUP BY race) SELECT race, round(l, 6) AS log_wealth FROM x")
def expected_log_wealth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staking.expected_log_wealth(_exclusive(spark, sf_dir), ["race"], "fraction", "p_blend", "win_odds").select("race", r6("log_wealth"))


@query(P + """, k AS (SELECT *, CASE WHEN saddle % 2 = 0 THEN 1 / nullif(p_market, 0) END AS known FROM priced), s AS (SELECT *, CASE WHEN known > 0 THEN 1 / known END AS kp FROM k),
 f AS (SELECT *, coalesce(kp, greatest(0.0, 1 - coalesce(sum(kp) OVER (PARTITION BY race), 0.0)) * p_model / sum(CASE WHEN kp IS NULL THEN p_model END) OVER (PARTITION BY race)) AS f FROM s) SELECT race, saddle, round(f / sum(f) OVER (PARTITION BY race), 6) AS p_imputed FROM f""")
def imputed_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priced(spark, sf_dir).withColumn("known", F.when(F.col("saddle") % 2 == 0, 1 / F.col("p_market")))
    return combos.impute_market(df, "race", "known", "p_model", "p_imputed").select(*KEY, r6("p_imputed"))


@query(W + """, r AS (SELECT *, CASE WHEN win_odds < 10 AND draw <= 3 THEN 'short_inside' END AS a, CASE WHEN win_odds >= 20 THEN 'long_price' END AS b, CASE WHEN surface = 'O' AND weight > 30 THEN 'heavy_o' END AS c FROM runners),
 u AS (SELECT a AS rule, won, payout FROM r WHERE a IS NOT NULL UNION ALL SELECT b, won, payout FROM r WHERE b IS NOT NULL UNION ALL SELECT c, won, payout FROM r WHERE c IS NOT NULL)
 SELECT rule, """ + SUMMARY + f" FROM (SELECT rule, {SETTLED} FROM u) GROUP BY rule")
def rule_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rules, each a predicate; a runner counts under every rule that it meets."""
    rules = {"short_inside": (F.col("win_odds") < 10) & (F.col("draw") <= 3), "long_price": F.col("win_odds") >= 20, "heavy_o": (F.col("surface") == "O") & (F.col("weight") > 30)}
    met = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return summary(settled(runners(spark, sf_dir)).withColumn("rule", F.explode(met)), ["rule"])


@query(W + """SELECT dim, level, count(*) AS n, round(avg(won), 6) AS win_rate, round(avg(won) / avg(1.0 / field_size), 6) AS lift FROM (SELECT 'distance' AS dim, CAST(distance AS VARCHAR) AS level, won, field_size FROM runners
 UNION ALL SELECT 'surface', surface, won, field_size FROM runners UNION ALL SELECT 'going', going, won, field_size FROM runners) GROUP BY dim, level""")
def segment_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in ("distance", "surface", "going")))
    df = runners(spark, sf_dir).select("won", "field_size", F.explode(dims).alias("x")).select("won", "field_size", "x.*")
    return df.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("won"), 6).alias("win_rate"), F.round(F.avg("won") / F.avg(1.0 / F.col("field_size")), 6).alias("lift"))


@query(P + " SELECT 'p_model' AS a, 'p_market' AS b, round(corr(p_model, p_market), 6) AS corr FROM priced UNION ALL SELECT 'p_model', 'weight', round(corr(p_model, weight), 6) FROM priced UNION ALL SELECT 'p_market', 'weight', round(corr(p_market, weight), 6) FROM priced")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.correlations(priced(spark, sf_dir), ["p_model", "p_market", "weight"]).select("a", "b", r6("corr"))


@query(W + """SELECT race, round(CASE WHEN sum(weight) > 0 THEN 10 * (1 - 0.175) * sum(weight) / sum(CASE WHEN won = 1 THEN weight END) ELSE 0.0 END, 6) AS dividend,
 round(10 * (1 - 0.175) * (sum(weight) + 100) / (sum(CASE WHEN won = 1 THEN weight END) + 100), 6) AS with_stake FROM runners GROUP BY race""")
def pool_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runners(spark, sf_dir).groupBy("race").agg(F.sum("weight").alias("gross"), F.sum(F.when(F.col("won") == 1, F.col("weight"))).alias("on_winner"))
    return df.select("race", F.round(payout.win_dividend(F.col("gross"), F.col("on_winner"), 0.175), 6).alias("dividend"), F.round(payout.impact_dividend(F.col("gross"), F.col("on_winner"), F.lit(100.0), 0.175), 6).alias("with_stake"))


@query(STAKES + """SELECT race, saddle, round(p_model, 6) AS p_model, round(p_market, 6) AS p_market, round(p_blend, 6) AS p_blend, round(p_blend * win_odds - 1, 6) AS ev, stake,
 row_number() OVER (PARTITION BY race ORDER BY round(p_blend, 9) DESC, saddle) AS rank_in_race FROM st WHERE race_date >= DATE '2001-01-01'""")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card's runners with chances, value, a capped and rounded quarter stake, and their place in the order."""
    df = _stakes(spark, sf_dir).where("race_date >= '2001-01-01'")
    rank = F.row_number().over(Window.partitionBy("race").orderBy(F.round("p_blend", 9).desc(), "saddle"))
    return df.select(*KEY, r6("p_model"), r6("p_market"), r6("p_blend"), F.round(payout.expected_value(F.col("p_blend"), F.col("win_odds")), 6).alias("ev"), "stake", rank.alias("rank_in_race"))


@query(W + ", f AS (SELECT season, dense_rank() OVER (ORDER BY season DESC) AS r FROM (SELECT DISTINCT season FROM runners)) SELECT season, count(*) AS n, round(avg(won), 6) AS win_rate FROM runners JOIN f USING (season) WHERE r <= 3 GROUP BY season")
def last_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest seasons, those that a test would use."""
    df = runners(spark, sf_dir)
    return windows.last_folds(df, "season", 3).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("won"), 6).alias("win_rate"))


@query(STAKES + ", bt AS (SELECT season, stake, CASE WHEN won = 1 THEN stake * (win_odds - 1) ELSE -stake END AS profit FROM st WHERE stake > 0) SELECT season, count(*) AS bets, round(sum(stake), 6) AS staked, round(sum(profit), 6) AS profit, round(sum(profit) / sum(stake), 6) AS roi FROM bt GROUP BY season")
def quarter_stake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets, stakes and return by season of quarter stakes from a fixed bank."""
    df = _stakes(spark, sf_dir).where("stake > 0").withColumn("profit", F.when(F.col("won") == 1, F.col("stake") * (F.col("win_odds") - 1)).otherwise(-F.col("stake")))
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum("stake"), 6).alias("staked"), F.round(F.sum("profit"), 6).alias("profit"), F.round(F.sum("profit") / F.sum("stake"), 6).alias("roi"))
