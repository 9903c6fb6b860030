"""Registered queries: data quality, text signals, pages, feeds, snapshots, models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.operators import joins, models, quality, reports, text, windows
from formline.plans.features import RUNNERS_SQL
from formline.plans.spine import PRICED_SQL, TASK_ROWS, priced, runners, table
from formline.sources import feeds, pages, tables
from formline.streaming import snapshots

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


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT l_partkey || '-' || l_suppkey) AS n_distinct, count(DISTINCT l_partkey || '-' || l_suppkey) > 1 AS differ FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query(W + """, t AS (SELECT race, string_agg(CAST(saddle AS VARCHAR), '-' ORDER BY saddle) AS by_saddle, string_agg(CAST(draw AS VARCHAR), '-' ORDER BY draw) AS by_draw FROM runners WHERE finish_pos <= 2 GROUP BY race HAVING count(*) = 2),
 paid AS (SELECT race, string_agg(CAST(saddle AS VARCHAR), '-' ORDER BY saddle) AS combo FROM runners WHERE finish_pos <= 2 GROUP BY race),
 j AS (SELECT 'by_saddle' AS key, CAST(by_saddle = combo AS INT) AS hit FROM t JOIN paid USING (race) UNION ALL SELECT 'by_draw', CAST(by_draw = combo AS INT) FROM t JOIN paid USING (race))
 SELECT key, count(*) AS "groups", CAST(sum(hit) AS BIGINT) AS matched, round(avg(hit), 6) AS rate FROM j GROUP BY key""")
def key_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two keys the paid combinations are written in."""
    top = runners(spark, sf_dir).where("finish_pos <= 2").groupBy("race")
    pair = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "-")  # noqa: E731  two members at most
    both = top.agg(pair("saddle").alias("by_saddle"), pair("draw").alias("by_draw"), F.count(F.lit(1)).alias("n"))
    winners = both.where("n = 2").drop("n")
    out = quality.key_match_rate(winners, both.select("race", F.col("by_saddle").alias("combo")), "race", ["by_saddle", "by_draw"], "combo")
    return out.select("key", "groups", "matched", r6("rate"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k, year(o_orderdate) AS y FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.05)
 SELECT y AS year_no, count(*) AS n_keys, count(b.k) AS n_covered, CAST(sum(CASE WHEN b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM a LEFT JOIN b USING (k) GROUP BY y""")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("year_no"))
    return quality.coverage(o, table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("k")), "k", "year_no")


@query("SELECT quality AS flag, toxic AS truth, count(*) AS n FROM labels GROUP BY 1, 2")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("flag"), F.col("toxic").alias("truth")), "flag", "truth")


@query(W + """, f AS (SELECT lag(weight) OVER h AS prev_weight, lag(weight, 3) OVER h AS third_weight, weight FROM runners WINDOW h AS (PARTITION BY horse ORDER BY ord, saddle)), m AS (SELECT 'prev_weight' AS c, avg(CASE WHEN prev_weight IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM f
 UNION ALL SELECT 'third_weight', avg(CASE WHEN third_weight IS NULL THEN 1.0 ELSE 0.0 END) FROM f UNION ALL SELECT 'weight', avg(CASE WHEN weight IS NULL THEN 1.0 ELSE 0.0 END) FROM f) SELECT c AS "column", round(r, 6) AS missing_rate FROM m""")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.lagged(windows.lagged(runners(spark, sf_dir), "horse", ["ord", "saddle"], ["weight"]), "horse", ["ord", "saddle"], ["weight"], 3, "third_")
    return quality.missing_rate(df, ["prev_weight", "third_weight", "weight"]).select("column", r6("missing_rate"))


@query("SELECT count(*) AS n_keys, count(s.l_suppkey) AS n_shared, round(count(s.l_suppkey) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM (SELECT DISTINCT s_suppkey AS l_suppkey FROM supplier) a LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49) s USING (l_suppkey)")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.overlap(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")), "k").select("n_keys", "n_shared", r6("ratio"))


@query("""SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders
 UNION ALL SELECT 'events', count(*), count(DISTINCT CAST(ts AS DATE)), min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM events""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return tables.coverage_summary({"orders": o, "events": table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))}, "day")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) SELECT day FROM s WHERE day NOT IN (SELECT day FROM d)""")
def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an order, between the first and the last."""
    return tables.gap_days(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that the ledger, the keys that have lines, lacks."""
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.skip_seen(table(spark, sf_dir, "orders"), ledger, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return joins.upsert_latest(e, e.limit(0), "user_id", "at").select("user_id", "event_id", "value")


@query("SELECT n_name, n_regionkey, coalesce(c, 0) AS n_customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def groups_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its number of entries, 0 where it has none."""
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return joins.strict_left_join(table(spark, sf_dir, "nation"), per, ["n_nationkey"]).select("n_name", "n_regionkey", F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


@query(W + "SELECT race, race_date, count(*) AS n_runners FROM runners GROUP BY race, race_date ORDER BY race_date DESC, race DESC LIMIT 20")
def recent_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest races with their fields."""
    return runners(spark, sf_dir).groupBy("race", "race_date").agg(F.count(F.lit(1)).alias("n_runners")).orderBy(F.desc("race_date"), F.desc("race")).limit(20)


#: Short tokens that occur in the invented texts stand for phrases.
WORDS = {"first": ("the", "of the", "and"), "second": ("de", "la", "que"), "third": ("und", "die")}


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, CASE WHEN json_extract_string(props, '$.k')::INT >= 50 THEN 1 ELSE 0 END AS high FROM events")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = feeds.rows_from_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "struct<k:int>")
    return e.select("event_id", F.col("x0.k").alias("k"), (F.col("x0.k") >= 50).cast("int").alias("high"))


PHRASES = WORDS | {f"lexicon_{k}": v for k, v in text.LEXICON.items()}


def _phrases_sql(phrases: tuple[str, ...]) -> str:
    """Every separator is doubled in ``t``, so that neighbours don't share one."""
    return " + ".join(f"""len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_]{p.replace(" ", "  ")}[^\\p{{L}}\\p{{N}}_]'))""" for p in phrases)


@query("WITH d AS (SELECT doc_id, '  ' || regexp_replace(lower(coalesce(text, '')), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || '  ' AS t FROM documents) SELECT doc_id, " + ", ".join(f"{_phrases_sql(p)} AS {n}" for n, p in PHRASES.items()) + " FROM d")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase counts by category of every document."""
    counts = text.phrase_counts(F.col("text"), PHRASES)
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in counts.items()))


@query("""WITH a AS (SELECT label, embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1 AND label < 3)
 SELECT e.vec_id, CAST(a.label AS VARCHAR) AS anchor, round(list_dot_product(e.embedding::DOUBLE[], a.v::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(a.v::DOUBLE[], a.v::DOUBLE[])), 6) AS similarity FROM embeddings e, a""")
def anchor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    anchors = windows.dedup(e.where("label < 3"), "label", ["vec_id"]).select(F.col("label").cast("string").alias("name"), "embedding")
    return text.anchor_similarity(e, "embedding", anchors, "name", "embedding", ["vec_id"]).select("vec_id", "anchor", r6("similarity"))


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*"[^"]*"[^>]*>.*?</a>') AS found FROM pages), e AS (SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS position FROM a)
 SELECT page_id, CAST(position AS INT) AS position, regexp_extract(a, '(?is)href\\s*=\\s*"([^"]*)"', 1) AS href,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[\\s\\x{00A0}]+', ' ', 'g')) AS label FROM e""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page with its place, address and text."""
    return pages.links(table(spark, sf_dir, "pages"), "html", ["page_id"])


SNAP = "WITH s AS (SELECT ts, date_trunc('minute', ts) AS minute_no, user_id % 10 AS grp, user_id AS member, event_type AS pool, 1 + value AS odds FROM events) "


def _snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.date_trunc("day", "ts").alias("day_no"), F.pmod("user_id", F.lit(10)).alias("grp"), F.col("user_id").alias("member"), F.col("event_type").alias("pool"), (1 + F.col("value")).alias("odds"))


@query("SELECT member, pool, day_no, ts, odds FROM (SELECT user_id AS member, event_type AS pool, date_trunc('day', ts) AS day_no, ts, 1 + value AS odds, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts) AS r FROM events) WHERE r = 1")
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot of each runner, pool and day; the tests hold the streaming form to the same rows."""
    return snapshots.dedup_snapshots(_snaps(spark, sf_dir), ["member", "pool", "day_no"], "ts").select("member", "pool", F.col("day_no").cast("timestamp").alias("day_no"), "ts", "odds")


DRIFT = """WITH s AS (SELECT user_id % 10 AS grp, user_id AS member, ts, 1 + value AS odds FROM events WHERE event_type = 'view'), c AS (SELECT grp, max(ts) AS off FROM s GROUP BY grp),
 p AS (SELECT grp, member, arg_min(odds, ts) AS op, arg_max(odds, ts) AS cl, count(*) AS snapshots, arg_max(odds, CASE WHEN ts <= off - INTERVAL 7200 MINUTE THEN ts END) FILTER (WHERE ts <= off - INTERVAL 7200 MINUTE) AS a FROM s JOIN c USING (grp) GROUP BY grp, member),
 d AS (SELECT *, ln(cl / op) AS drift, ln(cl / a) AS drift_7200 FROM p), v AS (SELECT *, drift - median(drift) OVER (PARTITION BY grp) AS drift_vs_field FROM d) """


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snaps(spark, sf_dir).where("pool = 'view'")
    off = s.groupBy("grp").agg(F.max("ts").alias("off"))
    return snapshots.price_drift(s.join(off, "grp"), ["grp", "member"], ["grp"], "ts", "odds", "off", lags=(7200,))


@query(DRIFT + "SELECT grp, member, op AS open, cl AS close, snapshots, round(drift, 6) AS drift, round(drift_7200, 6) AS drift_7200, round(drift_vs_field, 6) AS drift_vs_field, CASE WHEN drift_vs_field <= -0.1 THEN 1 ELSE 0 END AS steam, CASE WHEN drift_7200 * drift < 0 THEN 1 ELSE 0 END AS reversal FROM v")
def price_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("grp", "member", "open", "close", "snapshots", r6("drift"), r6("drift_7200"), r6("drift_vs_field"), "steam", "reversal")


@query(DRIFT + ", k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cl DESC NULLS LAST, member) AS strength_rank, row_number() OVER (PARTITION BY grp ORDER BY round(drift, 9) NULLS LAST, member) AS drift_rank FROM v) SELECT grp, member, strength_rank, drift_rank FROM k WHERE strength_rank <= 6 AND drift_rank <= 6")
def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _drift(spark, sf_dir)
    return snapshots.resonance(df, ["grp"], "member", F.col("close"), F.round("drift", 9), k=6).select("grp", "member", "strength_rank", "drift_rank")


@query("SELECT user_id AS member, arg_max(1 + value, ts) AS odds, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1")
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest_price(_snaps(spark, sf_dir).where("pool = 'view'"), ["member"], "ts", "odds")


@query("SELECT user_id AS member, round(max(CASE WHEN event_type = 'view' THEN 1 / (1 + value) END), 6) AS p_win, round(max(CASE WHEN event_type = 'click' THEN 1 / (1 + value) END), 6) AS p_place, round(max(CASE WHEN event_type = 'click' THEN 1 / (1 + value) END) / max(CASE WHEN event_type = 'view' THEN 1 / (1 + value) END), 6) AS place_over_win FROM events GROUP BY 1")
def implied_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.implied_gap(_snaps(spark, sf_dir), ["member"], "pool", "odds", "view", "click").select("member", r6("p_win"), r6("p_place"), r6("place_over_win"))


FEATURES = ["weight", "tax", "disc", "draw_rel"]


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).select("race", "saddle", "season", "won", *FEATURES)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel, made once and written; fits and scores read it."""
    from formline.llm.common import materialise

    return materialise(_panel(spark, sf_dir), "panel")


def _logit(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    return models.walk_forward_logits(_written(spark, sf_dir), "season", ["race"], "won", {"grouped_logit": (FEATURES, 1e-3)}, last=last).drop("setting")


@query()
def grouped_logit_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winning chances of each season by a model of all earlier ones, the models of all seasons fitted together."""
    return _logit(spark, sf_dir).select("season", "race", "saddle", "won", "p_win")


@query()
def controlled_logit_tstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients and t values of factors beside the log of the market's chance."""
    df = priced(spark, sf_dir).withColumn("log_market", F.log("p_market"))
    return models.fit_grouped_logit(df, ["race"], "won", ["log_market", "tax", "disc", "draw_rel"]).table(spark)


@query()
def canary_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient of a feature of pure noise beside real ones, by their mean size, with the noise picks' return."""
    from formline.functions import payout, scalars

    df = priced(spark, sf_dir).withColumn("noise", scalars.noise(F.col("race"), F.col("saddle")))
    ratio = models.canary_ratio(models.fit_grouped_logit(df, ["race"], "won", [*FEATURES, "noise"]), "noise")
    picks = windows.top_k(df, "race", [F.desc("noise"), "saddle"]).withColumn("stake", F.lit(10.0))
    picks = picks.withColumn("profit", payout.win_profit(F.col("stake"), F.col("won"), F.col("payout"), F.col("win_odds")))
    return reports.bet_summary(picks, ["season"], "stake", "profit", "won").select("season", F.lit(ratio).alias("coefficient_ratio"), "bets", r6("roi"))


@query()
def ablation(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """Loss of the model without each feature and without pairs of them, over all seasons that can be scored or the ``last`` of them."""
    from formline.llm.common import release

    groups = {"weight": ["weight"], "tax": ["tax"], "disc": ["disc"], "draw": ["draw_rel"], "weight and draw": ["weight", "draw_rel"]}
    df = _written(spark, sf_dir)
    out = models.ablate(df, "season", ["race"], "won", FEATURES, groups, last=last)
    release(df)  # the losses are summed
    return out


@query()
def param_search(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """Loss of the model by its penalty, over all seasons that can be scored or the ``last`` of them."""
    from formline.llm.common import release

    df = _written(spark, sf_dir)
    out = models.param_search(df, "season", ["race"], "won", FEATURES, [1e-3, 1e-1, 1.0, 10.0, 100.0, 1000.0, 10_000.0], last=last)
    release(df)  # the losses are summed
    return out


@query()
def leaderboard(spark: SparkSession, sf_dir: str, last: int | None = 3) -> DataFrame:
    """Log-loss of a grouped model, boosted trees and their ensemble, each season scored by models of all earlier ones, over the ``last`` seasons.

    The panel is made once and written; fits, scores and losses read it. The trees learn from counts of equal rows. All
    chances are columns beside each other, so rows meet by race once.
    """
    from formline.llm.common import materialise, release

    df = materialise(_panel(spark, sf_dir).withColumn("won", F.col("won").cast("double")), "panel")
    counts = materialise(df.groupBy("season", *FEATURES, "won").agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")
    gaps, earlier = models.with_gaps(counts, FEATURES), lambda rows, season: rows.where(F.col("season") < season)
    both = df.limit(0).select("season", "race", "won", F.lit(0.0).alias("eta"), F.lit(0.0).alias("boosted_trees"))
    for season, logit in models.fold_logits(df, "season", ["race"], "won", FEATURES, last=last).items():
        trees = models.fit_counted_gbt(earlier(df, season), earlier(counts, season), "n", FEATURES, gaps=gaps)
        now = df.where(F.col("season") == season).withColumn("eta", models.linear_score(logit))
        both = both.unionByName(models.scored_rows(trees, now, "boosted_trees").select("season", "race", "won", "eta", "boosted_trees"))
    n = max(spark.sparkContext.defaultParallelism, -(-int(counts.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS))
    release(counts)
    both = windows.renormalise(both.repartition(n, "race"), ["race", "season"], "boosted_trees")
    both = windows.softmax(both, "race", "eta", "grouped_logit").withColumn("ensemble", (F.col("grouped_logit") + F.col("boosted_trees")) / 2)
    both = windows.renormalise(both, "race", "ensemble")
    return reports.group_log_losses(both, ["race"], {m: m for m in ("grouped_logit", "boosted_trees", "ensemble")}, "won").orderBy("log_loss", "model")


@query(f"""WITH {PRICED_SQL}, t AS (SELECT * FROM (VALUES (0.5), (1.0), (2.0), (4.0)) v(t)), e AS (SELECT t::DOUBLE AS temperature, race, won, ln(greatest(p_model, 1e-12)) / t AS eta FROM priced, t), x AS (SELECT *, exp(eta - max(eta) OVER (PARTITION BY temperature, race)) AS x FROM e),
 q AS (SELECT temperature, race, won, x / sum(x) OVER (PARTITION BY temperature, race) AS q FROM x), g AS (SELECT temperature, race, sum(won * ln(greatest(1e-12, q))) / sum(won) AS l FROM q GROUP BY 1, 2 HAVING sum(won) > 0) SELECT temperature, round(-avg(l), 6) AS log_loss FROM g GROUP BY temperature""")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.temperature_losses(priced(spark, sf_dir), ["race"], "p_model", "won", [0.5, 1.0, 2.0, 4.0]).select("temperature", r6("log_loss"))


def _platt_sql(steps: int = 8) -> str:
    """Newton steps of all blocks' logistic curves, one after another."""
    out = "c0 AS (SELECT i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM blocks)"
    for k in range(steps):
        out += f""", s{k} AS (SELECT i, any_value(a) AS a, any_value(b) AS b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h0, sum(q * (1 - q) * x) AS h1, sum(q * (1 - q) * x * x) AS h2 FROM (SELECT c.*, x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM c{k} c JOIN blocks USING (i) JOIN r ON r.block <= upto) GROUP BY i),
 c{k + 1} AS (SELECT i, CASE WHEN h0 * h2 - h1 * h1 > 1e-9 THEN a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) ELSE a END AS a, CASE WHEN h0 * h2 - h1 * h1 > 1e-9 THEN b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) ELSE b END AS b FROM s{k})"""
    return out


@query(f"""WITH {PRICED_SQL}, blocks AS (SELECT * FROM (VALUES (0, 1995, 1996, 1997), (1, 1997, 1998, 1999), (2, 1999, 2000, 2001)) v(i, upto, lo, hi)),
 r AS (SELECT race, saddle, year(race_date) AS block, p_model, won::DOUBLE AS y, ln(greatest(p_model, 1e-6) / greatest(1 - p_model, 1e-6)) AS x, CAST(floor(p_model * 1000 + 0.5) AS INT) AS cell FROM priced),
 {_platt_sql()},
 cells AS (SELECT i, cell, sum(y) AS t, count(*) AS n FROM blocks JOIN r ON r.block <= upto GROUP BY i, cell),
 pre AS (SELECT *, sum(t) OVER w AS st, sum(n) OVER w AS sn, row_number() OVER w AS k FROM cells WINDOW w AS (PARTITION BY i ORDER BY cell)),
 spans AS (SELECT a.i, a.k AS j, b.k AS k, (b.st - a.st + a.t) / (b.sn - a.sn + a.n) AS m FROM pre a JOIN pre b ON a.i = b.i AND a.k <= b.k),
 least_ AS (SELECT i, j, k, min(m) OVER (PARTITION BY i, j ORDER BY k DESC) AS m FROM spans), curve AS (SELECT i, k, max(m) AS v FROM least_ GROUP BY i, k),
 steps AS (SELECT pre.i, cell, v FROM pre JOIN curve USING (i, k)),
 asked AS (SELECT DISTINCT i, cell FROM r JOIN blocks ON block BETWEEN lo AND hi),
 about AS (SELECT q.i, q.cell, max(CASE WHEN s.cell <= q.cell THEN s.cell END) AS c0, min(CASE WHEN s.cell >= q.cell THEN s.cell END) AS c1 FROM asked q JOIN steps s ON s.i = q.i GROUP BY q.i, q.cell),
 found AS (SELECT q.i, q.cell, CASE WHEN c0 IS NULL THEN b.v WHEN c1 IS NULL OR c0 = c1 THEN a.v ELSE a.v + (b.v - a.v) * (q.cell - c0) / (c1 - c0) END AS v FROM about q LEFT JOIN steps a ON a.i = q.i AND a.cell = c0 LEFT JOIN steps b ON b.i = q.i AND b.cell = c1)
 SELECT race, saddle, block, round(p_model, 6) AS p_model, won, round(p_platt, 6) AS p_platt, round(p_isotonic, 6) AS p_isotonic FROM (
 SELECT race, saddle, block, p_model, y AS won, 1 / (1 + exp(-(a + b * x))) AS p_platt, v AS p_isotonic FROM r JOIN blocks ON block BETWEEN lo AND hi JOIN c8 USING (i) JOIN found f ON f.i = blocks.i AND f.cell = r.cell)""")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic and step-curve calibration of each later block of years by all earlier ones."""
    df = priced(spark, sf_dir).withColumn("block", F.year("race_date")).select("race", "saddle", "block", "p_model", F.col("won").cast("double").alias("won"))
    out = models.expanding_calibration(df, "block", [(1995, 1996, 1997), (1997, 1998, 1999), (1999, 2000, 2001)], "p_model", "won")
    return out.select("race", "saddle", "block", r6("p_model"), "won", r6("p_platt"), r6("p_isotonic"))
