"""Registered queries: training sets and what their joins lose, listings, classes by name, side events' places, rebates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import scalars
from formline.operators import assembly, joins, reports, staking, windows
from formline.plans.betting import BANKS, EV, EXCLUSIVE, GRID, GRID_SQL, settled
from formline.plans.features import HORSE, KEY, W, r6
from formline.plans.spine import priced, runners, table, tasks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Cards known the day before, without draw 4 and with entries that never ran; jockeys' records; trainers' notes, some of them late.
PARTS_SQL = W + """, card AS (SELECT race, CASE WHEN draw = 2 THEN saddle + 100 ELSE saddle END AS saddle, weight AS card_weight FROM runners WHERE draw <> 4),
 record AS (SELECT jockey, count(*) AS rides, avg(won) AS strike FROM runners WHERE race_date < DATE '1998-01-01' GROUP BY jockey),
 note AS (SELECT race, trainer, min(tax) AS note, max(race_date + CASE WHEN draw = 3 THEN 1 ELSE 0 END) AS noted, count(*) AS n FROM runners GROUP BY race, trainer),
 j AS (SELECT r.*, c.card_weight, c.race IS NOT NULL AS in_card, rides, strike, k.jockey IS NOT NULL AS in_record, note, noted FROM runners r LEFT JOIN card c USING (race, saddle) LEFT JOIN record k ON k.jockey = r.jockey LEFT JOIN note o ON o.race = r.race AND o.trainer = r.trainer)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[assembly.Part]]:
    df = runners(spark, sf_dir)
    base = df.select("race", "saddle", "race_date", "jockey", "trainer", "won")
    card = df.where("draw <> 4").select("race", F.when(F.col("draw") == 2, F.col("saddle") + 100).otherwise(F.col("saddle")).alias("saddle"), F.col("weight").alias("card_weight"), F.date_sub("race_date", 1).alias("printed"))
    record = df.where("race_date < '1998-01-01'").groupBy("jockey").agg(F.count(F.lit(1)).alias("rides"), F.avg("won").alias("strike"))
    note = df.groupBy("race", "trainer").agg(F.min("tax").alias("note"), F.max(F.date_add("race_date", (F.col("draw") == 3).cast("int"))).alias("noted"))
    return base, [
        assembly.Part("card", card, ["race", "saddle"], ["card_weight"], "printed"),
        assembly.Part("record", record, ["jockey"], ["rides", "strike"]),
        assembly.Part("note", note, ["race", "trainer"], ["note"], "noted"),
    ]


@query(PARTS_SQL + " SELECT race, saddle, won, card_weight, rides, round(strike, 6) AS strike, note FROM j")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the columns of three feature tables, a row per runner whatever the tables lack."""
    base, parts = _parts(spark, sf_dir)
    rows = assembly.training_rows(assembly.matched(base, ["race", "saddle"], "race_date", parts, tasks(spark, sf_dir)), base, parts)
    return rows.select("race", "saddle", "won", "card_weight", "rides", r6("strike"), "note")


@query(PARTS_SQL + """ SELECT 'card' AS part, CAST(count(*) FILTER (in_card) AS BIGINT) AS matched, count(*) FILTER (NOT in_card) AS missing, 0::BIGINT AS repeated, 0::BIGINT AS late, (SELECT count(*) FROM card c ANTI JOIN runners r ON c.race = r.race AND c.saddle = r.saddle) AS lost FROM j
 UNION ALL SELECT 'record', count(*) FILTER (in_record), count(*) FILTER (NOT in_record), 0, 0, (SELECT count(*) FROM record k ANTI JOIN runners r ON k.jockey = r.jockey) FROM j
 UNION ALL SELECT 'note', count(*) FILTER (note IS NOT NULL), count(*) FILTER (note IS NULL), 0, count(*) FILTER (noted > race_date), 0 FROM j""")
def training_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the joins of ``training_set`` match, miss, repeat, bring too late and lose; as it stands, its late notes would be refused."""
    base, parts = _parts(spark, sf_dir)
    return assembly.report(assembly.matched(base, ["race", "saddle"], "race_date", parts, tasks(spark, sf_dir)), parts)


@query(EV + """, g AS (SELECT *, round(p_model / p_market, 9) AS ratio FROM e), b AS (SELECT *, CASE WHEN ratio >= 2.5 THEN 7 WHEN ratio >= 1.6 THEN 6 WHEN ratio >= 1.25 THEN 5 WHEN ratio >= 1.05 THEN 4 WHEN ratio >= 0.95 THEN 3 WHEN ratio >= 0.8 THEN 2 WHEN ratio >= 0.6 THEN 1 WHEN ratio >= 0 THEN 0 END AS bucket FROM g),
 k AS (SELECT bucket, race, sum(profit) AS num, sum(stake) AS den FROM b GROUP BY bucket, race), m AS (SELECT *, md5('0-' || q || '-' || race) AS h FROM k, range(0, 100) g(q)),
 u AS (SELECT bucket, q * 8 + j AS r, num, den, ('0x' || substr(h, j * 4 + 1, 4))::INT AS u FROM m, range(0, 8) g(j)),
 s AS (SELECT bucket, r, sum(w * num) / sum(w * den) AS x FROM (SELECT *, (u >= 24109)::INT + (u >= 48218)::INT + (u >= 60273)::INT + (u >= 64291)::INT + (u >= 65296)::INT + (u >= 65497)::INT + (u >= 65530)::INT AS w FROM u) GROUP BY bucket, r HAVING sum(w * den) > 0),
 ci AS (SELECT bucket, round(quantile_cont(x, 0.05), 6) AS lo, round(quantile_cont(x, 0.95), 6) AS hi FROM s GROUP BY bucket),
 t AS (SELECT bucket, count(*) AS n, round(avg(won), 6) AS actual, round(avg(p_model), 6) AS model, round(avg(p_market), 6) AS market, round(sum(profit) / sum(stake), 6) AS roi FROM b GROUP BY bucket) SELECT t.*, lo, hi FROM t LEFT JOIN ci USING (bucket)""")
def edge_ratio_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the model's chance over the market's, in eight bins: how often entries won, both chances, the return and its interval over resampled races."""
    df = settled(priced(spark, sf_dir)).withColumn("ratio", F.round(F.col("p_model") / F.col("p_market"), 9))
    df = df.withColumn("bucket", reports.bucket(F.col("ratio"), [0, 0.6, 0.8, 0.95, 1.05, 1.25, 1.6, 2.5]))
    aggs = [F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(a) for c, a in (("won", "actual"), ("p_model", "model"), ("p_market", "market"))), F.round(F.sum("profit") / F.sum("stake"), 6).alias("roi")]
    span = reports.block_bootstrap(df, "race", "profit", "stake", 800, 0, ["bucket"], 0.05, 0.95)
    return df.groupBy("bucket").agg(*aggs).join(span.select("bucket", r6("lo"), r6("hi")), "bucket", "left")


#: Classes by name: numbered ones, group and griffin races, and races for an age, whose class is unknown.
GRADES_SQL = W + """, named AS (SELECT *, CASE WHEN race % 11 = 0 THEN NULL WHEN race % 7 = 0 THEN '4 Year Olds' WHEN race % 5 = 0 THEN 'Group ' || (race % 3 + 1) WHEN race % 13 = 0 THEN 'Griffin Race' ELSE 'Class ' || race_class END AS grade FROM runners),
 graded AS (SELECT *, CASE WHEN grade LIKE 'Class%' THEN race_class::DOUBLE WHEN grade LIKE 'Group%' THEN 0.5 WHEN grade LIKE 'Griffin%' THEN 4.5 END AS ord_class FROM named)"""


@query(GRADES_SQL + f""", l AS (SELECT *, lag(ord_class) OVER ({HORSE}) AS prev FROM graded) SELECT race, saddle, ord_class AS class_ord, CASE WHEN ord_class > prev THEN 1 ELSE 0 END AS is_drop FROM l""")
def class_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's class as a number, lower for better company, and whether it is a drop from the run before; an unknown class never is."""
    race = F.col("race")
    grade = F.when(race % 11 == 0, None).when(race % 7 == 0, "4 Year Olds").when(race % 5 == 0, F.concat(F.lit("Group "), race % 3 + 1)).when(race % 13 == 0, "Griffin Race").otherwise(F.concat(F.lit("Class "), F.col("race_class")))
    df = runners(spark, sf_dir).withColumn("class_ord", scalars.class_ord(grade))
    df = windows.lagged(df, "horse", ["ord", "saddle"], ["class_ord"])
    return df.select(*KEY, "class_ord", F.coalesce((F.col("class_ord") > F.col("prev_class_ord")).cast("int"), F.lit(0)).alias("is_drop"))


@query(W + " SELECT DISTINCT 'horse' AS role, CAST(horse AS VARCHAR) AS code FROM runners UNION ALL SELECT DISTINCT 'jockey', CAST(jockey AS VARCHAR) FROM runners UNION ALL SELECT DISTINCT 'trainer', trainer FROM runners UNION ALL SELECT DISTINCT 'race', race_date || '-' || race FROM runners")
def stored_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that stored results name, once each: horses, jockeys, trainers and races, from one pass."""
    df = runners(spark, sf_dir)
    named = {"horse": F.col("horse").cast("string"), "jockey": F.col("jockey").cast("string"), "trainer": F.col("trainer"), "race": scalars.key_string(F.col("race_date"), F.col("race"))}
    cells = F.array(*(F.struct(F.lit(role).alias("role"), code.alias("code")) for role, code in named.items()))
    return df.select(F.explode(cells).alias("x")).select("x.*").where("code IS NOT NULL").distinct()


@query(W + " SELECT season, count(DISTINCT race) AS races, count(DISTINCT race_date) AS days, count(*) AS runners, min(race_date) AS first_day, max(race_date) AS last_day FROM runners GROUP BY season")
def season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per season its races, meeting days, runners, first and last day."""
    return runners(spark, sf_dir).groupBy("season").agg(F.countDistinct("race").alias("races"), F.countDistinct("race_date").alias("days"), F.count(F.lit(1)).alias("runners"), F.min("race_date").alias("first_day"), F.max("race_date").alias("last_day"))


@query(W + """, l AS (SELECT race, saddle, race_date, CASE draw % 5 WHEN 0 THEN 'Sha Tin Turf' WHEN 1 THEN 'Happy Valley (turf)' WHEN 2 THEN 'SHA TIN All Weather' WHEN 3 THEN 'Conghua AWT' ELSE NULL END AS location FROM runners)
 SELECT race, saddle, CAST(isodow(race_date) - 1 AS INT) AS day_of_week, CAST(month(race_date) AS INT) AS month, CASE WHEN lower(location) LIKE '%happy valley%' THEN 'HV' WHEN lower(location) LIKE '%sha tin%' THEN 'ST' END AS venue,
 CASE WHEN upper(location) LIKE '%ALL WEATHER%' OR upper(location) LIKE '%AWT%' THEN 'ALL WEATHER TRACK' WHEN upper(location) LIKE '%TURF%' THEN 'TURF' END AS track,
 CASE WHEN location IS NULL THEN NULL WHEN upper(location) LIKE '%TURF%' THEN 1 ELSE 0 END AS is_turf FROM l""")
def day_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's parts, and the venue, track and ground that a location's words name."""
    d = F.pmod("draw", F.lit(5))
    place = F.when(d == 0, "Sha Tin Turf").when(d == 1, "Happy Valley (turf)").when(d == 2, "SHA TIN All Weather").when(d == 3, "Conghua AWT")
    df = runners(spark, sf_dir).withColumn("location", place)
    loc = F.col("location")
    return df.select(*KEY, F.weekday("race_date").alias("day_of_week"), F.month("race_date").alias("month"), scalars.venue_of(loc).alias("venue"), scalars.track_of(loc).alias("track"), scalars.is_turf(loc).alias("is_turf"))


#: Side events in batches of a day and a tenth of the entities; positions as text, the last of them the final one.
TRIALS_SQL = """WITH t AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d, user_id % 10 AS batch, (event_id % 7 + 1) || ' ' || (event_id % 5 + 1) || ' ' || CASE WHEN event_id % 19 = 0 THEN 'x' ELSE CAST(event_id % 4 + 1 AS VARCHAR) END AS positions FROM events WHERE event_type = 'signup'),
 r AS (SELECT *, TRY_CAST(split_part(positions, ' ', 3) AS INT) AS last_pos, count(*) OVER (PARTITION BY d, batch) AS n FROM t), target AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"""


@query(TRIALS_SQL + """ SELECT a.event_id, s.last_pos AS last_trial_pos, round(s.last_pos / CAST(s.n AS DOUBLE), 6) AS last_trial_pos_ratio, date_diff('day', s.d, CAST(a.ts AS DATE)) AS days_since_trial FROM target a ASOF LEFT JOIN r s ON a.user_id = s.user_id AND a.ts >= s.ts""")
def trial_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final position of an entity's latest side event, over its batch's size, and the days since."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    last = F.when(i % 19 == 0, "x").otherwise((i % 4 + 1).cast("string"))
    side = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("trial_ts"), F.to_date("ts").alias("d"), F.pmod("user_id", F.lit(10)).alias("batch"), F.concat_ws(" ", (i % 7 + 1).cast("string"), (i % 5 + 1).cast("string"), last).alias("positions"))
    side = windows.position_ratio(side, ["d", "batch"], "positions", "last_trial_pos", "last_trial_pos_ratio")
    out = joins.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), side, "user_id", "ts", "trial_ts", ["last_trial_pos", "last_trial_pos_ratio"])
    return out.select("event_id", "last_trial_pos", r6("last_trial_pos_ratio"), F.datediff("ts", "asof_trial_ts").alias("days_since_trial"))


@query(EXCLUSIVE + f""", k AS (SELECT race, race_date, win_odds, won, fraction AS x, CASE WHEN p_blend * win_odds > 1 THEN least(1.0, (p_blend * win_odds - 1) / (win_odds - 1)) ELSE 0.0 END AS k FROM frac WHERE p_blend > 0 AND win_odds > 1 AND p_blend * win_odds - 1 >= 0.05),
 c AS (SELECT k.*, policy, bank, CASE method WHEN 'flat' THEN size / bank WHEN 'fraction' THEN size WHEN 'kelly' THEN size * k ELSE size * x END AS s FROM k, (VALUES {GRID_SQL}) g(policy, method, size), (VALUES {", ".join(f"({b}::DOUBLE)" for b in BANKS)}) b(bank)),
 rt AS (SELECT *, sum(s) OVER (PARTITION BY policy, bank, race) AS t FROM c), rc AS (SELECT * REPLACE (CASE WHEN t > 0.10 THEN s * 0.10 / t ELSE s END AS s) FROM rt),
 d AS (SELECT *, sum(s) OVER (PARTITION BY policy, bank, race_date) AS td FROM rc), d1 AS (SELECT *, round(CASE WHEN td > 0.25 THEN s * 0.25 / td ELSE s END * bank, 6) AS desired FROM d),
 z AS (SELECT *, CASE WHEN desired >= 10 AND floor(desired / 10 + 0.5) * 10 >= 10 THEN floor(desired / 10 + 0.5) * 10 ELSE 0.0 END AS stake FROM d1),
 y AS (SELECT policy, bank, race_date, sum(CASE WHEN won = 1 THEN 0.0 ELSE stake END) AS losing FROM z WHERE stake > 0 GROUP BY ALL)
 SELECT policy, bank, count(*) AS days, CAST(sum(CASE WHEN losing > 500 THEN 1 ELSE 0 END) AS BIGINT) AS rebate_days, round(sum(0.1 * greatest(losing - 500, 0.0)), 2) AS credit FROM y GROUP BY policy, bank""")
def rebate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and bank the days with bets, those whose losing turnover passes the threshold, and the credit."""
    out = staking.rebate_days(priced(spark, sf_dir), ["race"], "race_date", "p_blend", "win_odds", "won", "saddle", GRID, BANKS, 0.10, 500.0)
    return out.select("policy", "bank", "days", "rebate_days", F.round("credit", 2).alias("credit"))
