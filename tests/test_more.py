"""Hand-made cases of sources, feeds, pages, scalars, tickets, history and models that no SQL covers."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from formline.functions import payout, scalars
from formline.operators import combos, history, joins, models, reports, tickets, windows
from formline.sources import feeds, pages, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# sources
def test_views_and_stored_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{tmp_path}/t/season=1")
    spark.createDataFrame([(2, "b", 0.5)], "k int, v string, late double").write.parquet(f"{tmp_path}/t/season=2")
    assert tables.register_views(spark, str(tmp_path), ["t", "missing"]) == ["t"]
    assert {(r.k, r.late) for r in spark.table("t").collect()} == {(1, None), (2, 0.5)}
    assert tables.view_or_empty(spark, "missing", spark.table("t").schema).count() == 0
    assert tables.view_or_empty(spark, "t", spark.table("t").schema).count() == 2
    assert tables.write_features(spark.table("t"), f"{tmp_path}/f", "feats").count() == spark.table("feats").count() == 2


def test_meetings_become_flat_tables(spark, tmp_path):
    schema = "race_date date, venue string, races array<struct<race_no:int,distance_m:int,runners:array<struct<saddle:int,win_odds:double>>,dividends:array<struct<pool:string,combination:string,payout:double>>>>"
    rows = [(date(2024, 1, 1), "ST", [(1, 1200, [(1, 2.5), (2, 9.0)], [("WIN", "1", 25.0)]), (2, 1400, [(4, 3.0)], [])]), (date(2024, 1, 3), "HV", [(1, 1650, [(7, 5.0)], [("WIN", "7", 50.0)])])]
    meetings = spark.createDataFrame(rows, schema)
    assert tables.write_meetings(meetings, str(tmp_path)) == {"races": 3, "runners": 4, "dividends": 2}
    assert tables.write_meetings(meetings.where("venue = 'HV'"), str(tmp_path))["runners"] == 1  # writes over one day alone
    got = spark.read.parquet(f"{tmp_path}/runners").orderBy("race_date", "race_no", "saddle").collect()
    assert [(r.venue, r.race_no, r.saddle) for r in got] == [("ST", 1, 1), ("ST", 1, 2), ("ST", 2, 4), ("HV", 1, 7)]


def test_reports_and_json(spark, tmp_path):
    df = spark.createDataFrame([("flat", 1.5)], "policy string, roi double")
    tables.write_report(df, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r.csv").first().policy == "flat"
    assert spark.read.parquet(f"{tmp_path}/r.parquet").first().roi == 1.5
    tables.write_json(df, f"{tmp_path}/j")
    assert tables.read_json(spark, f"{tmp_path}/j", "policy string, roi double").first() == ("flat", 1.5)
    assert tables.read_json(spark, f"{tmp_path}/none", "policy string").count() == 0


def test_a_lost_write_leaves_the_table_as_it_was(spark, tmp_path):
    at = f"{tmp_path}/t"
    tables.write_latest(spark, spark.createDataFrame([(1, "a", 1)], "k int, v string, t int"), at, "k", "t")
    spark.createDataFrame([(9, "half", 9)], "k int, v string, t int").write.parquet(f"{at}/v1")
    (tmp_path / "t" / "v1" / "_SUCCESS").unlink()
    assert [r.v for r in tables.read_latest(spark, at).collect()] == ["a"]
    for i in range(3):
        tables.write_latest(spark, spark.createDataFrame([(1, f"b{i}", 2 + i)], "k int, v string, t int"), at, "k", "t")
    assert [r.v for r in tables.read_latest(spark, at).collect()] == ["b2"]
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2


# pages and feeds
def test_sectional_and_comment_pages(spark):
    page = "<table><tr><td>1</td><td>3</td><td>A</td><td>13.41<br>1</td><td>23.10</td><td></td></tr><tr><td>2</td><td>x</td><td>B</td><td>9.9</td></tr></table>"
    got = pages.sectional_rows(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).collect()
    assert [(r.saddle, r.section_index, r.section_time_s) for r in got] == [(3, 1, 13.41), (3, 2, 23.1)]
    page = "<tr><td>1</td><td>3</td><td>A</td><td>Ran on &amp; won.</td></tr><tr><td>2</td><td>4</td><td>B</td><td>--</td></tr>"
    got = pages.comment_rows(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).collect()
    assert [(r.saddle, r.comment) for r in got] == [(3, "Ran on & won.")]


def test_track_work_and_cards(spark):
    doc = {"page": 1, "next": 2, "Records": [{"Horse": " FAST ONE ", "Trainer": "T", "Type": "Gallop", "Workouts": "w"}, {"Horse": "  "}]}
    got = feeds.track_rows(spark.createDataFrame([(json.dumps(doc),), ("{",)], "doc string"), "doc").collect()
    assert [(r.page, r.horse_name, r.kind) for r in got] == [(1, "FAST ONE", "Gallop")]
    runner = {"no": "3", "status": "Declared", "name_en": "A", "horse": {"id": "HK_2020_A001"}, "barrierDrawNumber": "7", "handicapWeight": "126", "currentRating": "bad", "jockey": {"code": "J"}, "trainer": {"code": "T"}}
    card = {"data": {"raceMeetings": [{"date": "2024-01-01", "venueCode": "ST", "races": [{"no": "2", "distance": "1200", "runners": [runner, runner | {"no": "4", "status": "Scratched"}]}]}]}}
    got = feeds.card_rows(spark.createDataFrame([(json.dumps(card),)], "doc string"), "doc").collect()
    assert [(r.race_no, r.saddle, r.draw, r.actual_weight, r.rating) for r in got] == [(2, 3, 7, 126.0, None)]


# scalars
def test_ground_place_course_and_times(spark):
    r = one(
        spark, scalars.going_ord(F.lit(" good "), ("FIRM", "GOOD")).alias("a"), scalars.going_ord(F.lit("x"), ("FIRM",)).alias("b"), scalars.surface_of(F.lit("Sha Tin All Weather Track")).alias("c"),
        scalars.surface_of(F.lit("Happy Valley")).alias("d"), scalars.course_token(F.lit('TURF - "C + 3" COURSE')).alias("e"), scalars.course_token(F.lit("none")).alias("f"),
        scalars.early_position(F.lit("3 4 1")).alias("g"), scalars.last_position(F.lit("3 4 1")).alias("h"), scalars.local_time(F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("i"),
    )
    assert tuple(r)[:8] == (1.0, None, "AWT", "TURF", "C+3", None, 3.0, 1)
    assert r.i == datetime(2024, 1, 1, 8)


# tickets
def test_lookup_takes_the_least_payout_of_whole_numbers(spark):
    rows = [(1, "WIN", " 3", 45.0), (1, "WIN", "3", 40.0), (1, "WIN", "refund", 10.0), (1, "WIN", "4", None), (2, "PLACE", "3", 12.0)]
    div = spark.createDataFrame(rows, "race int, pool string, combination string, payout double")
    assert [tuple(r) for r in tickets.payout_lookup(div, "race", "WIN", "win_div").collect()] == [(1, 3, 40.0)]
    df = spark.createDataFrame([(1, 3), (1, 5), (2, 3)], "race int, saddle int")
    got = tickets.with_payouts(df, div, "race", {"w": "WIN", "p": "PLACE"}).orderBy("race", "saddle").collect()
    assert [(r.w, r.p) for r in got] == [(40.0, None), (None, None), (None, 12.0)]


def test_settlement_without_payouts(spark):
    r = one(spark, payout.place_profit(F.lit(10.0), F.lit(1), F.lit(None).cast("double")).alias("a"), payout.place_profit(F.lit(10.0), F.lit(1), F.lit(15.0)).alias("b"), payout.place_profit(F.lit(10.0), F.lit(0), F.lit(15.0)).alias("c"),
            payout.place_dividend(F.lit(1000.0), F.lit(900.0), F.lit(3), 0.175).alias("d"), payout.place_dividend(F.lit(1000.0), F.lit(0.0), F.lit(3), 0.175).alias("e"))
    assert tuple(r) == (0.0, 5.0, -10.0, 10.0, 0.0)


def test_pairs_of_full_choices_with_payouts_alone(spark):
    rows = [(g, s, 1.0 / s) for g in (1, 2, 3) for s in range(1, (5 if g < 3 else 4))]
    paid = spark.createDataFrame([(1, "4,2", 100.0), (1, "2", 1.0), (1, "1,x", 1.0), (3, "1,2", 30.0)], "race int, combination string, payout double").withColumn("pool", F.lit("QIN"))
    got = tickets.top_pairs(spark.createDataFrame(rows, "race int, saddle int, p double"), "race", "saddle", [F.desc("p"), "saddle"], 4, tickets.pair_payouts(paid, "race", "QIN"))
    assert {(r.race, r.i, r.j) for r in got.where("payout is not null").collect()} == {(1, 2, 4)}
    assert got.count() == 6
    r = tickets.ticket_report(got, "race").first()
    assert (r.n_groups, r.tickets, r.wins, r.staked, r.returned, r.roi) == (1, 6, 1, 60.0, 100.0, pytest.approx(2 / 3))


def test_a_threshold_needs_enough_bets(spark):
    rows = [("a", 0.1, 1, 5.0)] * 3 + [("a", 0.3, 0, -10.0)] + [("b", 0.1, 1, 5.0), ("b", 0.05, 0, -10.0)]
    df = spark.createDataFrame(rows, "fold string, edge double, won int, profit double").withColumn("stake", F.lit(10.0))
    got = tickets.locked_threshold(df, F.col("fold") == "a", "edge", [0.0, 0.1, 0.2], 2, "stake", "profit", "won").collect()
    assert [(r.threshold, r.bets) for r in got] == [(0.0, 2)]  # 0.0 and 0.1 tie, the lower wins; 0.2 has one bet
    assert tickets.locked_threshold(df, F.col("fold") == "a", "edge", [0.0], 99, "stake", "profit", "won").count() == 0
    report = spark.createDataFrame([(0.1, 5, 0.2), (0.2, 5, 0.2), (0.3, 1, 9.0)], "threshold double, bets int, roi double")
    assert reports.chosen_threshold(report, 2).first().threshold == 0.1


@pytest.mark.parametrize("n", [1, 2, 3])
def test_places_of_small_fields(spark, n):
    p = [1.0] if n == 1 else [0.7, 0.3] if n == 2 else [0.5, 0.3, 0.2]
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(p)], "race int, saddle int, p double")
    got = combos.place_chances(df, "race", "saddle", "p").collect()
    assert [r.top_k for r in got] == pytest.approx([1.0] * n)
    assert combos.pair_chances(df, "race", "saddle", ["p"]).count() == n * (n - 1) // 2
    assert [r.both_placed for r in combos.pair_place_chances(df, "race", "saddle", "p").collect()] == pytest.approx([1.0] * (n * (n - 1) // 2))


# history
def test_running_style_needs_numbers(spark):
    rows = [(1, 1, "1 2 3 4", 10), (1, 2, "9 9 9 9", 10), (1, 3, "5 x 2 2", 10), (1, 4, None, 10), (1, 5, "4 4 4 4", 10), (1, 6, "7 1", 10)]
    got = history.running_style(spark.createDataFrame(rows, "horse int, ord int, pos string, field int"), "pos", "field", "horse", "ord").orderBy("ord").collect()
    assert [r.style for r in got] == ["E", "S", None, None, "P", None]
    assert [r.habitual_early_pct_3 for r in got] == pytest.approx([None, 0.1, 0.5, 0.5, 0.9, 0.4])


def test_median_of_earlier_days(spark):
    rows = [("2024-01-01", v) for v in (1.0, 2.0, 9.0)] + [("2024-01-02", None), ("2024-01-02", 4.0), ("2024-01-03", None)]
    df = spark.createDataFrame(rows, "day string, v double")
    got = {r.day: r.f for r in history.median_so_far(df, "day", "v", "f", 1.0, least=3).where("v is null").collect()}
    assert got == {"2024-01-02": 2.0, "2024-01-03": 3.0}
    assert [r.f for r in history.median_so_far(df, "day", "v", "f", 1.0, least=4).where("v is null and day = '2024-01-02'").collect()] == [0.0]
    assert history.median_so_far(df.where("v is null"), "day", "v", "f", 1.0).where("f <> 0").count() == 0


def test_intervals_by_one_sort_equal_those_by_pairs(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (1, 20), (2, 5), (1, 40)], "u int, t int").withColumn("ts", F.timestamp_seconds(F.col("t") * 86400)).withColumn("id", F.monotonically_increasing_id())
    right = spark.createDataFrame([(1, t, float(t)) for t in (1, 9, 10, 11, 19, 20, 21, 39, 40, 41)] + [(2, 5, 1.0), (3, 1, 1.0)], "u int, t int, v double").select("u", F.timestamp_seconds(F.col("t") * 86400).alias("rts"), "v")
    aggs = [F.count("r_v").alias("n"), F.max("r_v").alias("m")]
    spans = windows.lagged(left, "u", ["ts", "id"], ["ts"]).withColumn("lo", F.coalesce("prev_ts", F.lit(datetime(1970, 1, 1))))
    want = joins.interval_agg_join(spans, right, "u", "lo", "ts", "rts", ["id"], aggs, 15).orderBy("id").collect()
    assert joins.between_agg_join(left, right, "u", "ts", "rts", ["id"], aggs, 15).orderBy("id").collect() == want


def test_filling_dates_from_another_table(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, d string")
    got = joins.fill_from(df, spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, d string"), ["k"], "d").orderBy("k").collect()
    assert [r.d for r in got] == ["a", "x", None]


# models
@pytest.fixture(scope="module")
def panel(spark):
    rows = [(g, i, float((g * 3 + i) % 7), float("nan") if (g + i) % 11 == 0 else float(i), "ab"[i % 2] if i else None, 1.0 if i == (g % 3) else 0.0) for g in range(60) for i in range(4)]
    return spark.createDataFrame(rows, "g int, i int, a double, b double, c string, won double")


def test_a_missing_number_does_not_stop_the_fit(panel):
    m = models.fit_grouped_logit(panel, ["g"], "won", ["a", "b"])
    assert all(abs(x) < 100 for x in m.beta)
    assert 0 <= models.canary_ratio(m, "a") <= 2
    assert models.score_grouped(panel, m, ["g"]).where("p_win is null or isnan(p_win)").count() == 0


def test_pointwise_models_and_their_storage(spark, panel, tmp_path):
    df = panel.withColumn("b", F.nanvl("b", F.lit(None)))
    for pipe in (models.pointwise_mlp(["a", "b"]), models.pointwise_logistic(["a", "b"], ["c"])):
        fitted = pipe.fit(df.fillna("none", ["c"]))
        scored = models.scored_by(fitted, df.fillna("new", ["c"]), ["g"])
        sums = scored.groupBy("g").agg(F.sum("p_win").alias("s")).agg(F.min("s"), F.max("s")).first()
        assert tuple(sums) == pytest.approx((1.0, 1.0))
    models.save_model(fitted, str(tmp_path), ["a", "b", "c"], "digest")
    again, features = models.load_model(str(tmp_path))
    assert features == ["a", "b", "c"]
    assert models.scored_by(again, df.fillna("new", ["c"]), ["g"]).exceptAll(scored).count() == 0


def test_months_walk_forward(spark, panel):
    """The walk over months: each month is scored by a pipeline learnt from all earlier ones."""
    df = panel.withColumn("month", F.floor(F.col("g") / 20).cast("int")).fillna(0.0, ["b"]).fillna("none", ["c"])
    pipe = models.pointwise_logistic(["a", "b"], ["c"])
    got = models.walk_forward(df, "month", pipe.fit, lambda now, m: models.scored_by(m, now, ["g"]), train_only=1)
    assert sorted(r.month for r in got.select("month").distinct().collect()) == [1, 2]


def test_scores_of_one_value_have_an_auc_of_a_half(spark):
    df = spark.createDataFrame([("a", 0.5, i % 2) for i in range(10)] + [("b", i / 10, int(i > 4)) for i in range(10)] + [("c", 0.1, 0)], "k string, p double, y int")
    assert {r.k: r.auc for r in reports.auc(df, "p", "y", ["k"]).collect()} == {"a": 0.5, "b": 1.0, "c": None}


@pytest.mark.parametrize("n", [1, 3, 10, 50])
def test_tiles_by_ranges_are_tiles(spark, n):
    rows = [(g, i * 7 % 3, i * 11 % 23, i) for g in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v int, t int, s int")
    want = F.ntile(4).over(windows.Window.partitionBy("g").orderBy("v", "t", "s"))
    assert windows.ntile_ranged(df, "g", "v", "t", "s", 4, "tile", ranges=3).withColumn("want", want).where("tile <> want").count() == 0


def test_named_sets_of_columns():
    assert history.drop_sets(["a", "b", "c"], {"A": ["b"], "B": []}) == {"A": ["a", "c"], "B": ["a", "b", "c"]}
    with pytest.raises(ValueError, match="not there"):
        history.drop_sets(["a"], {"A": ["z"]})


def test_fills_from_a_source_go_to_the_tasks_asked(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", None), (4, None, None)], "id int, k string, v int")
    source = spark.createDataFrame([("a", 9), ("a", 7), ("b", 1), (None, 3)], "k string, v int")
    got = joins.fill_from(df, source, ["k"], "v", tasks=7)
    assert {r.id: r.v for r in got.collect()} == {1: 7, 2: 5, 3: None, 4: None}
    assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan
