"""Models, sources, pages, feeds and streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from formline.operators import models, quality, reports, staking
from formline.plans.spine import priced
from formline.sources import feeds, pages, tables
from formline.streaming import snapshots


def test_grouped_logit_recovers_signs(spark):
    rows = [(g, i, float(i % 3), float((g * 7 + i) % 5), 1 if i == (g % 4 != 0) * 2 else 0) for g in range(300) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, i int, a double, noise double, won int")
    m = models.fit_grouped_logit(df, ["g"], "won", ["a", "noise"])
    assert m.beta[0] > 0.2
    assert abs(m.t_values[0]) > abs(m.t_values[1])
    scored = models.score_grouped(df, m, ["g"])
    assert scored.groupBy("g").agg(F.sum("p_win").alias("s")).agg(F.min("s"), F.max("s")).first() == pytest.approx((1, 1))


def test_grouped_logit_slope_vanishes(spark):
    """At the optimum chances and outcomes agree on every feature's sum."""
    df = priced(spark, "/root/testdata/sf0.001").select("race", "won", "tax", "weight")
    m = models.fit_grouped_logit(df, ["race"], "won", ["tax", "weight"], l2=1e-9)
    s = models.score_grouped(df, m, ["race"]).agg(F.sum((F.col("won") - F.col("p_win")) * F.col("tax")), F.sum((F.col("won") - F.col("p_win")) * F.col("weight"))).first()
    assert s == pytest.approx((0, 0), abs=1e-3)


def test_sweep_properties(spark):
    grid = staking.policy_grid()
    got = staking.stake_sweep(priced(spark, "/root/testdata/sf0.001"), ["race"], "race_date", "p_blend", "win_odds", "won", "saddle", grid, (1_000.0, 100_000.0)).collect()
    assert len(got) == len(grid) * 2
    lost = {(r.policy, r.bank): r.lost_to_rounding for r in got}
    assert lost["kelly_0.05", 1_000.0] >= lost["kelly_0.05", 100_000.0]
    assert all(r.staked % 10 == 0 for r in got)


def test_temperature_flattens_overconfidence(spark):
    rows = [(g, i, 0.9 if i == 0 else 0.1, int(i == g % 2)) for g in range(50) for i in range(2)]
    assert models.fit_temperature(spark.createDataFrame(rows, "g int, i int, p double, won int"), ["g"], "p", "won") > 2


def test_tables_round_trip(spark, tmp_path):
    schema = quality.typed([("k", "int"), ("v", "string"), ("late", "double")])
    assert tables.read_table(spark, str(tmp_path / "none"), schema).count() == 0
    df = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (2, "b", date(2024, 1, 2))], "k int, v string, d date")
    tables.write_partitioned(df, str(tmp_path / "t"), ["d"])
    tables.write_partitioned(df.where("k = 2").withColumn("v", F.lit("c")), str(tmp_path / "t"), ["d"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}
    got = tables.read_table(spark, str(tmp_path / "t"), schema)
    assert got.columns == ["k", "v", "late"]
    assert got.where("late is not null").count() == 0
    assert tables.fingerprint(df).first() == tables.fingerprint(df.orderBy(F.desc("k"))).first()


def test_ledger_skips_what_is_stored(spark, tmp_path):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    path = str(tmp_path / "ledger")
    assert tables.ingest_new(spark, urls, path, "url").count() == 2
    tables.record(spark, urls.where("url = 'a'"), path, "url", "page")
    assert [r.url for r in tables.ingest_new(spark, urls, path, "url").collect()] == ["b"]


def test_latest_row_wins(spark, tmp_path):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, t int")
    tables.write_latest(spark, old, str(tmp_path / "p"), "k", "t")
    tables.write_latest(spark, spark.createDataFrame([(1, "z", 2)], "k int, v string, t int"), str(tmp_path / "p"), "k", "t")
    assert {(r.k, r.v) for r in tables.read_latest(spark, str(tmp_path / "p")).collect()} == {(1, "z"), (2, "y")}


def test_csv_separator_is_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;x,y\n")
    assert tables.read_csv_auto(spark, str(tmp_path / "a.csv")).first().v == "x,y"


PAGE = """<table><tr><th>Pla.</th></tr><tr><td>1</td><td>3</td><td>FAST&nbsp;ONE</td><td>7</td><td>x</td><td>1:38.85</td><td>4.5</td></tr></table>
<table><tr><td>WIN</td><td>3</td><td>45.00</td></tr><tr><td></td><td>4</td><td>1,020.5</td></tr></table>"""


def test_result_pages(spark):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    r = pages.result_rows(df, "html", ["id"]).collect()
    assert [(x.finish_pos, x.saddle, x.horse_name, x.draw, x.time_s, x.win_odds) for x in r] == [(1, 3, "FAST ONE", 7, 98.85, 4.5)]
    d = pages.dividend_rows(df, "html", ["id"]).orderBy("dividend").collect()
    assert [(x.pool, x.combination, x.dividend) for x in d] == [("WIN", "3", 45.0), ("WIN", "4", 1020.5)]


def test_profile_trial_and_calendar_pages(spark):
    html = "<table><tr><td>Age</td><td>:</td><td>5</td></tr><tr><td>Age</td><td>:</td><td>6</td></tr><tr><td>Sex :</td><td>Mare</td></tr></table>"
    got = pages.profile_pairs(spark.createDataFrame([(1, html)], "id int, html string"), "html", ["id"]).first().profile
    assert got == {"Age": "5", "Sex": "Mare"}
    html = "<table><tr><td>Batch 2 - 1000m</td></tr><tr><td>A</td><td>3</td><td>58.5</td><td>Passed</td><td>ok</td></tr></table>"
    r = pages.trial_rows(spark.createDataFrame([(1, html)], "id int, html string"), "html", ["id"]).first()
    assert (r.batch, r.horse_name, r.time_s) == (2, "A", 58.5)
    cal = spark.createDataFrame([(2024, 5, "<td>4 <b>ST</b></td><td>5</td><td>8 HV night</td>")], "y int, m int, html string")
    assert {(r.race_date.day, r.venue) for r in pages.calendar_days(cal, "html", "y", "m").collect()} == {(4, "ST"), (8, "HV")}


ODDS = {"data": {"raceMeetings": [{"date": "2024-01-01", "venueCode": "ST", "pmPools": [
    {"id": "1", "oddsType": "WIN", "lastUpdateTime": "t1", "leg": {"number": 1, "races": [3]}, "oddsNodes": [{"combString": "01", "oddsValue": "4.5"}, {"combString": "02", "oddsValue": "---"}]}]}]}}


def test_feeds(spark):
    df = spark.createDataFrame([(json.dumps(ODDS),), ("{broken",)], "doc string")
    got = feeds.odds_rows(df, "doc").orderBy("comb").collect()
    assert [(r.race_no, r.pool_type, r.comb, r.odds) for r in got] == [(3, "WIN", "01", 4.5), (3, "WIN", "02", None)]
    hol = {"vcalendar": [{"vevent": [{"dtstart": ["20240101"], "summary": "New Year"}, {"dtstart": ["bad"], "summary": "x"}]}]}
    got = feeds.holiday_rows(spark.createDataFrame([("﻿" + json.dumps(hol),)], "doc string"), "doc").collect()
    assert [(r.date, r.name) for r in got] == [(date(2024, 1, 1), "New Year")]
    lines = spark.createDataFrame([("2024,1,5,18.5",), ("2024,1,6,***",), ("Year,Month",)], "value string")
    assert [(r.date.day, r["mean"]) for r in feeds.climate_table(feeds.climate_rows(lines, F.lit("mean"))).collect()] == [(5, 18.5)]
    hist = spark.createDataFrame([(1, '{"1":{"2":"9.9"}}'), (2, '{"1":{"2":"8.0"}}')], "t int, doc string")
    assert feeds.last_prices(hist, "doc", "t").first() == (1, 2, 8.0)


def test_stream_keeps_the_first_snapshot(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, i), "t1" if i < 3 else "t2", json.dumps(ODDS).replace('"t1"', '"t1"' if i < 3 else '"t2"')) for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, doc string")
    df.write.parquet(str(tmp_path / "in"))
    stream = snapshots.read_snapshots(spark, str(tmp_path / "in"), "ts timestamp, k string, doc string")
    q = snapshots.append_parquet(snapshots.pool_prices(stream, "doc", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4  # two pool updates of two nodes each
    batch = snapshots.pool_prices(df, "doc", "ts")
    assert got.select("race_no", "comb").exceptAll(batch.select("race_no", "comb")).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 1), 1)], "known date, event date, won int")
    with pytest.raises(ValueError, match="outcome columns"):
        quality.guard_columns(df, ["won"])
    with pytest.raises(ValueError, match="lies after"):
        quality.assert_not_after(df, "known", "event")
    reg = [quality.Feature("won", "int", "label"), quality.Feature("x", "double", "fundamental", "form"), quality.Feature("m", "double", "market", "form")]
    assert quality.conform(df, reg, "v1").columns == ["won", "x", "m", "feature_version"]
    assert quality.select_features(reg, groups=["form"]) == ["x"]


def test_walk_forward_scores_all_seasons_but_the_first(spark):
    from formline.plans import audits, spine

    sf = "/root/testdata/sf0.001"
    seasons = sorted(r.season for r in spine.runners(spark, sf).select("season").distinct().collect())
    assert sorted(r.season for r in audits.grouped_logit_walk_forward(spark, sf).select("season").distinct().collect()) == seasons[1:]
    assert [r.season for r in audits._logit(spark, sf, last=1).select("season").distinct().collect()] == seasons[-1:]


def test_gap_days_of_all_orders(spark, tmp_path):
    from formline.plans import audits

    days = [(5, "2020-01-01"), (1, "2020-01-02"), (2, "2020-01-05"), (3, "2020-01-05"), (10, "2020-01-09"), (11, "2020-01-10")]
    spark.createDataFrame(days, "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(str(r.day) for r in audits.gap_days(spark, str(tmp_path)).collect())
    assert got == [f"2020-01-0{d}" for d in (3, 4, 6, 7, 8)]


def test_bootstrap_brackets_the_point(spark):
    rows = [(b, float(b % 5) - 1.5, 1.0) for b in range(40)]
    df = spark.createDataFrame(rows, "b int, num double, den double")
    r = reports.block_bootstrap(df, "b", "num", "den", 100).first()
    assert r.lo <= 0.5 <= r.hi


def test_poisson_counts_equal_the_md5_of_each_text():
    import hashlib

    from formline.operators import draws

    blocks = [None, "", "7", "123456789", "é", "x" * 45, "x" * 80, *map(str, range(990, 1010))]
    got = draws.poisson_counts(blocks, 3, 1001)
    for i, b in enumerate(blocks):
        for r in (0, 7, 8, 79, 80, 799, 800, 1000):
            text = f"3-{r // 8}" + ("" if b is None else f"-{b}")
            u = int(hashlib.md5(text.encode()).hexdigest()[r % 8 * 4 : r % 8 * 4 + 4], 16)
            assert got[i, r] == sum(u >= t for t in draws.POISSON)


def test_bootstrap_draws_blocks_in_batches_and_not_in_rows(spark):
    rows = [(k, b, float(b % 5) - 1.5 if k != "c" else None, 1.0) for b in range(3000) for k in ("a", None, "c")]
    df = spark.createDataFrame(rows, "k string, b int, num double, den double")
    out = reports.block_bootstrap(df, "b", "num", "den", 100, 0, ["k"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # a row per block and replicate before
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"a", None, "c"} and got["a"].lo == pytest.approx(got[None].lo) and got["c"].lo is None
    assert got["a"].lo < 0.5 < got["a"].hi


def test_medians_are_exact_in_long_columns(spark):
    from formline.operators import history

    n = 1_000_001
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) + F.col("id") / n).alias("v"), (F.col("id") % 2).alias("k"))
    want = {k: vs[(len(vs) - 1) // 2] for k, vs in ((k, sorted(r.v for r in df.where(F.col("k") == k).collect())) for k in (0, 1))}
    assert {r.k: r.m for r in reports.medians(df, {"m": F.col("v")}, ["k"]).collect()} == want
    every = sorted(r.v for r in df.select("v").collect())
    rows = df.select(F.lit(2.0).alias("p"), F.lit(1).alias("j"), "v").union(spark.createDataFrame([(2.0, 1, None), (1.0, 1, 5.0)], "p double, j int, v double"))
    filled = history.clean_prices(rows, "p", ["j"], ["v"])
    assert filled.count() == n + 1 and filled.where(F.col("v") == every[(n - 1) // 2]).count() == 2
    assert reports.medians(df.where("k > 5"), {"m": F.col("v")}).first().m is None


@pytest.mark.parametrize("name", ["stake_sweep", "rebate_days", "quarter_stake_report"])
def test_no_task_holds_a_day_of_bets(spark, name):
    from formline.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("windowspecdefinition(")[1].split(", specifiedwindowframe")[0] for line in plan.splitlines() if " Window [" in line]
    assert windows and not any("race_date" in w for w in windows)
    assert "Generate" not in plan  # no row per bet, policy and bank


def test_fits_over_the_same_rows_are_summed_together():
    import numpy as np

    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(500, 4)) * [1, 50, 0.01, 3] + [5, 1e4, 0, -2], np.sort(rng.integers(0, 90, 500))
    y = (rng.random(500) < 0.3).astype(float)
    fits = [(c, np.array([[0.0] * len(c), [3.0] * len(c), [2.0 + i] * len(c)]), rng.normal(size=len(c)) * 0.1) for i, c in enumerate(([0, 1, 2, 3], [3, 0], [2]))]
    for gaps in (False, True):
        if gaps:
            x[7, 0] = np.nan
        got = models._sums_together(x, y, g, fits)
        for (c, s, b), sums in zip(fits, got, strict=True):
            want = models._group_sums((np.where(np.isnan(x[:, c]), s[0], x[:, c]) - s[1]) / s[2], y, g, b)
            assert np.allclose(sums, want, rtol=1e-9, atol=1e-9)


def test_folds_are_described_once_for_all_penalties(spark):
    rows = [(s, g, i, float(i % 3), float((g * 7 + i) % 5), int(i == g % 3)) for s in range(3) for g in range(s * 50, s * 50 + 50) for i in range(4)]
    df = spark.createDataFrame(rows, "s int, g int, i int, a double, b double, won int")
    earlier = [F.col("s") < s for s in (1, 2)]
    specs = [models.LogitSpec(("a", "b"), l2, e) for e in earlier for l2 in (1e-3, 1.0, 10.0)]
    sets, which = models._row_sets(specs)
    assert len(sets) == 2 and which == [0, 0, 0, 1, 1, 1]
    alone = [models.fit_grouped_logit(df.where(f"s < {s}"), ["g"], "won", ["a", "b"], l2) for s in (1, 2) for l2 in (1e-3, 1.0, 10.0)]
    for got, want in zip(models.fit_grouped_logits(df, ["g"], "won", specs), alone, strict=True):
        assert got.beta == pytest.approx(want.beta, abs=1e-7) and got.error == pytest.approx(want.error, rel=1e-6)


def test_temperatures_are_columns(spark):
    rows = [(g, (i + 1) / 10, int(i == g % 4)) for g in range(40) for i in range(4)]
    out = models.temperature_losses(spark.createDataFrame(rows, "g int, p double, won int"), ["g"], "p", "won", [0.5, 1.0])
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]
    import math

    want = {t: sum(-math.log(((g % 4 + 1) / 10) ** (1 / t) / sum(((i + 1) / 10) ** (1 / t) for i in range(4))) for g in range(40)) / 40 for t in (0.5, 1.0)}
    assert {r.temperature: pytest.approx(r.log_loss) for r in out.collect()} == want


@pytest.mark.parametrize("name,key", [("class_drop_trainer", "trainer"), ("connection_rates", "trainer_key")])
def test_no_task_orders_all_of_a_trainers_runs(spark, name, key):
    from formline.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keyed = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if " Window [" in line and f"windowspecdefinition({key}#" in line]
    assert keyed and all(line.split(", ")[1].startswith("_block#") for line in keyed)
