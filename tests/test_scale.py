"""Operators that split long histories, many fits and many phrases, against plain forms of the same work."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.operators import joins, models, reports, scans, text, windows
from formline.plans import audits, spine


@pytest.fixture(scope="module")
def history(spark):
    """One entity with half of all rows, some nulls and many events at one time."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 2 else f"e{i % 17}", rng.randrange(400), rng.choice([None, rng.gauss(1000, 0.5)])) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, key string, ord long, v double").persist()


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_sums_in_blocks_are_running_sums(history, width):
    got = scans.sums_so_far(history, ["key"], "ord", width, {"s": F.col("v"), "n": F.lit(1)})
    w = windows.before("key", "ord")
    want = got.withColumn("ws", F.coalesce(F.sum("v").over(w), F.lit(0.0))).withColumn("wn", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)))
    assert want.count() == 2000
    assert want.where("abs(s - ws) > 1e-6 OR n <> wn").count() == 0


@pytest.mark.parametrize("strict", [True, False])
def test_moments_in_blocks_keep_their_digits(history, strict):
    got = scans.moments_so_far(history, ["key"], "ord", 20, "v", strict)
    w = Window.partitionBy("key").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    want = got.withColumn("wm", F.avg("v").over(w)).withColumn("wv", F.when(F.count("v").over(w) > 1, F.var_samp("v").over(w)))
    assert want.where("abs(_mean - wm) > 1e-9 OR abs(_var - wv) > 1e-9 OR (_mean IS NULL) <> (wm IS NULL) OR (_var IS NULL) <> (wv IS NULL)").count() == 0


def test_no_task_of_a_scan_orders_a_whole_key(history):
    """Windows over the key alone see a row per block, those over rows have the block in their key."""
    plan = scans.expanding_z(history, ["key"], "ord", 20, "v", "z")._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.split("\n") if "Window [" in line and "_x" in line]
    assert over_rows and all("_block" in line.split("windowspecdefinition(", 1)[1].split("ASC", 1)[0] for line in over_rows)


def test_a_constant_has_no_spread(spark):
    df = spark.createDataFrame([("a", i, 20.07 if i < 50 else 35.5) for i in range(100)], "key string, ord long, v double")
    got = {r.ord: r.z for r in scans.expanding_z(df, ["key"], "ord", 8, "v", "z").collect()}
    assert all(got[i] == 0.0 for i in range(50)) and got[50] > 1


def test_scans_of_nothing_and_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 5, 3.0), ("a", None, 1.0)], "key string, ord long, v double")
    assert [r.s for r in scans.sums_so_far(df, ["key"], "ord", 2, {"s": F.col("v")}).orderBy("ord").collect()] == [0.0, 2.0]
    assert scans.moments_so_far(df.limit(0), ["key"], "ord", 2, "v").count() == 0


@pytest.fixture(scope="module")
def sides(spark):
    """A hot entity with half of all rows, ties in time, null entities and times."""
    rng = random.Random(9)
    pick = lambda i: None if i % 97 == 0 else "hot" if i % 2 else f"u{i % 13}"
    left = [(i, pick(i), None if i % 89 == 0 else rng.randrange(900)) for i in range(1500)]
    right = [(pick(i), None if i % 83 == 0 else rng.randrange(900), i) for i in range(1500)]
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).cast("timestamp")
    a = spark.createDataFrame(left, "id long, who string, d int").select("id", "who", day.alias("ts"))
    b = spark.createDataFrame(right, "who string, d int, v long").select("who", day.alias("side_ts"), "v")
    return a.persist(), b.persist()


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tolerance", [None, 5])
@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_sliced_asof_equals_the_unsliced(sides, strict, tolerance, days):
    a, b = sides
    whole = joins.asof_join(a, b, "who", "ts", "side_ts", ["v"], strict, tolerance, slice_days=None)
    cut = joins.asof_join(a, b, "who", "ts", "side_ts", ["v"], strict, tolerance, slice_days=days)
    assert cut.count() == 1500 and sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_asof_against_pairs(sides):
    a, b = sides
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.who") == F.col("b.who")) & (F.col("b.side_ts") <= F.col("a.ts")), "left").groupBy("a.id").agg(F.max(F.struct("b.side_ts", "b.v")).alias("m"))
    want = {r.id: r.m.v if r.m else None for r in pairs.collect()}
    assert {r.id: r.v for r in joins.asof_join(a, b, "who", "ts", "side_ts", ["v"]).collect()} == want


@pytest.mark.parametrize("days", [None, 1, 30])
def test_events_between_against_pairs(sides, days):
    a, b = sides
    aggs = [F.count("r_v").alias("n"), F.max("r_v").alias("m")]
    got = {(r.id, r.n, r.m) for r in joins.between_agg_join(a, b, "who", "ts", "side_ts", ["id"], aggs, max_days=365, slice_days=days).collect()}
    w = Window.partitionBy("who").orderBy("ts", "id")
    spans = a.withColumn("lo", F.when(F.col("who").isNotNull() & F.col("ts").isNotNull(), F.coalesce(F.lag("ts").over(w), F.lit("1900-01-01").cast("timestamp"))))
    assert got == {(r.id, r.n, r.m) for r in joins.interval_agg_join(spans, b, "who", "lo", "ts", "side_ts", ["id"], aggs, max_days=365).collect()}


def test_intervals_of_one_entity_take_no_square(spark):
    """40,000 side rows of one entity; a frame that starts anew at each row would take minutes."""
    import time

    n = 40_000
    b = spark.range(n).select(F.lit("u").alias("who"), F.timestamp_seconds(F.col("id") * 60).alias("side_ts"), F.col("id").alias("v"))
    a = spark.createDataFrame([(1, "u", n * 60 + 1)], "id long, who string, s long").select("id", "who", F.timestamp_seconds("s").alias("ts"))
    start = time.time()
    got = joins.between_agg_join(a, b, "who", "ts", "side_ts", ["id"], [F.count("r_v").alias("n")], slice_days=None).first()
    assert got.n == n and time.time() - start < 20


def plain_counts(t: str, lexicon: dict) -> list[int]:
    low = (t or "").lower()
    return [sum(len(re.findall(rf"(?=\b{re.escape(p.lower())}\b)", low)) for p in phrases) for phrases in lexicon.values()]


def test_phrases_of_one_pass_are_those_of_each_pattern(spark):
    lexicon = text.LEXICON | {"odd": ("wide", "Wide", "a-b", "é b", "-x", "")}
    texts = ["Ran on and RAN ON strongly, kept on well.", "wide wide-widest wide", None, "", "a-b a-bc xa-b", "é b é bé", "no room, no cover; no clear run", "y-x -x", "ran_on ran on_"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    counts = text.phrase_counts(F.col("t"), lexicon)
    got = df.select("i", *(c.alias(n) for n, c in counts.items())).orderBy("i").collect()
    lexicon["odd"] = tuple(p for p in lexicon["odd"] if p)
    assert [list(r)[1:] for r in got] == [plain_counts(t, lexicon) for t in texts]


def test_ten_thousand_phrases_take_the_time_of_few(spark):
    import time

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(10_000)})
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2).persist()
    df.count()

    def run(lexicon):
        start = time.time()
        total = df.select(text.phrase_counts(F.col("t"), lexicon)["all"].alias("n")).agg(F.sum("n")).first()[0]
        return total, time.time() - start

    run({"all": phrases[:10]})
    few, many = run({"all": phrases[:50]}), run({"all": phrases})
    sample = set(phrases)
    want = sum(" ".join(t[i : i + m]) in sample for t in (x.split() for x in texts) for m in (1, 2, 3) for i in range(len(t) - m + 1))
    assert many[0] == want and many[1] < 10 * few[1] + 3


@pytest.fixture(scope="module")
def season_panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(600):
        a, b = rng.normal(size=5), rng.normal(size=5)
        p = np.exp(1.2 * a - 0.4 * b)
        win = rng.choice(5, p=p / p.sum())
        rows += [(g, f"s{g // 150}", i, int(i == win), float(a[i]) if rng.random() > 0.02 else None, float(b[i])) for i in range(5)]
    return spark.createDataFrame(rows, "g long, season string, i int, won int, a double, b double").persist()


def test_fits_together_equal_fits_alone(season_panel):
    specs = [models.LogitSpec(f, l2, None if s is None else F.col("season") < s) for f in (("a",), ("b", "a")) for l2 in (1e-3, 50.0) for s in (None, "s1", "s3")]
    together = models.fit_grouped_logits(season_panel, ["g"], "won", specs)
    for spec, got in zip(specs, together, strict=True):
        rows = season_panel if spec.rows is None else season_panel.where(spec.rows)
        alone = models.fit_grouped_logit(rows, ["g"], "won", spec.features, spec.l2)
        assert np.allclose(got.beta, alone.beta, atol=1e-7) and np.allclose(got.error, alone.error, atol=1e-7) and np.allclose(got.mean, alone.mean)


def test_settings_and_folds_share_passes(season_panel):
    """Six penalties and three folds take as many jobs over the panel as their slowest fit."""
    sc = season_panel.sparkSession.sparkContext
    sc.setJobGroup("fits", "fits")
    settings = {f"{l2}": (("a", "b"), l2) for l2 in (1e-3, 0.1, 1.0, 10.0, 100.0, 1000.0)}
    got = models.walk_forward_logits(season_panel, "season", ["g"], "won", settings)
    passes = len(sc.statusTracker().getJobIdsForGroup("fits"))
    sc.setJobGroup("rest", "rest")
    assert got.count() == 6 * 450 * 5 and passes < 40
    one = models.walk_forward(season_panel, "season", lambda x: models.fit_grouped_logit(x, ["g"], "won", ["a", "b"], 10.0), lambda x, m: models.score_grouped(x, m, ["g"]), train_only=1)
    both = got.where("setting = '10.0'").join(one.select("g", "i", F.col("p_win").alias("p")), ["g", "i"])
    assert both.count() == 450 * 5 and both.where("abs(p_win - p) > 1e-6").count() == 0


def test_ablation_and_search_name_what_matters(season_panel):
    lost = {r.without: r.loss_added for r in models.ablate(season_panel, "season", ["g"], "won", ["a", "b"], {"a": ["a"], "b": ["b"]}).collect()}
    assert lost[""] == 0 and lost["a"] > lost["b"] > 0
    best = models.param_search(season_panel, "season", ["g"], "won", ["a", "b"], [1e-3, 1e5]).first()
    assert best.setting == "0.001"
    assert models.walk_forward_logits(season_panel.where("season = 's0'"), "season", ["g"], "won", {"x": (("a",), 1.0)}).count() == 0


def snapshots_of_races(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        off = 3600 * (g + 1)
        for m in range(5):
            if g == 3 and m > 0:
                continue
            times = sorted(rng.sample(range(off - 3000, off + 600), 12))
            rows += [(g, m, t, round(rng.uniform(1.5, 20), 3), off) for t in times]
    return rows


def test_drift_on_a_running_stream_equals_the_batch(spark, tmp_path):
    """Snapshots come out of order and repeatedly, in several batches; each race's rows come once, and its state goes."""
    from formline.streaming import snapshots

    rows = snapshots_of_races(spark)
    schema = "grp int, member int, t long, price double, o long"
    frame = lambda x: spark.createDataFrame(x, schema).select("grp", "member", F.timestamp_seconds("t").alias("ts"), "price", F.timestamp_seconds("o").alias("off"))
    rng = random.Random(2)
    for i, lo in enumerate(range(0, 50_000, 4000)):
        part = [r for r in rows if lo <= r[2] < lo + 4000]
        repeats = [r for r in rows if lo - 1500 <= r[2] < lo][:10]  # still inside the delay
        part = part + repeats + part[:7]
        rng.shuffle(part)
        if part:
            frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame([(99, 0, 200_000, 2.0, 250_000), (None, 1, 5, 2.0, 9), (1, 1, None, 2.0, 9), (0, 0, 10, 9.0, 3600)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the last is too late
    frame([(99, 0, 200_100, 2.0, 250_000)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = snapshots.drift_stream(stream, "grp", "member", "ts", "price", "off", lags=(30, 5), delay="40 minutes")
    run = snapshots.append_parquet(made, str(tmp_path / "out"), str(tmp_path / "state"))
    assert run.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = snapshots.price_drift(frame(rows), ["grp", "member"], ["grp"], "ts", "price", "off", lags=(30, 5))
    ranked = batch.withColumns({
        "strength_rank": F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("close"), "member")),
        "drift_rank": F.row_number().over(Window.partitionBy("grp").orderBy(F.round("drift", 9).asc_nulls_last(), "member")),
    })
    cols = batch.columns + ["strength_rank", "drift_rank"]
    tidy = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).fillna(-99.0).collect())
    assert tidy(got) == tidy(ranked) and got.count() == 11 * 5 + 1
    left = {o["operatorName"]: o["numRowsTotal"] for o in run.lastProgress["stateOperators"]}
    assert left["applyInPandasWithState"] == 1  # the race that hasn't closed
    k3 = got.where("strength_rank <= 3 AND drift_rank <= 3").select("grp", "member")
    want = snapshots.resonance(batch, ["grp"], "member", F.col("close"), F.round("drift", 9), k=3).select("grp", "member")
    assert sorted(map(tuple, k3.collect())) == sorted(map(tuple, want.collect()))


def test_latest_prices_and_gaps_on_a_running_stream(spark, tmp_path):
    from formline.streaming import snapshots

    rng = random.Random(6)
    rows = [(m, pool, t, round(rng.uniform(1.2, 9), 2)) for m in range(4) for pool in ("win", "place") for t in rng.sample(range(1000), 20)]
    rng.shuffle(rows)
    schema = "member int, pool string, t long, price double"
    frame = lambda x: spark.createDataFrame(x, schema).select("member", "pool", F.timestamp_seconds("t").alias("ts"), "price")
    for i in range(0, len(rows), 40):
        frame(rows[i : i + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made in (("latest", lambda d: snapshots.latest_price(d, ["member", "pool"], "ts", "price")), ("gap", lambda d: snapshots.implied_gap(d, ["member"], "pool", "price", "win", "place"))):
        run = made(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, made(frame(rows)).collect()))


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_paths_in_blocks_are_paths(spark, width):
    rng = random.Random(width)
    rows = [(k, i, rng.choice([None, rng.gauss(0, 5)]) if k else rng.gauss(-1, 2)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = {(r.k, r.o): (r.equity, r.peak, r.drawdown) for r in scans.path_so_far(df, ["k"], "o", width, "v").collect()}
    totals = {r.k: (r.total, r.lowest, r.highest, r.max_drawdown) for r in scans.path_summary(df, ["k"], "o", width, "v").collect()}
    for k in range(3):
        run, peak, drop, low, high = 0.0, 0.0, 0.0, math.inf, -math.inf
        for i in range(60):
            run += rows[k * 60 + i][2] or 0.0
            peak, low, high = max(peak, run), min(low, run), max(high, run)
            drop = max(drop, peak - run)
            assert np.allclose(got[k, i], (run, peak, peak - run), atol=1e-9)
        assert np.allclose(totals[k], (run, low, high, drop), atol=1e-9)
    assert scans.path_summary(df.limit(0), ["k"], "o", width, "v").count() == 0


def test_pooling_in_ranges_is_pooling(spark):
    """The step curve of ranges that merge equals the min-max formula over all cells."""
    rng = random.Random(12)
    rows = [(b, rng.random() ** 2, int(rng.random() < 0.4)) for b in (1, 2) for _ in range(400)] + [(1, None, 1), (2, 0.5, None), (3, 0.25, 1)]
    df = spark.createDataFrame(rows, "b int, p double, y int")
    curve = models.isotonic_curve(df, "p", "y", "b", digits=2, ranges=7)
    steps = {b: sorted((r.low, r.high, r.value) for r in curve.where(F.col("b") == b).collect()) for b in (1, 2, 3)}
    for b in (1, 2):
        cells: dict = {}
        for x, p, y in rows:
            if x == b and p is not None and y is not None:
                t, n = cells.get(math.floor(p * 100 + 0.5), (0, 0))
                cells[math.floor(p * 100 + 0.5)] = (t + y, n + 1)
        order = sorted(cells)
        mean = lambda j, k: sum(cells[c][0] for c in order[j : k + 1]) / sum(cells[c][1] for c in order[j : k + 1])
        for i, c in enumerate(order):
            want = max(min(mean(j, k) for k in range(i, len(order))) for j in range(i + 1))
            assert any(lo <= c <= hi and abs(v - want) < 1e-12 for lo, hi, v in steps[b])
        assert all(x[2] < y[2] for x, y in zip(steps[b], steps[b][1:], strict=False))
    asked = spark.createDataFrame([(3, 0.0), (3, 0.9), (4, 0.5), (3, None)], "b int, q double")
    got = models.on_curve(asked, curve, "q", "b", "v", digits=2).collect()
    assert sorted((str(r.q), r.b, r.v) for r in got) == sorted([("0.0", 3, 1.0), ("0.9", 3, 1.0), ("0.5", 4, None), ("None", 3, None)], key=str)


def test_logistic_curves_from_shared_passes(spark):
    rng = random.Random(1)
    rows = [(i % 3, p := rng.uniform(0.02, 0.98), int(rng.random() < 1 / (1 + math.exp(-(0.3 + 0.5 * math.log(p / (1 - p))))))) for i in range(6000)]
    df = spark.createDataFrame(rows, "b int, p double, y int")
    together = models.fit_platt(df, "p", "y", [F.col("b") <= 0, F.col("b") <= 2, F.lit(False)])
    assert together[2] == (0.0, 1.0)
    assert np.allclose(together[0], models.fit_platt(df.where("b = 0"), "p", "y", [F.lit(True)])[0])
    assert np.allclose(together[1], (0.3, 0.5), atol=0.1)


def test_medians_of_any_values(spark):
    """Off any grid, with outliers that would make millions of cells, ties and days without values; exact."""
    import statistics

    from formline.operators import history

    rng = random.Random(21)
    rows = []
    for d in range(14):
        rows += [(d, rng.choice([rng.gauss(0, 1), rng.choice([0.1, 0.25]), rng.expovariate(1) * 10.0 ** rng.randrange(-6, 12)])) for _ in range(0 if d % 9 == 4 else rng.randrange(1, 12))] + [(d, None), (d, float("nan"))]
    df = spark.createDataFrame(rows, "d int, v double")
    got = {r.d: r.f for r in history.median_so_far(df, "d", "v", "f", least=5, fan=8).where("v IS NULL").collect()}
    for d in range(14):
        past = [v for x, v in rows if x < d and v is not None and v == v]
        assert got[d] == (statistics.median(past) if len(past) >= 5 else 0.0)


def test_tasks_follow_the_lines(spark, monkeypatch):
    """A race's runners are dealt by race once, for the join with its order and all windows, to more tasks for more lines."""
    where = "/root/testdata/sf0.001"
    lines = spine.table(spark, where, "lineitem").count()
    monkeypatch.setattr(spine, "TASK_ROWS", lines // 9)
    n = spine.tasks(spark, where)
    assert n in (9, 10)
    plan = spine.runners(spark, where)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "plan_id" in line and "l_orderkey" in line.split("hashpartitioning(")[1].split(")")[0]]
    assert dealt and all(f", {n})" in line for line in dealt) and "hashpartitioning(race" not in plan


def test_leaderboard_reads_what_it_has_written(spark):
    """The losses read the members' written chances; no plan goes back to the lines."""
    plan = audits.leaderboard(spark, "/root/testdata/sf0.001", 1)._jdf.queryExecution().optimizedPlan()
    read = [str(plan.collectLeaves().apply(i).toString()) for i in range(plan.collectLeaves().size())]
    assert read and not any("l_orderkey" in r for r in read)


def reads_the_lines(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    return any("l_orderkey" in plan.collectLeaves().apply(i).toString() for i in range(plan.collectLeaves().size()))


def test_logit_chances_read_the_written_panel(spark):
    """Fits and chances read the panel that was made once; no plan goes back to the lines."""
    assert not reads_the_lines(audits.grouped_logit_walk_forward(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("n_sets", [4, 70])
def test_blocks_of_groups_that_are_alike_hold_every_fit(spark, n_sets):
    """Groups of many sizes, with gaps, in several sets and across them, in more sets than a whole number has bits, give each fit its own rows."""
    rng = np.random.default_rng(n_sets)
    rows = []
    for g in range(150):
        won = rng.integers(0, 3)
        for i in range(rng.integers(1, 9)):
            rows.append((g, int(rng.integers(0, 9)) if g % 10 == 0 else g % 9, int(i < won), None if rng.random() < 0.05 else float(rng.normal(1e4, 2)), float(rng.normal()), 3.5))
    df = spark.createDataFrame(rows, "g long, s int, won int, a double, b double, c double").repartition(3).persist()
    sets = [F.col("s") < n % 9 + 1 for n in range(n_sets)]
    specs = [models.LogitSpec(f, 0.1, sets[n]) for n in (0, 3, n_sets - 1) for f in (("a", "b", "c"), ("b",), ())]
    specs += [models.LogitSpec(("b",), 0.1, c) for c in sets] if n_sets > 62 else []
    for spec, got in list(zip(specs, models.fit_grouped_logits(df, ["g"], "won", specs), strict=True))[:9]:
        mine = [r for r in rows if r[1] < specs_upto(spec, sets)]
        x = np.array([[np.nan if r[3 + "abc".index(f)] is None else r[3 + "abc".index(f)] for f in spec.features] for r in mine], dtype=float).reshape(len(mine), -1)
        x = (np.where(np.isnan(x), got.median, x) - got.mean) / got.scale
        assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), [0 if f == "c" else 1 for f in spec.features])
        k = len(spec.features)
        sums = models._group_sums(x, np.array([r[2] for r in mine], dtype=float), np.array([r[0] for r in mine]), np.array(got.beta))
        assert np.allclose(sums[1 : 1 + k] - 0.2 * np.array(got.beta), 0, atol=1e-6)  # no slope is left
        assert np.allclose(np.array(got.error) ** 2, np.diag(np.linalg.inv(sums[1 + k :].reshape(k, k) + 0.2 * np.eye(k))), rtol=1e-5)


def specs_upto(spec, sets):
    return next(i for i, c in enumerate(sets) if c is spec.rows) % 9 + 1


def test_large_scores_do_not_overflow():
    x, y = np.array([[[900.0, 2.0], [-900.0, 1.0]]]), np.array([[1.0, 0.0], [0.0, 1.0]])
    got = models._sums(x, y, np.array([[1.0], [0.0]]))
    for i, b in enumerate((1.0, 0.0)):
        want = models._group_sums(x[0].T.reshape(-1, 1), y.T.reshape(-1), np.array([0, 0, 1, 1]), np.array([b]))
        assert np.allclose(got[i], want)


@pytest.fixture(scope="module")
def loose_panel(spark):
    """Gaps, groups across seasons, groups without a winner or with several, and nulls as labels."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(300):
        for i in range(rng.integers(1, 8)):
            season = f"s{(g + (i % 2 if g % 11 == 0 else 0)) // 75}"
            rows.append((g, season, i, None if rng.random() < 0.03 else int(rng.random() < 0.25), None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal(50, 9))))
    return spark.createDataFrame(rows, "g long, season string, i int, won int, a double, b double").persist()


def test_losses_of_settings_are_those_of_their_chances(loose_panel):
    settings = {"all": (("a", "b"), 1e-3), "ridge": (("a", "b"), 100.0), "a": (("a",), 1e-3), "none": ((), 1.0)}
    for last in (None, 1):
        got = {r.setting: r for r in models.walk_forward_losses(loose_panel, "season", ["g"], "won", settings, last=last).collect()}
        scored = models.walk_forward_logits(loose_panel, "season", ["g"], "won", settings, last=last)
        want = reports.group_log_loss(scored, ["g"], "p_win", "won", ["setting"]).collect()
        assert {r.setting for r in want} == set(got) == set(settings)
        for r in want:
            assert got[r.setting].groups == r.groups and got[r.setting].log_loss == pytest.approx(r.log_loss, rel=1e-9)
    assert models.walk_forward_losses(loose_panel.where("season = 's0'"), "season", ["g"], "won", settings).count() == 0


def test_search_repeats_no_row_for_a_penalty(spark):
    """Losses are summed from the packed panel: the result's plan has no rows of runners in it."""
    out = audits.param_search(spark, "/root/testdata/sf0.001", 2)
    assert not reads_the_lines(out) and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 7 and out.where("groups > 0 AND log_loss > 0").count() == 7


def test_ablation_repeats_no_row_for_a_setting(spark):
    out = audits.ablation(spark, "/root/testdata/sf0.001", 2)
    assert not reads_the_lines(out) and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 6 and out.where("without = '' AND loss_added = 0").count() == 1


def test_trees_from_counts_are_those_of_rows(spark):
    """Equal rows counted once, with gaps filled by the rows' medians, give the trees of the rows."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(4000):
        a, b = float(rng.integers(0, 4)), None if rng.random() < 0.2 else float(rng.integers(0, 60) ** 2)
        rows.append((a, b, float(rng.random() < (0.7 if a > 1 and (b or 0) > 300 else 0.2))))
    df = spark.createDataFrame(rows, "a double, b double, won double").withColumn("c", F.lit(2.5)).persist()
    counts = df.groupBy("a", "b", "c", "won").agg(F.count(F.lit(1)).cast("double").alias("n"))
    assert counts.count() < 600 and models.with_gaps(counts, ["a", "b"]) == ["b"]
    one, two = models.pointwise_gbt(["a", "b", "c"]).fit(df), models.fit_counted_gbt(df, counts, "n", ["a", "b", "c"])
    asked = df.select("a", "b", "c").distinct()
    p, q = ({(r.a, r.b): r.x for r in models.scored_rows(m, asked, "x").collect()} for m in (one, two))
    assert len(p) > 30 and all(abs(p[c] - q[c]) < 1e-9 for c in p)
    again = models.fit_counted_gbt(df, counts.repartition(7, "b").sortWithinPartitions("a"), "n", ["a", "b", "c"])
    assert {(r.a, r.b): r.x for r in models.scored_rows(again, asked, "x").collect()} == pytest.approx(q)


def test_leaderboard_learns_trees_from_counts(spark, monkeypatch):
    """The trees see no more rows than there are different ones, and the losses are those of members made one at a time."""
    seen = []
    fit = models.fit_counted_gbt
    monkeypatch.setattr(models, "fit_counted_gbt", lambda rows, counts, *a, **k: seen.append((rows.count(), counts.count(), counts.agg(F.sum("n")).first()[0])) or fit(rows, counts, *a, **k))
    got = {r.model: r for r in audits.leaderboard(spark, "/root/testdata/sf0.001", 2).collect()}
    assert len(seen) == 2 and all(n == weight and cells <= n for n, cells, weight in seen)
    df = audits._panel(spark, "/root/testdata/sf0.001").withColumn("won", F.col("won").cast("double")).persist()
    members = {
        "grouped_logit": models.walk_forward_logits(df, "season", ["race"], "won", {"m": (audits.FEATURES, 1e-3)}, last=2),
        "boosted_trees": models.walk_forward(df, "season", models.pointwise_gbt(audits.FEATURES).fit, lambda now, m: models.scored_by(m, now, ["race"]), train_only=1, last=2),
    }
    members = {n: m.select("race", "saddle", "won", "p_win") for n, m in members.items()}
    members["ensemble"] = models.ensemble(list(members.values()), ["race", "saddle", "won"], ["race"])
    for name, scored in members.items():
        want = reports.group_log_loss(scored, ["race"], "p_win", "won").first()
        assert got[name].groups == want.groups and got[name].log_loss == pytest.approx(want.log_loss, rel=1e-9)
