"""Hand-computed values of the feature operators, and invariance to rows that come later."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from formline.operators import joins, windows
from formline.plans.spine import runners

DAYS = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]


def test_career_and_form_of_one_entity(spark):
    rows = [(1, DAYS[0], 1, 1, 1, "2023-24"), (1, DAYS[1], 2, 0, 5, "2023-24"), (1, DAYS[2], 3, 1, 1, "2023-24")]
    df = spark.createDataFrame(rows, "horse int, day date, ord long, won int, finish int, season string")
    df = windows.career(df, "horse", "ord", "day", "season")
    df = windows.prior_rate(df, "horse", "ord", "won", "rate")
    df = windows.prior_roll(df, "horse", "ord", "finish", 3, "last3")
    got = df.orderBy("ord").select("career_run_number", "days_since_last_run", "seasons_active", "rate", "last3").collect()
    assert [r[0] for r in got] == [0, 1, 2]
    assert [r[1] for r in got] == [None, 31, 29]
    assert [r[2] for r in got] == [0, 0, 0]
    assert [r[3] for r in got] == [None, 1.0, 0.5]
    assert got[2][4] == 3.0


def test_siblings_of_one_event_do_not_see_each_other(spark):
    df = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 2, 0), (7, 3, 0)], "jockey int, ord long, won int")
    got = windows.prior_rate(df, "jockey", "ord", "won", "rate").orderBy("ord", "won").collect()
    assert [r.rate_n for r in got] == [0, 1, 1, 3]
    assert got[1].rate == got[2].rate == 1.0
    rows = windows.prior_rate(df, "jockey", ["ord", "won"], "won", "rate", strict=False).orderBy("ord", "won").collect()
    assert [r.rate_n for r in rows] == [0, 1, 2, 3]


def test_weight_steps(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([1000, 1010, 1002, 1022])], "horse int, ord int, w int")
    df = windows.lagged(df, "horse", "ord", ["w"]).withColumn("mean", F.avg("w").over(windows.rows("horse", "ord", windows.Window.unboundedPreceding, -1)))
    got = df.orderBy("ord").collect()
    assert [None if r.prev_w is None else r.w - r.prev_w for r in got] == [None, 10, -8, 20]
    assert got[2].mean == 1005


@pytest.mark.parametrize(("strict", "want"), [(False, [1.0, 2.0, None]), (True, [None, 1.0, None])])
def test_asof_with_ties(spark, strict, want):
    left = spark.createDataFrame([(1, DAYS[0]), (1, DAYS[1]), (2, DAYS[1])], "e int, d date")
    right = spark.createDataFrame([(1, DAYS[0], 1.0), (1, DAYS[1], 2.0), (None, DAYS[0], 9.0)], "e int, t date, v double")
    got = joins.asof_join(left, right, "e", "d", "t", ["v"], strict=strict).orderBy("e", "d").collect()
    assert [r.v for r in got] == want


def test_asof_tolerance_and_empty_side(spark):
    left = spark.createDataFrame([(1, DAYS[2])], "e int, d date")
    right = spark.createDataFrame([(1, DAYS[0], 1.0)], "e int, t date, v double")
    assert joins.asof_join(left, right, "e", "d", "t", ["v"], tolerance_days=30).first().v is None
    assert joins.asof_join(left, right, "e", "d", "t", ["v"], tolerance_days=90).first().v == 1.0
    assert joins.asof_join(left, right.limit(0), "e", "d", "t", ["v"]).first().v is None


def test_interval_join_excludes_both_ends(spark):
    left = spark.createDataFrame([(1, 10, DAYS[0], DAYS[2])], "e int, id int, lo date, hi date")
    right = spark.createDataFrame([(1, d, 1.0) for d in DAYS], "e int, t date, v double")
    got = joins.interval_agg_join(left, right, "e", "lo", "hi", "t", ["id"], [F.count("r_v").alias("n")]).first()
    assert got.n == 1


def test_strict_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="repeats a key"):
        joins.strict_left_join(left, right, ["k"])


def test_canonical_key_takes_the_usual_code(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("a", None), ("b", None)], "name string, code string")
    got = {(r.name, r.code): r.key for r in joins.canonical_key(df, "name", "code", "key").collect()}
    assert got == {("a", "X"): "X", ("a", "Y"): "Y", ("a", None): "X", ("b", None): "b"}


def test_features_do_not_change_when_later_rows_go(spark):
    df = runners(spark, "/root/testdata/sf0.001")

    def made(x):
        x = windows.prior_rate(x, "jockey", "ord", "won", "rate")
        x = windows.shrunk_bias(x.withColumn("due", 1.0 / F.col("field_size")), ["distance", "draw"], "ord", "won", "due", 20.0, "bias")
        return windows.global_expanding_z(x, "race_date", ["weight"]).where("race_date < '1998-01-01'").select("race", "saddle", "rate", "bias", "z_weight")

    assert made(df).exceptAll(made(df.where("race_date < '1998-01-01'"))).count() == 0


def test_expanding_z_needs_two_values(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 8.0)], "k int, o int, v double")
    got = [r.z for r in windows.expanding_z(df, "k", "o", "v", "z").orderBy("o").collect()]
    assert got[0] == 0.0
    assert got[1] == pytest.approx(2**-0.5)


def test_side_event_metrics(spark):
    df = spark.createDataFrame([(1, 1, 60.0), (1, 2, 62.0), (1, 3, None)], "batch int, id int, t double")
    got = windows.trial_metrics(df, "batch", "t", F.lit(0.0), F.lit(True)).orderBy("id").collect()
    assert [(r.bt_margin, r.bt_rank, r.bt_easy) for r in got] == [(0.0, 0.0, 1.0), (2.0, 1.0, 0.0), (None, None, 0.0)]
