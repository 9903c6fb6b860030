"""Tokens, labels, payouts and stakes; properties by Hypothesis on many values at once."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formline.functions import payout, scalars
from formline.operators import combos, staking
from formline.operators.text import LEXICON, cosine, phrase_counts


def run(spark, kind, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_lengths(spark):
    raw = ["-", "1-1/2", "3/4", "NK", "SH", "DIST", None, "abc", "2", "½", "1/0"]
    assert run(spark, "string", raw, scalars.lengths) == [0.0, 1.5, 0.75, 0.3, 0.05, 30.0, None, None, 2.0, 0.5, None]


def test_times_numbers_and_dates(spark):
    assert run(spark, "string", ["1:38.85", "58.5", "1.38.85", "x", None], scalars.seconds) == [98.85, 58.5, 98.85, None, None]
    assert run(spark, "string", ["1,234 m", "no", "-5"], scalars.first_int) == [1234, None, -5]
    assert run(spark, "string", ["31/12/2024", "1/2/24", "2024/12/31", "x"], scalars.day_of) == [date(2024, 12, 31), date(2024, 2, 1), date(2024, 12, 31), None]
    assert run(spark, "date", [date(2025, 9, 1), date(2026, 8, 31), date(1999, 10, 1)], scalars.season_label) == ["2025-26", "2025-26", "1999-00"]


def test_classes_places_and_keys(spark):
    assert run(spark, "string", ["Class 3", "Group One", "Griffin Race", "4 Year Olds", None], scalars.class_ord) == [3.0, 0.5, 4.5, None, None]
    assert run(spark, "int", list(range(0, 9)), scalars.paid_places) == [0, 0, 0, 0, 0, 2, 2, 3, 3]
    assert run(spark, "string", ["2,8", "8, 2", "1,2,3", "x"], scalars.combination_pair) == [[2, 8], [2, 8], None, None]
    assert run(spark, "string", ["C+3", '"A+2" course', None, "rail -4"], scalars.rail_offset) == [3, 2, 0, -4]
    assert run(spark, "string", ["a?HorseId=HK_2020_E123&x=1", "a"], lambda c: scalars.entity_id(c, "horseid")) == ["HK_2020_E123", None]
    assert run(spark, "string", ["HK_2020_E123", "x"], scalars.valid_horse_id) == [True, False]
    assert run(spark, "string", ["3 4 1", "12"], scalars.last_position) == [1, 12]
    assert all(0 <= v < 1 for v in run(spark, "int", [1, 2, 3], scalars.noise))


def test_text_signals(spark):
    counts = phrase_counts(F.col("v"))
    df = spark.createDataFrame([("Ran on well, kept on well; slow to begin",), (None,)], "v string").select(*(c.alias(n) for n, c in counts.items()))
    got = df.collect()
    assert (got[0].ran_on, got[0].slow_start, got[0].wide) == (3, 1, 0)  # "kept on" and "kept on well" both count
    assert sum(got[1]) == 0
    assert sum(map(len, LEXICON.values())) == 79
    one = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z"))).first()
    assert one[0] == pytest.approx(2**-0.5)
    assert one[1] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=50))
def test_stakes_are_legal(spark, amounts):
    for a, s in zip(amounts, run(spark, "double", [float(a) for a in amounts], payout.round_stake), strict=True):
        assert s % 10 == 0
        assert s == 0 or s >= 10
        assert a < 10 or abs(s - a) <= 5 + 1e-6


def test_pool_is_conserved(spark):
    df = spark.createDataFrame([(1000.0, 200.0)], "g double, w double")
    one, two = df.select(payout.win_dividend(F.col("g"), F.col("w"), 0.2), payout.win_dividend(F.col("g"), F.col("w"), 0.2, 2)).first()
    assert one * 200 / 10 == pytest.approx(800)
    assert two == pytest.approx(one / 2)
    assert df.select(payout.rebate(F.lit(12_000.0), 0.1, 10_000), payout.rebate(F.lit(5.0), 0.1, 10_000)).first() == (200.0, 0.0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(0.1, 5.0), min_size=4, max_size=8), min_size=1, max_size=6))
def test_place_chances_sum_to_places(spark, races):
    rows = [(i, j, x / sum(r)) for i, r in enumerate(races) for j, x in enumerate(r)]
    df = combos.place_chances(spark.createDataFrame(rows, "race int, id int, p double"), "race", "id", "p")
    for r in df.groupBy("race").agg(F.sum("p1").alias("a"), F.sum("p2").alias("b"), F.sum("p3").alias("c")).collect():
        assert (r.a, r.b, r.c) == pytest.approx((1, 1, 1))


def test_place_and_pair_chances_of_small_fields(spark):
    rows = [(1, 1, 1.0), (2, 1, 0.7), (2, 2, 0.3), (3, 1, 0.5), (3, 2, 0.3), (3, 3, 0.2), (4, 1, 1.0), (4, 2, 0.0)]
    df = spark.createDataFrame(rows, "race int, id int, p double")
    got = {(r.race, r.id): r for r in combos.place_chances(df, "race", "id", "p").collect()}
    assert len(got) == len(rows)
    assert [got[k].top_k for k in got if k[0] < 4] == pytest.approx([1.0] * 6)
    assert (got[1, 1].p2, got[1, 1].p3, got[2, 1].p3) == (0, 0, 0)
    assert (got[2, 1].p2, got[2, 2].p2) == pytest.approx((0.3, 0.7))
    both = {(r.race, r.i, r.j): r.both_placed for r in combos.pair_place_chances(df.where("race < 4"), "race", "id", "p").collect()}
    assert sorted(both) == [(2, 1, 2), (3, 1, 2), (3, 1, 3), (3, 2, 3)]
    assert list(both.values()) == pytest.approx([1.0] * 4)
    pairs = {(r.race, r.i, r.j): r.q_p for r in combos.pair_chances(df, "race", "id", ["p"]).collect()}
    assert pairs[2, 1, 2] == pytest.approx(1.0)
    assert sum(x for (race, _, _), x in pairs.items() if race == 3) == pytest.approx(1.0)


@pytest.mark.parametrize(("name", "least"), [("place_chances", 1), ("pair_probabilities", 2), ("pair_place_probabilities", 2)])
def test_place_queries_hold_every_race(spark, name, least):
    from formline.plans import betting, spine

    sf = "/root/testdata/sf0.001"
    got = {r.race for r in getattr(betting, name)(spark, sf).select("race").distinct().collect()}
    assert got == {r.race for r in spine.runners(spark, sf).where(f"field_size >= {least}").select("race").distinct().collect()}


def _best_by_prefix(p, b):
    import math

    order = sorted(range(len(p)), key=lambda i: -p[i] * b[i])
    best, stakes = 0.0, [0.0] * len(p)
    for t in range(1, len(p) + 1):
        on = order[:t]
        room, rest = 1 - sum(1 / b[i] for i in on), 1 - sum(p[i] for i in on)
        if room <= 1e-12 or rest <= 1e-12:
            continue
        f = {i: p[i] - rest / room / b[i] for i in on}
        if min(f.values()) < -1e-12:
            continue
        cash = 1 - sum(f.values())
        value = sum(p[i] * math.log(cash + f[i] * b[i]) for i in on) + rest * math.log(cash)
        if value > best + 1e-12:
            best, stakes = value, [f.get(i, 0.0) for i in range(len(p))]
    return stakes


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(0.05, 1.0), st.floats(1.2, 30.0)), min_size=1, max_size=7), min_size=1, max_size=8))
def test_exclusive_stakes_match_prefix_search(spark, races):
    rows, want = [], {}
    for i, race in enumerate(races):
        total = sum(x for x, _ in race) * 1.01
        p, b = [x / total for x, _ in race], [y for _, y in race]
        rows += [(i, j, p[j], b[j]) for j in range(len(p))]
        want |= {(i, j): f for j, f in enumerate(_best_by_prefix(p, b))}
    df = staking.kelly_exclusive(spark.createDataFrame(rows, "race int, id int, p double, b double"), ["race"], "p", "b", "id", "f")
    for r in df.collect():
        assert r.f == pytest.approx(want[r.race, r.id], abs=1e-6)


def test_caps_hold_after_rounding(spark):
    df = spark.createDataFrame([(1, 1, 700.0), (1, 1, 900.0), (1, 2, 2000.0)], "day int, race int, stake double")
    got = staking.cap_and_round(df, ["day", "race"], ["day"], "stake", 10_000.0)
    assert got.groupBy("race").agg(F.sum("desired").alias("s")).agg(F.max("s")).first()[0] <= 1000 + 1e-6
    assert got.agg(F.sum("desired")).first()[0] <= 2500 + 1e-6
