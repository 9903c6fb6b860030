"""Each reason to refuse a training set, and that a refusal leaves what was there."""

import pytest
from pyspark.sql import functions as F

from formline.operators import assembly
from formline.operators.assembly import Part


@pytest.fixture(scope="module")
def base(spark):
    df = spark.createDataFrame([(r, s, f"2020-01-{r + 1:02}", f"j{s % 2}") for r in range(5) for s in range(4)], "race int, saddle int, d string, jockey string")
    return df.withColumn("d", F.col("d").cast("date")).persist()


def features(spark, rows):
    return spark.createDataFrame(rows, "race int, saddle int, w double, known string").withColumn("known", F.col("known").cast("date"))


GOOD = [(r, s, float(r + s), "2020-01-01") for r in range(5) for s in range(4)]


def build(base, part, path, **how):
    return assembly.write_training_set(base, ["race", "saddle"], "d", [part], path, **how)


def test_a_sound_set_is_written_with_its_counts(spark, base, tmp_path):
    jockeys = spark.createDataFrame([("j0", 7), ("j9", 8), (None, 9)], "jockey string, rides int")
    parts = [Part("card", features(spark, GOOD[:18] + [(99, 0, 1.0, "2020-01-01")]), ["race", "saddle"], ["w"], "known", least_match=0.9), Part("record", jockeys, ["jockey"], ["rides"])]
    got = assembly.write_training_set(base, ["race", "saddle"], "d", parts, f"{tmp_path}/set")
    assert got == {
        "rows": 20, "base_repeated": 0, "card_matched": 18, "card_missing": 2, "card_repeated": 0, "card_late": 0, "card_lost": 1,
        "record_matched": 10, "record_missing": 10, "record_repeated": 0, "record_late": 0, "record_lost": 1,
    }
    rows = spark.read.parquet(f"{tmp_path}/set")
    assert rows.count() == 20 and rows.columns == ["race", "saddle", "d", "jockey", "w", "rides"] and rows.where("w IS NULL").count() == 2
    assert len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize(
    ("rows", "how", "says"),
    [
        (GOOD + [(1, 1, 5.0, "2020-01-01")], {}, "card repeats the key of 1 rows"),
        (GOOD[:-1] + [(4, 3, 5.0, "2020-01-06")], {}, "1 rows of card were known after the event"),
        (GOOD[:10], {"least_match": 0.6}, "card has 10 of 20 rows"),
        (GOOD + [(77, 1, 1.0, "2020-01-01")], {"most_lost": 0.0}, "1 keys of card meet no row"),
    ],
)
def test_each_breach_is_refused(spark, base, tmp_path, rows, how, says):
    path = f"{tmp_path}/set"
    build(base, Part("card", features(spark, GOOD), ["race", "saddle"], ["w"], "known"), path)
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    with pytest.raises(assembly.Refused) as e:
        build(base, Part("card", features(spark, rows), ["race", "saddle"], ["w"], "known", **how), path)
    assert e.value.breaches == [says] and e.value.report["rows"] == 20
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before and len(list(tmp_path.iterdir())) == 1


def test_repeated_base_keys_and_outcomes_are_refused(spark, base, tmp_path):
    part = Part("card", features(spark, GOOD), ["race", "saddle"], ["w"], "known")
    with pytest.raises(assembly.Refused, match="2 base rows repeat their key"):
        build(base.unionByName(base.where("race = 0 AND saddle = 0")), part, f"{tmp_path}/a")
    with pytest.raises(ValueError, match="outcome columns"):
        build(base, part, f"{tmp_path}/b", forbidden=["w"])
    with pytest.raises(ValueError, match="there already"):
        build(base.withColumn("w", F.lit(1)), part, f"{tmp_path}/c")
    assert not list(tmp_path.iterdir())


def test_assembly_of_nothing(spark, base, tmp_path):
    got = build(base.limit(0), Part("card", features(spark, []), ["race", "saddle"], ["w"], "known", 1.0, 0.0), f"{tmp_path}/set")
    assert set(got.values()) == {0} and spark.read.parquet(f"{tmp_path}/set").count() == 0


def test_keys_that_one_part_lost_meet_no_other_part(spark, base):
    """A lost entry of a race that has run neither takes the race's row nor counts it as lost."""
    card = features(spark, GOOD + [(1, s, 1.0, "2020-01-01") for s in range(50, 60)])
    going = spark.createDataFrame([(r, "G") for r in range(5)] + [(9, "F")], "race int, going string")
    parts = [Part("card", card, ["race", "saddle"], ["w"], "known"), Part("going", going, ["race"], ["going"])]
    for tasks in (None, 3):
        got = {r.part: (r.matched, r.missing, r.lost) for r in assembly.report(assembly.matched(base, ["race", "saddle"], "d", parts, tasks), parts).collect()}
        assert got == {"card": (20, 0, 10), "going": (20, 0, 1)}


def test_lost_keys_are_spread_over_the_tasks(spark, base):
    """Keys without a jockey don't all go to the one task of null jockeys."""
    card = spark.range(1000).selectExpr("100 + id AS race", "1 AS saddle", "1.0 AS w")
    record = spark.createDataFrame([("j0", 7)], "jockey string, rides int")
    parts = [Part("card", card, ["race", "saddle"], ["w"]), Part("record", record, ["jockey"], ["rides"])]
    held = assembly.matched(base, ["race", "saddle"], "d", parts, 8).where("_in IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 400
