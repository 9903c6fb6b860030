"""The log of the latest rows: untouched files, whole versions, writers that meet, compaction and lost writes."""

import os
import random
import threading

import pytest

from formline.sources.keyed_log import KeyedLog

COLS = "k int, v string, t int"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_the_log_equals_the_latest_rows(spark, tmp_path):
    log, rng, want = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=8, most=3), random.Random(1), {}
    for i in range(7):
        rows = [(k, f"{i}-{k}", rng.choice([None, *range(20)])) for k in rng.sample(range(40), 15)]
        assert log.write(frame(spark, rows)) == i
        for k, v, t in rows:
            if k not in want or (want[k][1] if want[k][1] is not None else -1) <= (t if t is not None else -1):
                want[k] = (v, t)
        assert {r.k: (r.v, r.t) for r in log.read().collect()} == want
    assert max(len(d) for d in log.manifest()["files"].values()) <= 3


def test_untouched_files_stay(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=16)
    log.write(frame(spark, [(k, "a", 1) for k in range(200)]))
    before, old = files(tmp_path), log.manifest()["files"]
    log.write(frame(spark, [(7, "b", 2)]))
    after, new = files(tmp_path), log.manifest()["files"]
    assert all(after[f] == m for f, m in before.items()) and len(after) == len(before) + 1
    assert sum(new[b] != old[b] for b in new) == 1
    assert log.read().where("v = 'b'").count() == 1 and log.read().count() == 200


def test_compaction_touches_its_bucket_alone(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=4, most=2)
    log.write(frame(spark, [(k, "a", 0) for k in range(40)]))
    for i in range(3):
        log.write(frame(spark, [(1, f"b{i}", i + 1)]))
    made = log.manifest()["files"]
    assert sorted(map(len, made.values())) in ([1, 1, 1, 1], [1, 1, 1, 2]) and sum("-c/" in d for ds in made.values() for d in ds) == 1
    assert log.read().where("k = 1").first().v == "b2" and log.read().count() == 40


def test_readers_keep_their_version(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=2, most=1)
    log.write(frame(spark, [(1, "a", 1)]))
    held = log.read()
    log.write(frame(spark, [(1, "b", 2), (2, "c", 1)]))
    assert [r.v for r in held.collect()] == ["a"] and [r.v for r in log.read(0).collect()] == ["a"]
    log.write(frame(spark, [(1, "d", 3)]))
    log.vacuum(keep=1)
    assert log.versions() == [2] and {r.k: r.v for r in log.read().collect()} == {1: "d", 2: "c"}
    with pytest.raises(ValueError):
        log.read(0)


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    path, took = f"{tmp_path}/t", []
    KeyedLog(spark, path, "k", "t", buckets=2).write(frame(spark, [(0, "a", 0)]))

    def write(i):
        took.append(KeyedLog(spark, path, "k", "t", buckets=2, most=2).write(frame(spark, [(i, f"w{i}", 1), (0, f"w{i}", i)])))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(took) == [1, 2, 3, 4, 5]
    assert {r.k: r.v for r in KeyedLog(spark, path, "k", "t").read().collect()} == {0: "w5"} | {i: f"w{i}" for i in range(1, 6)}


def test_a_version_that_is_taken_is_not_overwritten(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=2)
    log.write(frame(spark, [(1, "a", 1)]))
    stale = log.manifest(-1)
    assert not log._taken(stale | {"version": 0, "schema": None})
    assert [r.v for r in log.read().collect()] == ["a"]


def test_lost_and_half_made_writes_leave_the_table_as_it_was(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=2)
    log.write(frame(spark, [(1, "a", 1)]))
    frame(spark, [(1, "half", 9)]).write.parquet(f"{tmp_path}/t/data/lost/_bucket=0")
    (tmp_path / "t" / "manifest" / "1.json").touch()  # taken, then lost
    assert log.versions() == [0] and [r.v for r in log.read().collect()] == ["a"]
    log._after = lambda version, wait=0: KeyedLog._after(log, version, 0.3)
    assert log.write(frame(spark, [(1, "b", 2)])) == 2
    assert log.versions() == [0, 2] and [r.v for r in log.read().collect()] == ["b"]


def test_columns_may_come_and_types_may_not_change(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/t", "k", "t", buckets=2)
    log.write(frame(spark, [(1, "a", 1)]))
    log.write(spark.createDataFrame([(2, "b", 1, 0.5)], COLS + ", w double"))
    assert {(r.k, r.w) for r in log.read().collect()} == {(1, None), (2, 0.5)}
    with pytest.raises(ValueError):
        log.write(spark.createDataFrame([(2, "b", "x")], "k int, v string, t string"))
    with pytest.raises(ValueError):
        log.write(frame(spark, [(None, "b", 1)]))
    none = KeyedLog(spark, f"{tmp_path}/none", "k", "t")
    assert none.read(schema=frame(spark, []).schema).count() == 0
    assert none.write(frame(spark, [])) == 0 and none.read().count() == 0
