"""Running values of groups against plain ones."""

import random

from pyspark.sql import functions as F

from tidelog.operators import blobs, log, sync
from tidelog.operators.running import before_each

SCHEMA = "key string, at long, size long"


def some(n):
    rng = random.Random(5)
    order = rng.sample(range(10 * n), n)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), at, rng.choice([None, *range(50)])) for at in order]


def plain(rows, fold):
    held, out = {}, {}
    for key, at, size in sorted(rows, key=lambda r: r[1]):
        out[at] = held.get(key)
        if size is not None:
            held[key] = size if held.get(key) is None else fold(held[key], size)
    return out


def test_against_plain_sums_and_maxima(spark):
    rows = some(600)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for of, merge, fold in ((F.sum, lambda x, y: x + y, lambda x, y: x + y), (F.max, F.greatest, max)):
        for ranges in (2, 7, 64):
            got = before_each(table, ["key"], "at", of, F.col("size"), merge, ranges)
            assert {r["at"]: r["before_"] for r in got.collect()} == plain(rows, fold)


def test_parts_of_a_large_batch(spark):
    rows = [("one", k, k % 5) for k in range(1000)] + [("two", 3, 7), (None, 1, 2), (None, 2, 4)]
    got = {(r["batch"], r["seq"]): r["offset"] for r in blobs.combined(spark.createDataFrame(rows, "batch string, seq long, size long")).collect()}
    assert len(got) == len(rows) and got["two", 3] == got[None, 1] == 0 and got[None, 2] == 2
    assert all(got["one", k] == sum(i % 5 for i in range(k)) for k in range(1000))


def test_late_updates_of_a_busy_key(spark):
    rows = [("k", n, n if n % 10 else 0, "Update") for n in range(1, 500)]
    got = sync.conflicts(spark.createDataFrame(rows, "key_id string, message_id long, version long, operation string"))
    assert sorted((r["message_id"], r["seen"]) for r in got.collect()) == [(n, n - 1) for n in range(10, 500, 10)]


def test_positions_of_a_log_that_was_dealt_out(spark):
    table = spark.createDataFrame([(f"{k:04}", k % 97, "w") for k in range(500)], "hash string, time long, clock_id string").repartition(5)
    want = sorted((k % 97, f"{k:04}") for k in range(500))
    assert sorted((r["pos"], r["hash"]) for r in log.with_positions(table).collect()) == [(n + 1, h) for n, (_, h) in enumerate(want)]


def test_empty_and_null_orders(spark):
    empty = spark.createDataFrame([], "batch string, seq long, size long")
    assert blobs.combined(empty).count() == 0
    none = spark.createDataFrame([("x", None, 3)], "batch string, seq long, size long")
    assert [r["offset"] for r in blobs.combined(none).collect()] == [0]
    assert log.with_positions(spark.createDataFrame([], "hash string, time long, clock_id string")).count() == 0
