"""Logs and folds against a plain model, on random tables."""

import random

import pytest

from tidelog.operators import datastore, fold, log

GRAPH = "log_id string, hash string, next array<string>, time long, clock_id string, payload string"


def made(rng, n):
    rows = []
    for k in range(n):
        parents = rng.sample(rows, min(len(rows), rng.randint(0, 3)))
        time = 1 + max((p[3] for p in parents), default=0) + rng.randint(0, 1)
        names = [p[1] for p in parents]
        rows.append(("x", f"{rng.randrange(1 << 30):08x}", names + names[:1], time, rng.choice("abc"), str(k)))
    return rows


def in_order(rows):
    return [r[1] for r in sorted(rows, key=lambda r: (r[3], r[4], r[1]))]


@pytest.mark.parametrize("seed", range(4))
def test_log_model(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 25)
    a, b = rng.sample(rows, 18), rng.sample(rows, 18)
    frame = lambda x: spark.createDataFrame(x, GRAPH)
    hashes = lambda df: [r["hash"] for r in df.collect()]
    union = {r[1]: r for r in a + b}
    assert hashes(log.values(log.joined(frame(a), frame(b)))) == in_order(union.values())
    assert set(hashes(log.difference(frame(a), frame(b)))) == {r[1] for r in a} - {r[1] for r in b}
    named = {p for r in a for p in r[2]}
    assert set(hashes(log.heads(frame(a)))) == {r[1] for r in a} - named
    own = {r[1] for r in a}
    assert set(hashes(log.tails(frame(a)))) == {r[1] for r in a if not r[2] or any(p not in own for p in r[2])}
    order, full = in_order(rows), frame(rows).cache()
    for _ in range(4):
        n, x = rng.choice([-1, 0, 1, 3, 40]), rng.choice(order)
        at = order.index(x)
        cut = lambda items, first: items if n < 0 else items[:n] if first else items[max(0, len(items) - n) :] if n else []  # noqa: E731, B023
        assert hashes(log.list_store(full, amount=n)) == cut(order, False)
        assert hashes(log.list_store(full, amount=n, gte=x)) == cut(order[at:], True)
        assert hashes(log.list_store(full, amount=n, gt=x)) == cut(order[at + 1 :], True)
        assert hashes(log.list_store(full, amount=n, lte=x)) == cut(order[: at + 1], False)
        assert hashes(log.list_store(full, amount=n, lt=x)) == cut(order[:at], False)
        assert hashes(log.list_facade(full, amount=n, lte=x)) == cut(order[: at + 1], True)
    positions = {r["hash"]: r["pos"] for r in log.with_positions(full, buckets=4).collect()}
    assert positions == {h: k for k, h in enumerate(order, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_fold_model(spark, seed):
    rng = random.Random(seed)
    ops = [(k // 2, rng.choice("ab"), f"h{rng.random()}", rng.choice(["k1", "k2", "k3", ""]), rng.choice(["PUT", "PUT", "DEL", "ODD"]), rng.choice(["", "v1", "v2"])) for k in range(30)]
    df = spark.createDataFrame(ops, "time long, clock_id string, hash string, key string, op string, value string")
    steady, once = {}, {}
    for _, _, _, key, op, value in sorted(ops, key=lambda o: o[:3]):
        if not key:
            continue
        if op == "PUT" and value:
            steady[key] = once[key] = value
        else:
            once.pop(key, None)
            if op == "DEL":
                steady.pop(key, None)
    as_dict = lambda x: {r["key"]: r["value"] for r in x.collect()}
    assert as_dict(fold.current(df)) == steady and as_dict(fold.single_pass(df)) == once


@pytest.mark.parametrize("seed", range(3))
def test_page_model(spark, seed):
    rng = random.Random(seed)
    keys = sorted({f"/{rng.choice('ab')}{rng.randint(0, 30)}" for _ in range(40)})
    df = spark.createDataFrame([(k, "v") for k in keys], "key string, value string")
    for _ in range(4):
        prefix, limit, offset, desc = rng.choice(["", "/a", "/b1", "/c"]), rng.choice([None, 0, 1, 5]), rng.choice([0, 2, 50]), rng.random() < 0.5
        want = [k for k in keys if k.startswith(prefix)][offset:][: max(limit, 1) if limit is not None else None]
        assert [r["key"] for r in datastore.page(df, prefix, limit, offset, desc).collect()] == (want[::-1] if desc else want)
