"""Queries over all rows against plain Python on the smallest tables."""

import hashlib
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidelog.plans import registry

DIR = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("|".join(str(x) for x in parts if x is not None).encode()).hexdigest()


@pytest.fixture(scope="module")
def events():
    return sorted(pq.read_table(f"{DIR}/events.parquet").to_pylist(), key=lambda e: e["event_id"])


def got(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, DIR).collect())


def test_append(spark, events):
    base, want = max(e["event_id"] for e in events) + 1, []
    for k, e in enumerate(events):
        n_refs = sum(k >= 1 << b for b in range(7)) if k else len(events)
        want.append((base + k + 1, sha("events", base + k + 1, "w", e["props"]), n_refs))
    assert len(want) > 300 and got(spark, "log_append", "time", "hash", "n_refs") == sorted(want)


def test_append_gathers_no_heads_in_a_row(spark):
    plan = registry.QUERIES["log_append"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" in plan and "collect_" not in plan


def test_clock_compare(spark, events):
    entries = sorted((e["event_id"] + 1, str(e["user_id"]), sha(e["event_id"], e["user_id"], e["event_type"])) for e in events)
    want = [(a[2], b[2], (a[:2] > b[:2]) - (a[:2] < b[:2]), max(a[0], b[0]) + 1) for a, b in zip(entries, reversed(entries), strict=True)]
    assert got(spark, "log_clock_compare", "a", "b", "ordering", "merged") == sorted(want)


def test_traverse(spark):
    turns = {}
    for c in pq.read_table(f"{DIR}/conversations.parquet").to_pylist():
        turns.setdefault(c["conv_id"], {})[c["turn"]] = c["role"]
    want = set()
    for conv, own in turns.items():
        todo = [max(t for t in own if 2 * t <= min(own) + max(own))]
        while todo:
            t = todo.pop()
            if t in own and (conv, sha(conv, t)) not in want:
                want.add((conv, sha(conv, t)))
                todo += [t - 1, t - 2]
    assert len({c for c, _ in want}) > 5 and got(spark, "log_traverse", "log_id", "hash") == sorted(want)


def test_has(spark, events):
    assert got(spark, "ds_has", "key") == sorted((f"/ev/view/{e['event_id']:08}",) for e in events if e["event_type"] == "view")


def test_members(spark, events):
    before, after = ({f"{e['user_id']}/{e['event_id'] // 100}" for e in events if e["event_type"] == kind} for kind in ("signup", "purchase"))
    assert got(spark, "members_diff", "peer", "change") == sorted([(p, "left") for p in before - after] + [(p, "joined") for p in after - before])


def test_fresh_at_the_edge_of_the_hour(spark, tmp_path):
    top = datetime(2024, 1, 5, 12, 0, 0, 900001)
    ages = [timedelta(seconds=k) for k in (0, 1, 3599)] + [timedelta(seconds=3600, microseconds=k) for k in (-1, 0, 1, 500_000, 900_000, 900_001, 999_999)]
    rows = [(n, top - age, 1, "view", 0.0, None) for n, age in enumerate(ages)] + [(len(ages), None, 1, "view", 0.0, None)]
    columns = zip(*rows, strict=True)
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    kinds = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()]
    pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(con.sql(registry.ORACLES["keysync_fresh"]).fetchall())
    found = sorted(tuple(r) for r in registry.QUERIES["keysync_fresh"](spark, str(tmp_path)).collect())
    assert found == want == [(0,), (1,), (2,), (3,), (4,)]
