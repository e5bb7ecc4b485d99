"""Stores on Parquet, end to end."""

import json

import pytest

from tidelog.sources.store import Database


def test_key_value(spark, tmp_path):
    kv = Database(spark, str(tmp_path)).key_value("settings")
    for key, value in (("name", "a"), ("version", "1"), ("language", "x"), ("version", "2")):
        kv.put(key, value)
    kv.delete("language")
    assert {r["key"]: r["value"] for r in kv.all().collect()} == {"name": "a", "version": "2"}
    again = Database(spark, str(tmp_path)).key_value("settings")
    assert again.get("version").first()["value"] == "2"
    with pytest.raises(LookupError):
        again.delete("language")
    with pytest.raises(ValueError):
        again.put("", "x")


def test_event_log_and_snapshot(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    events = db.log("events")
    events.add(*[f"e{k}" for k in range(5)])
    events.add("e5")
    assert [r["payload"] for r in events.list(amount=3).collect()] == ["e3", "e4", "e5"]
    middle = events.list(amount=-1).collect()[2]["hash"]
    assert [r["payload"] for r in events.list(gte=middle, amount=2).collect()] == ["e2", "e3"]
    assert events.get(middle).first()["payload"] == "e2"
    with pytest.raises(LookupError):
        events.get("0" * 64)
    events.snapshot(str(tmp_path / "snap"))
    late = Database(spark, str(tmp_path / "other"), writer="late").log("events")
    late.load(str(tmp_path / "snap"))
    late.load(str(tmp_path / "snap"))
    assert late.log().count() == 6


def test_an_entry_names_all_heads(spark, tmp_path):
    """More heads than 64, from as many replicas."""
    from tidelog.operators import log

    db = Database(spark, str(tmp_path))
    events = db.log("events")
    other = [("events", f"h{k}", [], 1, f"w{k}", "ADD", f"p{k}") for k in range(70)]
    events.sync(spark.createDataFrame(other, "log_id string, hash string, next array<string>, time long, clock_id string, op string, payload string"))
    events.add("after", "later")
    made = {r["payload"]: r for r in events.log().where("payload in ('after', 'later')").collect()}
    assert sorted(made["after"]["next"]) == sorted(r[1] for r in other) and made["later"]["next"] == [made["after"]["hash"]]
    assert [r["payload"] for r in log.heads(events.log()).collect()] == ["later"]


def test_documents(spark, tmp_path):
    docs = Database(spark, str(tmp_path)).docs("projects")
    docs.put(*(json.dumps({"_id": f"project-{k}", "type": t, "stars": n}) for k, t, n in ((1, "database", 100), (2, "network", 500), (3, "network", 1000))))
    assert docs.query(lambda x: x["type"] == "network").count() == 2
    docs.delete("project-2")
    assert {r["key"] for r in docs.get("project", partial=True).collect()} == {"project-1", "project-3"}
    for bad in ('{"x":1}', '{"_id":""}'):
        with pytest.raises(ValueError):
            docs.put(bad)
    with pytest.raises(ValueError):
        docs.put()


def test_catalog(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create("a", "keyvalue")
    with pytest.raises(ValueError):
        db.create("a", "keyvalue")
    with pytest.raises(ValueError):
        db.open("a", "document")
    with pytest.raises(LookupError):
        db.open("b")
    assert [r["name"] for r in db.stores().collect()] == ["a"]


def test_keys_lie_in_folders(spark, tmp_path):
    kv = Database(spark, str(tmp_path)).key_value("many")
    for k in range(6):
        kv.put(f"k{k % 3}", str(k))
    plan = kv.get("k1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(key,k1)" in plan
    assert kv.get("k1").first()["value"] == "4"
    small = kv.table.compacted(str(tmp_path / "small"))
    assert sorted(r["hash"] for r in small.read().collect()) == sorted(r["hash"] for r in kv.log().collect())
    assert small.of_key("k2").count() == 2


def test_ranges_reach_the_scan(spark, tmp_path):
    events = Database(spark, str(tmp_path)).log("e")
    events.add(*[f"p{k}" for k in range(6)])
    middle = events.list().collect()[3]["hash"]
    found = events.list(gte=middle)
    assert "GreaterThanOrEqual(time,4)" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["payload"] for r in found.collect()] == ["p3", "p4", "p5"]


def test_access_list_and_views(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    acl = db.access("acl")
    acl.grant("write", "a", "b", "", "a")
    acl.grant("admin", "c")
    acl.revoke("write", "b")
    assert {tuple(r) for r in acl.grants().collect()} == {("write", "a"), ("admin", "c")}
    with pytest.raises(ValueError):
        acl.grant("write", "")
    db.key_value("kv").put_all({"x": "1", "y": "2"})
    assert db.views("v_") == ["v_acl", "v_kv"]
    assert spark.sql("SELECT role, value FROM v_acl CROSS JOIN v_kv WHERE v_kv.key = 'y' ORDER BY role").collect() == [("admin", "2"), ("admin", "2"), ("write", "2")]


def test_only_granted_entries_are_synced(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    events, acl = db.log("e"), db.access("acl")
    acl.grant("write", "ida")
    schema = "hash string, log_id string, time long, clock_id string, next array<string>, payload string, identity_id string, pub_key string"
    rows = [("h1", "e", 1, "w", [], "p", "ida", "k"), ("h2", "e", 2, "w", [], "p", "idb", "k"), ("h3", "e", 3, "w", [], "", "ida", "k")]
    events.sync(spark.createDataFrame(rows, schema), acl.grants())
    assert [r["hash"] for r in events.log().collect()] == ["h1"]


def test_documents_in_one_operation(spark, tmp_path):
    """PUTALL is one entry; another replica that takes it in has all its documents; a later put or delete of one wins."""
    a, b = (Database(spark, str(tmp_path / w), writer=w).docs("d") for w in "ab")
    a.put_all('{"_id": "x", "n": 1}', '{"_id": "y", "n": 2}', '{"_id": "x", "n": 3}')
    assert a.log().count() == 1
    a.put_batch('{"_id": "z", "n": 4}', '{"_id": "w", "n": 5}')
    b.sync(a.log())
    assert {(r["key"], r["body"]) for r in b.all().collect()} == {("x", '{"_id": "x", "n": 3}'), ("y", '{"_id": "y", "n": 2}'), ("z", '{"_id": "z", "n": 4}'), ("w", '{"_id": "w", "n": 5}')}
    b.delete("x")
    assert {r["key"] for r in b.all().collect()} == {"y", "z", "w"}
    before = a.log().count()
    with pytest.raises(ValueError):
        a.put_all('{"_id": "ok"}', '{"no": "key"}')
    assert a.log().count() == before


def test_catalog_has_one_row_a_name(spark, tmp_path):
    db = Database(spark, str(tmp_path), writer="w")
    db.create("s", "keyvalue").put("k", "v")
    address = db.address("s")
    assert db.open_address(address).kind == "keyvalue"
    db.create("s", "eventlog", overwrite=True)
    assert [r["type"] for r in db.stores().collect()] == ["eventlog"] and db.open("s").kind == "eventlog" and db.address("s") != address
    with pytest.raises(LookupError):
        db.open_address(address)
    db.drop("s")
    assert db.stores().count() == 0
    with pytest.raises(LookupError):
        db.open("s")


def test_load_more(spark, tmp_path):
    a, b = (Database(spark, str(tmp_path / w), writer=w).log("l") for w in "ab")
    a.add("1", "2", "3", "4")
    heads = a.log().where("payload = '4'").select("hash")
    b.load_more(a.log(), heads, amount=2)
    assert {r["payload"] for r in b.log().collect()} == {"4", "3"}
    b.load_more(a.log(), a.log().where("payload = '2'").select("hash"))
    assert b.log().count() == 4
