"""The catalogued fixtures of FIXTURES.md, by number, where other tests don't have them."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, keys
from tidelog.operators import acl, datastore, documents, fold, log
from tidelog.sources.store import Database

GRAPH = "log_id string, hash string, next array<string>, time long, clock_id string, payload string"
OPS = "time long, clock_id string, hash string, key string, op string, value string"


def ops(spark, *items):
    return spark.createDataFrame([(n, "w", f"h{n}", k, op, v) for n, (op, k, v) in enumerate(items, 1)], OPS)


def state(df):
    return {r["key"]: r["value"] for r in fold.current(df).collect()}


def test_f3_f4_appends_by_changing_writers(spark):
    entries = spark.createDataFrame([], GRAPH)
    for writer, text in zip("abc", ("one", "two", "three"), strict=True):
        new = log.appended(entries, spark.createDataFrame([(1, "x", writer, text)], "seq long, log_id string, clock_id string, payload string"))
        entries = spark.createDataFrame(entries.unionByName(new.select(*entries.columns)).collect(), GRAPH)
    rows = log.values(entries).collect()
    assert [(r["time"], r["clock_id"], r["payload"]) for r in rows] == [(1, "a", "one"), (2, "b", "two"), (3, "c", "three")]
    record = json.loads(log.head_record(entries).first()["record"])
    assert record == {"id": "x", "heads": [rows[2]["hash"]]}


def test_f5_joins(spark):
    words = lambda ws, w: [("x", f"{w}{k}", [f"{w}{k - 1}"] if k else [], k + 1, w, t) for k, t in enumerate(ws)]
    x, y, z = (spark.createDataFrame(words(ws, w), GRAPH) for ws, w in ((["to", "set", "your", "global"], "x"), (["second", "third", "fifth", "seventh"], "y"), (["second", "third", "fourth", "sixth", "eighth"], "z")))
    once = log.joined(y, z)
    assert once.count() == log.joined(once, z).count() == 9
    assert log.join_truncated(x, once, 10).count() == 10


def test_f6_f9_newest_entries(spark):
    df = spark.createDataFrame([("x", f"h{k:02}", [], k, "w", str(k)) for k in range(50)], GRAPH)
    assert [r["payload"] for r in log.list_store(df, amount=10).collect()] == [str(k) for k in range(40, 50)]
    assert log.list_store(df.limit(5), amount=3).count() == 3


def test_f11_f12_f13_folds(spark):
    many = [("PUT", "status", "active"), ("PUT", "counter", "0"), ("PUT", "temp", "x"), ("PUT", "status", "inactive"), ("PUT", "counter", "42"), ("DEL", "temp", None)]
    assert state(ops(spark, *many)) == {"status": "inactive", "counter": "42"}
    assert set(state(ops(spark, ("PUT", "k1", "a"), ("PUT", "k2", "b"), ("PUT", "k3", "c"), ("DEL", "k2", None)))) == {"k1", "k3"}
    assert state(ops(spark, ("PUT", "k", "value1"), ("PUT", "k", "value2"), ("DEL", "k", None))) == {}
    assert state(ops(spark, ("PUT", "k", "value1"), ("DEL", "k", None), ("PUT", "k", "value2"))) == {"k": "value2"}


def test_f16_f18_documents(spark):
    bodies = [{"_id": "user1", "name": "a"}, {"_id": "user2"}, {"_id": "admin1", "nested": {"level1": {"level2": {"value": "deep"}}}, "array": [1, 2, 3, 4, 5], "mixed": [{"key": "v"}]}]
    df = spark.createDataFrame([(b["_id"], json.dumps(b)) for b in bodies], "key string, body string")
    assert documents.query(df, documents.field(F.col("body"), "$._id").startswith("user")).count() == 2
    assert documents.query_callable(df, lambda x: x["_id"].startswith("user")).count() == 2
    deep = df.where("key = 'admin1'").select(documents.field(F.col("body"), "$.nested.level1.level2.value"), documents.field(F.col("body"), "$.array[0]"), documents.field(F.col("body"), "$.mixed[0].key")).first()
    assert list(deep) == ["deep", "1", "v"]


def test_f20_f21_f22_replicas(spark, tmp_path):
    a, b = (Database(spark, str(tmp_path / w), writer=w).log("shared") for w in "ab")
    a.add(*[f"a{k}" for k in range(5)])
    b.add(*[f"b{k}" for k in range(5)])
    mine, theirs = spark.createDataFrame(a.log().collect(), a.log().schema), spark.createDataFrame(b.log().collect(), b.log().schema)
    a.sync(theirs)
    b.sync(mine)
    assert {r["hash"] for r in a.log().collect()} == {r["hash"] for r in b.log().collect()} and a.log().count() == 10
    late = Database(spark, str(tmp_path / "c"), writer="c").log("shared")
    late.sync(a.log())
    late.add("late")
    a.sync(late.log())
    assert a.log().count() == 11 and a.list(amount=1).first()["payload"] == "late"
    assert Database(spark, str(tmp_path / "a")).log("other").log().count() == 0


def test_f23_f24_datastore(spark):
    df = spark.createDataFrame([("/a", "xx"), ("/b", "x" * 11), ("/c", "x" * 5)], "key string, value string")
    assert datastore.at_least(df, 5).count() == 2 and datastore.totals(df).first()["n_bytes"] == 18
    below = spark.range(1).select(keys.is_descendant(F.lit("/users/alice/profile"), F.lit("/users/alice")), keys.is_descendant(F.lit("/users/alice/profile"), F.lit("/users/bob"))).first()
    assert list(below) == [True, False]


def test_f25_order_of_insertion(spark):
    pairs = [(f"key{k}", k) for k in range(50)]
    a, b = ({k: v for k, v in p} for p in (pairs, pairs[::-1]))
    df = spark.createDataFrame([(a,), (b,)], "m map<string, long>").select(codec.canonical_map(F.col("m")).alias("t"))
    assert df.select(F.sha2("t", 256)).distinct().count() == 1


def test_f26_access(spark):
    grants = spark.createDataFrame([("write", "k1")], "role string, key string")
    twice = acl.granted(acl.granted(grants, grants), spark.createDataFrame([("write", "k2")], "role string, key string"))
    assert twice.count() == 2 and acl.stats(twice).first()["n_keys"] == 2
    assert acl.revoked(twice, twice).count() == 0
    cloned = acl.cloned(acl.by_role(twice), "write", "admin")
    assert {r["role"]: r["keys"] for r in cloned.collect()} == {"write": ["k1", "k2"], "admin": ["k1", "k2"]}


@pytest.mark.parametrize(("address", "valid"), [("", False), ("  padded  ", True), ("a/_access", True), ("a/", True), ("a/../b", False), ("a//b", False), ("x" * 1000, True), ("x" * 1001, False)])
def test_f27_addresses(spark, address, valid):
    assert spark.range(1).select(keys.is_acl_address(F.lit(address))).first()[0] is valid


@pytest.mark.parametrize(("key", "value"), [(None, "v"), ("k", None), ("k", ""), ("k", "\x00\x01ÿ"), ("ключ", "значение 日本")])
def test_f28_round_trip(spark, key, value):
    packed = codec.packed(codec.operation(F.lit(key).cast("string"), F.lit("PUT"), F.lit(value).cast("string")))
    got = spark.range(1).select(codec.unpacked(packed).alias("o")).select("o.*").first()
    assert (got["key"], got["op"], got["value"], got["docs"]) == (key, "PUT", value, [])
