"""Laws of logs and folds on small literal tables."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import clock, codec, keys
from tidelog.operators import acl, documents, fold, log, sync, telemetry
from tidelog.streaming.replication import versioned

GRAPH = "log_id string, hash string, next array<string>, time long, clock_id string, payload string"


def graph(spark, rows):
    return spark.createDataFrame([("x", h, n, t, c, h.upper()) for h, n, t, c in rows], GRAPH)


def hashes(df):
    return [r["hash"] for r in df.collect()]


@pytest.fixture(scope="module")
def chain(spark):
    """a <- b <- c, a <- d, with repeated and skipping parents."""
    return graph(spark, [("a", [], 1, "w1"), ("b", ["a", "a"], 2, "w1"), ("c", ["b", "a"], 3, "w1"), ("d", ["a"], 2, "w2")]).cache()


def test_unlinked_entries_in_order_of_writer(spark):
    assert hashes(log.values(graph(spark, [("h3", [], 0, "C"), ("h1", [], 0, "A"), ("h2", [], 0, "B")]))) == ["h1", "h2", "h3"]


def test_equal_clocks_are_all_heads(spark):
    assert set(hashes(log.heads(graph(spark, [("e1", [], 1, "A"), ("e2", [], 1, "A"), ("e3", [], 1, "A")])))) == {"e1", "e2", "e3"}


def test_heads_tails_dangling(chain):
    assert set(hashes(log.heads(chain))) == {"c", "d"}
    assert hashes(log.tails(chain)) == ["a"]
    part = chain.where("hash != 'a'")
    assert set(hashes(log.tails(part))) == {"b", "d", "c"}
    assert {tuple(r) for r in log.dangling(part).collect()} == {("b", "a"), ("c", "a"), ("d", "a")}


def test_traverse(chain):
    roots = chain.where("hash = 'c'")
    assert hashes(log.traverse(chain, roots)) == ["c", "b", "a"]
    assert hashes(log.traverse(chain, roots, amount=2)) == ["c", "b"]
    assert hashes(log.traverse(chain, roots, end_hash="b")) == ["c", "b"]


def test_traverse_of_a_long_chain(spark):
    """Thousands of generations of one writer, with further references, a gap, and branches that hang on other parents."""
    n = 3000
    rows = [(f"m{k}", [f"m{k - b}" for b in (1, 2, 4) if k >= b], 2 * k, "w1") for k in range(n)]
    rows += [(f"s{k}", [f"s{k - 1}"] if k else ["gone"], 2 * k + 1, "w2") for k in range(600)] + [("merge", [f"m{n - 1}", "s599"], 2 * n, "w1"), ("apart", [], 5, "w3")]
    long = graph(spark, rows).cache()
    roots = long.where("hash = 'merge'")
    found = hashes(log.traverse(long, roots))
    assert len(found) == n + 601 and "apart" not in found and found[:2] == ["merge", f"m{n - 1}"] and found[-1] == "m0"
    assert hashes(log.traverse(long, long.where("hash = 'm700'"), end_hash="m698")) == ["m700", "m699", "m698"]
    assert set(hashes(log.difference(long, long.where("hash = 'm10'"), root_limit=10))) == {r[0] for r in rows} - {"m10"}


def test_join_laws(spark, chain):
    a, b = chain.where("hash != 'd'"), chain.where("hash != 'c'")
    once, other = log.joined(a, b), log.joined(b, a)
    assert set(hashes(once)) == set(hashes(other)) == {"a", "b", "c", "d"}
    assert set(hashes(log.joined(once, b))) == set(hashes(once))
    assert hashes(log.join_truncated(a, b, 2).orderBy("time")) == ["d", "c"]
    assert set(hashes(log.difference(a, b))) == {"c"}
    assert set(hashes(log.difference(a, b, root_limit=10))) == {"c"}


def test_list_modes(chain):
    names = lambda **k: hashes(log.list_store(chain, **k))
    assert names(amount=2) == ["d", "c"] and names(amount=0) == [] and names(amount=-1) == ["a", "b", "d", "c"]
    assert names(amount=2, gte="b") == ["b", "d"] and names(amount=1, gt="b") == ["d"] and names(amount=1, lte="d") == ["d"]
    assert names(amount=5, lt="d") == ["a", "b"] and names(gte="none") == [] and names(gt="b", gte="a") == ["b", "d", "c"]
    facade = lambda **k: hashes(log.list_facade(chain, **k))
    assert facade(amount=2) == ["a", "b"] and facade(gte="b", lt="c") == ["b", "d"] and facade(amount=-2) == [] and facade(gte="b", lte="none") == []


def test_positions(chain):
    assert [r["pos"] for r in log.with_positions(chain).orderBy(*clock.ascending()).collect()] == [1, 2, 3, 4]
    assert hashes(log.positions_between(chain, 1, 3)) == ["b", "d"] and hashes(log.positions_between(chain, 3, 1)) == []
    assert hashes(log.first_children(chain).where("hash = 'a'")) == ["a"]


def test_append(spark, chain):
    new = spark.createDataFrame([(k, "x", "w3", f"p{k}") for k in range(1, 4)], "seq long, log_id string, clock_id string, payload string")
    rows = log.appended(chain, new).orderBy("time").collect()
    assert [r["time"] for r in rows] == [4, 5, 6] and rows[0]["next"] == ["c", "d"] and rows[2]["next"][0] == rows[1]["hash"]
    assert hashes(log.heads(chain.unionByName(log.appended(chain, new)))) == [rows[2]["hash"]]


def test_append_to_many_heads(spark, chain):
    loose = spark.createDataFrame([("x", f"h{k:04}", [], 3, "w") for k in range(500)], "log_id string, hash string, next array<string>, time long, clock_id string")
    new = spark.createDataFrame([(k, "x", "w3", f"p{k}") for k in range(1, 6)], "seq long, log_id string, clock_id string, payload string")
    entries, links = log.appended_apart(loose, new)
    rows, linked = entries.orderBy("time").collect(), links.collect()
    own = [r["hash"] for r in rows]
    assert sorted((r["child"], r["parent"]) for r in linked) == [(own[0], f"h{k:04}") for k in range(500)]
    assert [r["next"] for r in rows] == [[], own[:1], [own[1], own[0]], [own[2], own[1]], [own[3], own[2], own[0]]]
    whole = log.appended(loose, new).orderBy("time").collect()
    assert [r["hash"] for r in whole] == own and whole[0]["next"] == [f"h{k:04}" for k in range(500)] and [r["next"] for r in whole[1:]] == [r["next"] for r in rows[1:]]
    assert [r["next"] for r in log.appended(loose.limit(0), new).orderBy("time").collect()] == [r["next"] for r in log.appended_apart(loose.limit(0), new)[0].orderBy("time").collect()]


OPS = "time long, clock_id string, hash string, key string, op string, value string"


@pytest.mark.parametrize(
    ("ops", "steady", "once"),
    [
        (["PUT a", "PUT b", "DEL "], {}, {}),
        (["PUT a", "DEL ", "PUT b"], {"k": "b"}, {"k": "b"}),
        (["PUT a", "PUT "], {"k": "a"}, {}),
        (["PUT a", "ODD b"], {"k": "a"}, {}),
    ],
)
def test_folds(spark, ops, steady, once):
    rows = [(n, "w", f"h{n}", "k", *x.split(" ")) for n, x in enumerate(ops, 1)]
    df = spark.createDataFrame(rows, OPS)
    assert {r["key"]: r["value"] for r in fold.current(df).collect()} == steady
    assert {r["key"]: r["value"] for r in fold.single_pass(df).collect()} == once


def test_document_keys(spark):
    bodies = ['{"_id":"a"}', '{"x":1}', '{"_id":""}', '{"_id":3}', "[1]", "nope", '{"_id":"b","n":[1,2]}']
    df = spark.createDataFrame([(x,) for x in bodies], "body string")
    good, bad = documents.checked(df)
    assert sorted(r["key"] for r in good.collect()) == ["a", "b"]
    assert {r["body"]: r["problem"] for r in bad.collect()} == {'{"x":1}': "field missing", '{"_id":""}': "empty", '{"_id":3}': "not text", "[1]": "not an object", "nope": "not json"}


def test_keys(spark):
    one = spark.range(1)
    got = one.select(
        keys.normalised(F.lit(" users//alice/ ")), keys.parent(F.lit("/a/b")), keys.parent(F.lit("/")), keys.is_descendant(F.lit("/users/alice/profile"), F.lit("/users/alice")),
        keys.is_descendant(F.lit("/users/bob"), F.lit("/users/al")), keys.has_prefix(F.lit("/users/alice"), "/users/al"), keys.depth(F.lit("/")), keys.last_segment(F.lit("/")),
    ).first()
    assert list(got) == ["/users/alice", "/a", None, True, False, True, 0, None]


def test_codec_rejects_bad_payload(spark):
    assert spark.range(1).select(codec.unpacked(F.lit("%%%"))).first()[0] is None


def test_acl(spark):
    grants = spark.createDataFrame([("write", "a"), ("admin", "b")], "role string, key string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "pub_key string")
    assert [r[0] for r in acl.allowed(asked, grants, ["write"], ["pub_key"]).collect()] == ["a"]
    assert {r[0] for r in acl.can_read(asked, grants).collect()} == {"a"}
    anyone = grants.unionByName(spark.createDataFrame([("write", "*")], "role string, key string"))
    assert acl.allowed(asked, anyone, ["write"], ["pub_key"]).count() == 4
    assert set(map(tuple, acl.effective(grants).collect())) == {("write", "a"), ("admin", "b"), ("admin", "a")}
    with pytest.raises(LookupError):
        acl.cloned(acl.by_role(grants), "none", "x")


@pytest.mark.parametrize(("outcomes", "mode"), [("f" * 4, "closed"), ("f" * 5, "open"), ("fffffs", "closed"), ("ffsffff", "closed"), ("ffsfffff", "open")])
def test_breaker(spark, outcomes, mode):
    df = spark.createDataFrame([("n", k, c == "s") for k, c in enumerate(outcomes)], "node string, seq long, ok boolean")
    assert sync.breaker(df).first()["mode"] == mode


def test_breaker_folds_all_outcomes(spark):
    """As the step gives it, on runs beyond any bound, in any order of rows, for a null outcome and a null node."""
    runs = {"long": "s" + "f" * 2500, "all": "f" * 1300, "healed": "f" * 1200 + "s", "late": "f" * 1200 + "s" + "f" * 4, "odd": "sfn", None: "fs" * 5 + "f" * 6, "good": "sss"}
    df = spark.createDataFrame([(n, k, {"s": True, "f": False, "n": None}[c]) for n, o in runs.items() for k, c in reversed(list(enumerate(o)))], "node string, seq long, ok boolean")
    want = {n: len(o) - len(o.rstrip("fn")) for n, o in runs.items()}
    assert {r["node"]: (r["mode"], r["failures"]) for r in sync.breaker(df).collect()} == {n: ("open" if k >= sync.OPENS_AFTER else "closed", k) for n, k in want.items()}
    step = F.struct(F.lit("closed").alias("mode"), F.lit(0).alias("failures"), F.lit(0).alias("successes"))
    for n in ("late", "odd", None):
        folded = spark.range(1).select(F.aggregate(F.split(F.lit(runs[n]), ""), step, lambda s, x: sync.breaker_step(s, x == "s")).alias("s")).first()["s"]
        assert folded["failures"] == want[n]


def test_running_averages(spark):
    xs = [3.0, 5.0, 4.0, 10.0]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(xs)], "series string, seq long, x double")
    a, h = xs[0], 0.0
    for x in xs[1:]:
        a = a * 0.9 + x * 0.1
    for x in xs:
        h = (h + x) / 2
    assert telemetry.ewma(df, 0.1).first()["ewma"] == pytest.approx(a)
    assert telemetry.halving(df).first()["average"] == pytest.approx(h)
    assert telemetry.percentile_floor(df, 0.5).first()["value"] == 5.0


def test_versions():
    assert versioned(None, 3, "Update") == (None, "missing") and versioned(3, 3, "Create") == (3, "ignored") and versioned(3, 2, "Update") == (3, "conflict")
    assert versioned(3, 3, "Update") == (3, "updated") and versioned(3, 1, "Delete") == (None, "deleted") and versioned(None, 1, "Create") == (1, "created")


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_fresh_by_fractions_of_seconds(spark, kind, zone):
    # 00:30 UTC on 31 March 2024 to 01:30, when clocks in Berlin go from 2 to 3: as a written time, 02:30 isn't on them.
    now = 1711848600_900001 if kind == "timestamp" else 1711852200_900001
    ages = {-1: False, 0: True, 1: True, 3599_999999: True, 3600_000000: True, 3600_000001: False, 3600_900000: False, 3601_000000: False, -900_000: False}
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        df = spark.createDataFrame([(age, now - age) for age in ages], "age long, at long").select("age", F.timestamp_micros("at").cast(kind).alias("ts"), F.timestamp_micros(F.lit(now)).cast(kind).alias("top"))
        df = df.localCheckpoint()
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {r["age"] for r in sync.fresh(df, F.col("top"), 3600).collect()} == {age for age, taken in ages.items() if taken}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
