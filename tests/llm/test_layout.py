"""Packing, sharding and the pipeline."""

import re
import zlib
from collections import defaultdict

import pytest

from tidelog.llm import packing, sharding

none_first = lambda x: (x is not None, x or 0)


def plain_jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_shards(docs, rows, empty):
    got = sharding.shard(docs, 7).collect()
    groups = defaultdict(list)
    for r in rows:
        data = (r[1] or "").encode()
        groups[plain_jump(r[0] or 0, 7)].append((r[0], zlib.crc32(data), len(data) + 16))
    want = []
    for s, own in groups.items():
        own.sort(key=lambda x: (none_first(x[0]), x[1], x[2]))
        want += [(i, n, c, "key", s, k, plain_jump(i or 0, 8)) for k, (i, c, n) in enumerate(own)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sharding.shard(empty, 7).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 40, 300])
def test_jump(spark, shards):
    df = spark.range(-300, 700)
    got = df.select("id", sharding.jump_shard(df["id"], shards).alias("s")).collect()
    assert all(r["s"] == plain_jump(r["id"], shards) for r in got)


def test_packing(docs, rows, empty):
    capacity = 128
    got = packing.pack(docs, capacity).collect()
    assert packing.pack(empty).count() == 0
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["n_words"] for r in got) == sum(size(r[1]) for r in rows)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["bin_id"]].append(r)
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: (r["bin_offset"], r["n_words"])):
            assert r["bin_offset"] == end
            end += r["n_words"]
        assert end <= capacity
    unique = {r[0]: r for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for i, r in unique.items():
        own = sorted(pieces[i], key=lambda x: x["start"])
        assert [x["start"] for x in own] == [k * capacity for k in range(len(own))] and sum(x["n_words"] for x in own) == size(r[1])
    sources = defaultdict(lambda: None, {i: r[3] for i, r in unique.items()})
    for own in bins.values():
        found = [sources[r["doc_id"]] for r in own if sources[r["doc_id"]] is not None]
        assert len(found) == len(set(found))


def test_best_fit_is_tightest():
    rows = [(60, "a", None), (50, "b", None), (40, "b", None), (30, "c", "x"), (10, "d", "x"), (8, "a", None), (0, "a", None)]
    bins, masks = {}, {}
    for k, _, b, offset, _, n in packing.packed(rows, 100):
        room = lambda x: 100 - bins[x]
        tags = {t for t in (("s", rows[k][1]), ("c", rows[k][2])) if t[1] is not None}
        fits = [x for x in bins if room(x) >= n and not masks[x] & tags]
        assert (b in bins and room(b) == min(map(room, fits))) if fits else b not in bins
        assert offset == bins.get(b, 0)
        bins[b] = bins.get(b, 0) + n
        masks[b] = masks.get(b, set()) | tags


def test_pipeline(spark, rows):
    """Each stage on all that the one before kept; its decisions against plain ones."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), None
    before = docs
    for k, (name, stage) in enumerate(p.STAGES):
        after = stage(spark, before, d).cache()
        assert after.count() > 0, name
        if k < 4:
            names = names or docs.columns
            assert after.columns == names and after.count() <= before.count()
            assert after.select("doc_id").distinct().count() == after.count()
            before = after
    assert after.select("doc_id").distinct().count() == before.count()
    assert p.run(spark, d).count() == after.count()


def test_pipeline_on_empty_and_odd_tables(spark, docs, empty):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    for _, stage in p.STAGES:
        assert stage(spark, empty, d).count() == 0
        assert stage(spark, docs, d).count() > 0
