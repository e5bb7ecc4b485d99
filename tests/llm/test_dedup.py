"""Exact, line and near dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidelog.llm import exact_dedup, line_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
none_first = lambda x: (x is not None, x or 0)


def test_exact(docs, rows):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = []
    for text, ids in groups.items():
        ids.sort(key=none_first, reverse=True)
        want += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_joins_the_filter_beyond_its_bound(docs, monkeypatch):
    from tidelog.llm import common

    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(common, "FILTER_BYTES", 0)
    monkeypatch.setattr(common, "HOT_GROUPS", 40)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == line_dedup.line_dedup(empty).count() == simhash.near_duplicates(empty).count() == 0


def without_later_copies(rows):
    """Texts by (doc_id, text), by comparing all runs of lines."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (none_first(d[0]), hashlib.md5(d[1].encode()).digest()))
    places = defaultdict(list)
    for d, (_, text) in enumerate(docs):
        plain = [x.strip(" ") for x in text.split("\n")]
        words = [max(1, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in plain]
        runs = set()
        for i in range(len(plain)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(plain):
                    total += words[j]
                    if total >= line_dedup.MIN_WORDS:
                        runs.add((min(i, j), max(i, j)))
                        break
                    j += step
        for a, b in sorted(runs):
            places[tuple(plain[a : b + 1])].append((d, a))
    gone = defaultdict(set)
    for run, found in places.items():
        first, *later = sorted(found)
        for d, a in later:
            gone[d] |= set(range(max(a, first[1] + len(run)) if d == first[0] else a, a + len(run)))
    return {(i, t): ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), len(gone[d])) for d, (i, t) in enumerate(docs)}


def test_lines(docs, rows):
    got = line_dedup.line_dedup(docs).collect()
    assert got[0].asDict().keys() - {"lines_deleted"} == set(docs.columns) - {"lines_deleted"}
    want = without_later_copies(rows)
    expected = [(r[0], *(want[r[0], r[1]] if r[1] is not None else (None, 0))) for r in rows]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["lines_deleted"]) for r in got))) == sorted(map(str, expected))
    assert sum(n for _, _, n in expected) > 20


def test_lines_across_longer_runs(spark, rows):
    """Short lines only, so that runs of many lines have to be compared."""
    short = [f"line {k % 37} of {k % 5}" for k in range(90)]
    some = [(1, "\n".join(short[:60])), (2, "\n".join(["other"] + short[20:50] + ["end"])), (3, "\n".join(short[40:70])), (4, "\n".join(short[5:12]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    want = without_later_copies(some)
    assert got == {i: want[i, t][0] for i, t in some}
    assert got[2] == "other\nend" and got[4] == some[3][1]


def maximal_runs(rows):
    """Lines that lie in a maximal repeated run of MIN_WORDS words: (doc, line) of all its occurrences, by comparing all
    pairs of places and extending each match as far as it goes."""
    docs = [(i, [x.strip(" ") for x in t.split("\n")]) for i, t in sorted(rows)]
    places = [(d, k) for d, (_, own) in enumerate(docs) for k in range(len(own))]
    covered = set()
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            a, b = docs[d][1], docs[e][1]
            if i and j and a[i - 1] == b[j - 1]:
                continue
            length = 0
            while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
                length += 1
            if sum(max(1, len(x.split())) for x in a[i : i + length]) >= line_dedup.MIN_WORDS:
                covered |= {(docs[d][0], k) for k in range(i, i + length)} | {(docs[e][0], k) for k in range(j, j + length)}
    return covered


@pytest.mark.parametrize("seed", range(2))
def test_against_maximal_runs(spark, seed):
    """A line goes only if it lies in a maximal repeated run, and every maximal run keeps each of its lines somewhere and
    loses it everywhere else."""
    rng = random.Random(seed)
    passages = [[" ".join(f"p{p}l{k}w{w}" for w in range(rng.randint(3, 30))) for k in range(rng.randint(2, 9))] for p in range(4)]
    rows = []
    for d in range(14):
        own = []
        for _ in range(rng.randint(1, 4)):
            own += rng.choice(passages) if rng.random() < 0.6 else [f"own {d} {rng.random()} of it" for _ in range(rng.randint(1, 3))]
        rows.append((d, "\n".join(own)))
    covered = maximal_runs(rows)
    left = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    said = defaultdict(int)
    for d, text in rows:
        for k, line in enumerate(text.split("\n")):
            if (d, k) in covered:
                said[line] += 1
            else:
                assert line in left[d]
    assert said
    for line in said:
        assert sum(own.count(line) for own in left.values()) < sum(t.split("\n").count(line) for _, t in rows)
        assert any(line in own for own in left.values())


def test_words_that_a_run_needs_are_a_parameter(spark):
    some = [(1, "a b c\nd e\nx"), (2, "a b c\nd e\ny"), (3, "d e\nz")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_words=4).collect()} == {1: some[0][1], 2: "y", 3: some[2][1]}


def test_words_of_lines_are_parted_by_white_space(spark):
    """Sixty words count as sixty whatever parts them; a few padded words don't count as many."""
    long = ["\t".join(f"t{k}" for k in range(60)), "\x0b".join(f"v{k}" for k in range(60)), " \t".join(f"b{k}" for k in range(60)) + "\r", "  ".join(f"s{k}" for k in range(50))]
    short = ["a" + " " * 60 + "b", "\t" * 60, "x" + " " * 30 + "y" + "\t" * 30 + "z", "  ".join(f"n{k}" for k in range(49))]
    same, tail = [(2 * k, x) for k, x in enumerate(long + short)], [(2 * k + 1, f"own {k}\n{x}") for k, x in enumerate(long + short)]
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in line_dedup.line_dedup(spark.createDataFrame(same + tail, "doc_id long, text string")).collect()}
    assert got == {i: (t, 0) for i, t in same} | {i: (f"own {i // 2}", 1) if i // 2 < len(long) else (t, 0) for i, t in tail}


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, i in enumerate(ids):
        groups[find(k)].append(i)
    least = {g: min((i for i in own if i is not None), default=None) for g, own in groups.items()}
    return [least[find(k)] for k in range(len(prints))]


def test_near(docs, rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, linked(prints, [r[0] for r in rows]), strict=True)]
    assert sorted(map(str, map(tuple, simhash.near_duplicates(docs).collect()))) == sorted(map(str, want))


def test_positions_cover_all_pairs():
    from itertools import combinations

    assert all(any(set(x) <= set(five) for x in simhash.POSITIONS) for five in combinations(range(8), simhash.LEAST_BYTES))


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_as_all_pairs_do(spark, seed):
    """Families of many near fingerprints, whose lists are long, and chains."""
    rng = np.random.default_rng(seed)
    found = set()
    for _ in range(4):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            flips = rng.choice(64, size=int(rng.integers(0, 5)), replace=False)
            found.add(base ^ sum(1 << int(b) for b in flips))
    prints = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = linked(prints, list(range(len(prints))))
    roots = defaultdict(set)
    for k, x in enumerate(signed):
        roots[want[k]].add(got.get(x, x))
    assert all(len(x) == 1 for x in roots.values()) and len({next(iter(x)) for x in roots.values()}) == len(roots)


def test_long_lists_are_split(monkeypatch):
    rng = np.random.default_rng(1)
    positions = simhash.POSITIONS[3]
    mask = np.uint64(sum(255 << 8 * i for i in range(8) if i not in positions))
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = base[rng.integers(0, 12, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    prints = np.unique(near & mask)
    whole = simhash.list_links(positions, prints)
    monkeypatch.setattr(simhash, "LONG_LIST", 16)
    split = simhash.list_links(positions, prints)

    def groups(edges):
        root = {int(x): int(x) for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*edges, strict=True):
            root[find(int(a))] = find(int(b))
        found = defaultdict(set)
        for x in root:
            found[find(x)].add(x)
        return sorted(map(sorted, found.values()))

    assert groups(whole) == groups(split) and len(whole[0]) < len(split[0])


def test_parts_of_lists_that_are_too_long_for_a_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) << np.uint64(1)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2000, 2), dtype=np.uint64), axis=1)
    prints = np.unique(base[rng.integers(0, 40, 2000)] ^ flips)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")

    def roots():
        return sorted((r["node"], r["root"]) for r in simhash.components(simhash.links(table)).collect())

    whole = roots()
    seen = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1]
    root = list(range(len(prints)))
    changed = True
    while changed:  # the least neighbour, until nothing changes
        before = list(root)
        for i, j in seen:
            root[i] = root[j] = min(root[i], root[j], key=lambda k: int(prints.view(np.int64)[k]))
        changed = before != root
    signed = prints.view(np.int64).tolist()
    linked = {k for pair in seen for k in pair}
    assert whole == sorted((signed[k], signed[root[k]]) for k in linked)
    monkeypatch.setattr(simhash, "SPLIT_LIST", 4)
    assert roots() == whole


def test_bits_that_parts_of_a_list_leave_free():
    for positions in simhash.POSITIONS:
        assert len(simhash.free_bits(positions)) == 32
        for part in range(1, 17):
            assert len(simhash.free_bits(positions, part)) == 18


def test_a_dense_list_is_split_until_short(monkeypatch):
    sizes = []
    monkeypatch.setattr(simhash, "forest", lambda x: (sizes.append(len(x)), (x[:0], x[:0]))[1])
    simhash.list_links((0, 1, 2, 3), np.arange(1 << 18, dtype=np.uint64) << np.uint64(32))
    assert sizes and max(sizes) <= simhash.LONG_LIST


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (900, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {got[k] for k in range(201)} == {0} and got[501] == got[500] == 500 and 900 not in got


def test_representatives(spark, docs, rows):
    """Of each component one row stays; ids that repeat with other texts, rows that repeat, and rows without an id."""
    extra = [(3, "another text under an id that is there already", "en", "s0", 1), (400, rows[5][1], "en", "s0", 1), (2, rows[40][1], "en", "s0", 1)]
    own = rows + extra
    df = spark.createDataFrame(own, docs.schema.fieldNames()[0] + " long, text string, lang string, source string, n_chars long").repartition(3)
    prints = [plain_fingerprint(r[1]) for r in own]
    group = linked(prints, list(range(len(own))))
    digest = {r["text"]: r["h"] for r in df.selectExpr("text", "if(text is null, null, xxhash64(text)) as h").collect()}
    best = {}
    for k, r in enumerate(own):
        key = (r[0] is None, r[0] or 0, digest[r[1]] is not None, digest[r[1]] or 0)
        best[group[k]] = min(best.get(group[k], (key, r)), (key, r), key=lambda x: x[0])
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(str(r[:2]) for _, r in best.values())
    assert simhash.representatives(df.limit(0)).count() == 0 and len(best) < len(own) - 5
