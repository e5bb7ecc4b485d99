"""Near-duplicate detection on 64-bit SimHash fingerprints.

Texts with fingerprints of at most 3 differing bits are linked. Such fingerprints share at least 5 of their 8 bytes, so the
index is by byte positions: a posting list holds the distinct fingerprints that agree in the bytes at 4 positions. The 14
sets of positions are those whose numbers XOR to 0; every 5 positions contain exactly one of them, so no pair is missed and
lists stay 2**16 times shorter than those of single bytes. In a list the shared bytes of pairs are tallied, pairs with
fewer than 5 are left, and the rest verified bit by bit. Copies share a fingerprint and enter the index once; of a list's
links only a spanning forest leaves the task, because only reachability counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BITMAP_BITS, bitmaps, join_groups, let, looked_up, power_of_two, texts, written

SEED = 42
SHINGLE = 3  # words
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
#: Sets of 4 byte positions; any 5 positions contain one of them.
POSITIONS = [x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0]
HASHED_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 128
BITS_A_ROW = 32  # of the filter of rows that go
SHORT_LIST, LONG_LIST = 8, 1 << 14
SPLIT_LIST = 1 << 20
PART_AT, BLOCK_AT = 36, 41  # where a key says which part of a list it is of, and in which bits that part agrees
LOWEST = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text whose A-Z are lower-cased here; words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHED_AT_ONCE):
        cut = slice(at, min(n, at + HASHED_AT_ONCE))
        spans = map(joined.__getitem__, map(slice, starts[cut].tolist(), last[cut].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, cut.stop - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and digest (a hash of the whole text) of every row; a null text has no
    words, and no digest."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = (texts(batch.column(1).slice(at, ROWS_AT_ONCE)) for at in range(0, batch.num_rows, ROWS_AT_ONCE))
            found = np.fromiter((fingerprint(x) for cut in cuts for x in cut), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    return chosen.mapInArrow(printed, "doc_id long, fp long, digest long")


def _digest(text_col: str) -> Column:
    return F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the pairs share the least number of bytes, then whether their bits are near."""
    apart = x ^ y
    folded = apart | apart >> np.uint64(4)  # then the lowest bit of each byte tells whether the byte differs
    folded |= folded >> np.uint64(2)
    folded |= folded >> np.uint64(1)
    folded &= LOWEST
    shared = 8 - np.bitwise_count(folded) >= LEAST_BYTES
    return shared & (np.bitwise_count(apart) <= MOST_BITS)


def _blocks(free: list[int]) -> list[list[int]]:
    """The free bits in as many blocks as there are allowed differences and one more: linked fingerprints agree in one."""
    return [x.tolist() for x in np.array_split(np.array(free, np.int64), MOST_BITS + 1)]


def _without(free: list[int], n: int) -> list[int]:
    return [bit for k, block in enumerate(_blocks(free)) if k != n for bit in block]


def free_bits(positions: tuple[int, ...], part: int = 0) -> list[int]:
    """Bits in which fingerprints of a list may differ: those of the other byte positions, less what a part fixes."""
    free = [8 * i + bit for i in range(8) if i not in positions for bit in range(8)]
    return _without(_without(free, (part - 1) // 4), (part - 1) % 4) if part else free


def list_links(positions: tuple[int, ...], prints: np.ndarray, part: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in the list of fingerprints that agree at the positions, or in a part of it."""
    found = list(_split_links(prints, free_bits(positions, part)))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))


def _split_links(prints: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long list is split by each block of its free bits in turn, of which a pair has to agree in one: first by bytes, then
    by fewer bits. After three splits 14 bits at most are free, so no list is longer than 2**14."""
    if len(prints) <= LONG_LIST or len(free) <= MOST_BITS:
        yield forest(prints)
        return
    for n, block in enumerate(_blocks(free)):
        own = prints & np.uint64(sum(1 << bit for bit in block))
        order = np.argsort(own, kind="stable")
        for x in np.split(prints[order], np.flatnonzero(np.diff(own[order])) + 1):
            if len(x) > 1:
                yield from _split_links(x, _without(free, n))


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in a list of distinct fingerprints, without a cycle."""
    rest, out = prints, ([], [])
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near(rest, x)
            if near.any():
                found, rest = rest[near], rest[~near]
                out[0].extend(repeat(x, len(found)))
                out[1].extend(found)
                front.extend(found)
    return np.array(out[0], np.uint64), np.array(out[1], np.uint64)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the posting lists, which come sorted by key; a list may go on in the next batch."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        sizes = ends - starts
        short = np.repeat(sizes <= SHORT_LIST, sizes)
        a, b = [], []
        for d in range(1, SHORT_LIST):
            near = short[:-d] & (keys[:-d] == keys[d:])
            at = np.flatnonzero(near)
            at = at[_near(prints[at], prints[at + d])]
            a.append(prints[at])
            b.append(prints[at + d])
        for k in np.flatnonzero(sizes > SHORT_LIST).tolist():
            key = int(keys[starts[k]])
            x, y = list_links(POSITIONS[key >> 32 & 15], prints[starts[k] : ends[k]], key >> PART_AT & 31)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
        prints = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        whole = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
        if whole:
            yield from links(keys[:whole], prints[:whole])
        held_keys, held = keys[whole:], prints[whole:]
    if len(held_keys):
        yield from links(held_keys, held)


def _part_keys(key: Column, fp: Column) -> Column:
    """Keys of the 16 parts of a list that a fingerprint is in: those that agree in a further byte, then in a block of 6 of
    the 24 bits that are left. Every pair that is linked agrees so in one part, and a part has 2**18 fingerprints at most."""
    others = F.lit([[i for i in range(8) if i not in x] for x in POSITIONS])[F.shiftright(key, 32).cast("int")]
    byte = lambda j: F.call_function("shiftright", fp, 8 * others[j]).bitwiseAND(F.lit(255))
    rest = sum((F.shiftleft(byte(j), 8 * j) for j in (1, 2, 3)), byte(0))

    def parts(rest: Column) -> Column:
        found = []
        for j in range(4):
            own = F.shiftright(rest, 8 * j).bitwiseAND(F.lit(255))
            left = rest.bitwiseAND(F.lit((1 << 8 * j) - 1)) + F.shiftleft(F.shiftright(rest, 8 * (j + 1)), 8 * j)
            for i in range(4):
                block = F.shiftright(left, 6 * i).bitwiseAND(F.lit(63))
                found.append(key + F.lit(1 + 4 * j + i << PART_AT) + F.shiftleft(F.shiftleft(own, 6) + block, BLOCK_AT))
        return F.array(*found)

    return let(rest, parts)


def links(prints: DataFrame) -> DataFrame:
    """Links a-b that connect the distinct fingerprints of the column fp as all links would. A list of over SPLIT_LIST is
    dealt out in parts, so no task holds more of one list."""
    byte = lambda i: F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = []
    for k, positions in enumerate(POSITIONS):
        key = F.lit(k << 32)
        for n, i in enumerate(positions):
            key = key + F.shiftleft(byte(i), 8 * n)
        keys.append(key)
    posted = prints.select(F.explode(F.array(*keys)).alias("key"), "fp")
    gather = lambda lists: lists.repartition("key").sortWithinPartitions("key").mapInArrow(_listed, "a long, b long")
    if prints.count() <= SPLIT_LIST:  # a list holds each fingerprint once at most, so none is longer
        return gather(posted)
    long = written(posted.groupBy("key").count().where(F.col("count") > SPLIT_LIST).select("key", F.lit(True).alias("long")), "long-lists")
    marked = posted.join(long, "key", "left")  # lists that are too long for one task are few, so this is broadcast if its size allows
    parts = marked.where("long").select(F.explode(_part_keys(F.col("key"), F.col("fp"))).alias("key"), "fp")
    whole = marked.where("long is null").select("key", "fp")
    return gather(whole.unionByName(parts))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it is connected to, for the nodes of the edges a-b.

    Alternates the two star operations (every node hands the least neighbour to its larger ones, then to all its smaller
    ones) until nothing changes, a number of rounds that grows with the logarithm of the nodes.
    """
    state = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    summary = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = summary(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).withColumn("m", F.least("m", "u")), "least")
        large = join_groups(both, least, ["u"], "size", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")), "least")
        small = join_groups(large, least, ["u"], "size", 2 * before[0])
        small = small.select("v", "m").where("v != m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = written(small.distinct(), "small-star")
        now = summary(state)
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, fp, digest, component_id and best of every row, and how many rows there are. best: the id and digest of the
    row that is first in its component, in the order of id (nulls last), then digest."""
    printed = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    distinct = written(printed.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size")), "distinct-fingerprints")
    rooted = components(links(distinct.select("fp")))
    member = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member, "members")
    total = printed.count()
    roots = member.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members"))
    named = written(join_groups(member, roots, ["root"], "members", total).select("fp", "size", "best"), "named")
    return join_groups(printed, named, ["fp"], "size", total).select("doc_id", "fp", "digest", F.col("best.doc_id").alias("component_id"), "best"), total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A null or blank text has fingerprint zero, which is linked like any other. component_id is the least id reachable over
    links, null only if all ids reachable are null. Repeated rows are linked to each other. An empty table gives no rows;
    other columns are not read, so their names can't clash.
    """
    found, _ = _grouped(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, the one with the least id.

    Rows without an id come after all others. Of rows that share the least id, the one stays whose text has the least
    digest, and of rows that repeat id and text, one. Blank and null texts are a component like any other. An empty table
    gives no rows.

    Rows that go, or that repeat, are known by id and digest of the text. They are put into a Bloom filter, so that only
    rows which it holds are shuffled; the others pass straight through.
    """
    names = docs.columns
    found, _ = _grouped(docs, id_col, text_col)
    key = ["doc_id", "digest"]
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("digest").eqNullSafe(F.col("best.digest"))
    judged = written(found.select(*key, is_best.alias("stays")), "judged")
    gone = judged.where("not stays").select(*key).distinct().withColumn("stays", F.lit(False))
    again = judged.where("stays").groupBy(*key).count().where("count > 1").select(*key).withColumn("stays", F.lit(True))
    touched = written(gone.unionByName(again), "touched")
    filter_bits = power_of_two(max(BITMAP_BITS, BITS_A_ROW * touched.count()))
    position = lambda id_, digest: F.pmod(F.xxhash64(id_, digest), F.lit(filter_bits))
    filter_ = written(bitmaps(touched.select(position(F.col("doc_id"), F.col("digest")).alias("at"))), "touched-filter")
    keyed = docs.select(F.struct(*names).alias("row_"), F.col(id_col).cast("long").alias("id_"), _digest(text_col).alias("digest_"))
    keyed = looked_up(keyed, filter_, filter_bits, position(F.col("id_"), F.col("digest_")), "maybe_")
    maybe = keyed.where("maybe_").join(touched, F.col("id_").eqNullSafe(F.col("doc_id")) & F.col("digest_").eqNullSafe(F.col("digest")), "left")
    one = maybe.where("stays").groupBy("id_", "digest_").agg(F.first("row_").alias("row_"))
    kept = keyed.where("not maybe_").select("row_").unionByName(maybe.where("stays is null").select("row_")).unionByName(one.select("row_"))
    return kept.select(*(F.col("row_")[c].alias(c) for c in names))
