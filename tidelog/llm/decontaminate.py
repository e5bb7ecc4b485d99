"""Benchmark decontamination by winnowing.

Of each 6 neighbouring 5-word hashes the least is a fingerprint, for benchmark items and documents alike. A span of 10
words that both share holds 6 such hashes, so both choose the same least one there: every shared window of 10 words has a
shared fingerprint. Documents' fingerprints are joined with the benchmark's; each hit is extended to the windows around it,
which are compared in full. Items of fewer than 10 words are one window, whose own hash is the fingerprint.

A benchmark of up to INDEX_BYTES is broadcast as an index, and documents pass it once, without a shuffle. A larger one never
meets the driver or a single task: its fingerprints and windows are tables. A filter of at most FILTER_BITS bits, whatever
the benchmark's size, drops most other fingerprints before the shuffle; those left are joined with the fingerprints, and
their windows with the windows. Only documents with a hit are joined with what was found. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BITMAP_BITS, bitmaps, join_groups, looked_up, power_of_two, texts, written
from tidelog.llm.tokens import Words, word_table

WINDOW = 10  # words
GRAM = 5
SPREAD = WINDOW - GRAM + 1  # neighbouring hashes of which the least is kept
#: Bytes of benchmark text up to which the index is broadcast.
INDEX_BYTES = 4 << 20
#: Most bits of the filter of a larger benchmark's fingerprints; fuller than planned, it lets more fingerprints through.
FILTER_BITS = 1 << 28
CUT = 1 << 18  # bytes of documents that are judged at once
LEAKS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint>>>"


class Index:
    """The windows of some benchmark items and the fingerprints that lead to them, as arrays sorted by hash."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.items = [x for x, _ in items]
        self.words = Words([x for _, x in items], word_table())
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: hashes, and the words where they start
        self.known: dict[tuple[int, int], dict[bytes, set]] = {}
        for size, hashes, starts in windows_of(self.words):
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], starts[order]
        prints, chosen = fingerprints(self.words)
        self.prints = np.unique(prints[chosen])

    def found(self, size: int, hash_: int, words: bytes) -> set | None:
        """The items that hold these words as a window; None if none does."""
        key = size, hash_
        if key not in self.known:
            hashes, starts = self.windows[size]
            own: dict[bytes, set] = {}
            for at in starts[np.searchsorted(hashes, np.uint64(hash_)) : np.searchsorted(hashes, np.uint64(hash_), "right")].tolist():
                own.setdefault(self.words.words(at, size), set()).add(self.items[self.words.text[at]])
            if len(self.known) >= 10_000:  # memory, not results
                self.known.clear()
            self.known[key] = own
        return self.known[key].get(words)


def windows_of(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, hashes and first words of all windows of items: of WINDOW words, or of all of an item that has fewer."""
    first = np.concatenate([[0], np.cumsum(words.counts)])[:-1]
    for size in range(1, WINDOW + 1):
        hashes, whole = words.grams(size)
        if size == WINDOW:
            starts = np.flatnonzero(whole)
        else:
            starts = first[words.counts == size]
        if len(starts):
            yield size, hashes[starts], starts


def among(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Whether each x is in kept, which is sorted."""
    if not len(kept):
        return np.zeros(len(x), bool)
    return kept[np.minimum(np.searchsorted(kept, x), len(kept) - 1)] == x


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of GRAM words from each word on; whether each is the least of one of the windows that hold it."""
    hashes, whole = words.grams(GRAM)
    n = len(hashes) - SPREAD + 1
    chosen = np.zeros(len(hashes), bool)
    if n > 0:
        least = hashes[:n].copy()
        for i in range(1, SPREAD):
            np.minimum(least, hashes[i : i + n], out=least)
        inside = words.text[:n] == words.text[WINDOW - 1 : WINDOW - 1 + n]
        for i in range(SPREAD):
            chosen[i : i + n] |= inside & (hashes[i : i + n] == least)
    return hashes, chosen & whole


def near(words: Words, found: np.ndarray) -> np.ndarray:
    """First words of the windows of WINDOW words that hold one of the fingerprints at found."""
    hashes, whole = words.grams(WINDOW)
    marks = np.zeros(len(hashes) + WINDOW, bool)
    for i in range(SPREAD):
        marks[np.maximum(found - i, 0)] = True
    return np.flatnonzero(marks[: len(hashes)] & whole)


def hits(words: Words, index: Index) -> tuple[np.ndarray, dict[int, set]]:
    """Whether each word lies in an occurrence of a window; the items by text."""
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    items: dict[int, set] = {}
    for size, (known, _) in index.windows.items():
        hashes, whole = words.grams(size)
        if not len(hashes):
            continue
        if size == WINDOW:
            prints, chosen = fingerprints(words)
            found = np.flatnonzero(chosen)
            starts = near(words, found[among(prints[found], index.prints)])
        else:
            starts = np.flatnonzero(whole)
        for at in starts[among(hashes[starts], known)].tolist():
            if (own := index.found(size, int(hashes[at]), words.words(at, size))) is not None:
                marks[at] += 1
                marks[at + size] -= 1
                items.setdefault(int(words.text[at]), set()).update(own)
    return np.cumsum(marks[:-1]) > 0, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs with a column `leaks`: struct of n_words, n_hit, items (sorted as strings), spans of hit words.

    A null text has no words and no hits. An item without words has no windows; items that share an id count once; an
    item whose id is null hits words but isn't listed. Repeated rows are judged alike. An empty benchmark hits nothing.
    Texts alone decide, so id_col isn't read. A column of docs that is called `leaks` is replaced.
    """
    names = [c for c in docs.columns if c != "leaks"]
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return _broadcast(docs.select(*names), items, text_col) if size <= INDEX_BYTES else _joined(docs.select(*names), items, text_col)


def _broadcast(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    rows = [(r["item"], bytes(r["data"]).lower()) for r in items.select("item", F.encode("text", "utf-8").alias("data")).collect()]  # at most INDEX_BYTES of text
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = docs.select("*", F.lit(None).cast(LEAKS).alias("leaks")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            for cut in _cuts(batch, text_col):
                words = _words(cut, text_col)
                hit, found = hits(words, index)
                yield _with_leaks(cut, words, hit, [found.get(k, set()) for k in range(cut.num_rows)])

    return docs.mapInArrow(scan, schema)


def _words(batch: pa.RecordBatch, text_col: str) -> Words:
    return Words([x.lower() for x in texts(batch.column(text_col))], word_table())


def _digest(words: Words, at: int, size: int) -> bytes:
    """What stands for a window in tables."""
    return hashlib.md5(words.words(at, size)).digest()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, size and window (a digest) of every window of the items."""
    for batch in batches:
        for cut in _cuts(batch, "text"):
            words, ids = _words(cut, "text"), cut.column("item").to_pylist()
            for size, _, starts in windows_of(words):
                for part in np.array_split(starts, max(1, len(starts) // 65_536)):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in words.text[part]], pa.string()), pa.array([size] * len(part), pa.int32()), pa.array([_digest(words, at, size) for at in part.tolist()], pa.binary())], names=["item", "size", "window"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size and print: the fingerprints of the items."""
    for batch in batches:
        for cut in _cuts(batch, "text"):
            words = _words(cut, "text")
            for size, hashes, starts in windows_of(words):
                if size == WINDOW:
                    hashes, chosen = fingerprints(words)
                    hashes = hashes[chosen]
                hashes = np.unique(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(hashes), pa.int32()), pa.array(hashes.view(np.int64))], names=["size", "print"])


class Filter:
    """Bits of fingerprints, two for each; a fingerprint whose bits aren't both set isn't among them."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, data

    def places(self, size: int, hashes: np.ndarray) -> list[np.ndarray]:
        mixed = hashes + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))
        return [x & np.uint64(self.bits - 1) for x in (mixed, mixed >> np.uint64(32) ^ mixed << np.uint64(7))]

    def holds(self, size: int, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for x in self.places(size, hashes):
            found &= (self.data[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _filter(prints: DataFrame, total: int) -> tuple[int, np.ndarray]:
    """The filter's bits and data for all fingerprints; its places are found where the fingerprints are."""
    bits = min(FILTER_BITS, power_of_two(max(BITMAP_BITS, 16 * total)))
    data = np.zeros(bits // 8, np.uint8)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = batch.column("size").to_numpy(), batch.column("print").to_numpy().view(np.uint64)
            for size in np.unique(sizes).tolist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(Filter(bits).places(size, hashes[sizes == size]))).astype(np.int64))], names=["at"])

    for r in bitmaps(prints.mapInArrow(places, "at long")).toLocalIterator():  # 4 KB each, FILTER_BITS bits in all
        at = (r["number"] - 1) * (BITMAP_BITS // 8)
        data[at : at + BITMAP_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits, data


def _joined(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    windows = written(items.mapInArrow(_windows, "item string, size int, window binary").distinct(), "windows")
    prints = written(items.mapInArrow(_prints, "size int, print long").distinct(), "prints")
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # at most WINDOW rows
    shared = spark.sparkContext.broadcast(_filter(prints, prints.count()))  # at most FILTER_BITS bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*shared.value)
        for batch in batches:
            for cut in _cuts(batch, "text"):
                yield from _candidates(_words(cut, "text"), cut.column("doc").to_pylist(), sizes, known)

    # A document is known by the digest of its text, so copies are judged once.
    doc = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    some = docs.select(doc.alias("doc"), F.col(text_col).alias("text")).mapInArrow(scan, "doc binary, size int, print long, at long, window binary").distinct()
    some = written(some, "candidates")
    total = some.count()
    shared_prints = some.groupBy("size", "print").agg(F.count(F.lit(1)).alias("n")).join(prints, ["size", "print"], "left_semi")
    led = join_groups(some, written(shared_prints, "shared-prints"), ["size", "print"], "n", total).select("doc", "size", "at", "window").distinct()
    led = written(led, "extended")
    shared_windows = led.groupBy("size", "window").agg(F.count(F.lit(1)).alias("n")).join(windows, ["size", "window"], "left_semi")
    hit = written(join_groups(led, written(shared_windows, "shared-windows"), ["size", "window"], "n", total).select("doc", "size", "at", "window"), "hits")
    spans = hit.groupBy("doc").agg(F.collect_set(F.struct("at", "size")).alias("at_"))  # of one text's own words
    named = hit.select("doc", "size", "window").distinct().join(windows, ["size", "window"]).groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items_"))
    found = written(spans.join(named, "doc").withColumnRenamed("doc", "hit_"), "found")

    filter_bits = power_of_two(max(BITMAP_BITS, 32 * found.count()))
    position = lambda x: F.pmod(F.xxhash64(x), F.lit(filter_bits))
    filter_ = written(bitmaps(found.select(position(F.col("hit_")).alias("at"))), "found-filter")
    keyed = looked_up(docs.select(F.struct(*docs.columns).alias("row_"), doc.alias("doc_")), filter_, filter_bits, position(F.col("doc_")), "maybe_")
    touched = keyed.where("maybe_").join(found, F.col("doc_") == F.col("hit_"), "left").select("row_", "at_", "items_")
    rest = keyed.where("not maybe_").select("row_", F.lit(None).cast("array<struct<at:bigint,size:int>>").alias("at_"), F.lit(None).cast("array<string>").alias("items_"))
    both = touched.unionByName(rest)
    out = both.select(F.col("row_"), "at_", "items_", F.col(f"row_.{text_col}").alias("text_"), F.lit(None).cast(LEAKS).alias("leaks"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in _cuts(batch, "text_"):
                words = _words(cut, "text_")
                first = np.concatenate([[0], np.cumsum(words.counts)])
                marks = np.zeros(len(words.hashes) + 1, np.int64)
                for k, places in enumerate(cut.column("at_").to_pylist()):
                    for x in places or ():
                        marks[first[k] + x["at"]] += 1
                        marks[first[k] + x["at"] + x["size"]] -= 1
                yield _with_leaks(cut.drop_columns("leaks"), words, np.cumsum(marks[:-1]) > 0, [set(x or ()) for x in cut.column("items_").to_pylist()])

    told = out.mapInArrow(tell, out.schema)
    return told.select(*(F.col("row_")[c].alias(c) for c in docs.columns), "leaks")


def _candidates(words: Words, docs: list[bytes], sizes: list[int], known: Filter) -> Iterator[pa.RecordBatch]:
    """doc, size, print, at and window: fingerprints that the filter holds, each with the windows that it leads to. at is
    counted from the document's first word."""
    first = np.concatenate([[0], np.cumsum(words.counts)])
    for size in sizes:
        hashes, whole = words.grams(size)
        if not len(hashes):
            continue
        if size == WINDOW:
            prints, chosen = fingerprints(words)
            at = np.flatnonzero(chosen)
            at = at[known.holds(size, prints[at])]
            starts = (at[:, None] - np.arange(SPREAD)).ravel()
            prints = np.repeat(prints[at], SPREAD)
            inside = (starts >= 0) & (starts < len(hashes))
            starts, prints = starts[inside], prints[inside]
            inside = whole[starts]
            starts, prints = starts[inside], prints[inside]
        else:
            starts = np.flatnonzero(whole)
            starts = starts[known.holds(size, hashes[starts])]
            prints = hashes[starts]
        if len(starts):
            text = words.text[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[k] for k in text], pa.binary()), pa.array([size] * len(starts), pa.int32()), pa.array(prints.view(np.int64)), pa.array(starts - first[text]), pa.array([_digest(words, k, size) for k in starts.tolist()], pa.binary())],
                names=["doc", "size", "print", "at", "window"],
            )


def _cuts(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about CUT bytes of text, so that memory stays bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CUT, "right")))
        yield batch.slice(at, to - at)
        at = to


def _with_leaks(batch: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[set]) -> pa.RecordBatch:
    """The batch with its leaks. hit: whether each word of all texts is hit."""
    first = np.concatenate([[0], np.cumsum(words.counts)])
    found = []
    for k, named in enumerate(items):
        own = hit[first[k] : first[k + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8))) if len(own) else np.zeros(0, int)
        spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        found.append({"n_words": len(own), "n_hit": int(own.sum()), "items": sorted(x for x in named if x is not None), "spans": spans})
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "leaks"])
