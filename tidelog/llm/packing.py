"""Best-fit packing of documents into sequences, under conflicts.

Documents longer than a sequence are cut into full sequences and a rest. Rests are placed longest first into the bin with
the least room that is enough; a bin carries bitmaps of its sources and duplicate clusters, and where it already holds the
piece's source or cluster, the search goes on to the next larger room, until the tightest compatible bin is found or a new
one is opened. Rows are dealt by a hash into blocks of about BLOCK_ROWS, packed one by one, so each has bounded memory
whatever source or cluster is common; best fit holds within a block. pack(block_rows=None) packs all rows as one block,
which is best fit over the whole table in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, written

CAPACITY = 2048  # words
BLOCK_ROWS = 4096
#: Rows alike in all that counts are dealt in lots of at most so many, so that many of them fill no block.
LOT = 64


class Bins:
    """Open bins in the order of their room, each with bitmaps of sources and clusters."""

    def __init__(self):
        self.order: list[tuple[int, int]] = []  # (room, bin)
        self.masks: list[int] = []

    def place(self, size: int, mask: int, capacity: int) -> tuple[int, int]:
        """The bin and the offset that a piece gets."""
        order, masks = self.order, self.masks
        for k in range(bisect.bisect_left(order, (size, -1)), len(order)):
            room, found = order[k]
            if not masks[found] & mask:
                del order[k]
                masks[found] |= mask
                break
        else:
            room, found = capacity, len(masks)
            masks.append(mask)
        if room > size:
            bisect.insort(order, (room - size, found))
        return found, capacity - room


def packed(rows: list[tuple[int, object, object]], capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, piece, bin, offset, start, size) of each piece of rows (size, source, cluster); None conflicts with nothing."""
    bins, bits = Bins(), {}
    bit = lambda kind, x: 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))
    for _, source, _ in rows:  # sources first, so that their bits are low
        bit("source", source)
    full, rests = [], []
    for k, (size, _, _) in enumerate(rows):
        whole, rest = divmod(size, capacity)
        full += [(k, piece) for piece in range(whole)]
        if rest or not whole:
            rests.append((rest, k, whole))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for rest, k, whole in rests:
        found, offset = bins.place(rest, bit("source", rows[k][1]) | bit("cluster", rows[k][2]), capacity)
        yield k, whole, found, offset, whole * capacity, rest
    for n, (k, piece) in enumerate(full):
        yield k, piece, len(bins.masks) + n, 0, piece * capacity, capacity


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_cluster(text: Column) -> Column:
    """Equal texts, but for the case of A-Z and space around, are a cluster; blank or null ones are in none."""
    plain = F.trim(ascii_lower(text))
    return F.when(plain != "", F.xxhash64(plain))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, size: Column | None = None, source: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id", block_rows: int | None = BLOCK_ROWS
) -> DataFrame:
    """One row per piece: doc_id, piece, bin_id, bin_offset, start, n_words. A piece is n_words from start on of its document.

    In a bin, pieces lie end to end from offset 0 to at most capacity, no two from one source or one cluster. A null source
    or cluster conflicts with nothing. A document without words is a piece of size 0, in a bin whose room it doesn't lessen.
    Repeated rows are placed one by one. An empty table gives no rows; other columns are not read. Ids, sizes, sources and
    clusters alone decide the bins, not how the table is split into files.
    """
    size = word_count(F.col("text")) if size is None else size
    source = F.col("source") if source is None else source
    cluster = text_cluster(F.col("text")) if cluster is None else cluster
    light = docs.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.alias("cluster"))
    alike = written(light.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n")), "pack-rows")
    total = alike.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_rows)) if block_rows else 1

    def pack_block(lots: pd.DataFrame) -> pd.DataFrame:
        rows = lots.sort_values(["tie", "doc_id", "lot"], kind="stable").loc[lambda x: x.index.repeat(x["copies"])]
        ids = rows["doc_id"].tolist()
        clean = [(int(n), None if pd.isna(s) else s, None if pd.isna(c) else c) for n, s, c in zip(rows["size"], rows["source"], rows["cluster"], strict=True)]
        base = int(rows["block"].iloc[0]) << 32
        found = [(ids[k], piece, base | b, offset, start, n) for k, piece, b, offset, start, n in packed(clean, capacity)]
        return pd.DataFrame(found, columns=["doc_id", "piece", "bin_id", "bin_offset", "start", "n_words"])

    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    lots = lots.withColumn("copies", F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT)).withColumn("tie", F.xxhash64("doc_id", "size", "source", "cluster", "lot"))
    # Ids and clusters go through pandas as text, because a column of integers with nulls would become floats there.
    plain = lots.select(F.pmod("tie", F.lit(blocks)).alias("block"), F.xxhash64("tie").alias("tie"), "lot", "copies", "size", "source", F.col("doc_id").cast("string").alias("doc_id"), F.col("cluster").cast("string").alias("cluster"))
    placed = plain.groupBy("block").applyInPandas(pack_block, "doc_id string, piece long, bin_id long, bin_offset long, start long, n_words long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(light.schema["doc_id"].dataType))
