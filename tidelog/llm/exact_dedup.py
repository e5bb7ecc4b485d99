"""Exact deduplication by two-pass Bloom filtering.

Pass 1 puts two positions of every document's digest into a filter of 16 bits a document and keeps the positions that
were hit at least twice. Pass 2 looks the digests up: a document with a position that was hit once has no copy and passes
straight through; only the others (true copies and about 1 in 70 of the rest) are shuffled and grouped by the full digest.
The filter is a table of 4 KB bitmaps, one for each 32,768 bits. It is broadcast while its size, which is known from the
number of documents, is within FILTER_BYTES, and joined by bitmap number beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BITMAP_BITS, ascii_lower, bitmaps, join_groups, looked_up, power_of_two, written

BITS_A_DOCUMENT = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays (a null id is
    less than any other; of rows that share the largest id, one stays). A null text counts as empty, and empty texts are
    equal to each other. An empty table gives no rows; other columns are not read, so their names can't clash.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digests = written(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")),
        "exact-digests",
    )
    n = digests.count()
    filter_bits = power_of_two(max(BITMAP_BITS, BITS_A_DOCUMENT * n))
    positions = [F.pmod(F.xxhash64("sha"), F.lit(filter_bits)), F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(filter_bits))]
    repeated = digests.select(F.explode(F.array(*positions)).alias("at")).groupBy("at").count().where("count > 1")
    filter_ = written(bitmaps(repeated), "exact-filter")
    both = digests
    for k, position in enumerate(positions):
        both = looked_up(both, filter_, filter_bits, position, f"hit{k}")
    maybe = both.select("doc_id", "sha", "rid", (F.col("hit0") & F.col("hit1")).alias("maybe"))

    alone = maybe.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    candidates = maybe.where("maybe").select("doc_id", "sha", "rid")
    groups = written(candidates.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")), "exact-groups")

    found = join_groups(candidates, groups, ["sha"], "group_size", n)
    grouped = found.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "sha")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
