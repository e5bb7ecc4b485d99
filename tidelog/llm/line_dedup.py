"""Line deduplication with a suffix array over line ids.

Every document is a sequence of line ids; all suffixes of all sequences are sorted by distributed prefix doubling: ranks of
prefixes of 1, 2, 4, ... lines, each a range sort of pairs of the ranks before. Suffixes whose prefix occurs once are done
and drop out, as do ranks deeper than any run has to be. Suffixes with equal ranks are an interval of the array whose
longest common prefix is at least that long: a repeated run. A run counts from MIN_WORDS words on; the words of a line are
what white space parts. Every maximal run that counts is the union of its least counting stretches, from each of its lines
forwards and backwards, so deleting later copies of stretches deletes the same lines as deleting those of maximal runs,
except where the first occurrence of a part lies elsewhere than that of the whole, in which case the first of each part
stays. Documents that lose lines are shuffled to their list of lines; the rest pass by a Bloom filter of those documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BITMAP_BITS, bitmaps, join_groups, let, looked_up, power_of_two, written

#: A line counts for one word at least, so least counting stretches have at most so many lines.
MIN_WORDS = 50
BITS_A_DOCUMENT = 32


def _stretch(weights: Column, at: Column, forwards: bool, min_words: int) -> Column:
    """Lines from at (from 0) on, forwards or backwards, until they have min_words words; null if they never do."""
    if forwards:
        near = F.slice(weights, at + 1, F.lit(min_words))
    else:
        first = F.greatest(at - (min_words - 1), F.lit(0))
        near = F.reverse(F.slice(weights, first + 1, at - first + 1))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    step = lambda s, w: F.when(s["words"] >= min_words, s).otherwise(F.struct((s["words"] + w).alias("words"), (s["lines"] + 1).alias("lines")))
    return F.aggregate(near, start, step, lambda s: F.when(s["words"] >= min_words, s["lines"]))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Words of a line without blanks around it, one at least. Only where single blanks aren't all that parts them, they are
    counted by a regular expression."""
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    other = line.contains("  ") | line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.when(other, F.greatest(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))).otherwise(blanks + 1)


def _document(id_col: str, text_col: str) -> Column:
    """What stands for a document: its id and text. Rows that repeat both are one document."""
    return F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("text"))


def sequences(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, at, line (128-bit id) and the lengths of its least counting stretches, ahead and back, for every line."""
    line = lambda x: F.unhex(F.md5(F.trim(x)))
    words = lambda x: let(F.trim(x), _words)
    split = docs.where(F.col(text_col).isNotNull()).select(_document(id_col, text_col).alias("doc"), _lines(F.col(text_col)).alias("lines"))
    weighed = split.select("doc", "lines", F.transform("lines", words).alias("weights"))
    reach = lambda i, forwards: F.when(F.get("weights", i) >= min_words, 1).otherwise(_stretch(F.col("weights"), i, forwards, min_words))
    described = F.transform("lines", lambda x, i: F.struct(line(x).alias("line"), reach(i, True).alias("ahead"), reach(i, False).alias("back")))
    return weighed.select("doc", F.posexplode(described).alias("at", "x")).select("doc", "at", "x.line", "x.ahead", "x.back")


def _ranked(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """distinct with rank, which orders its rows as order does: the place in range partitions that follow each other."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), name)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc and at of the lines to delete, each once."""
    lines = written(sequences(docs, id_col, text_col, min_words), "lines")
    total = lines.count()
    spread = [F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("last"), F.count(F.lit(1)).alias("size")]
    repeated = lambda df, keys: df.groupBy(*keys).agg(*spread).where("first != last").select(*keys, "size")

    ranks = _ranked(repeated(lines, ["line"]), ["line"], "rank-1")
    suffixes = written(join_groups(lines, ranks, ["line"], "size", total).select("doc", "at", "rank", "ahead", "back").distinct(), "suffixes-1")
    stretches = written(
        suffixes.where("ahead is not null").select("doc", F.col("at").alias("start"), F.col("ahead").alias("lines"))
        .unionByName(suffixes.where("back is not null").select("doc", (F.col("at") - F.col("back") + 1).alias("start"), F.col("back").alias("lines"))).distinct(),
        "stretches",
    )
    longest = stretches.agg(F.max("lines")).first()[0] or 0
    here = suffixes.select("doc", "at", "rank")
    found, depth = [], 1
    while depth <= longest:
        # Equal stretches have equal ranks at both ends, where the prefixes of depth lines overlap or meet.
        due = stretches.where(F.col("lines").between(depth, 2 * depth - 1))
        left = here.select("doc", F.col("at").alias("start"), F.col("rank").alias("head"))
        right = here.select("doc", (F.col("at") + depth).alias("end"), F.col("rank").alias("tail"))
        named = due.join(left, ["doc", "start"]).withColumn("end", F.col("start") + F.col("lines")).join(right, ["doc", "end"])
        named = written(named.select("doc", "start", "lines", "head", "tail"), f"named-{depth}")
        first = named.groupBy("lines", "head", "tail").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
        copies = join_groups(named, first, ["lines", "head", "tail"], "size", total).where(F.struct("doc", "start") != F.col("first"))
        # In a document that repeats itself, a copy may overlap the first occurrence, whose lines stay.
        begin = F.when(F.col("doc") == F.col("first.doc"), F.greatest("start", F.col("first.start") + F.col("lines"))).otherwise(F.col("start"))
        gone = copies.select("doc", begin.alias("begin"), (F.col("start") + F.col("lines") - 1).alias("to")).where("begin <= to")
        found.append(written(gone, f"copies-{depth}"))  # a plan for each depth, not one of all
        if 2 * depth > longest:
            break
        after = here.select("doc", (F.col("at") - depth).alias("at"), F.col("rank").alias("next"))
        pairs = written(here.join(after, ["doc", "at"]), f"pairs-{depth}")
        ranks = _ranked(repeated(pairs, ["rank", "next"]).withColumnRenamed("rank", "this"), ["this", "next"], f"rank-{2 * depth}")
        here = written(join_groups(pairs.withColumnRenamed("rank", "this"), ranks, ["this", "next"], "size", total).select("doc", "at", "rank"), f"suffixes-{2 * depth}")
        depth *= 2
    if not found:
        return lines.select("doc", "at").limit(0)
    copies = found[0]
    for x in found[1:]:
        copies = copies.unionByName(x)
    return copies.select("doc", F.explode(F.sequence("begin", "to")).alias("at")).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts without later copies of repeated line runs, and a column `lines_deleted`.

    Lines end at a newline and are compared without the blanks around them. Occurrences are ordered by id (null first), then
    a digest of the text, then the line. A run is repeated if it occurs at two places, in one document or two; it counts from
    min_words words on, which are what white space parts, one a line at least. A null text stays null. Rows that repeat id and text are one document and come out alike. A column
    that is called `lines_deleted` is replaced; others are kept as they are.
    """
    names = [c for c in docs.columns if c != "lines_deleted"]
    gone = written(later_copies(docs, id_col, text_col, min_words).groupBy("doc").agg(F.collect_list("at").alias("deleted_")), "deleted-lines")
    filter_bits = power_of_two(max(BITMAP_BITS, BITS_A_DOCUMENT * gone.count()))
    position = lambda doc: F.pmod(F.xxhash64(doc["id"], doc["text"]), F.lit(filter_bits))
    filter_ = written(bitmaps(gone.select(position(F.col("doc")).alias("at"))), "deleted-filter")
    keyed = docs.select(F.struct(*names).alias("row_"), _document(id_col, text_col).alias("doc_"))
    keyed = looked_up(keyed, filter_, filter_bits, position(F.col("doc_")), "maybe_")
    touched = keyed.where("maybe_").select("row_", "doc_")
    joined = touched.join(gone, touched["doc_"].eqNullSafe(gone["doc"]), "left").select("row_", "deleted_")
    joined = joined.unionByName(keyed.where("not maybe_").select("row_", F.lit(None).cast("array<int>").alias("deleted_")))
    lines = _lines(F.col(f"row_.{text_col}"))
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("deleted_")), lambda i: F.get(x, i))
    text = F.when(F.col("deleted_").isNull(), F.col(f"row_.{text_col}")).otherwise(let(lines, lambda x: F.array_join(kept(x), "\n")))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in names), F.coalesce(F.size("deleted_"), F.lit(0)).cast("long").alias("lines_deleted"))
