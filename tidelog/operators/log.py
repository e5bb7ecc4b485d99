"""Operators on append-only logs whose entries name their parents by hash.

A log is a DataFrame with log_id, hash, next (parents), time, clock_id and any other columns. All states are views of it:
nothing is updated. The canonical order is (time, clock_id, hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.clock import CANONICAL, ascending, descending, order_key
from tidelog.operators.running import before_each
from tidelog.operators.running import ranged as in_ranges
from tidelog.shared import kept


def edges(log: DataFrame) -> DataFrame:
    """child and parent, once each; parents may be named repeatedly."""
    return log.select(F.col("hash").alias("child"), F.explode(F.array_distinct("next")).alias("parent"))


def values(log: DataFrame) -> DataFrame:
    """The entries once each, in canonical order."""
    return log.dropDuplicates(["hash"]).orderBy(*ascending())


def heads(log: DataFrame) -> DataFrame:
    """Entries that no other entry refers to."""
    return log.join(edges(log).select(F.col("parent").alias("hash")).distinct(), "hash", "left_anti")


def dangling(log: DataFrame) -> DataFrame:
    """Parents that aren't in the log: child and parent."""
    known = log.select(F.col("hash").alias("parent"))
    return edges(log).join(known, "parent", "left_anti").select("child", "parent")


def tails(log: DataFrame) -> DataFrame:
    """Entries without parents, or with a parent that isn't in the log."""
    cut = dangling(log).select(F.col("child").alias("hash")).distinct()
    return log.where(F.size("next") <= 0).unionByName(log.where(F.size("next") > 0).join(cut, "hash", "left_semi"))


def missing_from(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's entries that b lacks."""
    return a.join(b.select("hash").distinct(), "hash", "left_anti")


def difference(a: DataFrame, b: DataFrame, root_limit: int | None = None) -> DataFrame:
    """a's entries that are reached from its heads without passing an entry of b. If b holds all ancestors of what it
    holds, that is what b lacks; else, with any root_limit, the walk stops at known entries. It isn't cut short: an entry
    deeper than root_limit generations is found too."""
    lacking = missing_from(a, b)
    if root_limit is None:
        return lacking
    start = heads(a).select("hash").join(lacking.select("hash"), "hash", "left_semi")
    return lacking.join(reachable(lacking, start), "hash", "left_semi")


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two replicas, each entry once: idempotent, commutative and associative."""
    return a.unionByName(b).dropDuplicates(["hash"])


def truncated(log: DataFrame, size: int) -> DataFrame:
    """The newest entries in canonical order. Spark keeps size rows a task, so nothing is sorted as a whole."""
    return log.orderBy(*descending()).limit(max(size, 0))


def join_truncated(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    return truncated(joined(a, b), size)


def clock_time(log: DataFrame) -> DataFrame:
    """The log's clock: the greatest time of its heads, and so of all."""
    return log.agg(F.coalesce(F.max("time"), F.lit(0)).alias("time"))


def reachable(log: DataFrame, roots: DataFrame) -> DataFrame:
    """Hashes that are reached from roots (a column hash) over parents, themselves included, where the log has them.

    Every entry points to its latest parent; pointers are doubled, so the chain of a writer takes a number of rounds that
    grows as the logarithm of its length. Then comes a generation of the other parents, until no hash is new. Steps are
    kept in the shared folder.
    """
    known = log.select("hash", order_key().alias("key_")).dropDuplicates(["hash"])
    own, above = known.select(F.col("hash").alias("child"), F.col("key_").alias("own_")), known.select(F.col("hash").alias("parent"), F.col("key_").alias("above_"))
    links = kept(edges(log).distinct().join(above, "parent").join(own, "child"))
    # Only earlier parents, so that pointers can't go round; any other link is taken as one of the rest.
    latest = links.where(F.col("above_") < F.col("own_")).groupBy("child").agg(F.max_by("parent", "above_").alias("parent"))
    jumps = [kept(latest)]
    rest = kept(links.select("child", "parent").join(jumps[0], ["child", "parent"], "left_anti"))

    def with_chains(here: DataFrame) -> DataFrame:
        k = 0
        while not jumps[k].isEmpty():
            here = kept(here.unionByName(jumps[k].join(here, jumps[k]["child"] == here["hash"], "left_semi").select(F.col("parent").alias("hash"))).distinct())
            k += 1
            if k == len(jumps):
                first, second = jumps[-1].withColumnRenamed("parent", "via"), jumps[-1].withColumnRenamed("child", "via")
                jumps.append(kept(first.join(second, "via").select("child", "parent")))
        return here

    seen = with_chains(kept(roots.select("hash").join(known, "hash", "left_semi").distinct()))
    while True:
        new = kept(rest.join(seen, rest["child"] == seen["hash"], "left_semi").select(F.col("parent").alias("hash")).distinct().join(seen, "hash", "left_anti"))
        if new.isEmpty():
            return seen
        seen = kept(seen.unionByName(with_chains(new)).distinct())


def traverse(log: DataFrame, roots: DataFrame, amount: int = -1, end_hash: str | None = None) -> DataFrame:
    """Entries reached from roots, newest first, up to amount of them (negative: all) and to end_hash, included."""
    found = log.join(reachable(log, roots), "hash", "left_semi")
    if end_hash is not None:
        found = _anchored(found, log, end_hash, "gte")
    found = found.orderBy(*descending())
    return found if amount < 0 else found.limit(amount)


def children(log: DataFrame, hash_: str) -> DataFrame:
    return log.where(F.array_contains("next", hash_))


def first_children(log: DataFrame) -> DataFrame:
    """hash and child: the child that comes first in canonical order."""
    named = edges(log).join(log.select(F.col("hash").alias("child"), "time", "clock_id"), "child")
    return named.groupBy(F.col("parent").alias("hash")).agg(F.min_by("child", F.struct("time", "clock_id", "child")).alias("child"))


def parents_of(log: DataFrame) -> DataFrame:
    """hash and n_parents, counting each parent once."""
    return log.select("hash", F.size(F.array_distinct("next")).cast("long").alias("n_parents"))


#: Rows of a log that are linked by one task; each task sees the few before them as well.
LINKED_AT_ONCE = 1 << 16


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n_, counted from 1 in each log by seq."""
    counted = before_each(rows, ["log_id"], "seq", F.sum, F.lit(1), lambda x, y: x + y)
    return counted.withColumn("n_", F.coalesce("before_", F.lit(0)) + 1).drop("before_")


def appended_apart(log: DataFrame, new: DataFrame, references: int = 64) -> tuple[DataFrame, DataFrame]:
    """new (seq, log_id, clock_id, payload) as entries that follow the log, and child and parent for what the first of them
    refer to. Times go on from the log's clock; the first entry refers to all heads, which may be more than a row can hold,
    so its next is empty; every other refers to the one before and up to references further ones, by powers of two.

    A long log is linked in parts of LINKED_AT_ONCE rows, which see the references' rows before them."""
    base = clock_time(log).select(F.col("time").alias("base_"))
    timed = _numbered(new).join(F.broadcast(base)).withColumn("time", F.col("base_") + F.col("n_"))
    hashed = timed.withColumn("hash", F.sha2(F.concat_ws("|", "log_id", F.col("time"), "clock_id", "payload"), 256))
    steps = [1]
    while 2 * steps[-1] <= references:
        steps.append(2 * steps[-1])
    part = lambda n: F.floor(n / F.lit(LINKED_AT_ONCE))
    seen = hashed.withColumn("part_", F.explode(F.array_distinct(F.array(part(F.col("n_")), part(F.col("n_") + steps[-1])))))
    order = W.partitionBy("log_id", "part_").orderBy("n_")
    linked = seen.withColumn("next", F.array_compact(F.array(*(F.lag("hash", k).over(order) for k in steps)))).where(F.col("part_") == part(F.col("n_")))
    first = F.broadcast(hashed.where("n_ = 1").select(F.col("hash").alias("child")))  # one a log
    links = heads(log).select(F.col("hash").alias("parent")).join(first).select("child", "parent")
    return linked.select("hash", "log_id", "payload", "next", "time", "clock_id"), links


def appended(log: DataFrame, new: DataFrame, references: int = 64) -> DataFrame:
    """The entries of appended_apart, the first with all heads in its next: one row holds them, so they have to be few enough
    for a task's memory."""
    entries, links = appended_apart(log, new, references)
    named = links.groupBy(F.col("child").alias("hash")).agg(F.sort_array(F.collect_list("parent")).alias("heads_"))
    first = entries.where(F.size("next") == 0).join(named, "hash", "left").withColumn("next", F.coalesce("heads_", "next"))
    return first.select(*entries.columns).unionByName(entries.where(F.size("next") > 0))


def with_positions(log: DataFrame, buckets: int = 64) -> DataFrame:
    """The log with pos, counted from 1 in canonical order.

    Ranges of time are numbered by their own windows, in parallel; the few counts of the ranges give the offsets.
    """
    ranged = in_ranges(log, "time", buckets)
    counts = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select("range_", F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    place = F.row_number().over(W.partitionBy("range_").orderBy(*ascending()))
    return ranged.withColumn("place_", place).join(F.broadcast(before), "range_").withColumn("pos", (F.col("before_") + F.col("place_")).cast("long")).drop("range_", "place_", "before_")


#: Tests of an order key against an anchor's, and of the time alone, which follows from it and reaches the scan.
_TESTS = {
    "gt": (lambda x, a: x > a, lambda t, a: t >= a), "gte": (lambda x, a: x >= a, lambda t, a: t >= a),
    "lt": (lambda x, a: x < a, lambda t, a: t <= a), "lte": (lambda x, a: x <= a, lambda t, a: t <= a),
}


def _anchored(found: DataFrame, log: DataFrame, hash_: str, kind: str) -> DataFrame:
    """Rows of found that compare so to the log's entry of that hash; none if the log lacks it. The one entry is looked up
    first, so that its time is a literal by which files and row groups are skipped."""
    anchor = log.where(F.col("hash") == hash_).select(*CANONICAL).first()
    if anchor is None:
        return found.limit(0)
    whole, time = _TESTS[kind]
    key = F.struct(*(F.lit(anchor[n]).cast(found.schema[n].dataType).alias(n) for n in CANONICAL))
    return found.where(time(F.col("time"), F.lit(anchor["time"])) & whole(order_key(), key))


def list_store(log: DataFrame, amount: int = -1, gt: str | None = None, gte: str | None = None, lt: str | None = None, lte: str | None = None) -> DataFrame:
    """The store's range query. Without a bound it gives the newest amount; a lower bound gives the amount from there on and
    lets upper bounds be ignored; an upper bound gives the newest amount up to there. gt given with gte acts as gte at gt.
    A negative amount is all, 0 none. An unknown bound gives nothing. Shown in canonical order."""
    if gt is not None or gte is not None:
        found, newest = _anchored(log, log, gt if gt is not None else gte, "gt" if gte is None else "gte"), False
    elif lt is not None or lte is not None:
        found, newest = _anchored(log, log, lte if lte is not None else lt, "lt" if lte is None else "lte"), True
    else:
        found, newest = log, True
    if amount >= 0:
        found = found.orderBy(*(descending() if newest else ascending())).limit(amount)
    return found.orderBy(*ascending())


def list_facade(log: DataFrame, amount: int = -1, gt: str | None = None, gte: str | None = None, lt: str | None = None, lte: str | None = None) -> DataFrame:
    """The facade's range query: all bounds apply, then the first amount is taken. -1 is all; other amounts under 1 are none."""
    found = log
    for hash_, kind in ((gte, "gte"), (gt, "gt"), (lte, "lte"), (lt, "lt")):
        if hash_ is not None:
            found = _anchored(found, log, hash_, kind)
    found = found.orderBy(*ascending())
    return found if amount == -1 else found.limit(max(amount, 0))


def get(log: DataFrame, hash_: str) -> DataFrame:
    """The entry with that hash, if there is one."""
    return log.where(F.col("hash") == hash_)


def require(found: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none."""
    if found.isEmpty():
        raise LookupError(f"not found: {what}")
    return found


def positions_between(log: DataFrame, start: int, end: int) -> DataFrame:
    """Entries at positions start to end, from 0, the last not included; none where start is not before end."""
    if start < 0 or end <= start:
        return log.limit(0)
    return log.orderBy(*ascending()).offset(start).limit(end - start)


def last(log: DataFrame, n: int) -> DataFrame:
    return truncated(log, n).orderBy(*ascending())


def head_record(log: DataFrame) -> DataFrame:
    """log_id and the hashes of its heads, greatest first, as JSON."""
    own = heads(log).groupBy("log_id").agg(F.sort_array(F.collect_list("hash"), asc=False).alias("heads"))
    return own.select("log_id", F.to_json(F.struct(F.col("log_id").alias("id"), "heads")).alias("record"))
