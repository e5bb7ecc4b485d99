"""Lamport clocks and the orders of log entries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The total order of a store: time, writer, then hash.
CANONICAL = ("time", "clock_id", "hash")


def order_key(*names: str) -> Column:
    """A struct that compares as the named columns do, left to right."""
    return F.struct(*(names or CANONICAL))


def ascending(names: tuple[str, ...] = CANONICAL) -> list[Column]:
    return [F.col(n).asc() for n in names]


def descending(names: tuple[str, ...] = CANONICAL) -> list[Column]:
    return [F.col(n).desc() for n in names]


def tick(time: Column) -> Column:
    """The clock's next time."""
    return time + F.lit(1)


def merge(own: Column, *others: Column) -> Column:
    """The clock after hearing of others: the greatest time; null times are not heard."""
    return F.greatest(own, *others)


def compare(time_a: Column, id_a: Column, time_b: Column, id_b: Column) -> Column:
    """-1, 0 or 1: by time, then by the writer's id."""
    by_id = F.when(id_a < id_b, -1).when(id_a > id_b, 1).otherwise(0)
    return F.when(time_a < time_b, -1).when(time_a > time_b, 1).otherwise(by_id)
