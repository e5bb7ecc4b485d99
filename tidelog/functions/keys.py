"""Hierarchical keys, addresses and channel names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ADDRESS_CHARS = 1000
CONTROLLER_TYPES = ("simple", "store", "network")


def segments(key: Column) -> Column:
    """The key's non-empty path segments, trimmed."""
    return F.filter(F.transform(F.split(key, "/"), lambda x: F.trim(x)), lambda x: x != "")


def rendered(parts: Column) -> Column:
    """Segments as a key; the root is "/"."""
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def normalised(key: Column) -> Column:
    return rendered(segments(key))


def parent(key: Column) -> Column:
    """The key above; null for the root."""
    parts = segments(key)
    return F.when(F.size(parts) > 0, rendered(F.slice(parts, F.lit(1), F.size(parts) - 1)))


def child(key: Column, name: Column | str) -> Column:
    return rendered(F.concat(segments(key), segments(name if isinstance(name, Column) else F.lit(name))))


def last_segment(key: Column) -> Column:
    """The last segment; null for the root."""
    return F.try_element_at(segments(key), F.lit(-1))


def depth(key: Column) -> Column:
    return F.size(segments(key))


def is_root(key: Column) -> Column:
    return F.size(segments(key)) == 0


def is_descendant(key: Column, of: Column) -> Column:
    """Whether key lies strictly below of, segment by segment; unlike a prefix test on bytes."""
    own, above = segments(key), segments(of)
    return (F.size(own) > F.size(above)) & (F.slice(own, F.lit(1), F.greatest(F.size(above), F.lit(0))) == above)


def has_prefix(key: Column, prefix: Column | str) -> Column:
    """The prefix test on bytes, which pays no heed to segments."""
    return key.startswith(prefix)


def is_hash(value: Column) -> Column:
    """64 hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def address(root: Column, path: Column, prefix: str = "store") -> Column:
    """/<prefix>/<root hash>[/path]."""
    return F.concat(F.lit(f"/{prefix}/"), root, F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("/"), path)).otherwise(F.lit("")))


def parsed_address(value: Column) -> Column:
    """struct(root, path) of an address; both null where it isn't one."""
    pattern = r"^(?:/?[A-Za-z]+/)?([0-9a-fA-F]{64})(?:/(.*))?$"
    ok = value.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(value, pattern, 1)).alias("root"), F.when(ok, F.coalesce(F.regexp_extract(value, pattern, 2), F.lit(""))).alias("path"))


def is_address(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^(?:/?[A-Za-z]+/)?[0-9a-fA-F]{64}(?:/.*)?$"), F.lit(False))


def is_acl_address(value: Column) -> Column:
    """Not empty, at most 1000 characters, without ".." or "//"."""
    trimmed = F.trim(value)
    good = (trimmed != "") & (F.char_length(trimmed) <= MOST_ADDRESS_CHARS) & ~trimmed.contains("..") & ~trimmed.contains("//")
    return F.coalesce(good, F.lit(False))


def access_address(value: Column) -> Column:
    """The address of a store's access list: trimmed, without a trailing slash, ending in _access."""
    plain = F.trim(value)
    return F.when(plain.endswith("_access"), plain).when(plain.endswith("/"), F.concat(plain, F.lit("_access"))).otherwise(F.concat(plain, F.lit("/_access")))


def controller_type(declared: Column, value: Column) -> Column:
    """The declared controller type, else one that the address names, else simple."""
    own = F.lower(F.trim(declared))
    named = F.lit("simple")
    for kind in reversed(CONTROLLER_TYPES):
        named = F.when(F.lower(value).contains(kind), kind).otherwise(named)
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(named)


def topic(store_id: Column) -> Column:
    """The last path segment."""
    return F.element_at(F.split(store_id, "/"), -1)


def channel_id(a: Column, b: Column, separator: str = "/") -> Column:
    """One name for a pair of peers, whichever comes first."""
    return F.concat(F.least(a, b), F.lit(separator), F.greatest(a, b))


def channel_topic(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.least(a, b), F.greatest(a, b)), 256)
