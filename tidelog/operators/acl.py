"""Access lists: one row a grant (role, key), and the same as one row a role (role, keys ARRAY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANYONE = "*"


def by_role(grants: DataFrame) -> DataFrame:
    """role and its keys, each once."""
    return grants.groupBy("role").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def to_grants(lists: DataFrame) -> DataFrame:
    return lists.select("role", F.explode("keys").alias("key"))


def effective(grants: DataFrame) -> DataFrame:
    """Grants as they are read from a persisted list: who may write is an admin too."""
    promoted = grants.where("role = 'write'").select(F.lit("admin").alias("role"), "key")
    return grants.select("role", "key").unionByName(promoted).distinct()


def granted(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Grants with new ones; those with an empty key are left out."""
    return grants.select("role", "key").unionByName(new.where("key != ''").select("role", "key")).distinct()


def revoked(grants: DataFrame, gone: DataFrame) -> DataFrame:
    """Grants without some; a role without keys has no rows, and so disappears."""
    return grants.join(gone.select("role", "key").distinct(), ["role", "key"], "left_anti")


def cleared(lists: DataFrame, role: str) -> DataFrame:
    """Role lists with one emptied; the role itself stays."""
    return lists.withColumn("keys", F.when(F.col("role") == role, F.array().cast("array<string>")).otherwise(F.col("keys")))


def cloned(lists: DataFrame, source: str, target: str) -> DataFrame:
    """Role lists where target has what source has; an error if there is no source."""
    own = lists.where(F.col("role") == source)
    if own.isEmpty():
        raise LookupError(f"no role {source}")
    return lists.where(F.col("role") != target).unionByName(own.withColumn("role", F.lit(target)))


def allows(keys: Column, *ids: Column) -> Column:
    """Whether a list names one of the ids, or anyone."""
    found = F.array_contains(keys, ANYONE)
    for id_ in ids:
        found = found | F.array_contains(keys, id_)
    return F.coalesce(found, F.lit(False))


def allowed(requests: DataFrame, grants: DataFrame, roles: list[str], ids: list[str]) -> DataFrame:
    """Requests of which one id column is granted one of the roles, or whose roles are open to anyone.

    The grants are joined by key, so neither side has to fit in memory; whether anyone is allowed is a single row.
    """
    of = grants.where(F.col("role").isin(roles))
    anyone = of.where(F.col("key") == ANYONE).agg((F.count(F.lit(1)) > 0).alias("anyone_"))
    known = of.select("key").distinct()
    marked = requests.join(F.broadcast(anyone))
    for k, name in enumerate(ids):
        marked = marked.join(known.select(F.col("key").alias(f"key{k}_"), F.lit(True).alias(f"ok{k}_")), F.col(name) == F.col(f"key{k}_"), "left")
    passes = F.col("anyone_")
    for k in range(len(ids)):
        passes = passes | F.coalesce(F.col(f"ok{k}_"), F.lit(False))
    return marked.where(passes).select(*requests.columns)


def can_read(requests: DataFrame, grants: DataFrame, id_: str = "pub_key") -> DataFrame:
    """Requests that a read list allows; if there is none, those that may write."""
    if grants.where("role = 'read'").isEmpty():
        return allowed(requests, grants, ["write"], [id_])
    return allowed(requests, grants, ["read"], [id_])


def stats(grants: DataFrame) -> DataFrame:
    """role and how many keys it has."""
    return grants.groupBy("role").agg(F.countDistinct("key").alias("n_keys"))


def exported(grants: DataFrame) -> DataFrame:
    """All roles as one map."""
    return by_role(grants).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "keys")))).alias("access"))


def is_valid_manifest_type(kind: Column, known: tuple[str, ...]) -> Column:
    return F.coalesce((kind != "") & (F.char_length(kind) <= 255) & F.lower(kind).isin(*known), F.lit(False))


def simple_lookup(role: Column, keys: Column) -> Column:
    """The keys of a role where admins are the writers and nobody else has any."""
    return F.when(role.isin("admin", "write"), keys).otherwise(F.array().cast("array<string>"))
