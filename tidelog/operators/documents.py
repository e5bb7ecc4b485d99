"""Operators on JSON document collections: key and body, one row a document."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_matches(key: Column, query: str, case_insensitive: bool = False, partial: bool = False, facade: bool = False) -> Column:
    """The key search's test. A query with a space has its dots read as spaces; so have keys, but only if case doesn't
    matter, and never for the facade."""
    spaced = " " in query
    wanted = query.replace(".", " ") if spaced else query
    if case_insensitive:
        wanted, key = wanted.lower(), F.lower(key)
        if spaced and not facade:
            key = F.replace(key, F.lit("."), F.lit(" "))
    return key.contains(wanted) if partial else key == wanted


def search(docs: DataFrame, query: str, case_insensitive: bool = False, partial: bool = False) -> DataFrame:
    return docs.where(key_matches(F.col("key"), query, case_insensitive, partial))


def readable(docs: DataFrame) -> DataFrame:
    """Documents whose body is JSON."""
    return docs.where(F.try_parse_json("body").isNotNull())


def facade_search(docs: DataFrame, log_docs: DataFrame, query: str, case_insensitive: bool = False, partial: bool = False) -> DataFrame:
    """The facade's search of the index; of the log only if that finds nothing. Both have key and body. From the log, a body
    that isn't JSON is wrapped."""
    found = readable(docs).where(key_matches(F.col("key"), query, case_insensitive, partial, facade=True)).select("key", "body")
    wrapped = F.when(F.try_parse_json("body").isNotNull(), F.col("body")).otherwise(F.to_json(F.struct("key", F.col("body").alias("value"), F.lit("PUT").alias("op_type"))))
    own = F.lower("key") if case_insensitive else F.col("key")
    wanted = query.lower() if case_insensitive else query
    other = log_docs.where(own.contains(wanted) if partial else own == wanted).select("key", wrapped.alias("body"))
    none = found.limit(1).groupBy().agg(F.count(F.lit(1)).alias("n_")).where("n_ = 0").select(F.lit(1).alias("none_"))
    return found.unionByName(other.join(F.broadcast(none)).drop("none_"))


def field(body: Column, path: str) -> Column:
    """The text at a JSON path; null if there is none."""
    return F.get_json_object(body, path)


def query(docs: DataFrame, predicate: Column) -> DataFrame:
    """Documents of which the predicate holds; one that is null is skipped."""
    return docs.where(F.coalesce(predicate, F.lit(False)))


def query_callable(docs: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """Documents of which a Python function of the parsed body holds, in Arrow batches. One that fails is skipped."""
    @F.pandas_udf("boolean")
    def holds(bodies: pd.Series) -> pd.Series:
        def one(body: str | None) -> bool:
            try:
                return bool(predicate(json.loads(body)))
            except Exception:  # noqa: BLE001  the facade skips a document whose predicate fails
                return False

        return bodies.map(one).astype(bool)

    return docs.where(holds("body"))


def extracted_key(body: Column, name: str = "_id") -> Column:
    """The document's key: a text that isn't empty under the name; else null."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")) == "STRING"
    return F.when(is_text & (value != ""), value)


def key_problem(body: Column, name: str = "_id") -> Column:
    """Why a document has no key: not JSON, not an object, no such field, no text or an empty one; null if it has one."""
    parsed = F.try_parse_json(body)
    inner = F.try_variant_get(parsed, f"$.{name}", "variant")
    return (
        F.when(parsed.isNull(), "not json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object").when(inner.isNull(), "field missing")
        .when(F.schema_of_variant(inner) != "STRING", "not text").when(F.try_variant_get(parsed, f"$.{name}", "string") == "", "empty")
    )


def facade_key(body: Column) -> Column:
    """The first of _id, id and key, or an empty key."""
    return F.coalesce(field(body, "$._id"), field(body, "$.id"), field(body, "$.key"), F.lit(""))


def checked(docs: DataFrame, name: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Documents that have a key, with it, and the rejected ones with the reason."""
    judged = docs.withColumn("problem", key_problem(F.col("body"), name))
    return judged.where("problem is null").drop("problem").withColumn("key", extracted_key(F.col("body"), name)), judged.where("problem is not null")
