"""Queries on document collections and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import blobs, documents
from tidelog.plans.registry import DOCS, query
from tidelog.sources import adapters


def _search(spark: SparkSession, d: str, text: str, **options: bool) -> DataFrame:
    return documents.search(adapters.documents(spark, d), text, **options).select("key", "doc_id")


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE key = 'src7.en.7'")
def doc_get_exact(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "src7.en.7")


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE lower(key) = 'src2.en.2'")
def doc_get_ci(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "SRC2.en.2", case_insensitive=True)


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE contains(key, '.de.1')")
def doc_get_partial(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, ".de.1", partial=True)


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE contains(replace(lower(key), '.', ' '), 'src1 en')")
def doc_get_ci_partial(spark: SparkSession, d: str) -> DataFrame:
    """The query has a space, so dots of keys are read as spaces."""
    return _search(spark, d, "SRC1 En", case_insensitive=True, partial=True)


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE contains(replace(key, '.', ' '), 'src1 en')")
def doc_get_partial_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold spaces are found by a query with one, whose dots are read as spaces; where case matters, the dots of
    keys are kept, so only keys with spaces are found."""
    docs = adapters.documents(spark, d)
    spaced = docs.withColumn("key", F.replace("key", F.lit("."), F.lit(" ")))
    return documents.search(docs.unionByName(spaced), "src1 en", partial=True).select(F.replace("key", F.lit(" "), F.lit(".")).alias("key"), "doc_id")


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE lang = 'en' AND n_chars > 2000 AND source IN ('src1', 'src2')")
def doc_query_predicate(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    predicate = (documents.field(body, "$.lang") == "en") & (documents.field(body, "$.n_chars").cast("long") > 2000) & documents.field(body, "$.source").isin("src1", "src2")
    return documents.query(adapters.documents(spark, d), predicate).select("key", "doc_id")


@query(f"WITH {DOCS} SELECT key, doc_id FROM docs WHERE lang = 'de' AND n_chars % 2 = 0")
def doc_query_callable(spark: SparkSession, d: str) -> DataFrame:
    return documents.query_callable(adapters.documents(spark, d), lambda x: x["lang"] == "de" and x["n_chars"] % 2 == 0).select("key", "doc_id")


@query(f"WITH {DOCS} SELECT key, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM docs")
def doc_json_path(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return adapters.documents(spark, d).select("key", *(documents.field(body, f"$.{n}").alias(n) for n in ("lang", "source", "n_chars")))


_MIXED = "CASE doc_id % 4 WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'b' || doc_id WHEN 2 THEN 'c' || doc_id ELSE '' END"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Bodies whose key is under _id, id or key, or missing."""
    n = F.col("doc_id")
    body = F.when(n % 4 == 0, F.to_json(F.struct(F.concat(F.lit("a"), n).alias("_id")))).when(n % 4 == 1, F.to_json(F.struct(F.concat(F.lit("b"), n).alias("id")))).when(n % 4 == 2, F.to_json(F.struct(F.concat(F.lit("c"), n).alias("key")))).otherwise(F.lit('{"other":1}'))
    return adapters.table(spark, d, "documents").select("doc_id", body.alias("body"))


@query(f"SELECT doc_id, {_MIXED} AS key FROM documents")
def doc_put_key_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("doc_id", documents.facade_key(F.col("body")).alias("key"))


@query("SELECT doc_id, 'a' || doc_id AS key FROM documents WHERE doc_id % 4 = 0")
def doc_put_checked(spark: SparkSession, d: str) -> DataFrame:
    return documents.checked(_mixed(spark, d))[0].select("doc_id", "key")


@query("SELECT doc_id, 'field missing' AS problem FROM documents WHERE doc_id % 4 <> 0")
def doc_put_rejected(spark: SparkSession, d: str) -> DataFrame:
    return documents.checked(_mixed(spark, d))[1].select("doc_id", "problem")


@query(f"WITH {DOCS}, i AS (SELECT * FROM docs WHERE doc_id % 2 = 0), f AS (SELECT key FROM i WHERE contains(lower(key), 'src3.fr')) SELECT key FROM f UNION ALL SELECT key FROM docs WHERE contains(lower(key), 'src3.fr') AND NOT EXISTS (SELECT 1 FROM f)")
def doc_facade_search(spark: SparkSession, d: str) -> DataFrame:
    """The index holds every second document; the log is searched only if the index has none."""
    docs = adapters.documents(spark, d)
    return documents.facade_search(docs.where("doc_id % 2 = 0"), docs, "SRC3.fr", case_insensitive=True, partial=True).select("key")


@query(f"WITH {DOCS} SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM docs GROUP BY lang")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = adapters.documents(spark, d).select(documents.field(F.col("body"), "$.lang").alias("lang"), documents.field(F.col("body"), "$.n_chars").cast("long").alias("n_chars"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


_BLOBS = "b AS (SELECT 'doc_' || doc_id AS tag, sha256(text) AS hash, strlen(text) AS size, doc_id FROM documents)"


@query(f"WITH {_BLOBS} SELECT hash, CAST(max(size) AS BIGINT) AS size, count(*) AS n_refs FROM b GROUP BY hash")
def blob_dedup(spark: SparkSession, d: str) -> DataFrame:
    return blobs.stored(adapters.blobs(spark, d))


@query(f"WITH {_BLOBS} SELECT DISTINCT hash FROM b WHERE hash NOT IN (SELECT hash FROM b WHERE doc_id % 3 = 0)")
def blob_gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Only every third document has kept its tag."""
    named = blobs.addressed(adapters.blobs(spark, d)).select("hash", "doc_id", "tag")
    return blobs.collectable(named.select("hash").distinct(), named.where("doc_id % 3 = 0"))


@query(f"WITH {_BLOBS} SELECT DISTINCT 'pin-' || hash AS tag, hash FROM b WHERE doc_id % 5 = 0 AND hash NOT IN (SELECT hash FROM b WHERE doc_id % 10 = 0)")
def pin_ls(spark: SparkSession, d: str) -> DataFrame:
    """Pins of every fifth document, without those of every tenth."""
    named = blobs.addressed(adapters.blobs(spark, d)).select("hash", "doc_id", "tag")
    tags = blobs.pin(named.select("tag", "hash"), named.where("doc_id % 5 = 0"), named)
    return blobs.pinned(blobs.unpin(tags, named.where("doc_id % 10 = 0").select("hash").distinct())).select("tag", "hash")


@query(f"WITH {_BLOBS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'local' WHEN doc_id % 3 = 0 THEN 'remote' END AS origin FROM b")
def blob_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Half of the contents is here; a provider has every third. Contents are told apart by tag, as some are equal."""
    named = adapters.blobs(spark, d).select(F.sha2("tag", 256).alias("hash"), "content", "doc_id")
    got = blobs.fetched(named.select("hash"), named.where("doc_id % 2 = 0"), named.where("doc_id % 3 = 0").withColumn("rank", F.lit(1)))
    return got.join(named.select("hash", "doc_id"), "hash").select("doc_id", "origin")


@query("SELECT lang AS batch, doc_id AS seq, n_chars AS size, CAST(coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def batch_combine_offsets(spark: SparkSession, d: str) -> DataFrame:
    parts = adapters.table(spark, d, "documents").select(F.col("lang").alias("batch"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return blobs.combined(parts)
