"""The operators as registered queries over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, exact_dedup, html_extract, language_id, line_dedup, packing, pii, quality, sharding, simhash
from tidelog.llm.common import LOWER, UPPER, read, trained_on

SHARDS = 40
PII_SECRET = "demonstration key"  # a real run passes its own


def op2_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark"))
    leaks = F.col("leaks")
    return found.select(
        "doc_id", leaks["n_words"].alias("n_words"), leaks["n_hit"].alias("n_hit"), F.size(leaks["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leaks["items"], ","), 256).alias("items_sha256"), (leaks["n_hit"] > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, d, "documents").select("doc_id", "text"))


def op4_html_extract(spark: SparkSession, d: str) -> DataFrame:
    found = html_extract.extract(read(spark, d, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", (~trained_on(language_id.FOLD, language_id.FOLDS)).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.pseudonymise(read(spark, d, "documents").select("doc_id", "text"), PII_SECRET)
    total = F.aggregate(F.map_values("entities"), F.lit(0), lambda a, n: a + n).cast("long")
    counts = [F.coalesce(F.try_element_at("entities", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", "text", total.alias("n_entities"), *counts)


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = quality.score(docs.select("doc_id", "text"), quality.learn(docs, read(spark, d, "labels")))
    score = F.col("quality_score")
    return found.select("doc_id", (~trained_on(quality.FOLD, quality.FOLDS)).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(read(spark, d, "documents")),
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_simhash": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.pack(read(spark, d, "documents")),
    "op9_sharding": lambda spark, d: sharding.shard(read(spark, d, "documents"), SHARDS),
    "op10_quality": op10_quality,
}

_NORM = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) t
WINDOW w AS (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST)""",
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
starts AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS n, unnest(range(1, len(ws) - least({decontaminate.WINDOW}, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths) t),
found AS (SELECT doc_id, n, i, item FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) t GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list(DISTINCT item ORDER BY item), ',') AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, trim(ls[i], ' ') AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) t),
w AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT *, greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM l) t),
s AS (SELECT a.doc_id, a.i AS b, min(z.i) AS e FROM w a JOIN w z ON z.doc_id = a.doc_id AND z.i BETWEEN a.i AND a.i + {line_dedup.MIN_WORDS} AND z.upto >= a.upto - a.n + {line_dedup.MIN_WORDS} GROUP BY ALL
  UNION SELECT z.doc_id, max(a.i), z.i FROM w a JOIN w z ON z.doc_id = a.doc_id AND a.i BETWEEN z.i - {line_dedup.MIN_WORDS} AND z.i AND z.upto >= a.upto - a.n + {line_dedup.MIN_WORDS} GROUP BY z.doc_id, z.i),
g AS (SELECT doc_id, b, e, e - b + 1 AS m, array_to_string(list_transform(ls[b:e], lambda x: trim(x, ' ')), chr(10)) AS run FROM s JOIN d USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER v AS first_doc, first_value(b) OVER v AS first_b, row_number() OVER v AS r FROM g WINDOW v AS (PARTITION BY m, run ORDER BY doc_id, b)),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(b, first_b + m) ELSE b END, e + 1)) AS i FROM f WHERE r > 1),
lost AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(cut, i)), lambda i: ls[i]), chr(10)) END AS text, coalesce(len(cut), 0) AS lines_deleted
FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op9_sharding": f"""
WITH RECURSIVE walk(doc_id, key, place, upto) AS (
  SELECT doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616 ELSE CAST(coalesce(doc_id, 0) AS HUGEINT) END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, nxt, upto, CAST(floor((upto + 1) * (CAST(2147483648 AS DOUBLE) / CAST((nxt // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, (key * {sharding.FACTOR} + 1) % 18446744073709551616 AS nxt, upto FROM walk WHERE upto < {SHARDS}) t),
ended AS (SELECT doc_id, place, upto FROM walk WHERE upto >= {SHARDS}),
crcs AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT range AS i, list_reduce([range, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)) t),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, CAST(octet_length(raw) + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS text_crc32, 'key' AS law,
  CAST(place AS INTEGER) AS shard, row_number() OVER (PARTITION BY place ORDER BY doc_id) - 1 AS slot, CAST(CASE WHEN upto = {SHARDS} THEN {SHARDS} ELSE place END AS INTEGER) AS grown_shard
FROM b JOIN ended USING (doc_id), crcs""",
}
