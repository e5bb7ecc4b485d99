"""The registered queries: contracts of their columns, their SQL, and the pipeline's decisions against plain ones."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.test_dedup import linked, plain_fingerprint
from tests.llm.test_texts import plain_leaks
from tidelog.llm import language_id, quality, queries

DIR = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op2_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    types = dict(queries.QUERIES[name](spark, DIR).dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False))) == sorted(map(str, want[columns].itertuples(index=False)))


def test_decisions(spark):
    """Near duplicates: the least id of each component stays. Decontamination: what plain windows don't hit stays."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    roots = linked([plain_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    got = p.keep_one_of_near_duplicates(spark, docs, DIR)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(roots))
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, _, n_hit, _ in plain_leaks(rows, items) if not n_hit]
    assert sorted(r["doc_id"] for r in p.drop_contaminated(spark, docs, DIR).collect()) == sorted(clean)
    assert len(set(roots)) < len(rows) and len(clean) < len(rows)


def test_languages_beyond_any_number(spark):
    """Every labelled language is learned, however many there are."""
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(90)]
    rows = [(100 * k + n, " ".join(f"{s}{'aeiou'[(n + j) % 5]}{s[::-1]}" for j in range(30)), f"l{k}") for k, s in enumerate(stems) for n in range(6)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("lang", "language.lang_pred").collect()
    assert len({r["lang_pred"] for r in found}) == 90
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.95 * len(found)


def test_centroids_by_plain_sums():
    """The prediction against similarities that are added up one by one."""
    texts = {"a": ["the cat sat on the mat", "the dog sat on the log"], "b": ["der hund und die katze", "die maus und der hund"]}
    model = {"weight": np.ones(language_id.BUCKETS, np.float32), "langs": ["a", "b"], "of": np.array([0, 1]), "least": np.array([0.0, 0.0])}
    sums = [np.log1p(sum(language_id.counted(x) for x in own)) for own in texts.values()]
    model["centroids"] = np.array([x / np.sqrt(sum(float(v) ** 2 for v in x)) for x in sums], np.float32)
    for lang, own in texts.items():
        for x, got in zip(own, language_id.predicted(own, model), strict=True):
            v = np.log1p(language_id.counted(x))
            near = [sum(float(a) * float(b) for a, b in zip(v, c, strict=True) if a) / float(np.sqrt((v * v).sum())) for c in model["centroids"]]
            assert got["lang_pred"] == lang and got["score"] == pytest.approx(max(near), abs=1e-5)


def test_ftrl_by_plain_steps():
    """Weights against follow-the-regularised-leader updates of one coordinate at a time."""
    rows = list(quality.features([b"good clear text here", b"spam spam spam buy", b"clear good words", b"buy spam now"]))
    labels = [1, 0, 1, 0]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for (at, x), y in zip(rows, labels, strict=True):
            w = {int(i): weight(int(i)) for i in at}
            score = 1 / (1 + np.exp(-sum(w[int(i)] * float(v) for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                g, i = (score - y) * float(v), int(i)
                step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    got = quality.fitted(rows, labels)
    for at, _ in rows:
        for i in at:
            assert got[i] == pytest.approx(weight(int(i)), abs=1e-4)


def test_words_of_extracted_pages(spark):
    """The digest columns follow from the operator's text."""
    for r in queries.op4_html_extract(spark, DIR).collect():
        assert r["n_chars"] == len(r["text"]) and r["text"] == re.sub(r"\s+", " ", r["text"]).strip()
