"""Language identification by nearest centroids.

A text's bytes, lower-cased and with all but letters folded to single spaces, are cut into n-grams of 2 and 3 bytes, which
are hashed into BUCKETS; log counts times inverse document frequency, scaled to length 1, make its vector. Each language
has several centroids, found by k-means with cosine distance in a sample of its texts. A text gets the language of the
nearest centroid; if it is farther from it than nearly all that was learned, it is rejected as well. Few n-grams can't come
near a centroid, so below FULL_GRAMS the similarity asked for falls with the root of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import trained_on, written

BUCKETS = 1 << 13
CENTROIDS = 4  # per language
#: Bounds of the training sample: about so many texts of each language, and never more than so many.
SAMPLE_A_LANGUAGE = 800
MOST_ROWS = 2 * SAMPLE_A_LANGUAGE
FOLD, FOLDS = 1, 3
ROUNDS = 12
#: A text is rejected if its similarity is under this share of what all but 1 in 500 learned texts reach.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.002
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
ROWS_AT_ONCE = 128
FULL_GRAMS = 400
CUT = 1 << 20  # bytes that are counted at once


def _table() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


TABLE = _table()


def counted(text: str) -> np.ndarray:
    """Counts of the text's n-grams by bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    for at in range(0, len(data), CUT):
        folded = TABLE[data[at : at + CUT + 2]]
        space = folded == 0x20
        folded = folded[np.concatenate([[True], ~(space[1:] & space[:-1])])].astype(np.uint32)
        two = folded[:-1] * np.uint32(256) + folded[1:]
        three = two[:-1] * np.uint32(256) + folded[2:]
        for grams in (two, three + np.uint32(1 << 24)):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


def counts_of(texts: list[str]) -> np.ndarray:
    found = np.zeros((len(texts), BUCKETS), np.float32)
    for k, x in enumerate(texts):
        found[k] = counted(x)
    return found


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine from rows spread over the similarity to the mean, so the same rows always give the same ones."""
    k = min(k, len(x))
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    found = x[order[np.linspace(0, len(x) - 1, k).round().astype(int)]].copy()
    for _ in range(ROUNDS):
        nearest = (x @ found.T).argmax(axis=1)
        for i in range(k):
            if (own := x[nearest == i]).size:
                found[i] = scaled(own.mean(axis=0))
    return found


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, and the buckets and log counts of each text."""
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            counts = counted(text)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": [lang], "at": [at.astype(np.int32)], "value": [np.log1p(counts[at]).astype(np.float32)]})


def trained(vectors: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The centroids of one language's texts, and the least similarity that isn't rejected."""
    own = np.zeros((len(vectors), BUCKETS), np.float32)
    for k, (at, value) in enumerate(vectors):
        own[k, at] = value * weight[at]
    own = scaled(own)
    found = centroids(own, CENTROIDS).astype(np.float32)
    return found, float(np.quantile((own @ found.T).max(axis=1), REJECT_QUANTILE)) * REJECT_SHARE


def learn(docs: DataFrame) -> dict | None:
    """The model from a bounded sample of texts with a language, outside the held-out fold; None if there are none.

    Every language that labels a text is learned, from about SAMPLE_A_LANGUAGE texts that a hash of id and text draws, so
    any split of the table gives the same sample. Languages are trained each by itself; a model holds CENTROIDS centroids
    of BUCKETS numbers a language (128 KB).
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & trained_on(FOLD, FOLDS))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")  # a table, so that its size is known to the join
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double")
    sample = rows.join(counts, "lang").where(drawn < F.lit(float(SAMPLE_A_LANGUAGE << 53)) / F.col("n")).select("lang", "text")
    vectors = written(sample.mapInPandas(_vectors, "lang string, at array<int>, value array<float>"), "vectors")
    held = vectors.select(F.explode("at").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).collect()  # at most BUCKETS rows
    if not held:
        return None
    weight = np.zeros(BUCKETS, np.float32)
    weight[[r["bucket"] for r in held]] = [r["texts"] for r in held]
    weight = (np.log((1 + vectors.count()) / (1 + weight)) + 1).astype(np.float32)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(group)), key=lambda k: (len(group["at"].iloc[k]), np.asarray(group["at"].iloc[k]).tobytes(), np.asarray(group["value"].iloc[k]).tobytes()))
        found, least = trained([(np.asarray(group["at"].iloc[k]), np.asarray(group["value"].iloc[k])) for k in order[:MOST_ROWS]], weight)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "least": [least], "centroids": [found.tobytes()]})

    own = sorted(vectors.groupBy("lang").applyInPandas(train, "lang string, least double, centroids binary").collect(), key=lambda r: r["lang"])
    stacks = [np.frombuffer(r["centroids"], np.float32).reshape(-1, BUCKETS) for r in own]
    return {
        "weight": weight,
        "langs": [r["lang"] for r in own],
        "of": np.repeat(np.arange(len(own)), [len(s) for s in stacks]),
        "least": np.array([r["least"] for r in own]),
        "centroids": np.concatenate(stacks),
    }


def predicted(texts: list[str | None], model: dict | None) -> list[dict]:
    """Each text's language, similarity to the nearest centroid and whether it is rejected."""
    unknown = {"lang_pred": UNKNOWN, "score": 0.0, "rejected": True}
    known = [k for k, x in enumerate(texts) if model and x and LETTER.search(x)]
    found = [dict(unknown) for _ in texts]
    if known:
        counts = counts_of([texts[k] for k in known])
        asked = np.sqrt(np.minimum(1, counts.sum(axis=1) / FULL_GRAMS))
        near = scaled(np.log1p(counts) * model["weight"]) @ model["centroids"].T
        best = near.argmax(axis=1)
        for k, b, score, share in zip(known, best, near[np.arange(len(best)), best], asked, strict=True):
            lang = int(model["of"][b])
            found[k] = {"lang_pred": model["langs"][lang], "score": float(min(1.0, max(0.0, score))), "rejected": bool(score < model["least"][lang] * share)}
    return found


def identify(docs: DataFrame, learned_from: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with a column `language`: struct of lang_pred, score (0 to 1) and rejected.

    A null text or one without a letter is `und`, score 0, rejected, as is all if nothing can be learned. Equal texts get
    equal results; only the text decides. A column that is called `language` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs if learned_from is None else learned_from))
    names = [c for c in docs.columns if c != "language"]
    schema = docs.select(*names, F.lit(None).cast("struct<lang_pred:string,score:double,rejected:boolean>").alias("language")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                cut = batch.slice(at, ROWS_AT_ONCE)
                found = predicted(cut.column(text_col).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(found, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))], names=[*names, "language"])

    return docs.select(*names).mapInArrow(judge, schema)
