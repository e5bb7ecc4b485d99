"""Quality classification: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits or of other marks, lower-cased in ASCII. Features are tokens, pairs of neighbours, and
one feature that all pairs of a word with itself share. Their log counts, scaled to length 1, are the sparse vector whose dot
product with the weights is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import texts, trained_on
from tidelog.llm.tokens import Words, mixed

BITS = 18
#: Bound of the training sample, in labelled rows.
SAMPLE = 6000
FOLD, FOLDS = 2, 4
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
EPOCHS = 8
AGAIN = np.uint64(0xA5A5A5A5DEADBEEF)  # of a word and itself
ROWS_AT_ONCE = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    mark = ~word
    mark[:0x21] = mark[0x7F] = False
    return word, mark


WORD, MARK = _tables()


def features(batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text's vector; the last bucket is the bias."""
    lowered = [x.lower() for x in batch]
    words, marks = Words(lowered, WORD), Words(lowered, MARK)
    place = np.concatenate([words.starts, marks.starts])
    order = np.argsort(place, kind="stable")
    hashes = np.concatenate([words.hashes, marks.hashes])[order]
    text = np.concatenate([words.text, marks.text])[order]
    pairs = mixed(hashes[:-1] * np.uint64(31) + hashes[1:])
    same = text[:-1] == text[1:]
    again = (words.hashes[:-1] == words.hashes[1:]) & (words.text[:-1] == words.text[1:])  # whatever marks are between
    owner = np.concatenate([text, text[:-1][same], words.text[:-1][again]])
    bucket = (np.concatenate([hashes, pairs[same], np.full(again.sum(), AGAIN)]) >> np.uint64(64 - BITS)).astype(np.int64)
    both, counts = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
    owner, bucket, value = both >> BITS, both & ((1 << BITS) - 1), 1 + np.log(counts)
    cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
    for k in range(len(batch)):
        own = value[cuts[k] : cuts[k + 1]]
        norm = np.sqrt((own * own).sum()) if len(own) else 1.0
        yield np.append(bucket[cuts[k] : cuts[k + 1]], 1 << BITS).astype(np.int32), np.append(own / norm, 1.0).astype(np.float32)


def weights_at(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights after EPOCHS passes in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights_at(z[at], n[at])
            g = (sigmoid(w @ x) - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights_at(z, n)


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weights from the sample, in one task."""
    rows, labels = [], []
    for part in batches:
        for at in range(0, len(part), ROWS_AT_ONCE):
            rows += features([x.encode("utf-8", "replace") for x in part["text"].iloc[at : at + ROWS_AT_ONCE]])
        labels += part["quality"].astype(int).tolist()
    if labels:
        weights = fitted(rows, labels)
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"at": at, "weight": weights[at]})


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from a bounded sample of labelled documents outside the held-out fold; zeros if there are none.

    Labels are drawn by a hash of the id, so both keep their shares and a text without evidence scores as labels do on
    average. A label that is neither 0 nor 1 and a null text
    aren't learned from; a document with several labels is learned from with each.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & trained_on(FOLD, FOLDS)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    drawn = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "quality", "text").limit(2 * SAMPLE).select("text", "quality").coalesce(1)
    model = sample.mapInPandas(_learned, "at long, weight double").collect()  # at most 2**BITS rows
    weights = np.zeros((1 << BITS) + 1)
    for r in model:
        weights[r["at"]] = r["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with a column `quality_score`, 0 to 1, higher where label 1 is likelier.

    A null text scores as an empty one, which has the bias alone. Only the text decides, so equal texts score alike. A
    column that is called `quality_score` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c != "quality_score"]
    schema = docs.select(*names, F.lit(0.0).alias("quality_score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                found += [sigmoid(shared.value[k] @ x) for k, x in features(texts(batch.column(text_col).slice(at, ROWS_AT_ONCE)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "quality_score"])

    return docs.select(*names).mapInArrow(judge, schema)
