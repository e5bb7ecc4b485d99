import random

import pytest

LATIN = ["the", "of", "and", "lorem", "ipsum", "dolor", "sit", "amet", "élan", "für", "niño", "zwölf", "x1", "1999"]


def sentence(rng, n):
    return " ".join(rng.choice(LATIN) for _ in range(n))


def lines(rng, n):
    return "\n".join(sentence(rng, rng.randint(1, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text: ordinary ones, and each case that must not matter: nulls, blanks, repeats, ties, marks, a long text."""
    rng = random.Random(7)
    texts = [lines(rng, rng.randint(1, 8)) for _ in range(60)]
    found = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    extra = [texts[3], texts[3].upper(), texts[4] + "\n" + texts[5], texts[6].replace(" ", "  "), "", "   ", "\n\n", "!!! 123 ---", "Word", "\x00\x01", "short text", "a\tb\x0bc", "日本語 テキスト", None, None]
    found += [(100 + k, t, None, None, None) for k, t in enumerate(extra)]
    found += [(3, texts[3], "en", "s0", 1), (3, texts[3], "en", "s0", 1), (None, texts[7], "en", "s1", 1), (None, None, None, None, None), (None, texts[7], "en", "s1", 1)]
    found += [(200, (texts[8] + "\n") * 400, "en", "s2", 1), (-5, texts[9] + " tail words here", "fr", "s2", 1)]
    return found


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["keep_id", "kept", "group_size", "sha", "rid", "leaks", "language", "entities", "lines_deleted", "doc", "at", "maybe", "fp", "shard", "slot", "size", "cluster", "block", "row_", "found_", "quality_score", "main_text", "bits_", "number_", "at_"]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
