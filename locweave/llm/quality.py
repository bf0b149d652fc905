"""Quality scores of texts by an additive model of what can be counted in them."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam
from .columns import ship, table

#: Labelled rows the model learns from at most, those of least hash first: 16 features of 8 bytes a row.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "marks", "odd_marks", "lines",
    "distinct_words", "top_word", "repeated_next", "repeated_lines", "sentence_ends", "loud_ends",
)

_IS = np.zeros((6, 256), bool)
_IS[0, list(range(65, 91))] = True  # capitals
_IS[1, list(range(48, 58))] = True  # digits
_IS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # marks
_IS[3, list(b"|#$%&*<>{}[]\\^~_=+@/!")] = True  # marks that prose seldom has
_IS[4, [10, 13]] = True  # line ends
_IS[5, list(b".?")] = True  # ends of sentences


def features_of(text: str | None) -> list[float]:
    """The numbers of one text; null is empty, and an empty text has a row like any other."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) * _IS).sum(axis=1) if raw else np.zeros(6)
    n, words = max(1, len(raw)), raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = list(map(len, words))
    counts = Counter(words)
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        sum(sizes) / m,
        sum(s > 12 for s in sizes) / m,
        sum(s < 4 for s in sizes) / m,
        *(kinds[:4] / n),
        kinds[4] / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        kinds[5] / m,
        sum(w[-1:] in b"!#$%&*|" for w in words) / m,
    ]


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(-1, len(FEATURES))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether the id's fold is 0; a null id counts as empty, and so is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> gam.Gam:
    """Learn from the labelled rows outside the held-out fold, at most max_rows of them.

    Labels without id or quality are left out; an id with several labels has their rounded mean. An id
    with several texts counts once, by the least of their features, so that what comes to the driver has
    max_rows rows at most, however often an id is repeated.
    """
    ship(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select(F.col("doc_id").alias("label_id"), "label")
    )

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    one = rows.select("id", "label", numbers("body").alias("features")).groupBy("id", "label").agg(F.min("features").alias("features"))
    got = one.toPandas().sort_values("id", kind="stable")
    x = np.array([np.asarray(f, float) for f in got["features"]], float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["id"].to_numpy())) if len(got) else []
    return gam.fit(x[order], got["label"].to_numpy()[order])


def scored(docs: DataFrame, model: gam.Gam, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1; a null text scores as an empty one, a long one is read whole.

    A column of the score's name is replaced. The model is a few tables of fixed size.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return docs.withColumn(name, score(F.col(text_col)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
