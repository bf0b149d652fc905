"""Toxicity of texts by a support vector machine over a string kernel of gapped subsequences.

The kernel compares two words by the subsequences of three characters they share, each weighted by
DECAY to the power of the stretch it takes up, so that an insult with characters put in, left out or
exchanged stays near the plain one. Words stand for texts as instances stand for bags: a toxic text has
toxic words among others. The machine is trained on Nystroem features of words of labelled texts, its
landmarks chosen by pivoted Cholesky steps, and of the worst of these with a letter put in; a second round keeps of each toxic text only the words that
the first found worst. Landmarks and weights then fold into one table of 64^3 numbers, by which a word
costs a sum of looked-up numbers. A logistic curve over a text's worst words and their share gives its
score.
"""

from __future__ import annotations

import re
import string
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import passing_tables, ship, table, written

#: Labelled texts the model learns from at most, those of least hash first.
MAX_TRAIN_ROWS = 20_000
#: Different words the machine is trained on at most: the worst, the commonest, and some of the others by hash.
MAX_WORDS = 30_000
LANDMARKS, POOL = 256, 2_000
#: Words of a toxic text that the second round takes for the toxic ones.
WITNESSES = 3
#: So many of the worst words are also trained on with a letter put in, in so many forms each.
GAPPED, FORMS = 1_000, 3
COST = 3.0
#: One labelled text of so many is kept for the curve over texts, and not for the machine over words.
ASIDE = 4
LEAST_TO_SPLIT = 1_000
THRESHOLD = 0.5

#: Classes of characters: a to z, digits as one, and 36 that other letters fall into.
CLASSES = 64
DECAY, SPAN = 0.8, 7
#: Words are read in pieces of so many letters, a third of which overlap.
PIECE = 24

_SPELLED = re.compile(r"(?<!\S)(?:\S[^\S\n]+){2,}\S(?!\S)")
_MARKS = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, as often as they stand there: runs without white space in lower case, without marks.

    Letters set apart by blanks are one word, too. A word longer than PIECE letters is given in pieces.
    Null is empty, and words of under three letters are left out: they have no subsequence.
    """
    lower = (text or "").lower()
    raw = lower.split()
    if _SPELLED.search(lower):
        raw += ["".join(m.group().split()) for m in _SPELLED.finditer(lower)]
    out = []
    for word in raw:
        if not word.isalnum():
            word = _MARKS.sub("", word)
        if len(word) > PIECE:
            step = PIECE * 2 // 3
            out += [word[k : k + PIECE] for k in range(0, len(word) - PIECE + step, step)]
        elif len(word) > 2:
            out.append(word)
    return out


def _class_table() -> np.ndarray:
    kinds = np.zeros(128, np.int64)
    kinds[ord("a") : ord("z") + 1] = np.arange(26)
    kinds[ord("0") : ord("9") + 1] = 26
    return kinds


_ASCII = _class_table()


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """The triples of places within SPAN in a word of that length, their weights, and the root of the weights' squares."""
    found = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = np.array(found, np.int64).T
    weight = DECAY ** (k - i - 2.0)
    return i, j, k, weight, float(np.sqrt((weight**2).sum()))


def _by_length(words: list[str]):
    """For each length: the words' places in the list, the codes of their subsequences, and their weights over the norm.

    Weights are over the root of a norm that depends on the length alone: words are partly brought to one
    length, and kernels stay products of sums.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds = np.where(points < 128, _ASCII[np.minimum(points, 127)], 27 + points % 37)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for length in np.unique(lengths):
        i, j, k, weight, norm = _places(int(length))
        at = np.flatnonzero(lengths == length)
        c = kinds[starts[at][:, None] + np.arange(length)]
        yield at, (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k], weight / np.sqrt(norm)


class Landmarks:
    """Words that others are compared with: kernels with them are sums over the subsequences they have."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, rows, weights = [], [], []
        for at, code, weight in _by_length(words):
            codes.append(code.ravel())
            rows.append(np.repeat(at, code.shape[1]))
            weights.append(np.tile(weight, len(at)))
        used, place = np.unique(np.concatenate(codes), return_inverse=True)
        self.where = np.full(CLASSES**3, -1, np.int32)
        self.where[used] = np.arange(len(used))
        self.columns = np.zeros((len(used), len(words)), np.float32)
        np.add.at(self.columns, (place, np.concatenate(rows)), np.concatenate(weights).astype(np.float32))

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for at, codes, weight in _by_length(words):
            for part in range(0, len(at), 1024):
                here = self.where[codes[part : part + 1024]]
                line, place = np.nonzero(here >= 0)
                if len(line):
                    shares = self.columns[here[line, place]] * weight[place, None].astype(np.float32)
                    first = np.flatnonzero(np.diff(line, prepend=-1))
                    out[at[part + line[first]]] = np.add.reduceat(shares, first, axis=0)
        return out

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """The table of subsequences that stands for so much of each landmark."""
        table = np.zeros(CLASSES**3, np.float32)
        table[self.where >= 0] = self.columns @ coefficients
        return table


def weighed(words: list[str], table: np.ndarray) -> np.ndarray:
    """The sum over each word's subsequences of the table's numbers."""
    out = np.zeros(len(words))
    for at, codes, weight in _by_length(words):
        for part in range(0, len(at), 4096):
            out[at[part : part + 4096]] = table[codes[part : part + 4096]] @ weight
    return out


def pick_landmarks(pool: list[str], importance: np.ndarray, most: int) -> list[str]:
    """Those of the pool that pivoted Cholesky steps on its kernel come to first, each weighted by its importance."""
    if not pool:
        return []
    gram = Landmarks(pool).kernel(pool).astype(np.float64)
    left, factor, chosen = gram.diagonal().copy(), np.zeros((len(pool), 0)), []
    while len(chosen) < min(most, len(pool)):
        k = int(np.argmax(left * importance))
        if left[k] < 1e-6 * gram.diagonal().max():
            break
        column = (gram[:, k] - factor @ factor[k]) / np.sqrt(left[k])
        factor = np.hstack([factor, column[:, None]])
        left = np.maximum(left - column**2, 0)
        left[k] = 0
        chosen.append(k)
    return [pool[k] for k in chosen]


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(x.shape[1], 1.0)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        c = cost * weight[on]
        step = np.linalg.solve((x[on].T * c) @ x[on] + np.diag(keep), -(keep * w) + x[on].T @ (c * y[on] * slack[on]))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def gapped_forms(word: str, forms: int = FORMS) -> list[str]:
    """The word with a letter put in, at places and of letters that a hash of the word gives."""
    out, seed = [], zlib.crc32(word.encode())
    for k in range(forms):
        place, letter = 1 + (seed + k * 7) % max(1, len(word) - 1), string.ascii_lowercase[(seed // 31 + k * 11) % 26]
        out.append(word[:place] + letter + word[place:])
    return out


def train_words(words: list[str], toxic: np.ndarray, clean: np.ndarray, ratio: float) -> tuple[np.ndarray, float]:
    """The folded table and the offset, from words and the numbers of toxic and clean texts that have them.

    ratio is that of toxic to clean texts: a word without a part in toxicity is in so many toxic texts for each clean one.
    """
    excess = np.maximum(toxic - ratio * clean, 0)
    gapped = [(k, form) for k in np.argsort(-excess, kind="stable")[:GAPPED] if excess[k] > 1 for form in gapped_forms(words[k])]
    words = words + [form for _, form in gapped]
    excess = np.concatenate([excess, [excess[k] for k, _ in gapped]])
    clean = np.concatenate([clean, np.zeros(len(gapped))])
    order = np.argsort(-excess, kind="stable")
    common = np.argsort(-clean, kind="stable")
    pool = list(dict.fromkeys([*order[: POOL // 2].tolist(), *common[: POOL // 2].tolist()]))
    landmarks = pick_landmarks([words[k] for k in pool], np.sqrt(1 + np.maximum(excess, clean * ratio)[pool]), LANDMARKS)
    if not landmarks:
        return np.zeros(CLASSES**3, np.float32), 0.0
    marks = Landmarks(landmarks)
    values, vectors = np.linalg.eigh(marks.kernel(landmarks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    x = marks.kernel(words) @ root
    positive, negative = np.sqrt(excess), np.sqrt(clean)
    rows = np.concatenate([np.flatnonzero(positive), np.flatnonzero(negative)])
    y = np.concatenate([np.ones((positive > 0).sum()), -np.ones((negative > 0).sum())])
    w, offset = support_vectors(x[rows], y, np.concatenate([positive[positive > 0], negative[negative > 0]]))
    return marks.folded((root @ w).astype(np.float32)), offset


@dataclass
class Toxicity:
    """The folded table of the word machine with its offset, and the curve over texts."""

    table: np.ndarray
    offset: float
    curve: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        return weighed(words, self.table) + self.offset

    def facts(self, texts: pd.Series) -> np.ndarray:
        """What the curve looks at, for each text: its worst word, the mean of its two worst, how many are bad, and its length."""
        split = [words_of(t) for t in texts]
        known = list({w for words in split for w in words})
        value = dict(zip(known, self.words(known).tolist(), strict=True)) if known else {}
        out = np.zeros((len(split), 4))
        for row, words in zip(out, split, strict=True):
            marks = np.array([value[w] for w in words]) if words else np.array([-1.0])
            worst = np.sort(marks)[::-1][:2]
            row[:] = max(worst[0], -1), max(worst.mean(), -1), np.log1p((marks > 0).sum()), np.log1p(len(words))
        return out

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.curve[:-1] + self.curve[-1], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and offset of a logistic curve; with one label only, a constant with a weak prior of one row each."""
    prior = (y.sum() + 1) / (len(y) + 2)
    start = np.zeros(x.shape[1] + 1)
    start[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return start
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = start
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether the id's fold is 0; a null id counts as empty, and so is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Toxicity:
    """Learn from the labelled texts outside the held-out fold, at most max_rows ids of them.

    Labels without id or toxic are left out; an id with several labels has their rounded mean, one with
    several texts the least of them. What comes to the driver has MAX_WORDS words and four numbers a
    labelled text at most. Without labels, or with one only, every text has the same score.
    """
    spark = docs.sparkSession
    ship(spark)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.round(F.avg("toxic")).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select(F.col("doc_id").alias("label_id"), "label")
    )

    @F.pandas_udf("array<string>")
    def different(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(words_of(t))) for t in texts])

    with passing_tables(spark):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
        # Copies of one text say no more than one of them.
        one = rows.groupBy("id", "label").agg(F.min("body").alias("body")).dropDuplicates(["body", "label"])
        texts = written(one.repartition(spark.sparkContext.defaultParallelism), "toxic-texts")
        # With few texts, all serve both ends.
        few = texts.count() < LEAST_TO_SPLIT
        apart = F.lit(False) if few else F.pmod(F.xxhash64("id", F.lit(2)), F.lit(ASIDE)) == 0
        everything, texts = texts, texts.where(~apart)
        sizes = dict(texts.groupBy("label").count().collect())
        ratio = sizes.get(1, 0) / max(1, sizes.get(0, 0))
        words = written(texts.select("id", "label", F.explode(different("body")).alias("word")), "toxic-words")
        is_toxic, is_clean = F.sum(F.col("label")).cast("double"), F.sum(1 - F.col("label")).cast("double")

        def learned(mine: DataFrame) -> tuple[np.ndarray, float]:
            counts = written(mine.groupBy("word").agg(is_toxic.alias("toxic"), is_clean.alias("clean")), "toxic-counts")
            some = MAX_WORDS // 3
            ranks = [-(F.col("toxic") - ratio * F.col("clean")), -F.col("clean"), F.xxhash64("word")]
            got = pd.concat([counts.orderBy(r, F.xxhash64("word", F.lit(1)), "word").limit(some).toPandas() for r in ranks]).drop_duplicates("word").sort_values("word")
            return train_words(got["word"].tolist(), got["toxic"].to_numpy(float), got["clean"].to_numpy(float), ratio)

        first = Toxicity(*learned(words), np.zeros(5))

        @F.pandas_udf("array<string>")
        def worst(texts: pd.Series) -> pd.Series:
            split = [sorted(set(words_of(t))) for t in texts]
            value = first.words([w for words in split for w in words])
            ends = np.cumsum([len(words) for words in split])
            return pd.Series([[words[k] for k in np.argsort(-value[e - len(words) : e], kind="stable")[:WITNESSES]] for words, e in zip(split, ends, strict=True)])

        witnesses = texts.where("label = 1").select("id", "label", F.explode(worst("body")).alias("word"))
        model = Toxicity(*learned(words.where("label = 0").unionByName(witnesses)), np.zeros(5))

        @F.pandas_udf("array<double>")
        def facts(texts: pd.Series) -> pd.Series:
            return pd.Series(list(model.facts(texts)))

        got = everything.where(F.lit(few) | apart).select("id", "label", facts("body").alias("facts")).toPandas().sort_values("id", kind="stable")
    x = np.array([np.asarray(f, float) for f in got["facts"]], float).reshape(-1, 4)
    model.curve = logistic(x, got["label"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Toxicity, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1; a null text scores as an empty one, a long one is read whole.

    A column of the score's name is replaced. The model is a table of fixed size.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(model.facts(texts)))

    return docs.withColumn(name, score(F.col(text_col)))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
