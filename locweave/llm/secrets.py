"""Secrets in texts: a battery of randomness tests on token-like strings, with false discoveries held down by length.

A token's alphabet is inferred from its characters (hexadecimal, base32, letters, base64 and the like).
Three statistics are taken: chi-squared for uniformity over pools of characters, runs of character
classes, and the serial correlation of neighbours. Each is read twice. Against the hypothesis that the
token is random it sorts out patterns (repeats, alphabets, counters). Against the hypothesis tested,
that the token is ordinary writing, it gives a p-value; the three are combined by Cauchy's rule. Which
p-values count as found is settled for each alphabet and class of lengths by the step-up rule of
Benjamini and Hochberg over all tokens of all documents.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ship, table, written

# The base kinds and their patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

#: A token worth testing: long enough for the tests to say something.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The alphabets, smaller ones first.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
RATE = 0.01
#: p-values are counted in bins of a twentieth of a power of ten; the last bin holds all below.
BINS_PER_TEN, LAST_BIN = 20, 400

def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base rules, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


#: The hex matches that count. A run of 16 is sought first, so that short runs of letters cost nothing.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")


def alphabet_of(token: str) -> str:
    """The smallest known alphabet that holds the token, padding aside."""
    chars = set(token.rstrip("="))
    return next((n for n, a in ALPHABETS.items() if chars <= set(a)), "base64url")


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: float) -> float:
    """The upper tail of chi-squared, by the cube-root approximation."""
    if x <= 0:
        return 1.0
    return _upper(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _shifted_tail(x: float, df: int, shift: float) -> float:
    """The lower tail of chi-squared with a shift (noncentral), by a scaled plain one."""
    scale, size = (df + 2 * shift) / (df + shift), (df + shift) ** 2 / (df + 2 * shift)
    return 1 - _chi2_tail(x / scale, size) if x > 0 else _upper(math.sqrt(shift))


def _symbols(alphabet: str) -> str:
    return "".join(c for c in alphabet if not c.isalnum())


# Letters in a thousand of English words, a to z; vowels; and what ordinary long tokens (compounds,
# names with capitals or separators, numbered names, long numbers) are made of, as shares of lower case, upper case,
# digits and symbols, with how often neighbours change class and how far their classes are correlated.
PER_MILLE = dict(zip(LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7), strict=True))
FREQUENT = set("etaoinshrdlu")
VOWELS = set("aeiouy")
WRITING = {
    "hex": (0.05, 0, 0.95, 0), "HEX": (0, 0.05, 0.95, 0), "lower": (1, 0, 0, 0), "upper": (0, 1, 0, 0), "base32": (0, 0.92, 0.08, 0),
    "base36": (0.86, 0, 0.14, 0), "BASE36": (0, 0.86, 0.14, 0), "letters": (0.86, 0.14, 0, 0), "base62": (0.72, 0.14, 0.14, 0),
    "base64": (0.68, 0.1, 0.1, 0.12), "base64url": (0.68, 0.1, 0.1, 0.12),
}
#: Changes of class a character in ordinary tokens: of letters and digits, of case too, with symbols too; of vowels in words.
CHANGES = {"hex": 0.12, "HEX": 0.12, "base32": 0.13, "base36": 0.14, "BASE36": 0.14, "base62": 0.36, "base64": 0.36, "base64url": 0.36, "lower": 0.64, "upper": 0.64, "letters": 0.64}
#: Correlation of neighbours' classes, or of vowels, in ordinary tokens.
SERIAL = {n: (-0.3 if n in ("lower", "upper", "letters") else 0.3) for n in ALPHABETS}
# The letters that usually follow a letter in English words, which hold four fifths of all neighbours in names of programs.
USUAL_NEXT = {
    "a": "bcdgilmnprstvy", "b": "elouy", "c": "aehiot", "d": "eio", "e": "acdeilmnprstvx", "f": "aeior", "g": "ehr", "h": "aeio", "i": "acdefglmnorstv",
    "k": "e", "l": "adeiloy", "m": "aeiop", "n": "acdegiost", "o": "cdflmnoprstuvw", "p": "aelor", "r": "adeimosty", "s": "aehiopstu", "t": "aehiorstuy",
    "u": "clnrst", "v": "ei", "w": "aehio",
}
#: The share of usual neighbours counted on in ordinary tokens, whatever their language.
USUAL = 0.72
#: Ordinary tokens differ from these shares; this part of the distance from uniform is counted on.
SURE = 0.7


def _pools(alphabet: str, shares: tuple[float, float, float, float]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The pool of each character, and the shares of the pools in random tokens and in writing."""
    parts = [
        ([c for c in alphabet if c in LOWER and c in FREQUENT], shares[0]), ([c for c in alphabet if c in LOWER and c not in FREQUENT], shares[0]),
        ([c for c in alphabet if c in UPPER and c.lower() in FREQUENT], shares[1]), ([c for c in alphabet if c in UPPER and c.lower() not in FREQUENT], shares[1]),
        ([c for c in alphabet if c in DIGITS], shares[2]), (list(_symbols(alphabet)), shares[3]),
    ]
    weight = [sum(PER_MILLE.get(c.lower(), 1) for c in chars) for chars, _ in parts]
    case = {0: weight[0] + weight[1], 1: weight[0] + weight[1], 2: weight[2] + weight[3], 3: weight[2] + weight[3]}
    kept = [(chars, share * (w / case[k] if k in case else 1)) for k, ((chars, share), w) in enumerate(zip(parts, weight, strict=True)) if chars]
    pool = {c: k for k, (chars, _) in enumerate(kept) for c in chars}
    return pool, np.array([len(chars) for chars, _ in kept]) / len(alphabet), np.array([share for _, share in kept])


POOLS = {n: _pools(a, WRITING[n]) for n, a in ALPHABETS.items()}


def _classes(token: str, alphabet: str) -> np.ndarray:
    """The class of each character: vowel or not where there are only letters, else letter case, digit or symbol."""
    if alphabet in ("lower", "upper", "letters"):
        return np.array([c in VOWELS for c in token.lower()], float)
    return np.array([0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3 for c in token], float)


def _serial(x: np.ndarray) -> float | None:
    x = x - x.mean()
    var = float((x * x).sum())
    return float((x[1:] * x[:-1]).sum()) / var if var else None


def battery(token: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under the hypothesis that the token is random."""
    letters = ALPHABETS[alphabet_of(token)]
    place = {c: i for i, c in enumerate(letters)}
    codes = np.array([place[c] for c in token.rstrip("=") if c in place])
    n = len(codes)
    if n < 8:
        return 1.0, 1.0, 1.0
    # Few characters for many letters: the letters are pooled into classes of five expected hits at least.
    pools = max(2, min(len(letters), n // 5))
    seen = np.bincount(codes * pools // len(letters), minlength=pools)
    share = np.bincount(np.arange(len(letters)) * pools // len(letters), minlength=pools) / len(letters) * n
    uniform = _chi2_tail(float(((seen - share) ** 2 / share).sum()), pools - 1)
    high = codes >= len(letters) / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        spread = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        runs = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread))
    else:
        runs = 2.0 ** (1 - n)
    r = _serial(codes)
    serial = 2 * _upper(abs(r) * math.sqrt(n)) if r is not None else 2.0 ** (1 - n)
    return uniform, min(1.0, runs), min(1.0, serial)


@functools.lru_cache(1 << 14)
def _binomial_tail(n: int, share: float, most: int) -> float:
    """The probability of at most so many hits among n."""
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share)) for k in range(most + 1)))


def _unusual_neighbours(token: str) -> float:
    """The p-value of the neighbouring letters: how seldom a token of ordinary writing has as few usual ones."""
    low = token.lower()
    pairs = [(a, b) for a, b in zip(low, low[1:]) if a in PER_MILLE and b in PER_MILLE]
    return _binomial_tail(len(pairs), USUAL, sum(b in USUAL_NEXT.get(a, "") for a, b in pairs))


def _both(p: float, q: float) -> float:
    """One p-value of two that do not depend on one another (Fisher's combination)."""
    product = max(1e-300, p * q)
    return min(1.0, product * (1 - math.log(product)))


def against_writing(token: str) -> tuple[float, float, float]:
    """p-values of the same statistics under the hypothesis that the token is ordinary writing: small if it looks random.

    Uniformity: chi-squared of the pools is too small for writing. Runs: classes change too often, or
    vowels and consonants alternate too seldom. Serial correlation: that of classes is too far from that
    of writing, on the side of random tokens. Which letters follow one another is serial, too, and says
    most of short tokens; it does not depend on how often classes change, so that it is told with the
    runs. Six letters of hexadecimal tokens are too few for it.
    """
    name = alphabet_of(token)
    core = "".join(c for c in token.rstrip("=") if c in ALPHABETS[name])
    n = len(core)
    if n < 8:
        return 1.0, 1.0, 1.0
    pool, random, writing = POOLS[name]
    seen = np.bincount([pool[c] for c in core], minlength=len(random))
    chi = float(((seen - n * random) ** 2 / (n * random)).sum())
    uniform = _shifted_tail(chi, len(random) - 1, SURE * n * float(((writing - random) ** 2 / random).sum()))
    classes = _classes(core, name)
    rate = CHANGES[name]
    z = (int((classes[1:] != classes[:-1]).sum()) - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate))
    vowels = name in ("lower", "upper", "letters")
    r = _serial(classes)
    away = -1.0 if r is None else (r - SERIAL[name]) * (1 if vowels else -1)
    runs = _upper(-z if vowels else z)
    return uniform, runs if name in ("hex", "HEX") else _both(runs, _unusual_neighbours(core)), _upper(away * math.sqrt(n))


def combined(parts: tuple[float, ...]) -> float:
    """One p-value of several that may depend on one another (Cauchy's combination)."""
    parts = [min(1 - 1e-12, max(1e-20, p)) for p in parts]
    mean = sum(1 / (math.pi * p) if p < 1e-8 else math.tan((0.5 - p) * math.pi) for p in parts) / len(parts)
    return 1 / (math.pi * mean) if mean > 1e7 else 0.5 - math.atan(mean) / math.pi


def writing_p(token: str) -> float:
    """The p-value of the token as ordinary writing; 1 where the battery says that it is not random either (a part below 1e-4)."""
    return 1.0 if min(battery(token)) < 1e-4 else min(1.0, max(1e-20, combined(against_writing(token))))


def length_class(n: int) -> int:
    """Lengths from 20 up, in classes that double."""
    return min(12, max(0, (n // 20).bit_length() - 1))


def class_of(token: str) -> int:
    """The number of a token's class: its alphabet and its length class, whose tokens are tested together."""
    return list(ALPHABETS).index(alphabet_of(token)) * 13 + length_class(len(token))


def _bin(p: float) -> int:
    return min(LAST_BIN, int(-math.log10(p) * BINS_PER_TEN))


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """For each class the least bin that is found, by the step-up rule; counts are class, bin, number."""
    out = {}
    for c in {c for c, *_ in counts}:
        bins = sorted(((b, n) for k, b, n in counts if k == c), reverse=True)
        total, so_far = sum(n for _, n in bins), 0
        for b, n in bins:
            so_far += n
            if 10 ** (-b / BINS_PER_TEN) <= rate * so_far / total:
                out[c] = b
    return out


def tokens_of(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of the tokens worth testing that touch no base span; base spans are in order."""
    starts = [a for _, a, _ in base]
    reach = list(itertools.accumulate((b for *_, b in base), max))
    for m in TOKEN.finditer(text):
        k = bisect.bisect_left(starts, m.end())
        if not k or reach[k - 1] <= m.start():
            yield m.span()


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
MARKED = T.ArrayType(T.StructType([*SPAN.fields, T.StructField("test", T.IntegerType()), T.StructField("bin", T.IntegerType())]))
TESTED = T.ArrayType(T.StructType([T.StructField("test", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: id, base (array of start, place, kind, end in order), spans (all, likewise).

    Base spans are those of the base rules and always stay; the method adds spans of kind random that
    touch none of them. Positions count code points, ends are exclusive. Null and empty texts have no
    spans; repeated rows and null ids are rows of their own, and very long texts are scanned whole. An
    empty table gives no rows. A row's spans are kept beside its id from the first, so that no later
    step has to find the row again.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    least_bin = _bin(rate)  # the step-up rule finds nothing above the rate; those tokens are only counted
    out = T.StructType([T.StructField("id", id_type), T.StructField("marked", MARKED), T.StructField("tested", TESTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("test", pa.int32()), ("bin", pa.int32())])
        tested = pa.struct([("test", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            marked: list[list[dict]] = []
            counts: list[list[dict]] = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = [{"start": a, "place": KINDS.index(k), "kind": k, "end": b, "test": None, "bin": None} for k, a, b in base]
                seen: Counter[tuple[int, int]] = Counter()
                for a, b in tokens_of(text, base) if text else ():
                    test, p_bin = class_of(text[a:b]), _bin(writing_p(text[a:b]))
                    seen[test, p_bin] += 1
                    if p_bin >= least_bin:
                        spans.append({"start": a, "place": len(KINDS), "kind": "random", "end": b, "test": test, "bin": p_bin})
                marked.append(sorted(spans, key=lambda x: (x["start"], x["place"])))
                # Every token tested is counted, so that the step-up rule knows of all.
                counts.append([{"test": t, "bin": b, "n": n} for (t, b), n in sorted(seen.items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked, pa.list_(span)), pa.array(counts, pa.list_(tested))], names=["id", "marked", "tested"])

    found = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, out), "secret-spans")
    # 11 alphabets by 13 lengths by 401 bins at most reach the driver.
    counts = found.select(F.explode("tested").alias("t")).groupBy("t.test", "t.bin").agg(F.sum("t.n").alias("n")).collect()
    least = thresholds([(r["test"], r["bin"], r["n"]) for r in counts], rate)
    chosen = F.create_map(*[F.lit(x) for c, b in sorted(least.items()) for x in (c, b)]) if least else None

    def stays(s: Column) -> Column:
        return s["test"].isNull() if chosen is None else s["test"].isNull() | F.coalesce(s["bin"] >= F.try_element_at(chosen, s["test"]), F.lit(False))

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(*[s[f.name].alias(f.name) for f in SPAN]))

    return found.select(
        F.col("id").alias(id_col), plain(F.filter("marked", lambda s: s["test"].isNull())).alias("base"), plain(F.filter("marked", stays)).alias("spans")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import joined

    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
