"""Personal data by weak supervision: labelers vote on candidate spans, a label model weighs them, a classifier decides.

Candidates are cut out of the texts by patterns. Five labelers vote on each: a test of its form, a
gazetteer of known parts, the words before it, a test of what it could be mistaken for, and its place in
the sentence. Expectation maximisation over the counts of vote patterns, kind by kind, estimates how far
each labeler can be trusted. The estimated labels then train a classifier (naive Bayes over hashed
features) on what the labelers do not look at: the word before, the first word, the shape, what follows.
It starts from what the votes say, with a bound, and has the last word on spans that no base rule already
gives: it finds some that no gazetteer or cue knows, and drops some that labelers were taken in by.

A text's spans are made beside its id, by columns only, and stay in that row to the end.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import table, text_or_empty, written

# The base kinds and their patterns. The possessive forms match the same texts as the plain
# ones in linear time; the start conditions only skip starts inside a run that a leftmost match begins with.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words that open sentences and are no part of a name behind them.
OPENERS = "Yesterday|Today|Tomorrow|Then|When|While|After|Before|Here|There|Now|Later|Once|Since|Last|Next|Also|However|Meanwhile|Perhaps|Maybe|If|As|At|By|Gestern|Heute|Morgen|Dann|Als|Wenn|Hier|Jetzt|Demain|Puis|Quand|Ici|Maintenant|Ayer|Hoy|Luego|Cuando|Ahora"
# Candidates of the method beyond these: telephone numbers without a country, identity numbers (in the forms of
# social security, bank accounts, national cards and passports), and capitalised names.
MORE = {
    "local_phone": r"(?<![0-9A-Za-z+.,/-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z]|[.,-][0-9])",
    "identity": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{8}-?[A-Z]|[A-Z]{1,2}[0-9]{6,9})(?![0-9A-Za-z-])",
    "name": r"(?<![\p{L}])(?!(?:" + OPENERS + r")\x20)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20)?\p{Lu}\p{Ll}++(?:[\x20-]\p{Lu}(?:\.|\p{Ll}++)){1,3}",
}
KINDS, LEARNED = [*BASE, *MORE], list(MORE)
#: What must be in a text for a pattern to match; spares the others the search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9][ .)/-]", "identity": "[0-9]{3}-[0-9]{2}-|[A-Z][0-9]{2}|[0-9]{8}-?[A-Z]", "name": r"\p{Lu}\p{Ll}+[ -]\p{Lu}"}
CONTEXT_CHARS = 40
# Words in front of personal data, in four languages.
CUES = {
    "local_phone": r"phone|\btel|call|mobile|\bcell|\bfax|anruf|ruf(?:en|nummer)|appel|llam|móvil|portable|handy|whatsapp|\bdial",
    "identity": r"\bssn|social sec|passport|passnummer|passeport|pasaporte|iban|\bdni\b|\bnif\b|\bid\b|identi|ausweis|personal number|insurance|versicherung|licen[cs]e|account",
    "name": r"\bnamed?\b|author|\bby\s*$|dear|contact|\bnom\b|\bvon\s*$|\bpor\s*$|signed|regards|my name is|i am|called|nombre|heißt|je suis|attn|mrs?\.?\s*$|\bsaid\s*$|patient|customer|employee",
}
# Common first names, as public registers of names list them, in four languages.
FIRST_NAMES = """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua
kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary eric stephen jonathan larry justin scott peter mary patricia jennifer linda
elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah laura rebecca sharon
anna maria julia emma sophia olivia alice hans klaus jürgen stefan andreas wolfgang uwe heinz dieter petra sabine monika ursula claudia katrin heike jean pierre
jacques michel philippe alain marie nathalie isabelle sylvie camille jose juan carlos luis antonio manuel francisco javier miguel pedro carmen ana isabel pilar
lucia rosa elena eva""".split()
GAZETTEER = {
    "local_phone": r"^\(?(?:0[1-9]|[2-9][0-9]{2})",
    "identity": r"^(?:(?!000|666|9)[0-9]{3}-|(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}|[0-9]{8}|[A-Z]{1,2}[0-9])",
    "name": r"(?i)(?:^|[\x20-])(?:" + "|".join(FIRST_NAMES) + r")(?:[\x20-])",
}
# The strictest form of each kind.
FORM = {
    "local_phone": r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$|^\(?0[0-9]{1,4}\)?[ /-][0-9 .-]{5,12}$",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$|^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}|^[0-9]{8}-?[A-Z]$",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b",
}
# Months, days and openings of sentences that make capitalised words no names.
NO_NAME = r"(?i)\b(?:the|a|an|this|that|these|in|on|of|and|or|but|for|to|from|with|we|he|she|it|they|you|der|die|das|ein|eine|und|le|la|les|un|une|et|el|los|las|una|y|january|february|march|april|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|street|university|company|inc|city|north|south|west|east|new|united|licen[cs]e|version|copyright|foundation|software|public|general|apache|gnu|commons|project|chapter|section|table|figure|act|law|court|river|lake|mount|sea|bank|bridge|gate|airport|station|park|island|club|college|institute|hotel|museum|church|square|road|avenue|group|committee|party|union|war|prize|press)\b|\b(\p{L}+)[ -]\1\b"
# What stands right before a span within a sentence: for names a word in lower case, for numbers a word or a mark of what follows.
PLACES = {"local_phone": r"[\p{L}:#(]\x20?$", "identity": r"[\p{L}:#(]\x20?$", "name": r"(?:^|[^\p{L}])\p{Ll}+[,;:]?\x20$"}
LABELERS = ("form", "gazetteer", "context", "shape", "place")
#: What the votes together may weigh at most, as log odds.
MOST_VOTES = 3.0
#: Features of the classifier: the word before, the first word, the shape of all, its length, what stands before and after.
FEATURES = ("word_before", "first_word", "shape", "length", "mark_before", "mark_after")
BUCKETS = 512
EM_ROUNDS = 60
#: Spans that each labeler's first guess counts for: keeps the meaning of votes where a kind has few candidates.
PRIOR_SPANS = 20.0
ACCEPT = 0.8
#: Features are not independent, so the evidence of each counts for this part.
PART = 0.6
#: Parts of a text that running sums go over at a time.
RUN = 64

OPEN, SAFE = "\ue000", "\ue001"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def is_base(kind: str, span: Column) -> Column:
    """Whether a match of a base pattern passes its kind's test."""
    digits = _digits(span)
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    size = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": span.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"),
        "card": F.when(size.between(14, 19), luhn(F.when(size.between(14, 19), digits).otherwise("0"))).otherwise(False),
        "phone": size.between(10, 15),
    }[kind]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression in a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers: of blocks first, so that a long one takes no quadratic time."""
    zero = F.lit(0)

    def add(a: Column, b: Column) -> Column:
        return a + b

    def of_blocks(blocks: Column) -> Column:
        within = F.transform(blocks, lambda block: F.transform(block, lambda _, i: F.aggregate(F.slice(block, 1, i + 1), zero, add)))
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, add))
        offsets = let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, 1, i), zero, add)))
        return F.flatten(F.zip_with(within, offsets, lambda w, o: F.transform(w, lambda x: x + o)))

    starts = F.sequence(zero, F.floor((F.size(lengths) - 1) / RUN).cast("int"))
    return let(F.transform(starts, lambda b: F.slice(lengths, b * RUN + 1, F.lit(RUN))), of_blocks)


def candidates(body: Column, kind: str) -> Column:
    """Every match of a kind's pattern: array of struct(start, end, span, before, after); null where there can be none.

    The matches are set off by a private character and the text is split there; positions are running
    sums of the lengths of the parts.
    """
    plain = F.replace(body, F.lit(OPEN), F.lit(SAFE))
    parts = F.split(F.regexp_replace(plain, (BASE | MORE)[kind], f"{OPEN}$0{OPEN}"), OPEN)

    def spans(ps: Column, ends: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)),
            lambda i: F.struct(
                F.get(ends, i - 1).cast("long").alias("start"),
                F.get(ends, i).cast("long").alias("end"),
                F.get(ps, i).alias("span"),
                F.substring(F.get(ps, i - 1), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                F.substring(F.get(ps, i + 1), 1, 1).alias("after"),
            ),
        )

    found = let(parts, lambda ps: F.when(F.size(ps) > 2, let(running(F.transform(ps, F.length)), lambda ends: spans(ps, ends))))
    return F.when(body.rlike(HINTS[kind]), found)


def votes(kind: str, m: Column) -> Column:
    """A labeler's vote a bit, the first one lowest: 1 for personal data, 0 against."""
    span, size = m["span"], F.length(_digits(m["span"]))
    shape = {
        "local_phone": size.between(7, 12) & ~span.rlike(r"^(?:19|20)[0-9]{2}[ .-]|^[0-9]{3}([ .])[0-9]{3}\1[0-9]{3}$"),
        "identity": size.between(6, 26),
        "name": ~span.rlike(NO_NAME) & F.length(span).between(5, 40),
    }[kind]
    flags = (span.rlike(FORM[kind]), span.rlike(GAZETTEER[kind]), F.lower(m["before"]).rlike(CUES[kind]), shape, m["before"].rlike(PLACES[kind]))
    return sum((F.coalesce(v, F.lit(False)).cast("int") * 2**k for k, v in enumerate(flags)), F.lit(0))


def features(kind: str, m: Column) -> Column:
    """The bucket of each feature, among those of all kinds and features."""
    span, before = m["span"], m["before"]
    first = F.regexp_replace(F.lower(F.substring_index(span, " ", 1)), "[0-9]", "0")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(span, "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{Ll}+", "a")
    values = (
        F.lower(F.regexp_extract(before, r"([\p{L}0-9]+)[^\p{L}0-9]*$", 1)),
        first,
        shape,
        F.floor(F.length(span) / 3).cast("string"),
        F.regexp_replace(F.regexp_extract(before, r".$", 0), r"[\p{L}0-9]", "w"),
        F.regexp_replace(m["after"], r"[\p{L}0-9]", "w"),
    )
    at = LEARNED.index(kind) * len(FEATURES)
    return F.array(*[F.lit((at + k) * BUCKETS) + F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int") for k, v in enumerate(values)])


def marked(body: Column) -> Column:
    """The base spans and the other kinds' candidates of a text: array of struct(start, place, kind, end, votes, features).

    Base spans have no votes. What fails a base kind's test is none of that kind, and no candidate either.
    """
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,votes:int,features:array<int>>>")

    def of(kind: str) -> Column:
        def one(m: Column) -> Column:
            learned = (votes(kind, m), features(kind, m)) if kind in MORE else (F.lit(None).cast("int"), F.lit(None).cast("array<int>"))
            return F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                learned[0].alias("votes"), learned[1].alias("features"),
            )

        found = candidates(body, kind)
        kept = found if kind in MORE else F.filter(found, lambda m: F.coalesce(is_base(kind, m["span"]), F.lit(False)))
        return F.coalesce(F.transform(kept, one), none)

    return F.concat(*[of(kind) for kind in KINDS])


def label_model(counts: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation maximisation on one kind's vote patterns with counts: the share of true spans, and each labeler's rates of votes for true and other spans."""
    width, weight = len(counts[0][0]) if counts else len(LABELERS), PRIOR_SPANS
    share, rates = 0.3, [(0.8, 0.2)] * width
    for _ in range(rounds):
        sums = [[0.8 * weight, weight, 0.2 * weight, weight] for _ in range(width)]
        true, total = 1.0, 4.0
        for pattern, n in counts:
            p = posterior(pattern, share, rates)
            true, total = true + n * p, total + n
            for k, vote in enumerate(pattern):
                s = sums[k]
                s[0], s[1], s[2], s[3] = s[0] + n * p * vote, s[1] + n * p, s[2] + n * (1 - p) * vote, s[3] + n * (1 - p)
        share = true / total
        # A labeler says no less of true spans than of others: a kind's two classes cannot change places.
        rates = [(max(s[0] / s[1], s[2] / s[3]), min(s[0] / s[1], s[2] / s[3])) for s in sums]
    return share, rates


def posterior(pattern: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(share / (1 - share))
    for vote, (yes, no) in zip(pattern, rates, strict=True):
        odds += math.log(yes / no) if vote else math.log((1 - yes) / (1 - no))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def bits(number: int) -> tuple[int, ...]:
    return tuple(number >> k & 1 for k in range(len(LABELERS)))


def span_classifier(sums: dict[int, tuple[float, float]], smooth: float = 2.0) -> tuple[list[float], list[float]]:
    """Naive Bayes from the sums of labels for and against by bucket: the log odds of each kind, and those of each bucket."""
    odds, weights = [], [0.0] * (len(LEARNED) * len(FEATURES) * BUCKETS)
    for k in range(len(LEARNED)):
        first = k * len(FEATURES) * BUCKETS
        of = {f: [sums.get(first + f * BUCKETS + b, (0.0, 0.0)) for b in range(BUCKETS)] for f in range(len(FEATURES))}
        yes, no = (sum(x[i] for x in of[0]) for i in (0, 1))
        odds.append(math.log((yes + 1) / (no + 3)))
        share = (yes + 1) / (yes + no + 4)
        for f, rows in of.items():
            for b, (y, n) in enumerate(rows):
                if y + n:
                    weights[first + f * BUCKETS + b] = math.log((y + smooth * share) / (n + smooth * (1 - share))) - math.log(share / (1 - share))
    return odds, weights


def _numbers(values: list[float]) -> Column:
    """An array of numbers as one constant."""
    return F.from_json(F.lit(json.dumps([round(v, 6) for v in values])), "array<double>")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per input row: id, base (array of start, place, kind, end in order), spans (all of them, likewise).

    Base spans are those of the base rules and always stay; the method adds spans of any kind that its
    classifier accepts and that touch no base span. Positions count code points, ends are exclusive.
    Null and empty texts have no spans; very long texts are read whole. Repeated rows and null ids are
    rows of their own. With no candidates at all nothing is learned and nothing added.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), marked(text_or_empty(text_col)).alias("spans")), "pii-spans")

    # What leaves the cluster has a bound: 2 ** 5 vote patterns a kind, and then two sums a bucket.
    each = rows.select(F.explode(F.filter("spans", lambda s: s["votes"].isNotNull())).alias("s"))
    seen = each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    of_kind = {k: label_model([(bits(r["votes"]), r["n"]) for r in seen if r["kind"] == k]) for k in LEARNED}
    labels = _numbers([posterior(bits(v), *of_kind[k]) for k in LEARNED for v in range(1 << len(LABELERS))])
    label = F.get(labels, (F.col("s.place") - len(BASE)) * (1 << len(LABELERS)) + F.col("s.votes"))
    learned = each.select(F.explode("s.features").alias("bucket"), label.alias("p")).groupBy("bucket").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    _, weights = span_classifier({r["bucket"]: (r["yes"], r["no"]) for r in learned.collect()})
    weights = _numbers(weights)

    voted = _numbers([max(-MOST_VOTES, min(MOST_VOTES, math.log(p / (1 - p)))) for k in LEARNED for v in range(1 << len(LABELERS)) for p in [posterior(bits(v), *of_kind[k])]])

    def believed(s: Column) -> Column:
        kind = s["place"] - len(BASE)
        start = F.get(voted, kind * (1 << len(LABELERS)) + s["votes"])
        total = F.aggregate(s["features"], start, lambda a, f: a + PART * F.get(weights, f))
        return total >= math.log(accept / (1 - accept))

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "kind", "end")]))

    found = rows.select(
        "id", plain(F.filter("spans", lambda s: s["votes"].isNull())).alias("base"), plain(F.filter("spans", lambda s: s["votes"].isNotNull() & believed(s))).alias("more")
    )
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select(F.col("id").alias(id_col), F.sort_array("base").alias("base"), F.sort_array(F.concat("base", free)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
