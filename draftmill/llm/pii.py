"""Operator 3: personal data by candidate gradient boosting.

Base spans follow fixed formats: e-mail and IP addresses, card numbers (Luhn)
and phone numbers.  Beyond them, high-recall generators propose overlapping
spans: spelled-out e-mail addresses, spaced dotted quads and hexadecimal
addresses, and in each cluster of digits (any punctuation) every run of up to
``GROUPS`` digit groups from each group on, as card and as phone number, so
that values beside each other or beside a base span are proposed on their own.
Boosted trees judge each proposal by its format and its context; a calibrated
threshold for each kind selects those to add, and of overlapping ones in a
cluster the likeliest.  Base spans always stay.

The trees are trained by Spark ML on the corpus itself.  A bounded sample
(``SAMPLE_DOCS`` documents that may hold personal data, of at most
``SAMPLE_BYTES``, picked by hash; ``SPANS_EACH`` base spans of a kind and
``RAW_EACH`` proposals of each) gives positives, its base spans written in
another way where they stand, and hard negatives: other numbers in the same
places, numbers that fail the check digit, and all that the generators propose
there without a base span.  ``MADE_DOCS`` made documents let a table without any
base spans be handled too.  A fifth of the sample calibrates the thresholds,
another fifth gives ``Judge.report``: precision and recall on documents that
neither learned from.  The trained trees become literal arrays, which one SQL
expression walks, so finding spans needs no join, no shuffle and no Python: each
text is handled where it is read.

Patterns are the contract's, written so that a search takes linear time and no
recursion: quantifiers that need no backtracking are possessive, and a match
starts only where an earlier start could not have matched.  Positions count
code points.

Edge cases: null text is empty and has no spans; texts without '@', '+' or
digits skip the patterns; very long texts are taken whole; repeated rows are
handled alike; of equally likely spans the longer and then the first is taken;
other columns come through untouched, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm.common import drop, free_name, save, text_of

KINDS = ("email", "ip", "card", "phone")

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])(?<![0-9][\x20-])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these cannot hold a match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20@\x20)"
_DOT = r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)"
GENERATORS = {
    "mail": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}}",
    "digits": r"\(?[0-9]++(?:[\x20().\-/]{1,3}+[0-9]++)*+",
    "net": r"(?i)(?<![0-9a-f.:])(?:[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}|::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}|(?:[0-9a-f]{1,4}:){1,7}:)(?![0-9a-f:])",
}
GENERATOR_NEEDS = {"mail": r"(?i)[\[({]\x20?at\x20?[\])}]|\x20at\x20[a-z0-9-]+(?:\x20?[\[({]\x20?dot|\x20dot\x20|\.[a-z0-9])|\x20@\x20", "digits": r"[0-9][0-9\x20().\-/]{5}", "net": r"[0-9]\x20?\.\x20?[0-9]|[0-9a-fA-F]:[0-9a-fA-F:]|::[0-9a-fA-F]"}
#: What each generator's span may be.
PROPOSES = {"mail": ("email",), "digits": ("card", "phone"), "net": ("ip",)}
CONTEXT = 24
#: Digit groups, digits and characters of a proposal in a cluster of digits.
GROUPS, LEAST_DIGITS, MOST_DIGITS, MOST_LENGTH = 6, 7, 19, 31

CUES = {
    "email": r"(?i)(?:mail|contact|write|reach)[^\n]{0,16}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay)[^\n]{0,14}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|dial|whatsapp)[^\n]{0,14}$",
    "other": r"(?i)(?:isbn|order|invoice|version|build|release|page|item|\bid\b|ref|date|total|sum|serial|section|usd|eur|[$€#=])[^\n]{0,8}$",
}

SEED = 11
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES, SPANS_EACH, SPELLINGS, RAW_EACH, MADE_DOCS = 1500, 1 << 16, 8, 3, 32, 250
#: Characters before and after a base span that its other spellings are put between.
AROUND = 40
#: The least precision on the calibrating fifth that a kind's threshold must reach.
PRECISION = 0.95


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their positions: array of (start, end, m)."""
    # Each match of this pattern is a gap and what follows it, so that lengths give positions; the last one is the rest of the text.
    apart = rf"(?s)(.*?)(?:{pattern}|\z)"
    whole, gap = F.regexp_extract_all(text, F.lit(apart), F.lit(0)), F.regexp_extract_all(text, F.lit(apart), F.lit(1))
    found = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)

    def placed(x: Column) -> Column:
        """x has the pieces, their gaps and the pieces' ends."""
        spans = F.transform(x["w"], lambda w, i: bound(F.length(F.get(x["g"], i)), lambda n: F.struct((F.get(x["e"], i) - F.length(w) + n).alias("start"), F.get(x["e"], i).alias("end"), F.substr(w, n + 1).alias("m"))))
        return F.filter(spans, lambda s: s["end"] > s["start"])

    pieces = bound(F.struct(whole.alias("w"), gap.alias("g")), lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g"), running(F.transform(x["w"], lambda w: F.length(w))).alias("e")))
    return F.when(found, bound(pieces, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def running(sizes: Column, block: int = 256) -> Column:
    """Running sums of an array, by blocks: appending to an array copies it, so a long one is never grown item by item."""

    def within(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    def of(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda k: within(F.slice(sizes, k * block + 1, F.lit(block))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        added = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + F.get(b, F.size(b) - 1)).alias("at"), F.concat(acc["out"], F.array(F.transform(b, lambda v: v + acc["at"]))).alias("out")))
        return F.flatten(added["out"])

    return bound(sizes, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substr(d, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # At most 255; leading zeros do not count.
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return bound(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans_of(text, BASE[kind], NEEDS[kind]), lambda s: valid(kind, s["m"]))


# -------------------------------------------------------------------- proposals


def proposals(text: Column, generator: str) -> Column:
    """Arrays of overlapping proposals (start, end, m, before, after), one array for each match of the generator."""
    matches = F.transform(
        spans_of(text, GENERATORS[generator], GENERATOR_NEEDS[generator]),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["m"].alias("m"),
            F.substr(text, F.greatest(F.lit(1), s["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), s["start"])).alias("before"),
            F.substr(text, s["end"] + 1, F.lit(CONTEXT)).alias("after"),
        ),
    )
    return F.transform(matches, within_cluster if generator == "digits" else lambda s: F.array(s))


def within_cluster(c: Column) -> Column:
    """Every run of up to GROUPS digit groups of a cluster, from each group on, within the bounds of digits and length."""
    pieces = F.regexp_extract_all(c["m"], F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def groups(x: Column) -> Column:
        ends = F.zip_with(x, running(F.transform(x, lambda p: F.length(p))), lambda p, e: F.struct(p.alias("p"), (e - F.length(p)).alias("b"), e.alias("e")))
        return F.filter(ends, lambda g: g["p"].rlike("^[0-9]"))

    def counted(g: Column) -> Column:
        """The groups with n, the digits up to the end of each."""
        return F.zip_with(g, running(F.transform(g, lambda x: x["e"] - x["b"])), lambda x, n: F.struct(x["b"].alias("b"), x["e"].alias("e"), n.alias("n")))

    def runs(g: Column) -> Column:
        def from_group(first: Column, i: Column) -> Column:
            def to_group(t: Column) -> Column:
                last = F.get(g, i + t)
                n = last["n"] - first["n"] + first["e"] - first["b"]
                # An opening bracket before the first group belongs to it if it is closed within.
                inside = F.substr(c["m"], first["b"] + 1, last["e"] - first["b"])
                opened = (first["b"] > 0) & (F.substr(c["m"], first["b"], F.lit(1)) == "(") & F.contains(inside, F.lit(")"))
                b = first["b"] - F.when(opened, 1).otherwise(0)
                fits = last.isNotNull() & n.between(LEAST_DIGITS, MOST_DIGITS) & (last["e"] - first["b"] <= MOST_LENGTH)
                return F.when(fits, F.struct(b.alias("b"), last["e"].alias("e")))

            return F.filter(F.transform(F.array(*(F.lit(t) for t in range(GROUPS))), to_group), lambda x: x.isNotNull())

        return F.flatten(F.transform(g, from_group))

    def shaped(x: Column) -> Column:
        return F.struct(
            (c["start"] + x["b"]).alias("start"),
            (c["start"] + x["e"]).alias("end"),
            F.substr(c["m"], x["b"] + 1, x["e"] - x["b"]).alias("m"),
            F.right(F.concat(c["before"], F.substr(c["m"], F.lit(1), x["b"])), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(F.substr(c["m"], x["e"] + 1), c["after"]), F.lit(CONTEXT)).alias("after"),
        )

    return F.transform(bound(bound(bound(pieces, groups), counted), runs), shaped)


FEATURES = ["kind", "length", "digits", "groups", "longest_group", "marks", "dots", "slashes", "parens", "letters", "distinct_digits", "luhn", "most_part", "first_digit", *(f"cue_{k}" for k in CUES), "glued_before", "glued_after", "spelled"]


def features(s: Column, kind: str) -> Column:
    return of_kind(shape(s), kind)


def of_kind(x: Column, kind: str) -> Column:
    """The features of a proposal of the kind, from its shape."""
    return F.concat(F.array(F.lit(float(KINDS.index(kind)))), x)


def shape(s: Column) -> Column:
    """All features but the first, which is the kind."""
    return bound(digits(s["m"]), lambda d: _shape(s, d))


def _shape(s: Column, d: Column) -> Column:
    m = s["m"]
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")

    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    def count(chars: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, chars, ""))

    values = [
        F.length(m),
        F.length(d),
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        count(r"[\x20-]"),
        count(r"\."),
        count("/"),
        count("[()]"),
        count("[A-Za-z]"),
        F.size(F.array_distinct(F.filter(F.split(d, ""), lambda c: c != ""))),
        flag(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.substr(g, F.lit(1), F.lit(6)).cast("int"))), F.lit(0)),
        F.coalesce(F.when(d != "", F.substr(d, F.lit(1), F.lit(1)).cast("int")), F.lit(-1)),
        *(flag(s["before"].rlike(cue)) for cue in CUES.values()),
        flag(s["before"].rlike(r"[\p{L}\p{N}.,/:=$€#-]$")),
        flag(s["after"].rlike(r"^[\p{L}\p{N}%/:=-]|^[.,][0-9]")),
        flag(m.rlike(r"(?i)[\[({]\x20?(?:at|dot)|\x20dot\x20")),
    ]
    return F.array(*(v.cast("double") for v in values))


# -------------------------------------------------------------------- the model


@dataclass(frozen=True)
class Judge:
    """Boosted trees (nested tuples or leaf values) with their weights, the calibration, and a threshold for each kind."""

    trees: tuple
    slope: float
    offset: float
    thresholds: dict[str, float]
    #: By kind: precision, recall and the number of right proposals among those held back from learning and calibrating.
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All trees as arrays, the nodes of each in the order of a walk that takes low branches first.

        By node: its feature (a leaf: -1), the most that goes on to the node after it (a leaf: its weighted value)
        and the node for what is above that (a leaf: itself).  By tree: its first node.
        """
        at, most, above, first = [], [], [], []

        def put(node: tuple | float, weight: float) -> None:
            k = len(at)
            leaf = isinstance(node, float)
            at.append(-1 if leaf else node[0])
            most.append(node * weight if leaf else node[1])
            above.append(k)
            if not leaf:
                put(node[2], weight)
                above[k] = len(at)
                put(node[3], weight)

        for weight, tree in self.trees:
            first.append(len(at))
            put(tree, weight)
        return np.array(at, np.int32), np.array(most, np.float64), np.array(above, np.int32), np.array(first, np.int32)

    def depth(self) -> int:
        def of(node: tuple | float) -> int:
            return 0 if isinstance(node, float) else 1 + max(of(node[2]), of(node[3]))

        return max((of(tree) for _, tree in self.trees), default=0)

    def probability(self) -> Callable[[Column], Column]:
        """A function from an array of features to the probability.

        The trees are literal arrays that one short expression walks.  As nested
        conditions they would be thousands of expressions in each place of use,
        which the driver holds and rewrites many times over.
        """
        at, most, above, first = map(F.lit, self.nodes())
        steps = F.lit(np.arange(self.depth(), dtype=np.int32))

        def of(f: Column) -> Column:
            def step(n: Column, _: Column) -> Column:
                # A leaf has no feature: null is not at most anything, and above a leaf is the leaf.
                return F.when(F.get(f, F.get(at, n)) <= F.get(most, n), n + 1).otherwise(F.get(above, n))

            margin = F.aggregate(first, F.lit(0.0), lambda acc, k: acc + F.get(most, F.aggregate(steps, k, step)))
            return 1 / (1 + F.exp(-(margin * self.slope + self.offset)))

        return of


def parse_tree(text: str) -> tuple | float:
    """A tree from its debug string: nested (feature, threshold, at most, above)."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(k: int) -> tuple[tuple | float, int]:
        if m := re.match(r"Predict: (\S+)", lines[k]):
            return float(m[1]), k + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[k])
        low, k = node(k + 1)
        high, k = node(k + 1)  # past the line of Else
        return (int(m[1]), float(m[2]), low, high), k

    return node(0)[0]


def made_documents(spark: SparkSession, rows: int = MADE_DOCS) -> DataFrame:
    """(key, text): texts by rule with a base span of each kind, so that every kind has something to learn from."""

    def draw(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt), F.lit(SEED)), F.lit(n)).cast("int")

    def pick(salt: int, *values: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), draw(salt, len(values)))

    def number(salt: int, width: int) -> Column:
        return F.lpad(draw(salt, 10**width).cast("string"), width, "0")

    words = ("orth", "lichen", "pour", "que", "the", "nder", "casa", "was")

    def filler(salt: int) -> Column:
        return F.concat_ws(" ", *(pick(salt + k, *words) for k in range(5)))

    body = F.concat(pick(1, "4", "5", "37", "6"), number(2, 9), number(3, 5))
    body = F.substr(F.rpad(body, 15, "7"), F.lit(1), F.lit(15))
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(body, c.cast("string"))), luhn), F.lit(0))
    mail = F.concat(pick(4, "anna", "joe", "m.lopez", "k-weber"), number(5, 2), F.lit("@"), pick(6, "mail", "post", "uni-x"), number(7, 1), pick(8, ".com", ".org", ".co.net"))
    address = F.concat_ws(".", *(draw(20 + k, 256).cast("string") for k in range(4)))
    phone = F.concat(F.lit("+1 ("), (draw(9, 800) + 200).cast("string"), F.lit(") "), number(10, 3), F.lit("-"), number(11, 4))
    text = F.concat_ws(" ", filler(30), mail, filler(40), address, filler(50), card, filler(60), phone, filler(70))
    return spark.range(rows).select(F.xxhash64("id", F.lit(SEED)).alias("key"), text.alias("text"))


def sample_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of documents that may hold personal data: about SAMPLE_DOCS of them, picked by the hash of their text."""
    rows = docs.select(text_of(text).alias("text")).withColumn("key", F.xxhash64("text"))
    may = F.octet_length("text") <= SAMPLE_BYTES
    may = may & (F.contains("text", F.lit("@")) | F.col("text").rlike(r"[0-9][0-9\x20().+\-/]{5}[0-9]"))
    n = rows.where(may).count()
    # Rows are few enough for any share of the table, copies of one text included.
    return rows.where(F.pmod("key", F.lit(max(n, 1))) < SAMPLE_DOCS).where(may).select("key", "text").limit(2 * SAMPLE_DOCS)


def respelled(m: Column, kind: str, draw: Callable[[int, int], Column]) -> Column:
    """A base span's text in a spelling that is no base span."""

    def pick(salt: int, *values: Column | str) -> Column:
        return F.get(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), draw(salt, len(values)))

    d = digits(m)
    if kind == "email":
        at, dot = pick(1, " [at] ", " (at) ", " at ", "[at]", " @ "), pick(2, " [dot] ", " (dot) ", " dot ", ".")
        return F.concat(F.substring_index(m, "@", 1), at, F.replace(F.substring_index(m, "@", -1), F.lit("."), dot))
    if kind == "ip":
        h = F.md5(m)
        parts = [F.substr(h, F.lit(1 + 4 * k), draw(30 + k, 4) + 1) for k in range(8)]
        return pick(1, F.replace(m, F.lit("."), F.lit(" . ")), F.concat_ws(":", *parts), F.concat(F.concat_ws(":", *parts[:3]), F.lit("::"), parts[3]))
    if kind == "card":
        return grouped(d, pick(1, ".", "/", " - ", "  "))
    area, mid, last = F.substr(F.right(d, F.lit(10)), F.lit(1), F.lit(3)), F.left(F.right(d, F.lit(7)), F.lit(3)), F.right(d, F.lit(4))
    local = F.concat(mid, F.lit("-"), last)
    return pick(1, F.concat(F.lit("("), area, F.lit(") "), local), F.concat(area, F.lit("-"), local), F.concat_ws(".", area, mid, last), F.concat_ws(" ", area, mid, last), F.concat(F.lit("1 ("), area, F.lit(") "), local), F.concat(F.lit("001-"), area, F.lit("-"), local), F.concat(F.lit("0"), area, F.lit("/"), mid, last))


def grouped(d: Column, mark: Column) -> Column:
    """Digits in fours with a mark between them."""
    return F.replace(F.array_join(F.regexp_extract_all(d, F.lit("[0-9]{1,4}"), F.lit(0)), "#"), F.lit("#"), mark)


def other_number(draw: Callable[[int, int], Column]) -> Column:
    """A number that is no personal data: one that fails the check digit, a date, a version, a sum, a code."""

    def number(salt: int, width: int) -> Column:
        return F.lpad(draw(salt, 10**width).cast("string"), width, "0")

    sixteen = F.concat(number(11, 8), number(12, 8))
    failing = F.when(luhn(sixteen), F.concat(F.left(sixteen, F.lit(15)), F.pmod(F.right(sixteen, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))).otherwise(sixteen)
    marks = F.get(F.array(*map(F.lit, (".", "/", " - ", " ", ""))), draw(13, 5))
    kinds = [
        grouped(failing, marks),
        failing,
        F.concat(F.lit("20"), number(14, 2), F.lit("-0"), number(15, 1), F.lit("-1"), number(16, 1), F.lit(" 1"), number(17, 1), F.lit("."), number(18, 2)),
        F.concat(F.lit("1"), number(15, 1), F.lit("/0"), number(16, 1), F.lit("/20"), number(14, 2)),
        F.concat_ws(".", number(15, 1), number(14, 2), number(19, 3), number(20, 3)),
        F.concat_ws(" . ", number(15, 1), number(14, 2), number(19, 3), F.concat(F.lit("9"), number(20, 3))),
        F.concat_ws("-", F.lit("978"), number(15, 1), number(14, 2), number(21, 6), number(16, 1)),
        F.concat(number(19, 3), F.lit(" "), number(20, 3), F.lit(" "), number(22, 3), F.lit("."), number(14, 2)),
        number(21, 8),
        F.concat(number(21, 4), F.lit("-"), number(22, 4)),
        F.concat(F.left(F.md5(number(21, 8)), F.lit(6)), number(22, 8), F.left(F.md5(number(11, 8)), F.lit(4))),
        F.concat(F.lit("house at home."), number(15, 1)),
    ]
    return F.get(F.array(*kinds), draw(10, len(kinds)))


def examples(sample: DataFrame) -> DataFrame:
    """(key, line, lo, hi, kind, lo2, hi2): base spans of the sample in other spellings and other numbers, where they stand; and the sample's texts themselves, without any right span.

    A card or phone number may have another phone number beside it, at lo2 to hi2.
    """
    spans = F.concat(*(F.transform(F.slice(base_spans(F.col("text"), kind), 1, SPANS_EACH), lambda s: F.struct(F.lit(k).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"))) for k, kind in enumerate(KINDS)))
    rows = sample.select("key", "text", F.explode(spans).alias("s")).select("*", F.explode(F.array(*map(F.lit, range(SPELLINGS + 1)))).alias("v"))

    def draw(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("key", "s.start", "s.rank", "v", F.lit(salt), F.lit(SEED)), F.lit(n)).cast("int")

    before = F.substr("text", F.greatest(F.lit(1), F.col("s.start") - AROUND + 1), F.least(F.lit(AROUND), F.col("s.start")))
    after = F.substr("text", F.col("s.end") + 1, F.lit(AROUND))
    # Up to the next number or address, so that no part of another span is taken for a wrong one.
    before, after = F.regexp_extract(before, "[^0-9@+]*$", 0), F.regexp_extract(after, "^[^0-9@+]*", 0)
    spelled, name = F.lit(""), F.lit("none")
    for k, kind in enumerate(KINDS):
        spelled, name = F.when(F.col("s.rank") == k, respelled(F.col("s.m"), kind, draw)).otherwise(spelled), F.when(F.col("s.rank") == k, kind).otherwise(name)
    right = F.col("v") < SPELLINGS
    rows = rows.withColumns({"before": before, "after": after, "value": F.when(right, spelled).otherwise(other_number(draw)), "kind": F.when(right, name).otherwise("none")})
    beside = F.when((F.col("v") == 1) & F.col("kind").isin("card", "phone"), respelled(F.reverse("s.m"), "phone", lambda salt, n: draw(salt + 100, n))).otherwise("")
    rows = rows.withColumn("beside", beside).withColumns({"lo": F.length("before"), "hi": F.length("before") + F.length("value")})
    gap = F.when(F.col("beside") != "", " ").otherwise("")
    none = F.lit(-1)
    second = [F.when(F.col("beside") != "", x).otherwise(none) for x in (F.col("hi") + 1, F.col("hi") + 1 + F.length("beside"))]
    lines = rows.select("key", F.concat("before", "value", gap, "beside", "after").alias("line"), "lo", "hi", "kind", second[0].alias("lo2"), second[1].alias("hi2"))
    return lines.unionByName(sample.select("key", F.col("text").alias("line"), none.alias("lo"), none.alias("hi"), F.lit("none").alias("kind"), none.alias("lo2"), none.alias("hi2")))


def labelled(lines: DataFrame) -> DataFrame:
    """(key, kind, f, label): the proposals on the example lines with their features, and whether kind and place are right.

    A part of a right span is neither right nor wrong, as the whole is taken before it; nor is a number after '+'.
    """
    base = F.concat(*(base_spans(F.col("line"), k) for k in KINDS))
    lines = lines.withColumn("base", base)
    parts = []
    for generator, kinds in PROPOSES.items():
        found = F.filter(F.flatten(proposals(F.col("line"), generator)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        p = lines.select("key", F.col("kind").alias("of"), "lo", "hi", "lo2", "hi2", F.explode(F.slice(found, 1, RAW_EACH)).alias("s"))
        start, end = F.col("s.start"), F.col("s.end")
        for kind in kinds:
            right = (F.col("of") == kind) & (start == F.col("lo")) & (end == F.col("hi"))
            part = (F.col("of") == kind) & (start >= F.col("lo")) & (end <= F.col("hi"))
            if kind == "phone":
                right = right | ((start == F.col("lo2")) & (end == F.col("hi2")))
                part = part | ((F.col("hi2") > 0) & (start >= F.col("lo2")) & (end <= F.col("hi2")))
            unsure = part | F.col("s.before").endswith("+")  # of a number that is no base span for what follows it
            parts.append(p.where(right | ~unsure).select("key", F.lit(kind).alias("kind"), features(F.col("s"), kind).alias("f"), F.when(right, 1.0).otherwise(0.0).alias("label")))
    return reduce(DataFrame.unionByName, parts)


def judge(docs: DataFrame, text: str = "text") -> Judge:
    """The model trained on a bounded sample of docs."""
    sample = save(sample_documents(docs, text).unionByName(made_documents(docs.sparkSession)).coalesce(2), "pii-sample")
    part = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(5))
    # Few tasks: the sample is small, and each task compiles the whole of the features.
    lines = save(examples(sample).coalesce(4), "pii-lines")  # bounded, as the sample is
    rows = save(labelled(lines).withColumn("part", part).coalesce(8), "pii-examples")
    known = rows.where("part > 1").select("key", "kind", "label", array_to_vector("f").alias("features")).repartition(2, "key").sortWithinPartitions("key", "kind", "label", "features")
    model = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.4, seed=SEED).fit(known)
    trees = tuple((float(w), parse_tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True))
    plain = Judge(trees, 1.0, 0.0, {})
    held = rows.where("part <= 1").select("part", "kind", "label", plain.probability()(F.col("f")).alias("p")).collect()  # two fifths of a bounded sample
    p = np.clip(np.array([r["p"] for r in held]), 1e-9, 1 - 1e-9)
    margin, y = np.log(p / (1 - p)), np.array([r["label"] for r in held])
    kinds, tune = np.array([r["kind"] for r in held]), np.array([r["part"] for r in held]) == 1
    drop(sample, lines, rows)
    slope, offset = calibrate(margin[tune], y[tune])
    p = 1 / (1 + np.exp(-(margin * slope + offset)))
    limits = {k: threshold(p[tune & (kinds == k)], y[tune & (kinds == k)]) for k in KINDS}
    report = {}
    for k in KINDS:
        at = ~tune & (kinds == k)
        taken, right = p[at] >= limits[k], y[at] == 1
        report[k] = (float((taken & right).sum() / max(1, taken.sum())), float((taken & right).sum() / max(1, right.sum())), int(right.sum()))
    return replace(plain, slope=slope, offset=offset, thresholds=limits, report=report)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by gradient descent on targets drawn in by one example (Platt)."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margin.std() + 1e-9
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(2000):
        d = 1 / (1 + np.exp(-(a * x + b))) - target
        a, b = a - 0.5 * (d * x).mean(), b - 0.5 * d.mean()
    return float(a / scale), float(b)


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least of a grid of thresholds, from 0.5, with the precision asked for."""
    for t in np.arange(0.5, 0.995, 0.01):
        if (p >= t).any() and y[p >= t].mean() >= PRECISION:
            return float(t)
    return 0.995


# --------------------------------------------------------------------- spans


def find_spans(df: DataFrame, model: Judge, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with array columns of spans (start, rank, kind, end), sorted: 'base' and 'all'; gives their names."""
    cols = dict(zip(["text", "base", "added", "all"], free_name(df, "text", "base", "added", "all"), strict=True))
    out = df.withColumn(cols["text"], text_of(text))
    t = F.col(cols["text"])

    def shaped(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    out = out.withColumn(cols["base"], F.array_sort(F.concat(*(shaped(base_spans(t, k), k) for k in KINDS))))
    base, probability = F.col(cols["base"]), model.probability()

    def apart(x: Column, y: Column) -> Column:
        return (x["end"] <= y["start"]) | (y["end"] <= x["start"])

    def option(kind: str) -> Callable[[Column], Column]:
        return lambda p: F.struct((p - model.thresholds[kind]).alias("over"), p.alias("p"), F.lit(-KINDS.index(kind)).alias("less"), F.lit(kind).alias("kind"))

    def judged(generator: str) -> Column:
        def best(s: Column) -> Column:
            # The shape is worked out once for all kinds, the features once for all nodes.
            options = lambda x: F.array(*(bound(bound(of_kind(x, k), probability), option(k)) for k in PROPOSES[generator]))
            return bound(F.array_max(bound(shape(s), options)), lambda top: F.struct((-top["p"]).alias("less"), (s["start"] - s["end"]).alias("short"), s["start"].alias("start"), s["end"].alias("end"), F.abs(top["less"]).alias("rank"), top["kind"].alias("kind"), top["over"].alias("over")))

        def chosen(cluster: Column) -> Column:
            """The likeliest of a cluster's proposals, those that overlap none of them, and so on."""
            free = F.filter(cluster, lambda s: F.forall(base, lambda b: apart(b, s)))
            good = F.array_sort(F.filter(F.transform(free, best), lambda s: s["over"] >= 0))
            none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

            def take(acc: Column, s: Column) -> Column:
                span = F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
                return F.when(F.forall(acc, lambda a: apart(a, s)), F.concat(acc, F.array(span))).otherwise(acc)

            return F.aggregate(good, none, take)

        return F.flatten(F.transform(proposals(t, generator), chosen))

    others, numbers = [g for g in GENERATORS if g != "digits"], cols["all"]
    out = out.withColumn(cols["added"], F.concat(*(judged(g) for g in others))).withColumn(numbers, judged("digits"))
    beside = F.filter(numbers, lambda s: F.forall(cols["added"], lambda a: apart(a, s)))
    out = out.withColumn(cols["all"], F.array_sort(F.concat(base, F.col(cols["added"]), beside)))
    return out, cols


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, model: Judge, text: str = "text") -> DataFrame:
    """df with each span in the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, cols = find_spans(df, model, text)
    t = F.col(cols["text"])

    def put(acc: Column, s: Column) -> Column:
        gap = F.substr(t, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        fresh = F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(cols["all"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    return out.withColumn(text, F.when(F.size(cols["all"]) > 0, clean).otherwise(F.col(text))).drop(*cols.values())
