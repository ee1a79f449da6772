"""Operator 2: document fingerprints by I-Match.

Of a document's distinct terms only those within a band of inverse document
frequency count.  They are sorted, and several randomised subsets of the
lexicon each keep some of them; the hash of what a subset keeps is one slot of
the fingerprint.  Slot 0 is the whole lexicon.  The other subsets form eighteen
nested chains: level l keeps a term with chance 2**-l.  A slot whose subset
keeps more than two of a document's terms is marked ``+`` and not compared, as
one changed term among many would break it; a slot that keeps none is empty.
The number of levels follows from the longest text, so that a document of any
length has slots of one or two terms in most chains, and the share of equal
slots tells how much two texts have in common.

Document frequencies count distinct texts, so a group of copies counts once:
however large it is, its terms stay in the band.  A document without terms of
the band is fingerprinted by all its terms instead.  As an edit may bring the
first such term, the last chains keep terms of a second band, all that are rarer;
terms that are more frequent than the band count nowhere else.

Only DataFrame functions.  Frequencies cover all documents and combine before
the shuffle.  The lexicon cannot outgrow the mean number of distinct terms a
document over the least share of documents (200 times that number here), so it
is broadcast behind a check of its size; beyond it the join shuffles.  Texts are
shuffled by id for the join to the next document; to count each text once, only
those that may have copies are shuffled, by digest.  Terms are exploded, joined and gathered again within that
partitioning.  Within a chain only the three terms of the greatest depth tell
what its slots are, so one short sort a chain gives them all.

Edge cases: null text is empty; a text without any terms has all slots empty;
fingerprints without comparable slots have likeness 1 if they are equal and 0
if not; null ids come first in the order of documents and are spread by their
text, so that many of them are no hot key; of rows that share an id, the least
prefix and fingerprint stand for it as a next document; very long texts are
taken whole; only the id and the text are read, so other columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm.common import save, text_of

#: Terms in at least and at most these shares of all documents; as inverse document frequencies, ln 5 to ln 200.
LEAST_SHARE, MOST_SHARE = 0.005, 0.2
CHAINS, MOST_LEVELS = 18, 28
MOST_BITS = (1 << MOST_LEVELS) - 1
#: A term's 31-bit hash times one of these odd numbers gives its bits in a pair of chains.  Multiples of each other would tie chains together.
MIXERS = tuple(int(hashlib.sha256(f"chain {c}".encode()).hexdigest()[:8], 16) >> 1 | 1 for c in range(CHAINS // 2))
#: The last pairs of chains keep terms that are rarer than the band.
RARE_PAIRS = 3
BROADCAST_TERMS = 200_000
#: Hashes of texts that occur more than once are broadcast up to this many (some 30 MB); beyond it all texts are shuffled.
BROADCAST_REPEATS = 1_000_000
#: Rows of the null id are dealt by their text to so many keys.
NULL_SALTS = 64
TERM_BREAK = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != ""))


def name_of(term: Column) -> Column:
    """32 bits of the term's SHA-256."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long")


def bits_in(name: Column, mixer: int) -> Column:
    """The bits of a name that place it in a pair of chains: near 0 it is deep in the one, near the greatest number in the other."""
    return F.shiftright(name.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(mixer).cast("long"), 17).bitwiseAND(F.lit(MOST_BITS))


def depth_of(bits: Column) -> Column:
    """How many zeros the bits begin with."""
    return F.lit(MOST_LEVELS) - F.when(bits > 0, F.length(F.bin(bits))).otherwise(0)


def distinct_texts(texts: DataFrame, t: str = "t") -> DataFrame:
    """Each text once.  Only texts whose hash occurs more than once are shuffled, by digest: a text of a hash of its own has no copy."""
    hashed = texts.select(F.col(t).alias("t"), F.xxhash64(t).alias("h"))
    repeats = save(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "imatch-repeats")

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.md5("t").alias("d")).agg(F.first("t").alias("t")).select("t")

    if repeats.count() > BROADCAST_REPEATS:
        return once(hashed)
    repeats = F.broadcast(repeats)
    return hashed.join(repeats, "h", "left_anti").select("t").unionByName(once(hashed.join(repeats, "h", "left_semi")))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> tuple[DataFrame, int]:
    """The terms that are not rare, (term, in_band), and the number of levels that the longest text needs."""
    texts = docs.select(text_of(text).alias("t"))
    facts = texts.agg(F.count_distinct(F.md5("t")).alias("n"), F.coalesce(F.max(F.length("t")), F.lit(0)).alias("longest")).first()
    # A text of so many characters has at most half as many terms.
    levels = max(1, min(MOST_LEVELS, math.ceil(math.log2(facts["longest"] / 2 + 1))))
    counts = distinct_texts(texts).select(F.explode(terms_of(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = counts.where(F.col("df") >= F.lit(least) * facts["n"])
    return save(known.select("term", (F.col("df") <= F.lit(most) * facts["n"]).alias("in_band")), "imatch-lexicon"), levels


def fingerprint(names: Column, rare: Column, levels: int) -> Column:
    """Slot 0 and the slots of all chains, joined by '-', of the sorted names of a document's terms: the band's, then the rare ones."""

    def digest(*parts: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", *(n.cast("string") for n in parts))), 1, 8)

    def pair(c: int) -> Column:
        own = names if c < len(MIXERS) - RARE_PAIRS else rare
        keys = F.sort_array(F.transform(own, lambda x: F.shiftleft(bits_in(x, MIXERS[c]), 32).bitwiseOR(x)))

        def slots(k: Column, last: bool) -> Column:
            top = [F.get(k, F.size(k) - 1 - i if last else F.lit(i)) for i in range(3)]
            bits = [F.lit(MOST_BITS) - F.shiftright(t, 32) if last else F.shiftright(t, 32) for t in top]
            d1, d2, d3 = (F.when(t.isNull(), 0).otherwise(F.least(depth_of(b), F.lit(levels))) for t, b in zip(top, bits, strict=True))
            n1, n2 = (t.bitwiseAND(F.lit(0xFFFFFFFF)) for t in top[:2])
            two, one = F.concat(F.lit("-"), digest(F.least(n1, n2), F.greatest(n1, n2))), F.concat(F.lit("-"), digest(n1))
            return F.concat(F.repeat(F.lit("-+"), d3), F.repeat(two, d2 - d3), F.repeat(one, d1 - d2), F.repeat(F.lit("-"), F.lit(levels) - d1))

        return F.get(F.transform(F.array(keys), lambda k: F.concat(slots(k, False), slots(k, True))), F.lit(0))

    whole = F.when(F.size(names) > 0, F.substring(F.md5(F.array_join(F.transform(names, lambda x: x.cast("string")), " ")), 1, 8)).otherwise("")
    return F.concat(whole, *(pair(c) for c in range(len(MIXERS))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots among those that either fingerprint can compare."""
    x, y = F.split(a, "-"), F.split(b, "-")
    both = F.zip_with(x, y, lambda p, q: F.when((F.length(p) == 8) | (F.length(q) == 8), F.when(p == q, 1).otherwise(0)))
    used = F.filter(both, lambda v: v.isNotNull())
    same = F.size(F.filter(used, lambda v: v == 1))
    return F.when(F.size(used) > 0, same / F.size(used)).otherwise(F.when(a == b, 1.0).otherwise(0.0))


def next_ids(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, next_id, quarter) for each distinct id: the next in ascending order, the first after the last; quarter: the longest prefix that rows of this id need."""
    ids = docs.groupBy(F.col(id_column).alias("id")).agg(F.max(F.floor(F.length(text_of(text)) / 4)).alias("quarter"))
    ids = ids.withColumn("o", F.struct(F.col("id").isNotNull().alias("z"), F.col("id").alias("v")))
    # Ranges of ids, stored with their number; a window then never holds more than one range.
    ranged = save(ids.repartitionByRange("o").withColumn("part", F.spark_partition_id()), "imatch-ids")
    edges = ranged.groupBy("part").agg(F.min("o").alias("first"))  # a row a partition
    order = Window.orderBy("part")
    edges = edges.select("part", F.lead("first").over(order).alias("after"), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("start"))
    w = Window.partitionBy("part").orderBy("o")
    out = ranged.withColumn("n", F.lead("o").over(w)).join(F.broadcast(edges), "part")
    return save(out.select("id", "quarter", F.coalesce("n", "after", "start")["v"].alias("next_id")), "imatch-next")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    words, levels = lexicon(docs, text)
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    nexts = next_ids(docs, id_column, text)
    zero = F.lit(0).cast(docs.schema[id_column].dataType)

    def key(name: str, to: str = "") -> list[Column]:
        """Ids may be null: k and z are never, and both joins and the grouping share one partitioning."""
        return [F.coalesce(F.col(name), zero).alias(f"k{to}"), F.col(name).isNull().alias(f"z{to}")]

    def salted(keys: DataFrame) -> DataFrame:
        """A row for each salt that rows of the null id have; a row of salt 0 for others."""
        return keys.withColumn("s", F.explode(F.when(F.col("z"), F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))))

    rows = docs.select(*key(id_column), text_of(text).alias("text"))
    rows = rows.withColumn("s", F.when(F.col("z"), F.pmod(F.xxhash64("text"), F.lit(NULL_SALTS)).cast("int")).otherwise(0))

    need = salted(nexts.select(*key("next_id"), *key("id", "0"), "quarter"))
    prefix = rows.join(need, ["k", "z", "s"]).select(F.col("k0").alias("k"), F.col("z0").alias("z"), F.expr("substring(text, 1, cast(quarter as int))").alias("prefix"))
    prefix = salted(prefix.groupBy("k", "z").agg(F.min("prefix").alias("prefix")))
    both = rows.join(prefix, ["k", "z", "s"]).select("k", "z", "s", "text", F.length("text").alias("n"), "prefix")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n - cast(floor(n / 4) as int))"), F.expr("substring(prefix, 1, cast(floor(n / 4) as int))")))
    both = both.select("k", "z", "s", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"), F.sha2("edited", 256).alias("sha"), terms_of(F.col("text")).alias("a"), terms_of(F.col("edited")).alias("b"))

    # One exploded row carries what holds for the document; the others carry a term each.
    facts = F.struct(F.col("n"), F.col("sha"))
    none = F.lit(None).cast("struct<n:bigint,sha:string>")
    terms = F.concat(
        F.array(F.struct(F.lit(0).alias("of"), F.lit(None).cast("string").alias("term"), facts.alias("facts"))),
        F.transform("a", lambda t: F.struct(F.lit(1).alias("of"), t.alias("term"), none.alias("facts"))),
        F.transform("b", lambda t: F.struct(F.lit(2).alias("of"), t.alias("term"), none.alias("facts"))),
    )
    exploded = both.select("k", "z", "s", "h", F.explode(terms).alias("t")).select("k", "z", "s", "h", "t.*")
    found = exploded.join(words, "term", "left").select("k", "z", "s", "h", "of", "facts", name_of(F.col("term")).alias("p"), F.when(F.col("in_band"), "band").when(~F.col("in_band"), "often").otherwise("rare").alias("kind"))

    kinds = ("band", "often", "rare")
    gathered = found.groupBy("k", "z", "s", "h").agg(
        *(F.collect_list(F.when((F.col("of") == of) & (F.col("kind") == kind), F.col("p"))).alias(f"{kind}{of}") for of in (1, 2) for kind in kinds),
        F.collect_list("facts").alias("facts"),  # one for each row of equal id and text
    )
    used = []
    for of in (1, 2):
        whole = F.when(F.size(f"band{of}") > 0, F.col(f"band{of}")).otherwise(F.concat(*(F.col(f"{kind}{of}") for kind in kinds)))
        used += [F.sort_array(F.array_distinct(x)).alias(f"{name}{of}") for name, x in (("p", whole), ("r", F.col(f"rare{of}")))]
    gathered = gathered.select("k", "z", "s", *used, F.explode("facts").alias("f"))
    table = gathered.select("k", "z", "s", "f.n", "f.sha", fingerprint(F.col("p1"), F.col("r1"), levels).alias("fp"), fingerprint(F.col("p2"), F.col("r2"), levels).alias("fe"))
    table = save(table, "imatch-fingerprints")
    of_next = salted(nexts.select(*key("next_id"), *key("id", "0"))).join(table.select("k", "z", "s", "fp"), ["k", "z", "s"])
    of_next = salted(of_next.groupBy(F.col("k0").alias("k"), F.col("z0").alias("z")).agg(F.min("fp").alias("fn")))
    out = table.join(of_next, ["k", "z", "s"])
    return out.select(
        F.when(~F.col("z"), F.col("k")).alias(id_column),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("fe").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"),
        likeness(F.col("fp"), F.col("fn")).alias("near_next"),
    )
