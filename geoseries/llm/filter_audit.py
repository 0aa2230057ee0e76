"""How five document filters interact: what each removes, in every order, and what of it is good or toxic.

The word counts that two of them need are row sums and nonzero counts of the sparse document-term matrix. A document then is
five bits; all 120 orders follow from the counts of the 32 patterns in each part of the corpus.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import staged, text_or_empty
from geoseries.llm.term_matrix import row_totals, term_matrix

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"


def _marks(raw: bytes) -> int:
    """Bits of the filters that read characters: 4 (C, capitals) and 8 (D, symbols)."""
    points = len(raw.translate(None, CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return 4 * (100 * capitals > 2 * points) + 8 * (len(raw.translate(None, SYMBOLS)) < len(raw))


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per document: `doc_id`, `part`, `failed` (bits 1 to 16 for A to E).

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * capitals A-Z > 2 * code points. D: holds a symbol.
    E: a document with a smaller id has the same text; a document without an id never fails E, nor does it make others fail.
    Null texts are empty: they fail A, and E like other equal texts. Null parts are the empty string.
    """
    named = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"),
        text_or_empty(text).alias("text"),
    )
    matrix, _ = term_matrix(named, "text", ("doc_id", "part", "digest"), _marks)
    few = F.when(F.col("n_words") < 200, 1).otherwise(0) + F.when(100 * F.col("n_distinct") < 50 * F.col("n_words"), 2).otherwise(0)
    rows = staged(row_totals(matrix).select("doc_id", "part", "digest", (few + F.col("marks")).alias("failed")), "flags")
    # The smallest id of each repeated text; single texts, mostly all, need no join.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))


def pattern_counts(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """`part`, `failed`, and how many documents (`n`), good ones (`good`) and toxic ones (`toxic`) show it.

    A document is good or toxic if any of its rows in `labels` says so; one without an id has no labels.
    """
    marked = labels.groupBy(F.col(f"`{key}`").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    count = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]]
    return flags.join(marked, "doc_id", "left").groupBy("part", "failed").agg(*count)


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of the patterns (`pattern_counts`).

    `kept` after the step; `removed`, `good_lost`, `toxic_lost` at it; `redundant`: fail its filter but went earlier;
    `unique_fails`: fail its filter only; `shapley`: what its filter removes, summed over all orders.
    """
    entry = F.struct("failed", F.struct("n", "good", "toxic"))
    table = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("of"))  # 32 entries at most
    orders = table.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    places = F.sequence(F.lit(1), F.lit(5))
    bit = lambda place: F.pow(F.lit(2), F.ascii(F.col("filter_order").substr(place, F.lit(1))) - 65).cast("int")
    before = lambda step: F.aggregate(places, F.lit(0), lambda a, place: a + F.when(place < step, bit(place)).otherwise(0))
    # Exploded as they are: plain columns would be computed again at each of the 32 patterns below.
    step = F.explode(F.transform(places, lambda i: F.struct(i.alias("step"), bit(i).alias("own"), before(i).alias("earlier"))))
    steps = orders.select("part", "filter_order", "of", step.alias("at")).select("part", "filter_order", "of", "at.*")
    own, earlier = F.col("own"), F.col("earlier")

    def total(what: str, counts_here, weight=lambda m: F.lit(1)) -> Column:
        value = lambda m: F.coalesce(F.col("of")[m][what], F.lit(0)) * weight(m)
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, m: a + F.when(counts_here(m), value(m)).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(earlier) == 0)
    # Of c filters that a document fails, each comes first in 120 / c orders.
    share = lambda m: F.lit(120) / F.bit_count(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """`interactions` of the five filters over whole texts. No documents give no rows."""
    return interactions(pattern_counts(failed_filters(docs, key, text, part), labels, key))
