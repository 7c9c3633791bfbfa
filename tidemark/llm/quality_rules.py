"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Method: words are hashed into one half of ``BUCKETS`` buckets, word pairs into the other. Two multinomials are counted over whole texts, one of
all documents and one of trusted documents. The verdict on a document is the mean over its n-grams of
log p(trusted) - log p(all), compared with a fixed threshold; the base rules come first.

Scale: one scan counts, one scan judges. Counting is a partial aggregate of at most ``BUCKETS`` rows a task; the ratios
are that many numbers, folded into the plan as one constant array. The only broadcast is the ids of at most ``TRUSTED``
labelled documents, the documented sample the trusted model is fitted on; the raw model covers every document. No text
is shuffled. Windows of a document are sorted inside its row, in n log n.

Defined results: null, empty and wordless texts have no words, fail the base rules and are not kept. Repeated rows are
judged each. Other columns are ignored. Without trusted documents every ratio is 0 and the base rules decide alone.
A document with two labels is trusted if one row says so and none objects.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, table

BUCKETS = 1 << 16
#: Labelled documents the trusted model is fitted on, those of the smallest hashes.
TRUSTED = 20_000
#: A document's mean log ratio must reach this; about the ratio of a text with one foreign n-gram in ten.
THRESHOLD = -0.15
#: N-grams added to the trusted and the expected count of a bucket, so that rare ones say little.
SMOOTH = 5.0
_WHITE = r"[\x20\x09-\x0D]+"
_SOLID = r"[^\x20\x09-\x0D]"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE), lambda w: w != "")


def repeated_words(words: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Words that lie in a 3-word window found twice or more among these words.

    Windows are sorted by a hash and their place, and count as equal only where their words are.
    """

    none = F.array().cast("array<int>")

    def positions(w: Column) -> Column:
        """Positions of the windows that occur again, in order; equal windows sort near each other."""
        window = lambda i: F.slice(w, i + 1, 3)
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

        def again(s: Column) -> Column:
            def met(a: Column, b: Column) -> Column:
                same = (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))
                return F.coalesce(same, F.lit(False))

            # Beside it stands an equal window, or windows of its hash that are others: then all of that hash are compared.
            def crowd(a: Column) -> Column:
                others = F.filter(s, lambda b: (b["h"] == a["h"]) & (b["i"] != a["i"]))
                return F.exists(others, lambda b: window(a["i"]) == window(b["i"]))

            def mixed(a: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1), F.get(s, k + 1)
                return F.coalesce(before["h"] == a["h"], F.lit(False)) | F.coalesce(after["h"] == a["h"], F.lit(False))

            return F.filter(
                s, lambda a, k: met(F.get(s, k - 1), a) | met(F.get(s, k + 1), a) | (mixed(a, k) & crowd(a))
            )

        def among(h: Column) -> Column:
            numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            found = F.sort_array(F.transform(let(F.sort_array(numbered), again), lambda x: x["i"]))
            # Equal windows have equal hashes: most texts have none and are not sorted.
            return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(found)

        return let(hashes, among)

    def found(w: Column) -> Column:
        return F.when(F.size(w) < 3, none).otherwise(positions(w))

    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"))
    return F.aggregate(let(words, found), start, step, lambda acc: acc["n"])


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(_SOLID))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(documents: DataFrame) -> DataFrame:
    """(row, words, base, failed): the input row as one column, its words, the figures of the base rules, the verdict."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = documents.select(F.struct("*").alias("row")).withColumn("words", word_list(text))
    rows = rows.withColumn(
        "base",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
        ),
    )
    failed = (F.col("base.n_words") < 50) | (100 * F.col("base.n_repeat_words") > 50 * F.col("base.n_words"))
    return rows.withColumn("failed", failed)


def ngram_buckets(words: Column) -> Column:
    """Buckets of all words and word pairs of a text."""

    def both(w: Column) -> Column:
        half = F.lit(BUCKETS // 2)
        single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), half).cast("int"))
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(w) - 2),
            lambda i: (half + F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), half)).cast("int"),
        )
        return F.when(F.size(w) >= 2, F.concat(single, pairs)).otherwise(single)

    return let(words, both)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of documents labelled good and not toxic, at most so many, by smallest hash."""
    good = F.min(F.coalesce(F.col("quality"), F.lit(0)) * (1 - F.coalesce(F.col("toxic"), F.lit(0))))
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(good.alias("good")).where("good = 1")
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_trusted"))


def log_ratios(documents: DataFrame, labels: DataFrame) -> list[float]:
    """log p(bucket | trusted) - log p(bucket | all), with ``SMOOTH`` more n-grams in both at the rate of all."""
    ids = F.broadcast(trusted_ids(labels))
    rows = documents.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    grams = rows.select(
        F.col("_trusted").isNotNull().cast("long").alias("t"),
        F.explode(ngram_buckets(word_list(F.col("text").cast("string")))).alias("bucket"),
    )
    found = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()
    n_all, n_trusted = sum(r["n"] for r in found), sum(r["t"] for r in found)
    ratios = [0.0] * BUCKETS
    if n_trusted:
        for r in found:
            expected = r["n"] * n_trusted / n_all
            ratios[r["bucket"]] = math.log((r["t"] + SMOOTH) / (expected + SMOOTH))
    return ratios


def _judged(documents: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(row, base, failed, ratio, kept): the ratio is the mean log ratio."""
    numbers = ",".join(map(repr, log_ratios(documents, labels)))
    ratios = F.split(F.lit(numbers), ",").cast("array<double>")  # folded into one constant
    ratio = let(
        ngram_buckets(F.col("words")),
        lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.greatest(F.size(g), F.lit(1)),
    )
    rows = measured(documents).withColumn("ratio", ratio).drop("words")
    return rows.withColumn("kept", ~F.col("failed") & (F.col("ratio") >= threshold))


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the figures of the base rules, base_failed, log_ratio (per n-gram), kept."""
    rows = _judged(documents.select("doc_id", "text"), labels, threshold)
    return rows.select("row.doc_id", "base.*", F.col("failed").alias("base_failed"), F.col("ratio").alias("log_ratio"), "kept")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The kept documents with their own columns, whatever their names."""
    return _judged(documents, labels, threshold).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_rules": query}
ORACLE: dict[str, str] = {}
