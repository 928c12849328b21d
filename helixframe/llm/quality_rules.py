"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word unigrams and bigrams are hashed into `buckets` cells per order. Two multinomials over the cells are
estimated with additive smoothing, one from the trusted texts and one from all texts; a document's score is
the mean over its n-grams of log p_target - log p_raw, so that long and short documents compare. A document is
kept if the base rules pass and the score reaches `threshold`, a constant: no document's verdict depends on
chance or on the rank of others.

The main path is DataFrame expressions only. The corpus is read twice (counts, scores); the counts are added up
before the shuffle, which so carries at most 2 * buckets rows a task. The model, 2 * buckets doubles whatever
the corpus, goes to the tasks as one scalar subquery that only the expression of the sum refers to: it is in no row.

Defined results: a null text has no words, fails the base rules and scores null, as does any text without
words. With no trusted text at all there is no target: scores are null and the base rules decide alone.
Very long texts are counted whole, their words held as one array. A ratio equal to the threshold is kept. Repeated rows count
and are scored each; an empty table gives an empty table. Other columns are passed through by `score`; its own columns
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table, words

BUCKETS = 1 << 15
SMOOTHING = 0.5
THRESHOLD = -0.16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"
#: Trusted ids up to this number are broadcast (16 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000

WORK = ("_w", "_lines", "_h", "_s", "_r", "_m")
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _cells(w: Column, buckets: int) -> Column:
    """Cells of all unigrams, then of all bigrams (cells from `buckets` on), of a word array."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda x, i: (F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(buckets)) + buckets).cast("int"),
    )
    return F.concat(one, two)


def cell_counts(docs: DataFrame, trusted: Column, buckets: int = BUCKETS) -> DataFrame:
    """(cell, n_raw, n_target) over all texts; `trusted` marks the rows of the target."""
    rows = docs.select(trusted.alias("hit"), words(F.col("text")).alias("w"))
    cells = rows.select("hit", F.explode(_cells(F.col("w"), buckets)).alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("hit").alias("n_target"))


def model(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: array of the log ratios of cells 0 .. 2 * buckets - 1, or null if the target is empty."""
    spark = counts.sparkSession
    grid = spark.range(2 * buckets).select(F.col("id").cast("int").alias("cell"))
    full = grid.join(counts, "cell", "left").select(
        "cell",
        (F.col("cell") >= buckets).alias("two"),
        F.coalesce("n_raw", F.lit(0)).alias("r"),
        F.coalesce("n_target", F.lit(0)).alias("t"),
    )
    entry = F.struct("cell", "two", "r", "t")
    packed = full.agg(
        F.sort_array(F.collect_list(entry)).alias("cells"),
        *[F.sum(F.when(F.col("two") == two, F.col(c))).alias(f"{c}{int(two)}") for c in "rt" for two in (False, True)],
    )

    def share(n: Column, zero: Column, one: Column, two: Column) -> Column:
        total = F.when(two, one).otherwise(zero)
        return F.ln((n + F.lit(smoothing)) / (total + F.lit(smoothing * buckets)))

    ratio = F.transform(
        "cells",
        lambda c: share(c["t"], F.col("t0"), F.col("t1"), c["two"]) - share(c["r"], F.col("r0"), F.col("r1"), c["two"]),
    )
    return packed.select(F.when(F.col("t0") > 0, ratio).alias("llr"))


def base_rules(docs: DataFrame) -> DataFrame:
    """Word, symbol, line and repetition counts of every text, and `base_failed`; the words stay in `_w`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(A_WORD))
    keep = [c for c in docs.columns if c.lower() not in OWN]
    got = docs.select(
        *[f"`{c}`" for c in keep],
        words(text).alias("_w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_w")
    w = F.col("_w")
    got = got.select(
        *[c for c in got.columns if c != "_lines"],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        ).alias("_h"),
    )
    h = F.col("_h")
    # Only texts with a repeated window are sorted.
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    got = got.select(*[c for c in got.columns if c != "_h"], placed.alias("_s"))
    s = F.col("_s")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
    got = got.select(*[c for c in got.columns if c != "_s"], F.sort_array(F.transform(again, lambda x: x["i"])).alias("_r"))
    r = F.col("_r")
    cover = F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3))))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)
    got = got.select(*[c for c in got.columns if c != "_r"], F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def score(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of docs with the columns OWN; `ratios` is the one row of `model`."""
    based = base_rules(docs)
    keep = [c for c in based.columns if c != "_w"]
    # The model is referred to once, so that the optimiser puts the subquery where it is read.
    got = based.select(*[f"`{c}`" for c in keep], "_w", ratios.scalar().alias("_m"))
    total = F.aggregate(_cells(F.col("_w"), buckets), F.lit(0.0), lambda a, c: a + F.get(F.col("_m"), c))
    n = F.size("_w")
    # Without a target the model is null, and so is the sum.
    got = got.select(*[f"`{c}`" for c in keep], F.when(n > 0, total / (2 * n - 1)).alias("llr"))
    # A filter on the verdict must run after it: pushed below, it would copy the whole chain of array expressions into
    # itself. Spark pushes no filter through a projection with a row number, which here is never negative.
    verdict = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True))
    return got.withColumn("kept", verdict & (F.monotonically_increasing_id() >= 0))


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `trusted`: the id has a label of quality 1. Rows are neither lost nor multiplied."""
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = ids.withColumn("_hit", F.lit(True))
    marked = F.broadcast(marked) if few else marked.hint("shuffle_hash")
    return docs.join(marked, docs["doc_id"] == marked["_id"], "left").select(
        *[docs[f"`{c}`"] for c in docs.columns], F.coalesce("_hit", F.lit(False)).alias("trusted")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the rule counts, the mean log ratio and the verdict."""
    # Columns that are named like a work column of the rules are set aside under another name.
    aside = {c: f"{c}__aside" for c in docs.columns if c.lower() in WORK}
    if aside:
        got = quality_rules(docs.withColumnsRenamed(aside), labels, buckets, threshold)
        return got.withColumnsRenamed({v: k for k, v in aside.items()})
    slim = trusted_rows(docs.select("doc_id", "text"), labels)
    counts = cell_counts(slim, F.col("trusted"), buckets)
    return score(docs, model(counts, buckets), buckets, threshold)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *OWN)
