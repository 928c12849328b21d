"""Score cutoffs of motifs from background scores: exact order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 100


def score_cutoffs(scores: DataFrame) -> DataFrame:
    """(motif_idx, p, raw, score): for n scores of a motif, the (n div 10^e)-th best for e = 2 up to the digits of n less 1, 6 at most.

    Equal raw scores are counted first, before the shuffle; the running count is over a motif's distinct raw scores, so
    a motif's samples never meet in one task. Fewer than 100 scores raise.
    """
    counted = scores.groupBy("motif_idx", "raw", "score").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("motif_idx")
    running = own.orderBy(F.col("raw").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(own))
    enough = F.when(F.col("total") >= LEAST, F.col("total")).otherwise(F.raise_error(F.lit(f"a motif needs {LEAST} background scores")).cast("long"))
    powers = placed.withColumn("e", F.explode(F.filter(F.sequence(F.lit(2), F.lit(6)), lambda e: e < F.least(F.length(enough.cast("string")), F.lit(7)))))
    wanted = F.floor(F.col("total") / F.pow(F.lit(10.0), F.col("e")))
    hit = powers.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    return hit.select("motif_idx", F.concat(F.lit("1e-"), F.col("e").cast("string")).alias("p"), "raw", "score")


def averaged(cutoffs: DataFrame) -> DataFrame:
    """(motif_idx, p, score): mean over repeats at 8 decimals."""
    return cutoffs.groupBy("motif_idx", "p").agg(F.bround(F.avg("score"), 8).alias("score"))
