"""Enrichment of motifs in regions against control regions: counts, fold change, Fisher's exact test, ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pwm


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """One-sided p-values (greater, less) of the table [[a, b], [c, d]]; an empty margin gives 1."""
    row, column, total = a + b, a + c, a + b + c + d
    low, high = max(0, column - (total - row)), min(row, column)
    if low == high:
        return 1.0, 1.0
    whole = log_choose(total, column)
    mode = (row + 1) * (column + 1) // (total + 2)

    def tail(x: int, last: int, step: int) -> float:
        """Sum from a cell outwards, away from the mode: each term follows from the one before, until they vanish."""
        if (last - x) * step < 0:
            return 0.0
        terms, term = [1.0], 1.0
        while x != last:
            up = x if step > 0 else x - 1
            ratio = (row - up) * (column - up) / ((up + 1) * (total - row - column + up + 1))
            term *= ratio if step > 0 else 1 / ratio
            if term < 1e-20:
                break
            terms.append(term)
            x += step
        return math.fsum(terms)

    def scaled(x: int, last: int, step: int) -> float:
        log = log_choose(row, x) + log_choose(total - row, column - x) - whole if low <= x <= high else 0.0
        return min(1.0, math.exp(log) * tail(x, last, step))

    # The tail that holds the mode is the rest of the other one.
    if a > mode:
        return scaled(a, high, 1), min(1.0, 1.0 - scaled(a + 1, high, 1))
    return min(1.0, 1.0 - scaled(a - 1, low, -1)), scaled(a, low, -1)


def _fisher_rows(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher(*map(int, row)) for row in zip(a, b, c, d)], columns=["greater", "less"])


def fisher_column(*cells: Column | str) -> Column:
    """Fisher's test as a struct (greater, less); one row a motif, so the Python step is tiny."""
    return F.pandas_udf(_fisher_rows, "greater double, less double")(*cells)


def hit_counts(regions: DataFrame, sites: DataFrame, n_motifs: int, suffix: str) -> DataFrame:
    """(motif_idx, n_<suffix>, total_<suffix>): regions with a site, and all regions, for every motif."""
    spark = regions.sparkSession
    hits = sites.select("motif_idx", "region_id").distinct().groupBy("motif_idx").agg(F.count(F.lit(1)).alias("n"))
    total = regions.agg(F.count(F.lit(1)).alias("total"))
    motifs = spark.range(n_motifs).select(F.col("id").cast("int").alias("motif_idx"))
    return motifs.join(hits, "motif_idx", "left").select("motif_idx", F.coalesce("n", F.lit(0)).alias(f"n_{suffix}"), total.scalar().alias(f"total_{suffix}"))


def contingency(regions: DataFrame, sites: DataFrame, control: DataFrame, control_sites: DataFrame, n_motifs: int) -> DataFrame:
    """(motif_idx, n_input, total_input, n_control, total_control)."""
    return hit_counts(regions, sites, n_motifs, "input").join(hit_counts(control, control_sites, n_motifs, "control"), "motif_idx")


def fold_change() -> Column:
    """Share of input regions with a site over the share of control regions; NaN if it can't be told."""
    ratio = F.col("n_input") * F.col("total_control") / F.col("n_control") / F.col("total_input")
    return F.when((F.col("total_input") > 0) & (F.col("n_control") > 0), ratio).otherwise(F.lit(float("nan")))


def enrichment(counts: DataFrame, pwms: Sequence[Pwm]) -> DataFrame:
    """ENRICHMENT columns with motif_idx, p-values corrected for the number of motifs."""
    labels = F.array(*[F.lit(m.label) for m in pwms])
    tested = counts.withColumn("p", fisher_column("n_input", F.col("total_input") - F.col("n_input"), "n_control", F.col("total_control") - F.col("n_control")))
    corrected = F.least(F.least("p.greater", "p.less") * len(pwms), F.lit(1.0))
    return tested.select("motif_idx", F.get(labels, F.col("motif_idx")).alias("name"), "n_input", "n_control", fold_change().alias("fold_change"), F.col("p.greater").alias("p_enriched"), F.col("p.less").alias("p_depleted"), corrected.alias("p_corrected"))


def ranked(result: DataFrame) -> DataFrame:
    """The most enriched first; equal p-values by fold change, unknown ones last."""
    known = F.when(~F.isnan("fold_change"), F.col("fold_change"))
    return result.orderBy(F.col("p_enriched").asc(), known.desc_nulls_last(), "motif_idx")
