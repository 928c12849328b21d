"""Motif functions for SQL users: a scalar score and a table function of sites over a registered motif set."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pwm
from helixframe.operators.scan import Plan, encode
from helixframe.schemas import BASES


def score_column(seq: Column, pwm: Pwm) -> Column:
    """Forward score of a sequence of the motif's length as an expression, null for other lengths; other letters add nothing."""
    total = F.lit(0).cast("long")
    for k, column in enumerate(zip(*pwm.scaled()), 1):
        base, own = F.upper(F.substring(seq, k, 1)), F.lit(0)
        for letter, weight in zip(BASES, column):
            own = F.when(base == letter, weight).otherwise(own)
        total = total + own
    best = sum(max(c) for c in zip(*pwm.scaled()))
    return F.when(F.length(seq) == pwm.length, total / F.lit(best))


def register(spark: SparkSession, pwms: Sequence[Pwm], cutoffs: Sequence[float], strand: str = "both") -> None:
    """Make `score_motif(seq, motif_idx)` and `scan_motifs(seq)` available in SQL.

    score_motif is the forward score of a sequence of the motif's length, null for other lengths. scan_motifs gives
    (motif_idx, start, raw, score, strand) of a sequence; use it with LATERAL.
    """
    held = list(pwms)
    plan = Plan(held, list(cutoffs), strand)

    def score(seq: pd.Series, motif: pd.Series) -> pd.Series:
        out = np.full(len(seq), np.nan)
        lengths = seq.str.len()
        for m in motif.unique():
            table, best = np.zeros((held[m].length, 256)), held[m].max_raw
            for base, row in zip(BASES, held[m].values):
                table[:, ord(base)] = table[:, ord(base.lower())] = row
            own = np.flatnonzero((motif == m) & (lengths == held[m].length))
            if len(own):
                letters = np.frombuffer("".join(seq.iloc[own]).encode("latin-1", "replace"), np.uint8).reshape(len(own), -1)
                out[own] = table[np.arange(held[m].length), letters].sum(axis=1) / best
        return pd.Series(out)

    class Sites:
        def eval(self, seq: str):
            codes = encode(seq or "")
            for i, sign, at, raw, best in plan.hits(codes, np.array([len(codes)])):
                for p, r in zip(at.tolist(), raw.tolist()):
                    yield i, p, r, r / best, sign

    spark.udf.register("score_motif", F.pandas_udf(score, "double"))
    spark.udtf.register("scan_motifs", F.udtf(Sites, returnType="motif_idx int, start int, raw long, score double, strand string"))
