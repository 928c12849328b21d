"""Position matrices: validation on the driver, and the matrix algebra as plans over long-form tables.

Long form: one row a motif, position and base (motif_idx, pos, base, value). A motif set has hundreds of motifs of a few
dozen positions, so every step is a narrow window over the few rows of a motif.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.schemas import BASES

#: Weights are kept to 5 decimals; scaled by this they are integers, and sums don't depend on the order.
SCALE = 100_000
PSEUDO = 0.001
COLUMN = ("motif_idx", "pos")


def _rows(values: Sequence[Sequence[float]]) -> list[list[float]]:
    rows = [list(r) for r in values]
    if len(rows) != 4:
        raise ValueError("a position matrix has four rows: A, C, G, T")
    if not rows[0] or len({len(r) for r in rows}) != 1:
        raise ValueError("the rows of a position matrix have one length, at least 1")
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for r in rows for v in r):
        raise ValueError("a position matrix holds numbers")
    return rows


@dataclass
class Matrix:
    """A 4 x N matrix with its ids; `kind` decides which values are valid."""

    values: Sequence[Sequence[float]]
    matrix_id: str | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        self.values = _rows(self.values)
        self.name = self.name if self.name is not None else self.matrix_id

    @property
    def length(self) -> int:
        return len(self.values[0])

    @property
    def label(self) -> str:
        return f"{self.matrix_id},{self.name}"


@dataclass
class Pfm(Matrix):
    """Counts: integers, none negative, no empty position."""

    def __post_init__(self) -> None:
        super().__post_init__()
        if any(int(v) != v or v < 0 for r in self.values for v in r):
            raise ValueError("a frequency matrix holds non-negative integers")
        if any(sum(c) == 0 for c in zip(*self.values)):
            raise ValueError("a position without counts")


@dataclass
class Ppm(Matrix):
    """Probabilities: each position sums to 1."""

    def __post_init__(self) -> None:
        super().__post_init__()
        if any(v < 0 for r in self.values for v in r):
            raise ValueError("a probability is negative")
        if any(not math.isclose(sum(c), 1, rel_tol=1e-5, abs_tol=1e-8) for c in zip(*self.values)):
            raise ValueError("a position doesn't sum to 1")


@dataclass
class Pwm(Matrix):
    """Log-odds weights with score cutoffs by p-value text."""

    cutoffs: dict[str, float] = field(default_factory=dict)

    def scaled(self) -> list[list[int]]:
        return [[round(v * SCALE) for v in r] for r in self.values]

    @property
    def max_scan(self) -> int:
        """Best raw score in scans, scaled: a position never adds less than nothing."""
        return sum(max(0, *c) for c in zip(*self.scaled()))

    @property
    def max_raw(self) -> float:
        return sum(max(c) for c in zip(*self.values))

    @property
    def min_raw(self) -> float:
        return sum(min(c) for c in zip(*self.values))

    def score(self, sequence: str) -> float:
        """Forward score of one sequence of the motif's length, as a share of the best; other letters add nothing."""
        if len(sequence) != self.length:
            raise ValueError("the sequence must have the motif's length")
        raw = sum(self.values[BASES.index(b)][i] for i, b in enumerate(sequence.upper()) if b in BASES)
        return raw / self.max_raw

    def cutoff(self, p_value: str) -> float:
        if p_value not in self.cutoffs:
            raise ValueError(f"motif {self.label} has no cutoff for p-value {p_value}")
        return self.cutoffs[p_value]

    def reverse(self) -> list[list[int]]:
        """Scaled weights of the reverse complement."""
        return [r[::-1] for r in self.scaled()[::-1]]


def weights(pfm: Pfm, background: dict[str, float] | None = None, pseudo: float = PSEUDO) -> Pwm:
    """The weight matrix of one frequency matrix, on the driver: the same steps as the plans below."""
    bg = background or dict.fromkeys(BASES, 0.25)
    columns = []
    for column in zip(*pfm.values):
        shares = [v / sum(column) for v in column]
        if min(shares) == 0:
            shares = [v + pseudo / (1 - 4 * pseudo) for v in shares]
        columns.append([round(math.log(v / sum(shares) / bg[b]), 5) for v, b in zip(shares, BASES)])
    return Pwm([list(r) for r in zip(*columns)], pfm.matrix_id, pfm.name)


def long_form(spark: SparkSession, matrices: Sequence[Matrix]) -> DataFrame:
    """(motif_idx, pos, base, value) of a motif set."""
    rows = [(i, p, b, float(m.values[k][p])) for i, m in enumerate(matrices) for p in range(m.length) for k, b in enumerate(BASES)]
    return spark.createDataFrame(rows, "motif_idx int, pos int, base string, value double")


def to_ppm(pfm: DataFrame) -> DataFrame:
    """Counts to probabilities: each value over its position's total."""
    return pfm.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy(*COLUMN)))


def normalize(ppm: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """Add a pseudo probability to positions that hold a zero, and rescale all positions."""
    if not 0 < pseudo < 0.25:
        raise ValueError("the pseudo probability lies between 0 and 0.25")
    extra = F.when(F.min("value").over(Window.partitionBy(*COLUMN)) == 0, F.lit(pseudo / (1 - 4 * pseudo))).otherwise(F.lit(0.0))
    raised = ppm.withColumn("value", F.col("value") + extra)
    return raised.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy(*COLUMN)))


def to_pwm(ppm: DataFrame, background: dict[str, float] | None = None) -> DataFrame:
    """Probabilities to log-odds weights at 5 decimals against a background, 0.25 each by default."""
    bg = background or dict.fromkeys(BASES, 0.25)
    share = F.element_at(F.create_map(*[x for b in BASES for x in (F.lit(b), F.lit(float(bg[b])))]), F.col("base"))
    return ppm.withColumn("value", F.bround(F.ln(F.col("value") / share), 5))


def extremes(pwm: DataFrame) -> DataFrame:
    """(motif_idx, length, max_raw, max_scan, min_raw): sums of the positions' best and worst weights."""
    by_column = pwm.groupBy("motif_idx", "pos").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return by_column.groupBy("motif_idx").agg(
        F.count(F.lit(1)).alias("length"),
        F.sum("hi").alias("max_raw"),
        F.sum(F.greatest("hi", F.lit(0.0))).alias("max_scan"),
        F.sum("lo").alias("min_raw"),
    )


def collected(long: DataFrame) -> list[list[list[float]]]:
    """Matrices of a long-form motif set, for the driver (a motif set is small by nature)."""
    out: dict[int, dict] = {}
    for r in long.collect():
        out.setdefault(r["motif_idx"], {})[r["base"], r["pos"]] = r["value"]
    return [[[m[b, p] for p in range(len(m) // 4)] for b in BASES] for _, m in sorted(out.items())]


def pfms_to_pwms(spark: SparkSession, pfms: Sequence[Pfm], background: dict[str, float] | None = None, pseudo: float = PSEUDO) -> list[Pwm]:
    weights = collected(to_pwm(normalize(to_ppm(long_form(spark, pfms)), pseudo), background))
    return [Pwm(w, m.matrix_id, m.name) for w, m in zip(weights, pfms)]


def cutoff_hit(score: Column, cutoff: Column | float) -> Column:
    """A score reaches a cutoff within 1e-10."""
    return score - cutoff >= F.lit(-1e-10)
