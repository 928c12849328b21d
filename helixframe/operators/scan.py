"""Motif scans: every place of every sequence where a weight matrix scores at its cutoff or above.

`scan` is one narrow Arrow pass: sequences are encoded once per batch, laid one after another, and each motif is
added up column by column in integers over all positions of both strands. No shuffle, no cross join of motifs and
positions; memory is bounded by the step. `scan_native` is the same in expressions, one row a position, for short sequences and for
SQL users.

Scores are raw sums over the best possible raw sum. Raw sums are integers (weights times 10^5), so both forms agree to
the bit. Letters other than A, C, G, T add nothing and are not skipped. A motif whose best sum is 0 has no sites.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.matrix import SCALE, Pwm, cutoff_hit

SITES = "motif_idx int, region_id long, start long, raw long, score double, strand string"
SITES_ARROW = pa.schema([("motif_idx", pa.int32()), ("region_id", pa.int64()), ("start", pa.int64()), ("raw", pa.int64()), ("score", pa.float64()), ("strand", pa.string())])
TOLERANCE = 1e-10
#: Bases that one step of the kernel handles at once.
STEP = 1 << 20
#: Positions of a sequence that `scan_native` takes together.
STRETCH = 1024

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def strands(which: str) -> str:
    if which not in ("both", "+", "-"):
        raise ValueError(f"strand must be both, + or -, not {which!r}")
    return "+-" if which == "both" else which


def encode(text: str) -> np.ndarray:
    """Codes of the characters: 0-3 for bases, 4 for all else; one code a character."""
    if text.isascii():
        return _CODE[np.frombuffer(text.encode(), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(points, 255)] * (points < 128) + 4 * (points >= 128).astype(np.uint8)


class Plan:
    """Weights of a motif set as lookup rows by position, both strands, and the least raw sums that hit."""

    def __init__(self, pwms: Sequence[Pwm], cutoffs: Sequence[float], which: str):
        self.motifs = []
        for i, (m, cutoff) in enumerate(zip(pwms, cutoffs)):
            best = m.max_scan
            if best == 0:
                continue
            for strand in strands(which):
                rows = m.scaled() if strand == "+" else m.reverse()
                table = np.array([[*c, 0] for c in zip(*rows)], np.int32)
                self.motifs.append((i, m.length, strand, table, best, cutoff))

    def hits(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, int]]:
        """(motif, strand, positions, raw sums, best sum) over sequences laid one after another that end at `ends`."""
        left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(codes))
        for i, length, strand, table, best, cutoff in self.motifs:
            n = len(codes) - length + 1
            if n <= 0:
                continue
            raw = table[0][codes[:n]]
            for c in range(1, length):
                raw += table[c][codes[c : c + n]]
            least = int(np.floor((cutoff - TOLERANCE) * best)) - 1
            at = np.flatnonzero((raw >= least) & (left[:n] >= length))
            found = raw[at].astype(np.int64)
            ok = found / best - cutoff >= -TOLERANCE
            yield i, strand, at[ok], found[ok], best


def scan(seqs: DataFrame, pwms: Sequence[Pwm], p_value: str | None = "1e-4", strand: str = "both", cutoffs: Sequence[float] | None = None, dedup: bool = False) -> DataFrame:
    """SITES of (region_id, w_start, seq): sites of all motifs, starts in chromosome coordinates.

    Cutoffs are the motifs' own for a p-value text, or given. With `dedup`, overlapping sites of a motif on one strand of a
    region are thinned as in `operators.dedup`, within the pass.
    """
    limits = list(cutoffs) if cutoffs is not None else [m.cutoff(p_value) for m in pwms]
    plan = Plan(pwms, limits, strand)
    lengths = [m.length for m in pwms]

    def run(batches):
        for batch in batches:
            ids, starts, texts = (batch.column(i) for i in range(3))
            ids, starts = ids.to_numpy(zero_copy_only=False), starts.to_numpy(zero_copy_only=False)
            held, size, first = [], 0, 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size > STEP:
                    if held:
                        yield from found(held, ids[first:k], starts[first:k])
                    held, size, first = [], 0, k
                if k < batch.num_rows:
                    held.append(encode(texts[k].as_py() or ""))
                    size += len(held[-1])

    def found(codes: list, ids: np.ndarray, starts: np.ndarray):
        ends = np.cumsum([len(c) for c in codes])
        begin = ends - [len(c) for c in codes]
        for i, sign, at, raw, best in plan.hits(np.concatenate(codes), ends):
            row = np.searchsorted(ends, at, side="right")
            if dedup and len(at):
                keep = thinned(row, at, raw, lengths[i])
                row, at, raw = row[keep], at[keep], raw[keep]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, i, np.int32)), pa.array(ids[row]), pa.array(starts[row] + at - begin[row]), pa.array(raw), pa.array(raw / best), pa.array([sign] * n, pa.string())], schema=SITES_ARROW
            )

    return seqs.select(F.col("region_id").cast("long"), F.col("w_start").cast("long"), "seq").mapInArrow(run, SITES)


def thinned(row: np.ndarray, at: np.ndarray, raw: np.ndarray, length: int) -> list[int]:
    """Indices of the sites that stay: walking by start, an overlapping site replaces the last if it scores higher."""
    keep: list[int] = []
    for k in range(len(at)):
        if keep and row[keep[-1]] == row[k] and at[k] - at[keep[-1]] < length:
            if raw[k] > raw[keep[-1]]:
                keep[-1] = k
        else:
            keep.append(k)
    return keep


def window_sum(codes: Column, at: Column, rows: list[list[int]]) -> Column:
    """Raw sum of the window from `at` (from 0) on in an array of codes 0-4."""
    total = F.lit(0)
    for c, column in enumerate(zip(*rows)):
        total = total + F.get(F.array(*[F.lit(v) for v in (*column, 0)]), F.get(codes, at + c))
    return total


def codes_column(seq: Column) -> Column:
    """Array of codes 0-4 of a sequence's characters."""
    # Not in upper case first: that makes two letters of some, and later ones would move.
    mapped = F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "4"), "ACGTacgt", "01230123")
    return F.transform(F.split(mapped, ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(4)))


def scan_native(seqs: DataFrame, pwms: Sequence[Pwm], cutoffs: Sequence[float], strand: str = "both") -> DataFrame:
    """The same SITES by expressions only.

    Every place is a row, so that its sums run as generated code; in a lambda over places they are interpreted, one lookup
    after another. Only places where some motif hits go on to the motifs.
    """
    motifs = [
        (i, m.length, m.scaled() if sign == "+" else m.reverse(), m.max_scan, cutoff, sign)
        for i, (m, cutoff) in enumerate(zip(pwms, cutoffs))
        if m.max_scan
        for sign in strands(strand)
    ]
    if not motifs:
        return seqs.sparkSession.createDataFrame([], SITES)
    shortest, widest = (pick(length for _, length, *_ in motifs) for pick in (min, max))
    whole = seqs.select(F.col("region_id").cast("long"), F.col("w_start").cast("long"), "seq", F.length("seq").alias("size"))
    # Rows may carry their codes along and be held together, so they are of a stretch, not of a whole long sequence.
    firsts = F.when(F.col("size") >= shortest, F.sequence(F.lit(0), F.col("size") - shortest, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    own = F.transform(firsts, lambda at: F.struct(at.alias("at"), F.substring("seq", at + 1, F.lit(STRETCH + widest - 1)).alias("own")))
    cut = whole.select("region_id", "w_start", "size", F.inline(own))
    base = cut.select("region_id", (F.col("w_start") + F.col("at")).alias("w_start"), codes_column(F.col("own")).alias("codes"), (F.col("size") - F.col("at")).alias("n"))
    places = F.sequence(F.lit(0), F.least(F.col("n") - shortest, F.lit(STRETCH - 1)))
    placed = base.select("region_id", "w_start", "codes", "n", F.explode(places).alias("p"))

    def hit(k: int, raw: Column) -> Column:
        _, length, _, best, cutoff, _ = motifs[k]
        return (F.col("n") - F.col("p") >= length) & cutoff_hit(raw / float(best), cutoff)

    def site(k: int) -> Column:
        i, _, _, best, _, sign = motifs[k]
        raw = F.col(f"raw_{k}")
        return F.when(hit(k, raw), F.struct(F.lit(i).alias("motif_idx"), raw.cast("long").alias("raw"), (raw / float(best)).alias("score"), F.lit(sign).alias("strand")))

    raws = [window_sum(F.col("codes"), F.col("p"), rows) for _, _, rows, *_ in motifs]
    some = reduce(or_, (hit(k, raw) for k, raw in enumerate(raws)))
    # Spark pushes no filter through a projection with a row number, which here is never negative; the sums stay shared.
    summed = placed.select("region_id", "w_start", "n", "p", *[raw.alias(f"raw_{k}") for k, raw in enumerate(raws)], (some & (F.monotonically_increasing_id() >= 0)).alias("some"))
    start = (F.col("w_start") + F.col("p")).alias("start")
    sites = summed.filter("some").select("region_id", start, F.inline(F.array(*[site(k) for k in range(len(motifs))]))).filter("motif_idx is not null")
    return sites.select("motif_idx", "region_id", "start", "raw", "score", "strand")


def prefix_scores(seqs: DataFrame, pwms: Sequence[Pwm], strand: str = "both") -> DataFrame:
    """(motif_idx, region_id, raw, score): the score of each sequence's first window, the better strand of two.

    Sequences shorter than a motif raise.
    """
    base = seqs.select("region_id", codes_column(F.col("seq")).alias("codes"))
    rows = []
    for i, m in enumerate(pwms):
        sums = [window_sum(F.col("codes"), F.lit(0), m.scaled() if s == "+" else m.reverse()) for s in strands(strand)]
        best = F.greatest(*sums) if len(sums) > 1 else sums[0]
        long_enough = F.when(F.size("codes") >= m.length, best).otherwise(F.raise_error(F.lit("a sequence is shorter than the motif")).cast("int"))
        rows.append(F.struct(F.lit(i).alias("motif_idx"), long_enough.cast("long").alias("raw"), (long_enough / float(m.max_scan or 1)).alias("score")))
    return base.select("region_id", F.inline(F.array(*rows))).select("motif_idx", "region_id", "raw", "score")


__all__ = ["SCALE", "SITES", "Plan", "encode", "prefix_scores", "scan", "scan_native", "strands", "thinned"]
