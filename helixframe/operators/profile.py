"""Profiles behind the plots: where sites lie around summits, and how enrichment follows the regions' scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pwm

TAPS = 11
BIN = 10
#: Places of a curve that one task works on.
BLOCK = 1 << 18


def hanning(n: int = TAPS) -> list[float]:
    w = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    return [v / sum(w) for v in w]


def smooth_array(x: Column, n: int = TAPS) -> Column:
    """Hanning-weighted moving average of an array, reflected at its ends; arrays of at most n values stay."""
    half, size = n // 2, F.size(x)

    def at(i: Column) -> Column:
        inside = F.abs(i)
        return F.get(x, F.when(inside >= size, 2 * (size - 1) - inside).otherwise(inside))

    def tap(i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(hanning(n)):
            if w:
                total = total + at(i + (k - half)) * w
        return total

    return F.when(size <= n, x).otherwise(F.transform(F.sequence(F.lit(0), size - 1), tap))


def have_same_length(regions: DataFrame) -> bool:
    low, high = regions.agg(F.min(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start"))).first()
    return low == high


def have_scores(regions: DataFrame) -> bool:
    return regions.filter("score is null").isEmpty()


def distance_histogram(regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm], width: int) -> DataFrame:
    """(motif_idx, bin, n, freq): sites by distance of their middle to the summit, in bins of 10 around it.

    All distances count in the share's total, also those outside the bins; the last bin holds its right end too.
    """
    extend = width // 2
    low = -extend - BIN // 2
    n_bins = (2 * extend + BIN) // BIN
    halves = F.array(*[F.lit(m.length / 2) for m in pwms])
    near = sites.join(regions.select("region_id", "summit"), "region_id")
    distance = F.col("start") + F.get(halves, F.col("motif_idx")) - F.col("summit")
    at = F.floor((distance - low) / BIN)
    at = F.when(distance == low + n_bins * BIN, n_bins - 1).otherwise(at)
    counted = near.groupBy("motif_idx", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("motif_idx").agg(F.sum("n").alias("total"))
    spark = sites.sparkSession
    frame = spark.range(len(pwms)).select(F.col("id").cast("int").alias("motif_idx"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = frame.join(counted, ["motif_idx", "bin"], "left").join(totals, "motif_idx", "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("motif_idx", "bin", n.alias("n"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("freq"))


def smoothed_histogram(histogram: DataFrame) -> DataFrame:
    """(motif_idx, bin, smooth) of a distance histogram; a motif's bins form one short array."""
    arrays = histogram.groupBy("motif_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "freq"))), lambda b: b["freq"]).alias("x"))
    return arrays.select("motif_idx", F.posexplode(smooth_array(F.col("x"))).alias("bin", "smooth"))


def placed_by_score(regions: DataFrame, n: int, rows: int = BLOCK) -> DataFrame:
    """(region_id, place) of n regions: 0 for the best score, the least region_id on ties.

    Regions are ordered within ranges of about `rows` of them, so that no task orders them all: ranges end at approximate
    quantiles of the score, and a score that fills several ranges is cut again at quantiles of its ids. The ends only deal the
    rows; places are exact wherever they lie.
    """
    scored = regions.select("region_id", F.col("score").cast("double").alias("score"))
    k = n // rows
    ends: list[float] = []
    if k:
        shares = [j / (k + 1) for j in range(1, k + 1)]
        known = scored.filter("score is not null and not isnan(score)")
        ends = known.agg(F.percentile_approx("score", shares, 10 * (k + 1))).first()[0] or []
    often = {v: m for v in set(ends) if (m := ends.count(v)) > 1}
    cuts = sorted(set(ends))
    range_ = F.lit(0)
    if cuts:
        # Nulls come last, as they do in the order itself.
        above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e > F.col("score")))
        range_ = F.when(F.col("score").isNull(), len(cuts) + 1).otherwise(above)
    part = F.lit(0)
    for value, m in often.items():
        ids = scored.filter(F.col("score") == value).agg(F.percentile_approx("region_id", [j / (m + 1) for j in range(1, m + 1)], 10 * (m + 1))).first()[0] or []
        below = F.size(F.filter(F.array(*map(F.lit, sorted(set(ids)))), lambda e: e < F.col("region_id")))
        # A cut is the least score of its range, so the range's other scores (part 0) go first.
        part = F.when(F.col("score") == value, below + 1).otherwise(part)
    dealt = scored.withColumn("range", range_).withColumn("part", part)
    own = Window.partitionBy("range", "part").orderBy(F.col("score").desc(), "region_id")
    ordered = dealt.select("region_id", "range", "part", (F.row_number().over(own) - 1).cast("long").alias("at"))
    if not cuts:
        return ordered.select("region_id", F.col("at").alias("place"))
    sizes = dealt.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
    # About n / rows of them.
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return ordered.join(F.broadcast(offsets), ["range", "part"]).select("region_id", (F.col("first") + F.col("at")).alias("place"))


def ranked_fold_change(regions: DataFrame, hits: DataFrame, control_share: float, rows: int = BLOCK) -> DataFrame:
    """(motif_idx, region_id, place, fold_change): moving share of regions with a site along the scores, over the control's.

    hits has (motif_idx, region_id, n_sites) of all motifs and regions. The frame reaches 1 % of the regions to both sides.
    Places are worked on in blocks of `rows`, whatever the number of regions.
    """
    n = regions.count()
    if n < 100:
        raise ValueError(f"a curve needs 100 regions, not {n}")
    reach = n // 100
    has = (F.col("n_sites") > 0).cast("int").alias("has")
    joined = hits.join(placed_by_score(regions, n, rows), "region_id").select("motif_idx", "region_id", "place", has)
    dealt = joined.withColumn("block", F.floor(F.col("place") / rows))
    # The frame [place - reach, place + reach) is a difference of running sums: those within a block, and of whole blocks.
    own = Window.partitionBy("motif_idx", "block")
    running = dealt.withColumn("upto", F.sum("has").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    if n <= rows:
        # One block: nothing lies before it, so hits need not be computed again for sums by block, nor rows dealt again.
        met = running.withColumn("total", F.sum("has").over(own))
        around, kept = own.orderBy("place"), F.lit(True)
        ahead, behind = F.lead("upto", reach - 1).over(around), F.lag("upto", reach + 1).over(around)
    else:
        sums = dealt.groupBy("motif_idx", "block").agg(F.sum("has").alias("n"))
        motif = Window.partitionBy("motif_idx")
        before = F.sum("n").over(motif.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sums.select("motif_idx", "block", F.coalesce(before, F.lit(0)).alias("first"), F.sum("n").over(motif).alias("total"))
        whole = running.join(offsets, ["motif_idx", "block"]).withColumn("upto", F.col("first") + F.col("upto"))
        # A running sum goes to its own block and to those of the two rows whose frames end at it.
        blocks_of = [F.floor((F.col("place") + d) / rows) for d in (0, 1 - reach, 1 + reach)]
        met = whole.withColumn("at", F.explode(F.array_distinct(F.array(*blocks_of))))
        around, kept = Window.partitionBy("motif_idx", "at").orderBy("place"), F.col("at") == F.col("block")
        ahead, behind = (F.max("upto").over(around.rangeBetween(d, d)) for d in (reach - 1, -reach - 1))
    hit = F.coalesce(ahead, F.col("total")) - F.coalesce(behind, F.lit(0))
    size = F.least(F.col("place") + reach, F.lit(n)) - F.greatest(F.col("place") - reach, F.lit(0))
    shares = met.select("motif_idx", "region_id", "place", kept.alias("kept"), (hit / size / (control_share or 1.0)).alias("fold_change"))
    return shares.filter("kept").select("motif_idx", "region_id", "place", "fold_change")


def smoothed_curve(curve: DataFrame, n: int = TAPS, size: int | None = None, rows: int = BLOCK) -> DataFrame:
    """(motif_idx, place, smooth) of a ranked curve: the same taps by neighbours, reflected at the ends.

    size is the number of places of each motif, counted if not given. Places are worked on in blocks of `rows`, each with
    the neighbours of its first and last ones.
    """
    half = n // 2
    own = Window.partitionBy("motif_idx", "at").orderBy("place")
    # A reflected neighbour k places before the first row lies 2 * (k - place) ahead of where it would be, at k - place.
    if size is None:
        sized = curve.join(F.broadcast(curve.groupBy("motif_idx").agg(F.count(F.lit(1)).alias("size"))), "motif_idx")
    else:
        sized = curve.withColumn("size", F.lit(size).cast("long"))
    near = F.array(*[F.floor((F.col("place") + d) / rows) for d in (-half, 0, half)])
    wide = sized.withColumn("at", F.explode(F.array_distinct(near)))
    total = F.lit(0.0)
    for k, w in enumerate(hanning(n)):
        d = k - half
        if not w:
            continue
        value = F.lag("fold_change", -d).over(own) if d < 0 else F.lead("fold_change", d).over(own) if d else F.col("fold_change")
        for p in range(half):
            mirror = abs(p + d)
            if p + d < 0:  # rows p of the first `half`
                step = mirror - p
                value = F.when(F.col("place") == p, F.lead("fold_change", step).over(own) if step > 0 else F.lag("fold_change", -step).over(own)).otherwise(value)
            if p - d < 0:  # the p-th row from the end
                step = p - abs(p - d)
                value = F.when(F.col("place") == F.col("size") - 1 - p, F.lead("fold_change", step).over(own) if step > 0 else F.lag("fold_change", -step).over(own)).otherwise(value)
        total = total + value * w
    smooth = F.when(F.col("size") <= n, F.col("fold_change")).otherwise(total).alias("smooth")
    return wide.select("motif_idx", "place", "at", smooth).filter(F.col("at") == F.floor(F.col("place") / rows)).drop("at")
