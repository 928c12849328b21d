"""Regions against genes and chromosomes: scan windows, promoter and distal subsets, nearest gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.genome import promoters

#: Tables up to this many rows are broadcast after a count; larger ones are joined by shuffled bins.
BROADCAST_ROWS = 200_000
BIN = 10_000
FAR = 10_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a bounded count shows that it is small."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def windows(regions: DataFrame, sizes: DataFrame, width: int = 0) -> DataFrame:
    """Add w_start, w_end: the whole region for a width of 0 or less, else so far around the summit, inside the chromosome.

    Odd widths count as one less. Chromosomes without a size raise when a width is asked for.
    """
    if width <= 0:
        return regions.withColumn("w_start", F.col("start")).withColumn("w_end", F.col("end"))
    half = width // 2
    sized = regions.join(small(sizes.select(F.col("chrom").alias("_chrom"), "size")), F.col("chrom") == F.col("_chrom"), "left")
    size = F.coalesce("size", F.raise_error(F.concat(F.lit("no size for chromosome "), F.coalesce(F.col("chrom"), F.lit("null")))).cast("long"))
    return sized.select(
        *regions.columns,
        F.greatest(F.col("summit") - half, F.lit(0)).cast("long").alias("w_start"),
        F.least(F.col("summit") + half, size).cast("long").alias("w_end"),
    )


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open intervals share a position."""
    return (start < other_end) & (end > other_start)


def by_location(regions: DataFrame, genes: DataFrame, location: str, upstream: int = 2000, downstream: int = 2000) -> DataFrame:
    """Regions that overlap some promoter ("promoter"), or none ("distal").

    Few promoters are broadcast by chromosome. Many are binned: a region and a promoter that overlap share a bin, so
    the join has an equality on (chromosome, bin) and no chromosome meets in one task.
    """
    if location not in ("promoter", "distal"):
        raise ValueError(f"location must be promoter or distal, not {location!r}")
    p = promoters(genes, upstream, downstream).select(F.col("chrom").alias("p_chrom"), "p_start", "p_end")
    hit = overlaps(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end"))
    how = "left_semi" if location == "promoter" else "left_anti"
    if p.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return regions.join(F.broadcast(p), (F.col("chrom") == F.col("p_chrom")) & hit, how)

    def bins(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / BIN)))

    binned = regions.select("region_id", "chrom", "start", "end", bins("start", "end").alias("bin"))
    met = binned.join(p.withColumn("p_bin", bins("p_start", "p_end")), (F.col("chrom") == F.col("p_chrom")) & (F.col("bin") == F.col("p_bin")) & hit, "left_semi")
    return regions.join(met.select("region_id").distinct(), "region_id", how)


def nearest_gene(regions: DataFrame, genes: DataFrame, mode: str = "reference", far: int = FAR) -> DataFrame:
    """(region_id, distance): signed distance of each region's start to a start site nearer than `far`, else null.

    "nearest" takes the least distance, the first gene in file order on ties. "reference" keeps the established
    rule: genes are walked in file order with the signed distance as the bound, so the first gene downstream that comes
    within the bound ends the search. The sign turns for genes on the minus strand. Starts meet by stretches of `far`: the
    own one and its two neighbours, so that not all genes of a chromosome are tried.
    """
    if mode not in ("reference", "nearest"):
        raise ValueError(f"mode must be reference or nearest, not {mode!r}")
    stretch = F.floor(F.col("tss") / far).alias("g_bin")
    g = small(genes.select(F.col("chrom").alias("g_chrom"), "tss", F.col("strand").alias("g_strand"), "ord", stretch))
    t = F.col("start") - F.col("tss")
    # Only genes nearer than the bound can ever be taken or change what is taken.
    own = F.floor(F.col("start") / far)
    near = (F.col("chrom") == F.col("g_chrom")) & (F.col("bin") == F.col("g_bin")) & (F.abs(t) < far)
    placed = regions.select("region_id", "chrom", "start", F.explode(F.array(own - 1, own, own + 1)).alias("bin"))
    pairs = placed.join(g, near).select("region_id", t.alias("t"), "g_strand", "ord")
    signed = F.when(F.col("g_strand") == "-", -F.col("t")).otherwise(F.col("t"))
    if mode == "nearest":
        best = pairs.groupBy("region_id").agg(F.min_by(signed, F.struct(F.abs("t"), "ord")).alias("distance"))
    else:
        before = Window.partitionBy("region_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        bound = F.coalesce(F.min(F.when(F.col("t") >= 0, F.col("t"))).over(before), F.lit(far))
        marked = pairs.withColumn("locks", (F.col("t") < 0) & (-F.col("t") < bound))
        # A lock wins over all; without one, the least distance upstream, the earliest on ties.
        rank = F.struct(F.when(F.col("locks"), 0).otherwise(1), F.when(F.col("locks"), F.lit(0)).otherwise(F.col("t")), F.col("ord"))
        best = marked.filter("locks or t >= 0").groupBy("region_id").agg(F.min_by(signed, rank).alias("distance"))
    return regions.select("region_id").join(best, "region_id", "left")
