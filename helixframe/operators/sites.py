"""What becomes of sites: thinning of overlaps, the full grid of motifs and regions, wide tables, BED rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pwm
from helixframe.functions.sequence import file_name


def dedup(sites: DataFrame, pwms: Sequence[Pwm]) -> DataFrame:
    """Thin overlapping sites of one motif, region and strand, by expressions.

    Walking by start, a site nearer to the last survivor than the motif's length replaces it if it scores higher and is
    dropped otherwise. A group is the hits within one region, a short array.
    """
    lengths = F.array(*[F.lit(m.length) for m in pwms])
    one = F.struct("start", "raw", "score")
    grouped = sites.groupBy("motif_idx", "region_id", "strand").agg(F.array_sort(F.collect_list(one)).alias("s"))
    kind = "array<struct<start:bigint,raw:bigint,score:double>>"
    length = F.get(lengths, F.col("motif_idx"))

    def walk(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        alone = (F.size(kept) == 0) | (x["start"] - last["start"] >= length)
        better = x["raw"] > last["raw"]
        return F.when(alone, F.concat(kept, F.array(x))).when(better, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    kept = F.filter(F.aggregate(F.slice("s", 2, F.size("s")), F.slice("s", 1, 1).cast(kind), walk), lambda x: x.isNotNull())
    return grouped.select("motif_idx", "region_id", F.inline(kept), "strand").select("motif_idx", "region_id", "start", "raw", "score", "strand")


def per_region(sites: DataFrame) -> DataFrame:
    """(motif_idx, region_id, n_sites, max_score) of pairs that have sites; added up before the shuffle."""
    return sites.groupBy("motif_idx", "region_id").agg(F.count(F.lit(1)).alias("n_sites"), F.max("score").alias("max_score"))


def grid(regions: DataFrame, sites: DataFrame, n_motifs: int) -> DataFrame:
    """(motif_idx, region_id, n_sites, max_score) of all motifs and regions; no sites are 0 and null."""
    full = regions.select("region_id", F.explode(F.sequence(F.lit(0), F.lit(n_motifs - 1))).alias("motif_idx"))
    return full.join(per_region(sites), ["motif_idx", "region_id"], "left").select("motif_idx", "region_id", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "max_score")


def wide(regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm], value: str = "number") -> DataFrame:
    """One row a region: chr, start (from 1), end and a column a motif, its number of sites or best score ("NA" without).

    Columns go by the motif's place, m0, m1, ...; labels, which may repeat, are set when the table is written.
    """
    totals = []
    for i in range(len(pwms)):
        own = F.col("motif_idx") == i
        totals.append((F.count_if(own) if value == "number" else F.max(F.when(own, F.col("score")))).alias(f"m{i}"))
    pivoted = sites.groupBy("region_id").agg(*totals)
    joined = regions.join(pivoted, "region_id", "left")
    empty = (lambda c: F.coalesce(c, F.lit(0))) if value == "number" else (lambda c: F.coalesce(c.cast("string"), F.lit("NA")))
    return joined.select("region_id", F.col("chrom").alias("chr"), (F.col("start") + 1).alias("start"), "end", *[empty(F.col(f"m{i}")).alias(f"m{i}") for i in range(len(pwms))])


def bed_rows(regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm]) -> DataFrame:
    """(motif_file, region_id, chrom, start, end, name, score, strand): sites as BED rows with the file they go to."""
    lengths = F.array(*[F.lit(m.length) for m in pwms])
    files = F.array(*[F.lit(f"{m.matrix_id}_{m.name}") for m in pwms])
    joined = sites.join(regions.select("region_id", "chrom"), "region_id")
    return joined.select(
        file_name(F.get(files, F.col("motif_idx"))).alias("motif_file"),
        "region_id",
        "chrom",
        "start",
        (F.col("start") + F.get(lengths, F.col("motif_idx"))).alias("end"),
        F.lit(".").alias("name"),
        "score",
        "strand",
    )
