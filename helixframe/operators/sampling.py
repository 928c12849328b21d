"""Random sequences and control regions, drawn by integer hashes of row numbers: the same for any partitioning.

A draw of `below` is ((id * 48271 + seed) mod M) * 69621 mod M with M = 2^31 - 1, scaled to its range. Draws of one id
under neighbouring seeds are nearly the same number, so two draws that have to be independent are taken from `hashed`
(52 bits of the MD5 of id, stream and seed). Both are available in any SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.locate import FAR, nearest_gene, small

MODULUS = 2_147_483_647
BEYOND = (10_000, 100_000)


def draw(number: Column, seed: int) -> Column:
    """Integer in [0, MODULUS)."""
    first = F.pmod(F.pmod(number, F.lit(MODULUS)) * 48271 + seed, F.lit(MODULUS))
    return F.pmod(first * 69621 + 1, F.lit(MODULUS))


def below(number: Column, seed: int, limit: Column) -> Column:
    """Integer in [0, limit)."""
    # Divided as integers: a quotient of decimals has 6 digits only, and one just under a whole number would be rounded up to it.
    return F.call_function("div", draw(number, seed).cast("decimal(10,0)") * limit.cast("decimal(19,0)"), F.lit(MODULUS).cast("decimal(10,0)")).cast("long")


def hashed(number: Column, stream: int, seed: int, limit: Column) -> Column:
    """Integer in [0, limit), independent between streams and between seeds."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(stream)), number.cast("string"))), 1, 13), 16, 10)
    # Integers of 52 + 63 bits fit in 38 digits, and are divided as integers.
    return F.call_function("div", part.cast("decimal(19,0)") * limit.cast("decimal(18,0)"), F.lit(1 << 52).cast("decimal(19,0)")).cast("long")


def sized(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """regions with the size of their chromosome; an unknown chromosome raises."""
    known = regions.join(small(sizes.select(F.col("chrom").alias("_chrom"), "size")), F.col("chrom") == F.col("_chrom"), "left").drop("_chrom")
    unknown = F.raise_error(F.concat(F.lit("no size for chromosome "), F.coalesce(F.col("chrom"), F.lit("null")))).cast("long")
    return known.withColumn("size", F.coalesce("size", unknown))


def random_windows(sizes: DataFrame, n: int, length: int, seed: int = 0, pieces: int = 1024, first: int = 0) -> DataFrame:
    """(draw_id, chrom, w_start, w_end) of draws first to first + n: chromosomes drawn by size, starts uniform in [0, size - length).

    A draw in [0, total) falls in one chromosome's stretch. Stretches and draws meet by piece of the whole, so the join
    has an equality and no chromosome's draws meet in one task. A chromosome too short for a window raises when it is drawn.
    """
    spark = sizes.sparkSession
    order = Window.orderBy("chrom")
    # One row a chromosome: the running sum is over a genome's list of sequences, not over data.
    stretch = sizes.withColumn("hi", F.sum("size").over(order)).withColumn("lo", F.col("hi") - F.col("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if total <= 0:
        raise ValueError("there is no sequence to draw from")
    width = -(-total // pieces)
    stretch = stretch.withColumn("piece", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    at = hashed(F.col("id"), 0, seed, F.lit(total))
    draws = spark.range(first, first + n).select(F.col("id").alias("draw_id"), at.alias("at"))
    draws = draws.withColumn("at_piece", F.floor(F.col("at") / width))
    met = draws.join(small(stretch), (F.col("at_piece") == F.col("piece")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    room = F.col("size") - length
    short = F.raise_error(F.concat(F.lit("chromosome too short: "), F.col("chrom"))).cast("long")
    place = hashed(F.col("draw_id"), 1, seed, room)
    start = F.when(room > 0, place).otherwise(short)
    return met.select("draw_id", "chrom", start.alias("w_start")).withColumn("w_end", F.col("w_start") + length)


def uniform_controls(regions: DataFrame, sizes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n control regions for each region: its chromosome and length, a start uniform in [0, size - length].

    A region on an unknown chromosome raises.
    """
    length = F.col("end") - F.col("start")
    drawn = sized(regions, sizes).select("region_id", "chrom", length.alias("length"), "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    number = F.col("region_id") * n + F.col("k")
    start = below(number, seed, F.col("size") - F.col("length") + 1)
    return drawn.select(number.alias("control_id"), "region_id", "chrom", start.alias("start"), (start + F.col("length")).alias("end"))


def gene_controls(regions: DataFrame, sizes: DataFrame, genes: DataFrame, n: int, seed: int = 0, tries: int = 20, mode: str = "reference") -> DataFrame:
    """n control regions for each region as far from a random gene of its chromosome as it is from its nearest one.

    Places off the chromosome are drawn again, up to `tries` times a slot; a slot that never fits raises. Regions without
    a gene nearer than FAR get one random distance beyond; chromosomes without genes give no controls, unknown chromosomes raise.
    """
    order = Window.partitionBy("chrom").orderBy("ord")
    listed = genes.withColumn("g_no", F.row_number().over(order) - 1).select(F.col("chrom").alias("g_chrom"), "g_no", "tss", "strand")
    counts = genes.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_genes")).withColumnRenamed("chrom", "c_chrom")
    base = regions.join(nearest_gene(regions, genes, mode, FAR), "region_id")
    base = sized(base, sizes)
    base = base.join(small(counts), F.col("chrom") == F.col("c_chrom"))
    beyond = BEYOND[0] + below(F.col("region_id"), seed + 2, F.lit(BEYOND[1] - BEYOND[0] + 1))
    base = base.select("region_id", "chrom", (F.col("end") - F.col("start")).alias("length"), "size", "n_genes", F.coalesce("distance", beyond).alias("distance"))
    slots = base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    number = (F.col("region_id") * n + F.col("slot")) * tries + F.col("k")
    tried = slots.withColumn("pick", below(number, seed, F.col("n_genes")))
    met = tried.join(small(listed), (F.col("chrom") == F.col("g_chrom")) & (F.col("pick") == F.col("g_no")))
    start = F.when(F.col("strand") == "+", F.col("tss") + F.col("distance")).otherwise(F.col("tss") - F.col("distance"))
    placed = met.withColumn("at", start).withColumn("fits", (F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.col("size")))
    first = placed.groupBy("region_id", "slot", "chrom", "length").agg(F.min_by(F.when(F.col("fits"), F.col("at")), F.when(F.col("fits"), F.col("k"))).alias("start"))
    checked = F.coalesce("start", F.raise_error(F.lit("no gene of the chromosome leaves room for a control region")).cast("long"))
    return first.select((F.col("region_id") * n + F.col("slot")).alias("control_id"), "region_id", "chrom", checked.alias("start")).join(base.select("region_id", "length"), "region_id").select(
        "control_id", "region_id", "chrom", "start", (F.col("start") + F.col("length")).alias("end")
    )


def nth_smallest(ids: DataFrame, n: int, width: int = 4096) -> int:
    """The n-th smallest of a column `draw_id` of distinct numbers: counts by stretches of `width`, then one stretch in order."""
    stretch = F.floor(F.col("draw_id") / width)
    run = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    counts = ids.groupBy(stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(run))
    at = counts.filter(F.col("upto") >= n).orderBy("stretch").first()
    own = ids.filter(stretch == at["stretch"]).orderBy("draw_id").collect()
    return own[n - (at["upto"] - at["c"]) - 1]["draw_id"]
