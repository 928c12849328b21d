"""The jobs behind the commands: install a genome, install and build motifs, scan regions."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import sinks
from helixframe.catalog import Catalog
from helixframe.errors import MissingGenomeFileError, MissingPfmsError, MissingPwmsError
from helixframe.functions.matrix import Pwm, pfms_to_pwms
from helixframe.functions.sequence import few_unknown
from helixframe.operators import cutoffs as C
from helixframe.operators import enrich as E
from helixframe.operators import locate as L
from helixframe.operators import profile as P
from helixframe.operators import sampling as R
from helixframe.operators import sites as S
from helixframe.operators.scan import prefix_scores, scan
from helixframe.sources import genome as G
from helixframe.sources.archives import concatenate
from helixframe.sources.motifs import read_pfms, read_pwms, write_pwms
from helixframe.sources.regions import file_lines, read_regions


class Genome:
    """An installed genome: a folder with Parquet tables of sequence chunks, chromosome sizes and genes, and frequencies."""

    def __init__(self, spark: SparkSession, name: str, catalog: Catalog):
        self.name, self.path, self.spark = name, catalog.genomes[name], spark
        for part in ("chunks", "sizes"):
            if not os.path.isdir(os.path.join(self.path, part)):
                raise MissingGenomeFileError(name, part)
        try:
            with open(os.path.join(self.path, "background.txt")) as f:
                self.background = G.parse_background(f.read())
        except FileNotFoundError:
            raise MissingGenomeFileError(name, "background") from None

    def table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, part))

    @property
    def genes(self) -> DataFrame | None:
        return self.table("genes") if os.path.isdir(os.path.join(self.path, "genes")) else None


def _claim(section, name: str, path: str | None) -> str:
    """The folder of a new entry; taken names and folders with files are refused."""
    path = path or os.path.join(section.root, name)
    if name in section:
        raise ValueError(f"{name!r} is installed already")
    if os.path.isdir(path) and os.listdir(path):
        raise ValueError(f"{path!r} is not empty")
    os.makedirs(path, exist_ok=True)
    return path


def install_genome(spark: SparkSession, catalog: Catalog, name: str, fasta: Sequence[str], genes: str | None = None, path: str | None = None) -> str:
    path = _claim(catalog.genomes, name, path)
    G.read_fasta(spark, *fasta).write.parquet(os.path.join(path, "chunks"))
    chunks = spark.read.parquet(os.path.join(path, "chunks"))
    G.chrom_sizes(chunks).write.parquet(os.path.join(path, "sizes"))
    shares = G.background(chunks).first()
    if shares["a"] is None:
        raise ValueError("the sequences hold no known base")
    with open(os.path.join(path, "background.txt"), "w") as f:
        f.write(G.background_text({b: shares[b.lower()] for b in "ACGT"}))
    if genes:
        G.parse_genes(file_lines(spark, genes)).write.parquet(os.path.join(path, "genes"))
    catalog.genomes[name] = path
    catalog.save()
    return path


def uninstall(catalog: Catalog, section, name: str) -> None:
    shutil.rmtree(section[name], ignore_errors=True)
    del section[name]
    catalog.save()


def _pfms_path(catalog: Catalog, name: str) -> str:
    return os.path.join(catalog.motifs[name], "pfms.jaspar")


def _pwms_path(catalog: Catalog, name: str, genome: str) -> str:
    return os.path.join(catalog.motifs[name], f"pwms_{genome}.txt")


def install_motifs(catalog: Catalog, name: str, files: Sequence[str], path: str | None = None) -> str:
    path = _claim(catalog.motifs, name, path)
    catalog.motifs[name] = path
    concatenate(files, _pfms_path(catalog, name))
    read_pfms(_pfms_path(catalog, name))
    catalog.save()
    return path


def random_sequences(genome: Genome, n: int, length: int, most_unknown: int = 0, seed: int = 0) -> DataFrame:
    """(draw_id, seq) of the first n draws whose windows have few unknown bases.

    Draws go on in rounds, sized by the share accepted so far, until there are n; a round that accepts none raises. The rows
    are those up to the n-th accepted number, so that no task has to gather them.
    """
    found, first, count, more = None, 0, 0, n + n // 16 + 100
    while count < n:
        drawn = R.random_windows(genome.table("sizes"), more, length, seed, first=first)
        accepted = G.fetch(drawn, genome.table("chunks")).filter(few_unknown(F.col("seq"), most_unknown)).select("draw_id", "seq")
        got = accepted.count()
        if not got:
            raise ValueError(f"none of {more} random windows of genome {genome.name!r} has {most_unknown} unknown bases or fewer")
        found = accepted if found is None else found.unionByName(accepted)
        first, count = first + more, count + got
        more = (n - count) * first // count + (n - count) // 8 + 100
    return found.filter(F.col("draw_id") <= R.nth_smallest(found.select("draw_id"), n))


def build_motifs(spark: SparkSession, catalog: Catalog, name: str, genome_name: str, n: int = 1_000_000, repeats: int = 1, most_unknown: int = 0, seed: int | None = None) -> list[Pwm]:
    """Weights from counts, and cutoffs from the scores of random sequences, averaged over repeats."""
    genome = Genome(spark, genome_name, catalog)
    if not os.path.isfile(_pfms_path(catalog, name)):
        raise MissingPfmsError(name)
    pfms = read_pfms(_pfms_path(catalog, name))
    pwms = pfms_to_pwms(spark, pfms, genome.background)
    length = max(m.length for m in pwms)
    parts = []
    for r in range(repeats):
        seqs = random_sequences(genome, n, length, most_unknown, (seed or 0) + r)
        scores = prefix_scores(seqs.select(F.col("draw_id").alias("region_id"), "seq"), pwms)
        parts.append(C.score_cutoffs(scores).drop("raw"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    for row in C.averaged(every).orderBy("motif_idx", "p").toLocalIterator():
        pwms[row["motif_idx"]].cutoffs[row["p"]] = row["score"]
    write_pwms(_pwms_path(catalog, name, genome_name), pwms)
    return pwms


def built_motifs(catalog: Catalog, name: str, genome: str) -> list[Pwm]:
    path = _pwms_path(catalog, name, genome)
    if not os.path.isfile(path):
        raise MissingPwmsError(name, genome)
    return read_pwms(path)


def scan_regions(
    spark: SparkSession, catalog: Catalog, regions_path: str, motif_set: str, genome_name: str, out: str, *, region_format: str = "bed", p_value: str = "1e-4", location: str | None = None, upstream: int = 4000,
    downstream: int = 2000, width: int = 1000, strand: str = "both", enrich: bool = True, n_random: int = 5, seed: int | None = None, control_path: str | None = None, control_format: str = "bed", beds: bool = False, bed_files: bool = True, profiles: bool = False,
) -> dict[str, DataFrame]:
    """The scan command: site tables, and unless told otherwise the enrichment against control regions.

    Sites go to one BED file a motif, or, with bed_files=False, to folders that the executors write.
    """
    genome = Genome(spark, genome_name, catalog)
    pwms = built_motifs(catalog, motif_set, genome_name)
    sizes, chunks, genes = genome.table("sizes"), genome.table("chunks"), genome.genes
    os.makedirs(out, exist_ok=True)

    def located(regions: DataFrame) -> DataFrame:
        if location is None:
            return regions
        if genes is None:
            raise MissingGenomeFileError(genome_name, "genes")
        return L.by_location(regions, genes, location, upstream, downstream)

    def sites_of(regions: DataFrame) -> DataFrame:
        fetched = G.fetch(L.windows(regions, sizes, width).select("region_id", "chrom", "w_start", "w_end"), chunks)
        return scan(fetched, pwms, p_value, strand, dedup=True)

    regions = located(read_regions(spark, regions_path, region_format))
    # Sites feed several outputs; a written table keeps them through lost executors.
    sites_of(regions).write.mode("overwrite").parquet(os.path.join(out, "_sites"))
    sites = spark.read.parquet(os.path.join(out, "_sites"))
    sinks.site_tables(out, regions, sites, pwms)
    if beds:
        (sinks.site_bed_files if bed_files else sinks.site_beds)(out, regions, sites, pwms)
    result = {"regions": regions, "sites": sites}
    if enrich:
        if control_path:
            control = located(read_regions(spark, control_path, control_format))
        else:
            placed = R.gene_controls(regions, sizes, genes, n_random, seed or 0) if location and genes is not None else R.uniform_controls(regions, sizes, n_random, seed or 0)
            control = placed.select(F.col("control_id").alias("region_id"), "chrom", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("summit"), F.lit(None).cast("double").alias("score"))
        sites_of(control).write.mode("overwrite").parquet(os.path.join(out, "_control_sites"))
        control_sites = spark.read.parquet(os.path.join(out, "_control_sites"))
        ranked = E.ranked(E.enrichment(E.contingency(regions, sites, control, control_sites, len(pwms)), pwms))
        sinks.enrichment_table(out, ranked)
        result |= {"control": control, "control_sites": control_sites, "enrichment": ranked}
    if profiles:
        span = width if width > 0 else None
        if span is None and P.have_same_length(regions):
            span = regions.agg(F.max(F.col("end") - F.col("start"))).first()[0]
        if span:
            result["distances"] = P.smoothed_histogram(P.distance_histogram(regions, sites, pwms, span))
            result["distances"].write.mode("overwrite").parquet(os.path.join(out, "profiles", "distances"))
        if enrich and P.have_scores(regions) and (n_regions := regions.count()) >= 100:
            hits, n = S.grid(regions, sites, len(pwms)), result["control"].count()
            control_hits = {r[0]: r[1] for r in result["control_sites"].select("motif_idx", "region_id").distinct().groupBy("motif_idx").count().collect()}
            curve = P.ranked_fold_change(regions, hits, 1.0)
            shares = F.array(*[F.lit((control_hits.get(i, 0) / n) or 1.0) for i in range(len(pwms))])
            scaled = curve.withColumn("fold_change", F.col("fold_change") / F.get(shares, F.col("motif_idx")))
            result["curve"] = P.smoothed_curve(scaled, size=n_regions)
            result["curve"].write.mode("overwrite").parquet(os.path.join(out, "profiles", "curve"))
    return result
