"""Genomes: FASTA to chunked sequence tables, gene annotation, background frequencies, sequence fetch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.errors import BackgroundFormatError
from helixframe.functions.sequence import base_count
from helixframe.schemas import BASES, CHROM_SEQ, GENE

CHUNK = 100_000
#: Genomes of up to so many sequences have their names broadcast.
BROADCAST_CHROMS = 200_000
#: Parts of chromosome names that mark sex, mitochondrial, unplaced and alternative sequences.
NOT_AUTOSOMES = ("chrX", "chrY", "chrM", "chrUn_", "_random", "_hap", "_alt")


def fasta_chunks(lines: Iterator[str], size: int = CHUNK) -> Iterator[tuple[str, int, int, str]]:
    """(chrom, chunk_id, chunk_start, seq) of FASTA lines; only one chunk is held at a time."""
    chrom, held, length, chunk = None, [], 0, 0
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if chrom is not None and (length or not chunk):
                yield chrom, chunk, chunk * size, "".join(held)
            words = line[1:].split()
            chrom, held, length, chunk = words[0] if words else "", [], 0, 0
        elif line and chrom is not None:
            held.append(line)
            length += len(line)
            while length >= size:
                whole = "".join(held)
                yield chrom, chunk, chunk * size, whole[:size]
                chunk += 1
                held, length = [whole[size:]], length - size
    if chrom is not None and (length or not chunk):
        yield chrom, chunk, chunk * size, "".join(held)


def read_fasta(spark: SparkSession, *paths: str, size: int = CHUNK) -> DataFrame:
    """Chunked sequences of FASTA files of any size; written once as Parquet.

    Files are read as records between headers (a line's end and ">"), which Spark deals out by blocks of the files: tasks
    get whole sequences, and a sequence, not a file, must fit in memory. Text before the first header is no sequence.
    """
    records = spark.read.option("lineSep", "\n>").text(list(paths)).select("value")

    def run(batches):
        import io

        for batch in batches:
            for record in batch.column(0):
                text = record.as_py()
                # Only a file's first record still has its ">"; a record without a header is blank or comment.
                text = text.lstrip() if text.lstrip().startswith(">") else ">" + text
                for row in fasta_chunks(io.StringIO(text, newline=None), size):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["chrom", "chunk_id", "chunk_start", "seq"])

    return records.mapInArrow(run, CHROM_SEQ)


def chrom_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).cast("long").alias("size"))


def is_autosome(chrom: Column) -> Column:
    return ~chrom.rlike("|".join(map(re.escape, NOT_AUTOSOMES)))


def base_counts(seqs: DataFrame, autosomes_only: bool = True) -> DataFrame:
    """One row (a, c, g, t): counts over all sequences (chrom, seq); added up before the shuffle."""
    kept = seqs.filter(is_autosome(F.col("chrom"))) if autosomes_only else seqs
    return kept.agg(*[F.coalesce(F.sum(base_count(F.col("seq"), b)), F.lit(0)).cast("long").alias(b.lower()) for b in BASES])


def background(seqs: DataFrame, autosomes_only: bool = True) -> DataFrame:
    """One row (a, c, g, t): shares at 5 decimals of all known bases; null where there is none."""
    counts = base_counts(seqs, autosomes_only)
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return counts.select(*[F.when(total > 0, F.bround(F.col(b) / total, 5)).alias(b) for b in "acgt"])


def parse_background(text: str) -> dict[str, float]:
    """Four lines `base<TAB>share` in the order A, C, G, T."""
    found: dict[str, float] = {}
    lines = text.splitlines()
    for n, base in enumerate(BASES):
        line = lines[n] if n < len(lines) else ""
        fields = line.strip().split("\t")
        try:
            if len(fields) != 2 or fields[0] != base:
                raise ValueError
            found[base] = float(fields[1])
        except ValueError:
            raise BackgroundFormatError(n + 1, line) from None
    if any(line.strip() for line in lines[4:]):
        raise BackgroundFormatError(5, lines[4])
    return found


def background_text(shares: dict[str, float]) -> str:
    return "".join(f"{b}\t{shares[b]}\n" for b in BASES)


def parse_genes(lines: DataFrame) -> DataFrame:
    """Typed genes of annotation lines (line_no, line): the start site by strand; file order stays in `ord`."""
    f = lines.filter("trim(line) != ''").select("line_no", F.split(F.trim("line"), r"\s+").alias("f"))
    strand = F.get("f", F.lit(3))
    tss = F.when(strand == "+", F.get("f", F.lit(4))).when(strand == "-", F.get("f", F.lit(5)))
    tss = tss.otherwise(F.raise_error(F.concat(F.lit("strand must be + or - at line "), F.col("line_no").cast("string"))))
    return f.select(
        F.col("line_no").cast("long").alias("ord"), F.get("f", F.lit(2)).alias("chrom"), tss.cast("long").alias("tss"), strand.alias("strand"), F.get("f", F.lit(1)).alias("name")
    ).select(*[c.split(" ")[0] for c in GENE.split(", ")])


def genes_on(genes: DataFrame, chrom: str) -> DataFrame:
    """The genes of a chromosome in file order."""
    return genes.filter(F.col("chrom") == chrom).orderBy("ord")


def gene_counts(genes: DataFrame) -> DataFrame:
    """(chrom, n_genes)."""
    return genes.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_genes"))


def promoters(genes: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Add p_start, p_end around each start site, not clamped."""
    plus = F.col("strand") == "+"
    before = F.when(plus, F.lit(upstream)).otherwise(F.lit(downstream))
    after = F.when(plus, F.lit(downstream)).otherwise(F.lit(upstream))
    return genes.withColumn("p_start", F.col("tss") - before).withColumn("p_end", F.col("tss") + after)


def fetch(windows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add `seq`: the bases [w_start, w_end) of each row's chromosome, cut where the chromosome ends.

    Windows meet the chunks they touch by (chrom, chunk_id), so a chromosome is never in one task. Most windows lie in one
    chunk and are done by the join; only the few that straddle chunks are grouped to join their pieces in order. An unknown
    chromosome raises.
    """
    columns = windows.columns
    first = F.floor(F.col("w_start") / size).cast("int")
    last = F.floor((F.greatest(F.col("w_end"), F.col("w_start") + 1) - 1) / size).cast("int")
    parts = chunks.select(F.col("chrom").alias("_chrom"), F.col("chunk_id").alias("_id"), "chunk_start", F.col("seq").alias("_seq"))
    a = F.greatest(F.col("w_start") - F.col("chunk_start"), F.lit(0))
    b = F.least(F.col("w_end") - F.col("chunk_start"), F.lit(size))
    piece = F.substring("_seq", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    same = (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_id"))
    # Every chromosome has a chunk 0: one row each tells the unknown ones, also where a window lies past the end.
    names = chunks.filter("chunk_id = 0").select(F.col("chrom").alias("_known"))
    listed = F.broadcast(names) if names.limit(BROADCAST_CHROMS + 1).count() <= BROADCAST_CHROMS else names
    unknown = F.raise_error(F.concat(F.lit("no sequence for chromosome "), F.coalesce(F.col("chrom"), F.lit("null")))).cast("boolean")
    windows = windows.join(listed, F.col("chrom") == F.col("_known"), "left").filter(F.col("_known").isNotNull() | unknown).select(*columns)

    one = windows.filter(first == last).withColumn("_at", first).join(parts, same, "left")
    one = one.select(*columns, F.when(F.col("_id").isNotNull(), piece).alias("seq"))
    many = windows.filter(first < last).withColumn("_at", F.explode(F.sequence(first, last))).join(parts, same, "left")
    many = many.groupBy(*columns).agg(F.sort_array(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_id", piece.alias("s"))))).alias("p"))
    many = many.select(*columns, F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))
    return one.unionByName(many).withColumn("seq", F.coalesce("seq", F.lit("")))
