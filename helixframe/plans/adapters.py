"""The driver tables as sequences, regions, genes and motifs.

Documents are chromosomes: letters map to A, C, G, T in turn, everything else is N. Orders are regions, parts are genes;
both go to documents by their key modulo the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pfm, weights
from helixframe.operators.locate import windows
from helixframe.sources.genome import fetch
from helixframe.sources.regions import with_summit

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "ACGT" * 6 + "AC"
CHUNK = 4096
WINDOW = 60

PFMS = [
    Pfm([[12, 0, 1, 20], [3, 18, 0, 1], [4, 2, 19, 0], [2, 1, 1, 0]], "HX0001.1", "quad"),
    Pfm([[0, 14, 2, 0, 9, 1], [15, 1, 0, 12, 3, 0], [1, 1, 13, 2, 2, 0], [0, 0, 1, 2, 2, 15]], "HX0002.1", "hexa"),
    Pfm([[3, 3, 20, 0, 1, 17, 0, 5], [10, 1, 0, 19, 2, 1, 2, 5], [4, 15, 0, 0, 16, 1, 1, 5], [3, 1, 0, 1, 1, 1, 17, 5]], "HX0003.2", "octa::x"),
]
PWMS = [weights(m) for m in PFMS]
#: Cutoffs that make hits of about one position in a hundred or fewer.
CUTOFFS = [0.95, 0.85, 0.75]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bases(text: Column) -> Column:
    both = LETTERS + LETTERS.upper()
    return F.regexp_replace(F.translate(text, both, AS_BASES + AS_BASES), "[^ACGT]", "N")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, chrom, w_start, seq, size, lang, source): whole documents."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("region_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("chrom"), F.lit(0).cast("long").alias("w_start"), as_bases(text).alias("seq"), F.length(text).cast("long").alias("size"), "lang", "source"
    )


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("chrom", "size")


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """Whole documents cut in chunks (chrom, chunk_id, chunk_start, seq)."""
    last = F.greatest(F.floor((F.col("size") - 1) / size), F.lit(0)).cast("int")
    cut = seqs(spark, sf_dir).select("chrom", "seq", F.explode(F.sequence(F.lit(0), last)).alias("chunk_id"))
    start = F.col("chunk_id") * size
    return cut.select("chrom", "chunk_id", start.cast("long").alias("chunk_start"), F.substring("seq", start + 1, F.lit(size)).alias("seq"))


def _home(spark: SparkSession, sf_dir: str, key: str) -> Column:
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()
    return F.concat(F.lit("doc"), F.pmod(F.col(key), n))


def g_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as regions, summits in the middle."""
    start = F.pmod(F.col("o_custkey"), F.lit(200))
    end = start + 50 + F.pmod(F.col("o_custkey"), F.lit(51))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("region_id"), _home(spark, sf_dir, "o_orderkey").alias("chrom"), start.alias("start"), end.alias("end"), F.lit(None).cast("long").alias("summit"), F.col("o_totalprice").alias("score")
    )
    return with_summit(rows)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes in key order."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), _home(spark, sf_dir, "p_partkey").alias("chrom"), F.pmod(F.col("p_partkey") * 37, F.lit(2000)).alias("tss"), F.when(F.pmod(F.col("p_size"), F.lit(2)) == 0, "+").otherwise("-").alias("strand"), F.col("p_name").alias("name")
    )


def region_windows(spark: SparkSession, sf_dir: str, width: int = WINDOW) -> DataFrame:
    return windows(g_regions(spark, sf_dir), sizes(spark, sf_dir), width)


def region_seqs(spark: SparkSession, sf_dir: str, width: int = WINDOW) -> DataFrame:
    """Regions with the bases of their windows."""
    return fetch(region_windows(spark, sf_dir, width).select("region_id", "chrom", "w_start", "w_end"), chunks(spark, sf_dir), CHUNK)


# ---------------------------------------------------------------- the same views in SQL

_BOTH = LETTERS + LETTERS.upper()
SEQS = f"""seqs AS (SELECT doc_id AS region_id, 'doc' || doc_id AS chrom, CAST(0 AS BIGINT) AS w_start,
  regexp_replace(translate(coalesce(text, ''), '{_BOTH}', '{AS_BASES + AS_BASES}'), '[^ACGT]', 'N', 'g') AS seq,
  length(coalesce(text, '')) AS size, lang, source FROM documents)"""
HOME = "(SELECT max(doc_id) + 1 FROM documents)"
REGIONS = f"""g_regions AS (SELECT *, (start + "end") // 2 AS summit FROM (SELECT o_orderkey AS region_id, 'doc' || (o_orderkey % {HOME}) AS chrom,
  o_custkey % 200 AS start, o_custkey % 200 + 50 + o_custkey % 51 AS "end", o_totalprice AS score FROM orders))"""
GENES = f"""genes AS (SELECT p_partkey AS ord, 'doc' || (p_partkey % {HOME}) AS chrom, (p_partkey * 37) % 2000 AS tss,
  CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS name FROM part)"""
WINDOWS = f"""wins AS (SELECT r.*, s.size, s.seq AS whole, greatest(r.summit - {WINDOW // 2}, 0) AS w_start, least(r.summit + {WINDOW // 2}, s.size) AS w_end
  FROM g_regions r JOIN seqs s ON r.chrom = s.chrom)"""
REGION_SEQS = "rseqs AS (SELECT region_id, chrom, w_start, w_end, substr(whole, CAST(w_start AS INT) + 1, CAST(greatest(w_end - w_start, 0) AS INT)) AS seq FROM wins)"


def sites_sql(source: str, cutoffs: list[float] = CUTOFFS, strands: str = "+-", keep_all: bool = False) -> str:
    """CTEs letters, leads, sites over a CTE (region_id, w_start, seq)."""
    widest = max(m.length for m in PWMS)
    leads = ", ".join(f"lead(b, {k}) OVER w AS b{k}" for k in range(1, widest))
    parts = []
    for i, (m, cutoff) in enumerate(zip(PWMS, cutoffs)):
        for sign in strands:
            rows = m.scaled() if sign == "+" else m.reverse()
            terms = " + ".join("CASE b{} WHEN 'A' THEN {} WHEN 'C' THEN {} WHEN 'G' THEN {} WHEN 'T' THEN {} ELSE 0 END".format(c, *column) for c, column in enumerate(zip(*rows)))
            where = f"n - p >= {m.length}"
            score = f"CAST(raw AS DOUBLE) / CAST({m.max_scan} AS DOUBLE)"
            inner = f"SELECT region_id, w_start + p AS start, p, CAST({terms} AS BIGINT) AS raw FROM leads WHERE {where}"
            hit = "p = 0" if keep_all else f"{score} - {cutoff} >= -1e-10"
            parts.append(f"SELECT {i} AS motif_idx, region_id, start, raw, {score} AS score, '{sign}' AS strand FROM ({inner}) WHERE {hit}")
    return f"""letters AS (SELECT region_id, w_start, length(seq) AS n, unnest(string_split(seq, '')) AS b, unnest(range(0, length(seq))) AS p FROM {source} WHERE seq <> ''),
leads AS (SELECT region_id, w_start, n, p, b AS b0, {leads} FROM letters WINDOW w AS (PARTITION BY region_id ORDER BY p)),
sites AS ({' UNION ALL '.join(parts)})"""
