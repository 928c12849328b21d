"""Registered queries over text formats, wide score tables, single scores and curves, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import matrix as M
from helixframe.functions.register import score_column
from helixframe.operators import enrich as E
from helixframe.operators import profile as P
from helixframe.operators import sites as S
from helixframe.plans import adapters as A
from helixframe.plans import queries as Q
from helixframe.plans.queries import query, rounded, values_sql
from helixframe.sources import genome as G
from helixframe.sources import motifs as MF
from helixframe.sources import regions as RG

# ---------------------------------------------------------------- region formats, with headers and bad lines

#: Events are the data lines of 40 files; one line in 97 has a start that is no number.
_FILES, _BAD, _LATE = 40, 97, 10_000_000
_START, _END = "user_id % 1000", "user_id % 1000 + 10 + event_id % 90"
#: By format: the headers of a file, the offset of the start, the fields from the fourth on, and summit and score in SQL.
_FORMATS = {
    "bed": (["#one", "track name=x", "browser position"], 0, ["'n'", "value", "'+'"], "NULL", "value"),
    "bed3-summit": (["# one", "#two"], 0, [f"{_START} + 5"], "s + 5", "NULL"),
    "macs": (["# made by", "chr\tstart\tend"], 1, ["10", "7", "3", "value", "'2.0'", "'1.0'"], "s + 7", "value"),
    "macs2": (["# made by", "chr\tstart\tend"], 1, ["10", f"{_START} + 6", "'7.5'", "value", "'2.0'", "'1.0'", "'p'"], "s + 5", "value"),
    "narrowpeak": (["track type=narrowPeak", "#x"], 0, ["'n'", "value", "'.'", "'1.5'", "2", "3", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 10 END"], "CASE WHEN event_id % 3 = 0 THEN NULL ELSE s + event_id % 10 END", "value"),
    "broadpeak": (["browser hide all"], 0, ["'n'", "value", "'.'", "'1.5'", "2", "3"], "NULL", "value"),
    "manorm": (["chr\tstart\tend\tsummit"], 1, [f"{_START} + 4", "value", "1", "2"], "s + 3", "value"),
}


def region_lines(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """(file, line_no, line): headers, data lines, a header and a blank line too late."""
    headers, shift, rest, _, _ = _FORMATS[name]
    events = A.table(spark, sf, "events")
    start = f"CASE WHEN event_id % {_BAD} = 0 THEN 'x' ELSE CAST({_START} + {shift} AS string) END"
    fields = [F.expr(e) for e in ("concat('chr', user_id % 23)", start, _END, *rest)]
    data = events.select((F.col("event_id") % _FILES).alias("f"), (F.col("event_id") + 100).alias("line_no"), F.concat_ws("\t", *fields).alias("line"))
    extra = [(i + 1, line) for i, line in enumerate([*headers, "  "])] + [(_LATE, headers[0]), (_LATE + 1, "")]
    around = spark.range(_FILES).crossJoin(F.broadcast(spark.createDataFrame(extra, "line_no long, line string")))
    both = data.unionByName(around.select(F.col("id").alias("f"), "line_no", "line"))
    return both.select(F.concat(F.lit("f"), "f").alias("file"), "line_no", "line")


def _format_sql(name: str) -> str:
    headers, _, _, summit, score = _FORMATS[name]
    late = headers[0].split("\t")[0]
    return f"""WITH d AS (SELECT event_id, value, user_id, user_id % 1000 AS s, event_id % {_BAD} = 0 AS bad FROM events)
SELECT 'f' || (event_id % {_FILES}) AS file, event_id + 100 AS line_no, 'chr' || (user_id % 23) AS chrom, CASE WHEN NOT bad THEN s END AS start, s + 10 + event_id % 90 AS "end",
  {'CASE WHEN NOT bad THEN ' + summit + ' END' if name in ('macs', 'narrowpeak') else summit} AS summit, round({score}, 6) AS score, bad FROM d
UNION ALL SELECT 'f' || range, {_LATE}, '{late}', NULL, NULL, NULL, NULL, true FROM range(0, {_FILES})"""


def _parsed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return RG.parse_region_lines(region_lines(spark, sf, name), name)


def _register_formats() -> None:
    for name in _FORMATS:

        def parse(spark, sf, name=name):
            return rounded(_parsed(spark, sf, name).drop("line"), "score")

        parse.__name__ = f"parse_{name.replace('-', '_')}_file"
        query(_format_sql(name))(parse)


_register_formats()


@query(f"SELECT 'f' || (event_id % {_FILES}) AS file, min(event_id) + 100 AS line_no FROM events WHERE event_id % {_BAD} = 0 GROUP BY 1 UNION ALL SELECT 'f' || range, {_LATE} FROM range(0, {_FILES}) WHERE range NOT IN (SELECT event_id % {_FILES} FROM events WHERE event_id % {_BAD} = 0)")
def first_bad_line(spark, sf):
    """The line of each file that reading it reports."""
    return _parsed(spark, sf, "narrowpeak").filter("bad").groupBy("file").agg(F.min("line_no").alias("line_no"))


@query("WITH " + values_sql("f", "name", [(n,) for n in _FORMATS]) + " SELECT name FROM f")
def region_formats(spark, sf):
    return spark.createDataFrame([(n,) for n in RG.FORMATS], "name string")


# ---------------------------------------------------------------- genes and backgrounds


def gene_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = A.table(spark, sf, "part")
    strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    fields = ["p_size", F.concat(F.lit("NM_"), "p_partkey"), F.concat(F.lit("chr"), F.col("p_partkey") % 19), strand, F.col("p_partkey") * 7, F.col("p_partkey") * 7 + 900, F.lit("0"), F.lit("1")]
    return part.select(F.col("p_partkey").alias("line_no"), F.concat_ws("\t", *fields).alias("line"))


_GENE_SQL = """SELECT p_partkey AS ord, 'chr' || (p_partkey % 19) AS chrom, p_partkey * 7 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 900 END AS tss, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, 'NM_' || p_partkey AS name FROM part"""


@query(_GENE_SQL)
def parse_gene_file(spark, sf):
    return G.parse_genes(gene_lines(spark, sf))


@query(f"SELECT chrom, count(*) AS n_genes FROM ({_GENE_SQL}) GROUP BY chrom")
def gene_counts(spark, sf):
    return G.gene_counts(G.parse_genes(gene_lines(spark, sf)))


@query(f"SELECT * FROM ({_GENE_SQL}) WHERE chrom = 'chr7'")
def genes_of_chromosome(spark, sf):
    return G.genes_on(G.parse_genes(gene_lines(spark, sf)), "chr7")


_SHARES = [("A", 0.29123), ("C", 0.20877), ("G", 0.2081), ("T", 0.2919)]


@query("WITH " + values_sql("b", "base, share", _SHARES) + " SELECT base, CAST(share AS DOUBLE) AS share FROM b")
def background_file(spark, sf):
    """Shares written as a background file and read back."""
    return spark.createDataFrame(list(G.parse_background(G.background_text(dict(_SHARES))).items()), "base string, share double")


# ---------------------------------------------------------------- motif files and single scores

_JASPAR = "".join(f">{m.matrix_id} {m.name}\n" + "".join(f"{b}  [ {' '.join(map(str, r))} ]\n" for b, r in zip("ACGT", m.values)) for m in A.PFMS)


@query(f"WITH {Q.PFM_SQL} SELECT motif_idx, pos, base, CAST(n AS DOUBLE) AS value FROM pfm")
def parse_pfm_file(spark, sf):
    got = M.long_form(spark, MF.parse_pfms(_JASPAR))
    return got.select("motif_idx", "pos", "base", F.col("value").cast("double").alias("value"))


def _with_cutoffs() -> list:
    return [M.Pwm(m.values, m.matrix_id, m.name, {"1e-2": c, "1e-3": c + 0.01}) for m, c in zip(A.PWMS, A.CUTOFFS)]


@query(f"WITH {Q.PWM_SQL} SELECT motif_idx, pos, base, value FROM pwm")
def pwm_file_weights(spark, sf):
    """Weights written as a motif file and read back."""
    return M.long_form(spark, MF.parse_pwms(MF.pwm_text(_with_cutoffs())))


@query("WITH " + values_sql("c", "motif_idx, p, score", [(i, p, c + d) for i, c in enumerate(A.CUTOFFS) for p, d in (("1e-2", 0), ("1e-3", 0.01))]) + " SELECT motif_idx, p, round(CAST(score AS DOUBLE), 6) AS score FROM c")
def pwm_file_cutoffs(spark, sf):
    rows = [(i, p, m.cutoff(p)) for i, m in enumerate(MF.parse_pwms(MF.pwm_text(_with_cutoffs()))) for p in m.cutoffs]
    return rounded(spark.createDataFrame(rows, "motif_idx int, p string, score double"), "score")


def _score_sql(i: int) -> str:
    m = A.PWMS[i]
    terms = " + ".join("CASE substr(seq, {}, 1) WHEN 'A' THEN {} WHEN 'C' THEN {} WHEN 'G' THEN {} WHEN 'T' THEN {} ELSE 0 END".format(k, *c) for k, c in enumerate(zip(*m.scaled()), 1))
    best = sum(max(c) for c in zip(*m.scaled()))
    return f"SELECT region_id, {i} AS motif_idx, CASE WHEN length(seq) >= {m.length} THEN round(CAST({terms} AS DOUBLE) / {best}, 6) END AS score FROM seqs"


@query(f"{Q.WITH_SEQS} " + " UNION ALL ".join(map(_score_sql, range(len(A.PWMS)))))
def motif_score(spark, sf):
    """Score of the motif at the very start of every sequence."""
    seqs = A.seqs(spark, sf)
    parts = [seqs.select("region_id", F.lit(i).alias("motif_idx"), score_column(F.substring("seq", 1, m.length), m).alias("score")) for i, m in enumerate(A.PWMS)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "score")


# ---------------------------------------------------------------- wide scores, curves, unknown fold changes

_BEST = ", ".join(f"coalesce(CAST(round(max(CASE WHEN motif_idx = {i} THEN max_score END), 6) AS VARCHAR), 'NA') = 'NA' AS na{i}, round(max(CASE WHEN motif_idx = {i} THEN max_score END), 6) AS m{i}" for i in range(Q.N))


@query(f'{Q.WITH_RSITES}, {Q.dedup_sql()}, {Q.GRID_SQL} SELECT g.region_id, r.chrom AS chr, r.start + 1 AS start, r."end", {_BEST} FROM grid g JOIN g_regions r USING (region_id) GROUP BY g.region_id, r.chrom, r.start, r."end"')
def sites_score_pivot(spark, sf):
    got = S.wide(A.g_regions(spark, sf), Q._region_sites(spark, sf), A.PWMS, "score")
    known = [(F.col(f"m{i}") == "NA").alias(f"na{i}") for i in range(Q.N)]
    return got.select("region_id", "chr", "start", "end", *known, *[F.round(F.col(f"m{i}").try_cast("double"), 6).alias(f"m{i}") for i in range(Q.N)])


_PLACES = Q._CURVE.replace("@F", Q._REACH).replace("@G", f"({Q._REACH} - 1)") + ", sm AS (" + Q._smooth_sql("curve", "place", "fold_change", "(SELECT count(*) FROM orders)") + ")"


@query(f"{_PLACES} SELECT motif_idx, place, round(smooth, 6) AS smooth FROM sm")
def curve_smoothed(spark, sf):
    regions = A.g_regions(spark, sf)
    curve = P.ranked_fold_change(regions, S.grid(regions, Q._region_sites(spark, sf), Q.N), 0.5)
    return rounded(P.smoothed_curve(curve), "smooth")


@query(f"{Q.WITH_SITES} SELECT m.motif_idx, (SELECT count(DISTINCT region_id) FROM sites s WHERE s.motif_idx = m.motif_idx) AS n_input, 0 AS n_control, true AS unknown FROM (SELECT unnest(range(0, {Q.N})) AS motif_idx) m")
def enrichment_without_control(spark, sf):
    """No control region has a site: the fold change can't be told."""
    docs, sites = A.seqs(spark, sf), Q._doc_sites(spark, sf)
    counts = E.contingency(docs, sites, docs.limit(0), sites.limit(0), Q.N)
    return counts.select("motif_idx", "n_input", "n_control", F.isnan(E.fold_change()).alias("unknown"))


# ---------------------------------------------------------------- windows over chunk borders

#: Regions over the whole length of their documents, in windows that straddle chunks of 512 bases.
_WIDE, _SMALL = 700, 512
_SPREAD = f"""spread AS (SELECT o_orderkey AS region_id, chrom, (o_custkey * 7919) % size AS s, size, seq AS whole FROM orders JOIN seqs ON 'doc' || (o_orderkey % {A.HOME}) = chrom WHERE size > 0)"""


@query(f"{Q.WITH_SEQS}, {_SPREAD} SELECT region_id, chrom, greatest(s - {_WIDE // 2}, 0) AS w_start, least(s + {_WIDE // 2}, size) AS w_end, md5(substr(whole, CAST(greatest(s - {_WIDE // 2}, 0) AS INT) + 1, CAST(least(s + {_WIDE // 2}, size) - greatest(s - {_WIDE // 2}, 0) AS INT))) AS seq_md5 FROM spread")
def fetch_over_chunks(spark, sf):
    sizes = A.sizes(spark, sf).filter("size > 0")
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("region_id"), A._home(spark, sf, "o_orderkey").alias("chrom"), (F.col("o_custkey") * 7919).alias("far"))
    at = F.col("far") % F.col("size")
    regions = orders.join(sizes, "chrom").select("region_id", "chrom", at.alias("start"), (at + 1).alias("end"), at.alias("summit"))
    got = G.fetch(A.windows(regions, sizes, _WIDE).select("region_id", "chrom", "w_start", "w_end"), A.chunks(spark, sf, _SMALL), _SMALL)
    return got.select("region_id", "chrom", "w_start", "w_end", F.md5("seq").alias("seq_md5"))
