"""The registered queries over the driver tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import matrix as M
from helixframe.functions.sequence import base_count, file_name, few_unknown
from helixframe.operators import cutoffs as C
from helixframe.operators import enrich as E
from helixframe.operators import locate as L
from helixframe.operators import profile as P
from helixframe.operators import sampling as R
from helixframe.operators import sites as S
from helixframe.operators.scan import prefix_scores, scan, scan_native
from helixframe.plans import adapters as A
from helixframe.sources import genome as G
from helixframe.sources import regions as RG
from helixframe.sources.remote import jaspar_sets

FLAGSHIP = "sites_count_grid"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
N = len(A.PWMS)


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives its rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


PFM_ROWS = [(i, p, b, m.values[k][p]) for i, m in enumerate(A.PFMS) for p in range(m.length) for k, b in enumerate("ACGT")]
PFM_SQL = values_sql("pfm", "motif_idx, pos, base, n", PFM_ROWS)
PPM_SQL = PFM_SQL + ", ppm AS (SELECT motif_idx, pos, base, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY motif_idx, pos) AS value FROM pfm)"
NORM_SQL = (
    PPM_SQL
    + f""", raised AS (SELECT motif_idx, pos, base, value + CASE WHEN min(value) OVER (PARTITION BY motif_idx, pos) = 0 THEN CAST({M.PSEUDO} AS DOUBLE) / (1 - 4 * CAST({M.PSEUDO} AS DOUBLE)) ELSE 0 END AS value FROM ppm),
norm AS (SELECT motif_idx, pos, base, value / sum(value) OVER (PARTITION BY motif_idx, pos) AS value FROM raised)"""
)
PWM_SQL = NORM_SQL + ", pwm AS (SELECT motif_idx, pos, base, round(ln(value / 0.25), 5) AS value FROM norm)"
WITH_SEQS = f"WITH {A.SEQS}"
WITH_WINDOWS = f"WITH {A.SEQS}, {A.REGIONS}, {A.WINDOWS}"
WITH_RSEQS = f"{WITH_WINDOWS}, {A.REGION_SEQS}"
WITH_SITES = f"{WITH_SEQS}, {A.sites_sql('seqs')}"
WITH_RSITES = f"{WITH_RSEQS}, {A.sites_sql('rseqs')}"
GRID_SQL = f"""cells AS (SELECT r.region_id, m.motif_idx FROM g_regions r, (SELECT unnest(range(0, {N})) AS motif_idx) m),
grid AS (SELECT c.motif_idx, c.region_id, count(s.start) AS n_sites, max(s.score) AS max_score FROM cells c LEFT JOIN dsites s ON c.motif_idx = s.motif_idx AND c.region_id = s.region_id GROUP BY ALL)"""


def dedup_sql(source: str = "sites", name: str = "dsites") -> str:
    lengths = "[" + ", ".join(str(m.length) for m in A.PWMS) + "]"
    return f"""folded AS (SELECT motif_idx, region_id, strand, list([{{'start': start, 'raw': raw, 'score': score}}] ORDER BY start) AS l FROM {source} GROUP BY ALL),
walked AS (SELECT motif_idx, region_id, strand, list_reduce(l, lambda a, b: CASE WHEN b[1].start - a[-1].start >= {lengths}[motif_idx + 1] THEN list_concat(a, b)
  WHEN a[-1].raw >= b[1].raw THEN a ELSE list_concat(a[:-2], b) END) AS k FROM folded),
{name} AS (SELECT motif_idx, region_id, strand, u.start AS start, u.raw AS raw, u.score AS score FROM (SELECT motif_idx, region_id, strand, unnest(k) AS u FROM walked))"""


def _doc_sites(spark: SparkSession, sf: str, strand: str = "both", dedup: bool = False) -> DataFrame:
    return scan(A.seqs(spark, sf), A.PWMS, cutoffs=A.CUTOFFS, strand=strand, dedup=dedup)


def _region_sites(spark: SparkSession, sf: str, dedup: bool = True) -> DataFrame:
    return scan(A.region_seqs(spark, sf), A.PWMS, cutoffs=A.CUTOFFS, dedup=dedup)


# ---------------------------------------------------------------- genome


@query(f"{WITH_SEQS} SELECT sum(len(seq) - len(replace(seq, 'A', ''))) AS a, sum(len(seq) - len(replace(seq, 'C', ''))) AS c, sum(len(seq) - len(replace(seq, 'G', ''))) AS g, sum(len(seq) - len(replace(seq, 'T', ''))) AS t FROM seqs")
def base_counts(spark, sf):
    return G.base_counts(A.seqs(spark, sf), autosomes_only=False)


_BG = "SELECT round(a / (a + c + g + t), 5) AS a, round(c / (a + c + g + t), 5) AS c, round(g / (a + c + g + t), 5) AS g, round(t / (a + c + g + t), 5) AS t FROM counts"
_COUNTS = "counts AS (SELECT CAST(sum(len(seq) - len(replace(seq, 'A', ''))) AS DOUBLE) AS a, CAST(sum(len(seq) - len(replace(seq, 'C', ''))) AS DOUBLE) AS c, CAST(sum(len(seq) - len(replace(seq, 'G', ''))) AS DOUBLE) AS g, CAST(sum(len(seq) - len(replace(seq, 'T', ''))) AS DOUBLE) AS t FROM {})"


@query(f"{WITH_SEQS}, {_COUNTS.format('seqs')} {_BG}")
def bg_freq(spark, sf):
    return G.background(A.seqs(spark, sf), autosomes_only=False)


_NAMES = "CASE WHEN region_id % 5 = 0 THEN 'chrX' WHEN region_id % 7 = 0 THEN 'chr1_random' WHEN region_id % 11 = 0 THEN 'chrUn_2' ELSE 'chr' || region_id END"


@query(f"{WITH_SEQS}, named AS (SELECT {_NAMES} AS chrom, seq FROM seqs), {_COUNTS.format('''(SELECT * FROM named WHERE NOT regexp_matches(chrom, 'chrX|chrY|chrM|chrUn_|_random|_hap|_alt'))''')} {_BG}")
def bg_freq_filtered(spark, sf):
    return G.background(A.seqs(spark, sf).withColumn("chrom", F.expr(_NAMES)))


@query("SELECT 'doc' || doc_id AS chrom, length(text) AS size FROM documents")
def chrom_sizes(spark, sf):
    return G.chrom_sizes(A.chunks(spark, sf))


@query(f"{WITH_SEQS} SELECT region_id, len(seq) - len(replace(seq, 'N', '')) AS n_unknown FROM seqs WHERE len(seq) - len(replace(seq, 'N', '')) <= 100")
def seq_n_count_filter(spark, sf):
    kept = A.seqs(spark, sf).filter(few_unknown(F.col("seq"), 100))
    return kept.select("region_id", base_count(F.col("seq"), "N").alias("n_unknown"))


# ---------------------------------------------------------------- regions


@query(f'WITH {A.REGIONS} SELECT region_id, chrom, start, "end", summit FROM g_regions')
def region_default_summit(spark, sf):
    return A.g_regions(spark, sf).select("region_id", "chrom", "start", "end", "summit")


@query('SELECT o_orderkey AS region_id, (o_custkey % 200 <= o_custkey % 300) AND (o_custkey % 300 < o_custkey % 200 + 50) AS summit_ok FROM orders')
def region_summit_check(spark, sf):
    orders = A.table(spark, sf, "orders")
    start, summit = F.col("o_custkey") % 200, F.col("o_custkey") % 300
    return RG.summit_inside(orders.select(F.col("o_orderkey").alias("region_id"), start.alias("start"), (start + 50).alias("end"), summit.alias("summit"))).select("region_id", "summit_ok")


@query(f"{WITH_WINDOWS} SELECT region_id, chrom, w_start, w_end FROM wins")
def region_window_clamp(spark, sf):
    return A.region_windows(spark, sf).select("region_id", "chrom", "w_start", "w_end")


@query(f"{WITH_RSEQS} SELECT region_id, chrom, w_start, w_end, seq FROM rseqs")
def region_fetch_sequence(spark, sf):
    return A.region_seqs(spark, sf)


_PROM = "proms AS (SELECT *, CASE WHEN strand = '+' THEN tss - {up} ELSE tss - {down} END AS p_start, CASE WHEN strand = '+' THEN tss + {down} ELSE tss + {up} END AS p_end FROM genes)"


@query(f"WITH {A.GENES}, {_PROM.format(up=200, down=100)} SELECT ord, chrom, tss, strand, p_start, p_end FROM proms")
def promoter_intervals(spark, sf):
    return G.promoters(A.genes(spark, sf), 200, 100).select("ord", "chrom", "tss", "strand", "p_start", "p_end")


_LOCATED = f'WITH {A.REGIONS}, {A.GENES}, {_PROM.format(up=60, down=30)} SELECT region_id, chrom, start, "end" FROM g_regions r WHERE {{}} EXISTS (SELECT 1 FROM proms p WHERE p.chrom = r.chrom AND r."end" > p.p_start AND r.start < p.p_end)'


@query(_LOCATED.format(""))
def promoter_semi_join(spark, sf):
    return L.by_location(A.g_regions(spark, sf), A.genes(spark, sf), "promoter", 60, 30).select("region_id", "chrom", "start", "end")


@query(_LOCATED.format("NOT"))
def distal_anti_join(spark, sf):
    return L.by_location(A.g_regions(spark, sf), A.genes(spark, sf), "distal", 60, 30).select("region_id", "chrom", "start", "end")


_PAIRS = f"WITH {A.REGIONS}, {A.GENES}, pairs AS (SELECT r.region_id, r.start - g.tss AS t, g.strand, g.ord FROM g_regions r JOIN genes g ON r.chrom = g.chrom)"


_NEAREST = (
    _PAIRS
    + f""", marked AS (SELECT *, least({L.FAR}, coalesce(min(CASE WHEN t >= 0 THEN t END) OVER (PARTITION BY region_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {L.FAR})) AS m FROM pairs),
locked AS (SELECT region_id, arg_min(CASE WHEN strand = '-' THEN -t ELSE t END, ord) AS d FROM marked WHERE t < 0 AND -t < m GROUP BY region_id),
upstream AS (SELECT region_id, CASE WHEN strand = '-' THEN -t ELSE t END AS d FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY t, ord) AS k FROM pairs WHERE t >= 0 AND t < {L.FAR}) WHERE k = 1)"""
)


@query(_NEAREST + " SELECT r.region_id, coalesce(l.d, u.d) AS distance FROM g_regions r LEFT JOIN locked l USING (region_id) LEFT JOIN upstream u USING (region_id)")
def nearest_gene_reference(spark, sf):
    return L.nearest_gene(A.g_regions(spark, sf), A.genes(spark, sf), "reference")


@query(
    _PAIRS
    + f""", best AS (SELECT region_id, CASE WHEN strand = '-' THEN -t ELSE t END AS d FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY abs(t), ord) AS k FROM pairs WHERE abs(t) < {L.FAR}) WHERE k = 1)
SELECT r.region_id, b.d AS distance FROM g_regions r LEFT JOIN best b USING (region_id)"""
)
def nearest_gene_true(spark, sf):
    return L.nearest_gene(A.g_regions(spark, sf), A.genes(spark, sf), "nearest")


_BED = """SELECT event_id, 'chr' || (user_id % 23) AS chrom, user_id % 1000 AS start, user_id % 1000 + 10 + event_id % 90 AS "end", value AS score FROM events"""


@query(_BED.replace("value AS score", "round(value, 6) AS score"))
def parse_bed_lines(spark, sf):
    events = A.table(spark, sf, "events")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("user_id") % 23), F.col("user_id") % 1000, F.col("user_id") % 1000 + 10 + F.col("event_id") % 90, F.lit("n"), F.col("value"), F.lit("+"))
    lines = events.select(F.col("event_id").cast("string").alias("file"), F.lit(1).alias("line_no"), line.alias("line"))
    got = RG.parse_region_lines(lines, "bed").filter("not bad")
    return rounded(got.select(F.col("file").cast("long").alias("event_id"), "chrom", "start", "end", "score"), "score")


@query("""SELECT event_id, 'chr' || (user_id % 23) AS chrom, user_id % 1000 AS start, user_id % 1000 + 100 AS "end", user_id % 1000 + 50 AS summit, round(value, 6) AS score FROM events""")
def parse_macs2_lines(spark, sf):
    events = A.table(spark, sf, "events")
    start = F.col("user_id") % 1000
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("user_id") % 23), start + 1, start + 100, F.lit(100), start + 51, F.lit("7.5"), F.col("value"), F.lit("2.0"), F.lit("1.0"), F.lit("peak"))
    lines = events.select(F.col("event_id").cast("string").alias("file"), F.lit(1).alias("line_no"), line.alias("line"))
    got = RG.parse_region_lines(lines, "macs2").filter("not bad")
    return rounded(got.select(F.col("file").cast("long").alias("event_id"), "chrom", "start", "end", "summit", "score"), "score")


# ---------------------------------------------------------------- matrices


@query(f"WITH {PPM_SQL} SELECT motif_idx, pos, base, round(value, 9) AS value FROM ppm")
def pfm_to_ppm(spark, sf):
    return rounded(M.to_ppm(M.long_form(spark, A.PFMS)), "value", digits=9)


@query(f"WITH {NORM_SQL} SELECT motif_idx, pos, base, round(value, 9) AS value FROM norm")
def ppm_normalize(spark, sf):
    return rounded(M.normalize(M.to_ppm(M.long_form(spark, A.PFMS))), "value", digits=9)


@query(f"WITH {PWM_SQL} SELECT motif_idx, pos, base, value FROM pwm")
def ppm_to_pwm(spark, sf):
    return M.to_pwm(M.normalize(M.to_ppm(M.long_form(spark, A.PFMS))))


@query(f"WITH {PWM_SQL}, c AS (SELECT motif_idx, pos, max(value) AS hi, min(value) AS lo FROM pwm GROUP BY ALL) SELECT motif_idx, count(*) AS length, round(sum(hi), 5) AS max_raw, round(sum(greatest(hi, 0)), 5) AS max_scan, round(sum(lo), 5) AS min_raw FROM c GROUP BY motif_idx")
def pwm_min_max_raw(spark, sf):
    return rounded(M.extremes(M.to_pwm(M.normalize(M.to_ppm(M.long_form(spark, A.PFMS))))), "max_raw", "max_scan", "min_raw", digits=5)


@query(f"{WITH_SEQS}, whole AS (SELECT * FROM seqs WHERE size >= 8), {A.sites_sql('whole', keep_all=True)} SELECT motif_idx, region_id, max(raw) AS raw, round(max(score), 6) AS score FROM sites GROUP BY ALL")
def pwm_score_prefix_both(spark, sf):
    return rounded(prefix_scores(A.seqs(spark, sf).filter("size >= 8").withColumn("seq", F.substring("seq", 1, 8)), A.PWMS), "score")


# ---------------------------------------------------------------- scans


@query(f"{WITH_SEQS}, {A.sites_sql('seqs', strands='+')} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score FROM sites")
def scan_fwd(spark, sf):
    return rounded(_doc_sites(spark, sf, "+").drop("strand"), "score")


@query(f"{WITH_SEQS}, {A.sites_sql('seqs', strands='-')} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score FROM sites")
def scan_rev(spark, sf):
    return rounded(_doc_sites(spark, sf, "-").drop("strand"), "score")


@query(f"{WITH_SITES} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score, strand FROM sites")
def scan_both(spark, sf):
    return rounded(_doc_sites(spark, sf), "score")


@query(f"{WITH_RSITES} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score, strand FROM sites")
def scan_native_regions(spark, sf):
    return rounded(scan_native(A.region_seqs(spark, sf), A.PWMS, A.CUTOFFS), "score")


_LOW = [-0.05, -0.02, 0.0]


@query(f"{WITH_RSEQS}, {A.sites_sql('rseqs', cutoffs=_LOW)} SELECT motif_idx, region_id, strand, count(*) AS n_sites, sum(raw) AS raw FROM sites GROUP BY ALL")
def scan_nonpositive_cutoff(spark, sf):
    sites = scan(A.region_seqs(spark, sf), A.PWMS, cutoffs=_LOW)
    return sites.groupBy("motif_idx", "region_id", "strand").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("raw").alias("raw"))


@query(f"{WITH_RSITES}, {dedup_sql()} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score, strand FROM dsites")
def scan_dedup(spark, sf):
    return rounded(S.dedup(_region_sites(spark, sf, dedup=False), A.PWMS), "score")


@query(f"{WITH_SITES}, {dedup_sql()} SELECT motif_idx, region_id, start, raw, round(score, 6) AS score, strand FROM dsites")
def scan_dedup_fused(spark, sf):
    return rounded(_doc_sites(spark, sf, dedup=True), "score")


@query(f"{WITH_RSITES}, {dedup_sql()}, {GRID_SQL} SELECT motif_idx, region_id, n_sites FROM grid")
def sites_count_grid(spark, sf):
    return S.grid(A.g_regions(spark, sf), _region_sites(spark, sf), N).select("motif_idx", "region_id", "n_sites")


@query(f"{WITH_RSITES}, {dedup_sql()}, {GRID_SQL} SELECT motif_idx, region_id, round(max_score, 6) AS max_score FROM grid")
def sites_max_score_grid(spark, sf):
    return rounded(S.grid(A.g_regions(spark, sf), _region_sites(spark, sf), N).select("motif_idx", "region_id", "max_score"), "max_score")


_WIDE = ", ".join(f"max(CASE WHEN motif_idx = {i} THEN n_sites END) AS m{i}" for i in range(N))


@query(f'{WITH_RSITES}, {dedup_sql()}, {GRID_SQL} SELECT g.region_id, r.chrom AS chr, r.start + 1 AS start, r."end", {_WIDE} FROM grid g JOIN g_regions r USING (region_id) GROUP BY g.region_id, r.chrom, r.start, r."end"')
def sites_number_pivot(spark, sf):
    return S.wide(A.g_regions(spark, sf), _region_sites(spark, sf), A.PWMS)


_FILES = "['" + "', '".join(f"{m.matrix_id}_{m.name}" for m in A.PWMS) + "']"
_LENGTHS = "[" + ", ".join(str(m.length) for m in A.PWMS) + "]"


@query(f"{WITH_RSITES}, {dedup_sql()} SELECT regexp_replace({_FILES}[motif_idx + 1], '[-:./*]', '_', 'g') AS motif_file, region_id, r.chrom, s.start, s.start + {_LENGTHS}[motif_idx + 1] AS \"end\", '.' AS name, round(s.score, 6) AS score, strand FROM dsites s JOIN g_regions r USING (region_id)")
def sites_bed(spark, sf):
    return rounded(S.bed_rows(A.g_regions(spark, sf), _region_sites(spark, sf), A.PWMS), "score")


# ---------------------------------------------------------------- cutoffs

_SCORED = f"{WITH_SEQS}, whole AS (SELECT * FROM seqs WHERE size >= 8), {A.sites_sql('whole', keep_all=True)}, scores AS (SELECT motif_idx, region_id, max(raw) AS raw, max(score) AS score FROM sites GROUP BY ALL)"
_RANKED = """ranked AS (SELECT {keys}, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
cut AS (SELECT {keys}, '1e-' || e AS p, score FROM ranked, (SELECT unnest(range(2, 7)) AS e) WHERE e < least(length(CAST(n AS VARCHAR)), 7) AND k = n // CAST(pow(10, e) AS BIGINT))"""


def _prefix(spark, sf):
    return prefix_scores(A.seqs(spark, sf).filter("size >= 8").withColumn("seq", F.substring("seq", 1, 8)), A.PWMS)


@query(f"{_SCORED}, {_RANKED.format(keys='motif_idx', source='scores')} SELECT motif_idx, p, round(score, 6) AS score FROM cut")
def score_cutoffs(spark, sf):
    return rounded(C.score_cutoffs(_prefix(spark, sf)).drop("raw"), "score")


@query(
    f"{_SCORED}, halves AS (SELECT *, region_id % 2 AS rep FROM scores), {_RANKED.format(keys='motif_idx, rep', source='halves')} SELECT motif_idx, p, round(avg(score), 6) AS score FROM cut GROUP BY ALL"
)
def cutoffs_avg_repeats(spark, sf):
    parts = [C.score_cutoffs(_prefix(spark, sf).filter(F.col("region_id") % 2 == r)) for r in (0, 1)]
    return rounded(C.averaged(parts[0].unionByName(parts[1])), "score")


# ---------------------------------------------------------------- enrichment

_TABLE = f"""{WITH_SITES}, hits AS (SELECT DISTINCT motif_idx, region_id, lang = 'en' AS inp FROM sites JOIN seqs USING (region_id)),
tab AS (SELECT m.motif_idx, (SELECT count(*) FROM hits h WHERE h.motif_idx = m.motif_idx AND inp) AS n_input, (SELECT count(*) FROM seqs WHERE lang = 'en') AS total_input,
  (SELECT count(*) FROM hits h WHERE h.motif_idx = m.motif_idx AND NOT inp) AS n_control, (SELECT count(*) FROM seqs WHERE lang <> 'en') AS total_control FROM (SELECT unnest(range(0, {N})) AS motif_idx) m)"""
#: log-choose in SQL; the tails are summed over the possible cells.
_FISHER = """cells AS (SELECT motif_idx, n_input AS a, unnest(range(greatest(0, total_input - (total_input + total_control - n_input - n_control)), least(total_input, n_input + n_control) + 1)) AS x, total_input AS r, n_input + n_control AS k, total_input + total_control AS n FROM tab),
pmf AS (SELECT motif_idx, a, x, exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(r - x + 1) - lgamma(n - k - r + x + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)) AS p FROM cells),
fish AS (SELECT motif_idx, least(1, sum(CASE WHEN x >= a THEN p ELSE 0 END)) AS pe, least(1, sum(CASE WHEN x <= a THEN p ELSE 0 END)) AS pd FROM pmf GROUP BY motif_idx)"""


def _table(spark, sf):
    # Longer documents nearly all have sites; the share of documents with one differs by language through their lengths.
    docs = A.seqs(spark, sf)
    sites = _doc_sites(spark, sf)
    inp, ctl = docs.filter("lang = 'en'"), docs.filter("lang <> 'en'")
    return E.contingency(inp, sites.join(inp.select("region_id"), "region_id", "left_semi"), ctl, sites.join(ctl.select("region_id"), "region_id", "left_semi"), N)


@query(f"{_TABLE} SELECT * FROM tab")
def enrichment_contingency(spark, sf):
    return _table(spark, sf)


@query(f"{_TABLE} SELECT motif_idx, round(CAST(n_input AS DOUBLE) * total_control / n_control / total_input, 6) AS fold_change FROM tab WHERE n_control > 0")
def enrichment_fold_change(spark, sf):
    return rounded(_table(spark, sf).filter("n_control > 0").select("motif_idx", E.fold_change().alias("fold_change")), "fold_change")


_LABELS = "['" + "', '".join(m.label for m in A.PWMS) + "']"


@query(f"{_TABLE}, {_FISHER} SELECT motif_idx, {_LABELS}[motif_idx + 1] AS name, n_input, n_control, round(pe, 6) AS p_enriched, round(pd, 6) AS p_depleted, round(least(least(pe, pd) * {N}, 1), 6) AS p_corrected FROM tab JOIN fish USING (motif_idx)")
def enrichment_fisher(spark, sf):
    got = E.enrichment(_table(spark, sf), A.PWMS).drop("fold_change")
    return rounded(got, "p_enriched", "p_depleted", "p_corrected")


@query(f"{_TABLE}, {_FISHER} SELECT {_LABELS}[motif_idx + 1] AS name, row_number() OVER (ORDER BY round(pe, 9), CAST(n_input AS DOUBLE) * total_control / n_control / total_input DESC, motif_idx) AS place FROM tab JOIN fish USING (motif_idx)")
def enrichment_ranked(spark, sf):
    from pyspark.sql import Window

    got = E.ranked(E.enrichment(_table(spark, sf), A.PWMS).withColumn("p_enriched", F.round("p_enriched", 9)))
    known = F.when(~F.isnan("fold_change"), F.col("fold_change"))
    return got.select("name", F.row_number().over(Window.orderBy("p_enriched", known.desc_nulls_last(), "motif_idx")).alias("place"))


# ---------------------------------------------------------------- profiles

_HALF = A.WINDOW // 2
_BINS = (2 * _HALF + 10) // 10
_HIST = f"""{WITH_RSITES}, {dedup_sql()}, dist AS (SELECT s.motif_idx, s.start + {_LENGTHS}[s.motif_idx + 1] / 2.0 - r.summit AS d FROM dsites s JOIN g_regions r USING (region_id)),
binned AS (SELECT motif_idx, CAST(CASE WHEN d = {-_HALF - 5 + 10 * _BINS} THEN {_BINS - 1} ELSE floor((d - ({-_HALF - 5})) / 10) END AS INT) AS bin, count(*) AS n FROM dist GROUP BY ALL),
frame AS (SELECT m.motif_idx, b.bin FROM (SELECT unnest(range(0, {N})) AS motif_idx) m, (SELECT unnest(range(0, {_BINS})) AS bin) b),
hist AS (SELECT f.motif_idx, f.bin, coalesce(n, 0) AS n, coalesce(CAST(n AS DOUBLE) / (SELECT count(*) FROM dist d WHERE d.motif_idx = f.motif_idx), 0) AS freq FROM frame f LEFT JOIN binned b ON f.motif_idx = b.motif_idx AND f.bin = b.bin)"""


@query(f"{_HIST} SELECT motif_idx, bin, n, round(freq, 9) AS freq FROM hist")
def site_distance_histogram(spark, sf):
    return rounded(P.distance_histogram(A.g_regions(spark, sf), _region_sites(spark, sf), A.PWMS, A.WINDOW), "freq", digits=9)


_WEIGHTS = P.hanning()


def _smooth_sql(source: str, order: str, value: str, size: str) -> str:
    """Reflected taps by a self-join on the mirrored place."""
    taps = ", ".join(f"({k - 5}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(_WEIGHTS))
    at = f"abs(a.{order} + t.k)"
    mirrored = f"CASE WHEN {at} >= {size} THEN 2 * ({size} - 1) - {at} ELSE {at} END"
    return f"SELECT a.motif_idx, a.{order}, CASE WHEN {size} <= 11 THEN any_value(a.{value}) ELSE sum(b.{value} * t.w) END AS smooth FROM {source} a, (VALUES {taps}) t(k, w), {source} b WHERE b.motif_idx = a.motif_idx AND b.{order} = {mirrored} GROUP BY ALL"


@query(f"{_HIST}, sm AS ({_smooth_sql('hist', 'bin', 'freq', str(_BINS))}) SELECT motif_idx, bin, round(smooth, 9) AS smooth FROM sm")
def hist_smoothed(spark, sf):
    hist = P.distance_histogram(A.g_regions(spark, sf), _region_sites(spark, sf), A.PWMS, A.WINDOW)
    return rounded(P.smoothed_histogram(hist), "smooth", digits=9)


_CURVE = f"""{WITH_RSITES}, {dedup_sql()}, {GRID_SQL}, flags AS (SELECT g.motif_idx, g.region_id, r.score, CASE WHEN n_sites > 0 THEN 1 ELSE 0 END AS has FROM grid g JOIN g_regions r USING (region_id)),
curve AS (SELECT motif_idx, region_id, row_number() OVER (PARTITION BY motif_idx ORDER BY score DESC, region_id) - 1 AS place,
  avg(has) OVER (PARTITION BY motif_idx ORDER BY score DESC, region_id ROWS BETWEEN @F PRECEDING AND @G FOLLOWING) / 0.5 AS fold_change FROM flags)"""
#: The frame is 1 % of the regions; SQL takes it from the table.
_REACH = "(SELECT count(*) // 100 FROM orders)"


@query(_CURVE.replace("@F", _REACH).replace("@G", f"({_REACH} - 1)") + " SELECT motif_idx, region_id, place, round(fold_change, 6) AS fold_change FROM curve")
def ranked_fold_change(spark, sf):
    regions = A.g_regions(spark, sf)
    return rounded(P.ranked_fold_change(regions, S.grid(regions, _region_sites(spark, sf), N), 0.5), "fold_change")


# ---------------------------------------------------------------- names and remote sets


@query("SELECT p_partkey, regexp_replace(p_name || '-' || p_type || '.' || p_brand, '[-:./*]', '_', 'g') AS name FROM part")
def sanitize_name(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", file_name(F.concat("p_name", F.lit("-"), "p_type", F.lit("."), "p_brand")).alias("name"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS description FROM nation WHERE contains(lower('n' || n_nationkey), 'a') OR contains(lower(n_name), 'a')")
def assembly_search(spark, sf):
    from helixframe.sources.remote import search

    nations = A.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("description"))
    return search(nations, "A")


_CORE = ("vertebrates", "plants", "insects", "nematodes", "fungi", "urochordates")
_COLLECTIONS = ("CNE", "PHYLOFACTS", "SPLICE", "POLII", "FAM", "PBM", "PBM_HOMEO", "PBM_HLH", "UNVALIDATED")


@query(
    "WITH "
    + values_sql("taxa", "taxon", [(t,) for t in _CORE])
    + ", "
    + values_sql("cs", "name", [(c,) for c in _COLLECTIONS])
    + " SELECT 'jaspar_core' AS source, taxon || '_' || kind AS name FROM taxa, (VALUES ('non-redundant'), ('redundant')) k(kind) UNION ALL SELECT 'jaspar_collections', name FROM cs"
)
def motif_sets(spark, sf):
    return spark.createDataFrame(jaspar_sets(), "source string, name string")


# ---------------------------------------------------------------- random

_DRAW = "((({n}) % 2147483647 * 48271 + {seed}) % 2147483647 * 69621 + 1) % 2147483647"


def below_sql(n: str, seed: int, limit: str) -> str:
    return f"CAST((CAST({_DRAW.format(n=n, seed=seed)} AS HUGEINT) * CAST({limit} AS HUGEINT)) // 2147483647 AS BIGINT)"


def hashed_sql(n: str, stream: int, seed: int, limit: str) -> str:
    part = f"CAST('0x' || substr(md5('{seed}|{stream}|' || CAST({n} AS VARCHAR)), 1, 13) AS BIGINT)"
    return f"CAST((CAST({part} AS HUGEINT) * CAST({limit} AS HUGEINT)) // {1 << 52} AS BIGINT)"


@query(
    f"""WITH st AS (SELECT 'doc' || doc_id AS chrom, length(text) AS size, sum(length(text)) OVER (ORDER BY 'doc' || doc_id) AS hi FROM documents WHERE length(text) > 8),
d AS (SELECT range AS draw_id, {hashed_sql('range', 0, 5, '(SELECT sum(length(text)) FROM documents WHERE length(text) > 8)')} AS at FROM range(0, 20000))
SELECT d.draw_id, st.chrom, {hashed_sql('d.draw_id', 1, 5, '(st.size - 8)')} AS w_start, {hashed_sql('d.draw_id', 1, 5, '(st.size - 8)')} + 8 AS w_end FROM d JOIN st ON d.at >= st.hi - st.size AND d.at < st.hi"""
)
def random_background(spark, sf):
    return R.random_windows(A.sizes(spark, sf).filter("size > 8"), 20_000, 8, 5)


@query(
    f"""{WITH_SEQS}, {A.REGIONS}, k AS (SELECT unnest(range(0, 3)) AS k),
fit AS (SELECT r.region_id * 3 + k AS control_id, r.region_id, r.chrom, "end" - start AS len, size FROM g_regions r JOIN seqs s ON r.chrom = s.chrom, k WHERE "end" - start <= size),
placed AS (SELECT *, {below_sql('control_id', 9, '(size - len + 1)')} AS s FROM fit) SELECT control_id, region_id, chrom, s AS start, s + len AS "end" FROM placed"""
)
def control_regions_uniform(spark, sf):
    regions = A.g_regions(spark, sf).join(A.sizes(spark, sf), "chrom").filter(F.col("end") - F.col("start") <= F.col("size")).drop("size")
    return R.uniform_controls(regions, A.sizes(spark, sf), 3, 9)


_FAR_GENES, _ROOM, _SLOTS, _TRIES = 200_000, 1_000_000, 2, 20
_TRY = f"((region_id * {_SLOTS} + slot) * {_TRIES} + k)"


@query(
    _NEAREST
    + f""", dist AS (SELECT r.region_id, r.chrom, "end" - start AS len, coalesce(l.d, u.d, {R.BEYOND[0]} + {below_sql('r.region_id', 5, str(R.BEYOND[1] - R.BEYOND[0] + 1))}) AS d
  FROM g_regions r LEFT JOIN locked l USING (region_id) LEFT JOIN upstream u USING (region_id)),
listed AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY ord) - 1 AS g_no, count(*) OVER (PARTITION BY chrom) AS n_genes FROM genes),
counts AS (SELECT chrom, count(*) AS n_genes FROM genes GROUP BY chrom),
tried AS (SELECT d.*, slot, k, {below_sql(_TRY, 3, 'n_genes')} AS pick FROM dist d JOIN counts USING (chrom), (SELECT unnest(range(0, {_SLOTS})) AS slot), (SELECT unnest(range(0, {_TRIES})) AS k)),
placed AS (SELECT t.region_id, t.chrom, slot, k, len, CASE WHEN strand = '+' THEN tss + {_FAR_GENES} + d ELSE tss + {_FAR_GENES} - d END AS spot FROM tried t JOIN listed g ON t.chrom = g.chrom AND t.pick = g.g_no)
SELECT region_id * {_SLOTS} + slot AS control_id, region_id, chrom, arg_min(spot, k) AS start, arg_min(spot + len, k) AS "end" FROM placed WHERE spot >= 0 AND spot + len <= {_ROOM} GROUP BY region_id, slot, chrom"""
)
def control_regions_gene(spark, sf):
    # Chromosomes long enough that some gene always leaves room.
    sizes = A.sizes(spark, sf).withColumn("size", F.lit(_ROOM).cast("long"))
    genes = A.genes(spark, sf).withColumn("tss", F.col("tss") + _FAR_GENES)
    regions = A.g_regions(spark, sf).withColumn("start", F.col("start") + _FAR_GENES).withColumn("end", F.col("end") + _FAR_GENES)
    return R.gene_controls(regions, sizes, genes, _SLOTS, 3, _TRIES)
