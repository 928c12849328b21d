import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import matrix as M
from helixframe.operators import sites as S
from helixframe.operators.scan import encode, prefix_scores, scan, scan_native
from helixframe.plans import adapters as A

TWO = M.Pwm([[1, 0], [0, 1], [0, 0], [1, 0]], "m", "two", {"1e-3": 0.5, "1e-4": 1.0})


def seqs(spark, texts, start=0):
    return spark.createDataFrame([(i, start, t) for i, t in enumerate(texts)], "region_id long, w_start long, seq string")


def plain(text, pwms, cutoffs, strand="both", start=0):
    """Sites of one text by nested loops."""
    out = []
    for i, (m, cutoff) in enumerate(zip(pwms, cutoffs)):
        for sign in "+-" if strand == "both" else strand:
            rows = m.scaled() if sign == "+" else m.reverse()
            for p in range(len(text) - m.length + 1):
                raw = sum(rows["ACGT".index(b)][c] for c, b in enumerate(text[p : p + m.length].upper()) if b in "ACGT")
                if m.max_scan and raw / m.max_scan - cutoff >= -1e-10:
                    out.append((i, start + p, raw, sign))
    return sorted(out)


def rows(df):
    return sorted((r["motif_idx"], r["start"], r["raw"], r["strand"]) for r in df.collect())


def test_known_window(spark):
    df = seqs(spark, ["aTtC"], 1)
    assert scan(df, [TWO], "1e-4", dedup=True).count() == 1
    assert scan(df, [TWO], "1e-3", dedup=True).count() == 3
    assert scan(df, [TWO], "1e-3").count() == 5
    with pytest.raises(ValueError):
        scan(df, [TWO], "1e-2")
    with pytest.raises(ValueError):
        scan(df, [TWO], "1e-3", strand="*")


@pytest.mark.parametrize("strand", ["both", "+", "-"])
def test_kernels_match_loops(spark, strand):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ACGTacgtNé") for _ in range(rnd.randint(0, 40))) for _ in range(30)] + ["", "ACG", None]
    cutoffs = [0.6, 0.5, -0.1]
    df = seqs(spark, texts, 7)
    want = sorted((i, *s) for i, t in enumerate(texts) for s in plain(t or "", A.PWMS, cutoffs, strand, 7))
    for found in (scan(df, A.PWMS, cutoffs=cutoffs, strand=strand), scan_native(df, A.PWMS, cutoffs, strand)):
        got = sorted((r["region_id"], r["motif_idx"], r["start"], r["raw"], r["strand"]) for r in found.collect())
        assert got == want


def test_expressions_sum_in_generated_code(spark):
    plan = scan_native(seqs(spark, ["ACGT"] * 2), A.PWMS, A.CUTOFFS)._jdf.queryExecution().executedPlan().toString()
    table = str([*next(zip(*A.PWMS[0].scaled())), 0]).replace(" ", "")
    sums = [line for line in plan.splitlines() if table in line.replace(" ", "")]
    assert sums and all("*(" in line and "lambda" not in line for line in sums)


def test_expressions_at_the_edges(spark):
    # Two of these letters in upper case are one in lower case.
    texts = ["ßACGTTTA", "ŉﬃacgttta", "A", "AC" * 5000, "ACGTTTAC", None, "", "".join(random.Random(4).choices("ACGTn", k=3000))]
    df = seqs(spark, texts, 3)
    three = [TWO, M.Pwm([[0.0], [0.0], [0.0], [0.0]], "z", "z"), *A.PWMS]
    cutoffs = [0.6, 0.0, 0.5, 0.4, 0.2]
    want = rows(scan(df, three, cutoffs=cutoffs))
    assert want and rows(scan_native(df, three, cutoffs)) == want
    assert scan_native(df, three[1:2], [0.0]).collect() == scan(df, three[1:2], cutoffs=[0.0]).collect() == []


def test_unknown_bases_hit_at_cutoffs_of_zero(spark):
    assert scan(seqs(spark, ["NNNN"]), [TWO], cutoffs=[0.0]).count() == 6
    flat = M.Pwm([[-1.0], [0.0], [-2.0], [0.0]], "f", "f")
    assert scan(seqs(spark, ["CCC"]), [flat], cutoffs=[-5.0]).count() == 0


def test_palindromes_hit_on_both_strands(spark):
    both = M.Pwm([[1, 0], [0, 0], [0, 0], [0, 1]], "p", "p")
    assert rows(scan(seqs(spark, ["AT"]), [both], cutoffs=[1.0])) == [(0, 0, 200_000, "+"), (0, 0, 200_000, "-")]


def test_codes():
    assert encode("acGTn").tolist() == [0, 1, 2, 3, 4] and encode("Aé日😀C").tolist() == [0, 4, 4, 4, 1]


def test_dedup_fold(spark):
    sites = [(0, 0, 1, 100, 1.0, "+"), (0, 0, 3, 80, 0.8, "+"), (0, 0, 1, 100, 1.0, "-"), (0, 0, 2, 300, 3.0, "-"), (0, 0, 5, 100, 1.0, "+")]
    df = spark.createDataFrame(sites, "motif_idx int, region_id long, start long, raw long, score double, strand string")
    three = [M.Pwm([[0, 0, 1]] * 4, "x", "x")]
    assert rows(S.dedup(df, three)) == [(0, 1, 100, "+"), (0, 2, 300, "-"), (0, 5, 100, "+")]


def test_dedup_in_the_pass_is_the_fold(spark):
    rnd = random.Random(4)
    df = seqs(spark, ["".join(rnd.choice("ACGT") for _ in range(200)) for _ in range(20)])
    raw = scan(df, A.PWMS, cutoffs=[0.3, 0.3, 0.2])
    fused = scan(df, A.PWMS, cutoffs=[0.3, 0.3, 0.2], dedup=True)
    key = lambda d: sorted((r["motif_idx"], r["region_id"], r["start"], r["raw"], r["strand"]) for r in d.collect())
    assert key(S.dedup(raw, A.PWMS)) == key(fused)


def test_prefix_scores(spark):
    got = {r["region_id"]: r["score"] for r in prefix_scores(seqs(spark, ["ACT", "GTT", "TTA"]), [TWO]).collect()}
    assert got[0] == 1.0
    with pytest.raises(Exception, match="shorter"):
        prefix_scores(seqs(spark, ["A"]), [TWO]).collect()


def test_grid_and_wide_tables(spark):
    regions = spark.createDataFrame([(i, "c", 10 * i, 10 * i + 5) for i in range(3)], "region_id long, chrom string, start long, end long")
    sites = spark.createDataFrame([(0, 1, 10, 5, 0.5, "+"), (0, 1, 12, 7, 0.75, "-")], "motif_idx int, region_id long, start long, raw long, score double, strand string")
    assert S.grid(regions, sites, 3).filter("n_sites = 0").count() == 8
    assert [tuple(r) for r in S.wide(regions, sites, A.PWMS).orderBy("region_id").collect()][1] == (1, "c", 11, 15, 2, 0, 0)
    assert [tuple(r)[4:] for r in S.wide(regions, sites, A.PWMS, "score").orderBy("region_id").collect()] == [("NA",) * 3, ("0.75", "NA", "NA"), ("NA",) * 3]
    bed = S.bed_rows(regions, sites, A.PWMS).orderBy("start").first()
    assert (bed["motif_file"], bed["start"], bed["end"], bed["name"]) == ("HX0001_1_quad", 10, 14, ".")


def test_scan_is_one_narrow_pass(spark, sf):
    plan = scan(A.seqs(spark, sf), A.PWMS, cutoffs=A.CUTOFFS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert F is not None
