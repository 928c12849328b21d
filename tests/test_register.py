from helixframe.functions.register import register
from helixframe.operators.scan import scan
from helixframe.plans import adapters as A


def test_sql_functions(spark):
    register(spark, A.PWMS, A.CUTOFFS)
    df = spark.createDataFrame([(1, 0, "ACGAACGACCNTTCGT"), (2, 0, ""), (3, 0, None)], "region_id long, w_start long, seq string")
    df.createOrReplaceTempView("windows")
    got = spark.sql("SELECT s.motif_idx, w.region_id, s.start, s.raw, s.score, s.strand FROM windows w, LATERAL scan_motifs(w.seq) s")
    key = lambda d: sorted((r["motif_idx"], r["region_id"], r["start"], r["raw"], r["strand"]) for r in d.collect())
    assert key(got) == key(scan(df, A.PWMS, cutoffs=A.CUTOFFS)) != []
    scores = [r[0] for r in spark.sql("SELECT score_motif(substr(seq, 1, 4), 0) FROM windows ORDER BY region_id").collect()]
    assert scores == [A.PWMS[0].score("ACGA"), None, None]
