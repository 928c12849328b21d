import os
import random

import pytest

from helixframe import cli, jobs
from helixframe.catalog import Catalog
from helixframe.errors import InvalidCatalogError, MissingPwmsError, UnknownAssemblyError, UnknownMotifSetError
from helixframe.operators.scan import scan
from helixframe.plans import adapters as A
from helixframe.streaming.scan_stream import arrivals, arrivals_per_window, scan_stream


def test_catalog(tmp_path):
    path = str(tmp_path / "c.ini")
    c = Catalog(path)
    c.genomes["HG19"] = "/x"
    c.motifs.root = "/m"
    c.save()
    c = Catalog(path)
    assert c.genomes["hg19"] == "/x" and "Hg19" in c.genomes and c.motifs.root == "/m"
    del c.genomes["hg19"]
    for section, error in ((c.genomes, UnknownAssemblyError), (c.motifs, UnknownMotifSetError)):
        with pytest.raises(error):
            section["none"]
        with pytest.raises(error):
            del section["none"]
    (tmp_path / "bad.ini").write_text("no section\n")
    with pytest.raises(InvalidCatalogError):
        Catalog(str(tmp_path / "bad.ini"))


def test_config_command(tmp_path, capsys):
    path = str(tmp_path / "c.ini")
    run = lambda *a: cli.main(["config", "--catalog", path, *a])
    assert run("--set-genome", "g", "/g", "--set-default-motif", "/d") == 0 and run("--get-genome", "g") == 0 and run("--show") == 0
    out = capsys.readouterr().out
    assert "/g" in out and "[motif] /d" in out
    assert run("--rm-genome", "g") == 0 and run("--rm-genome", "g") == 1


@pytest.mark.parametrize("argv", [["genome"], ["genome", "--list", "--install"], ["scan", "-i", "x"], ["scan", "-i", "x", "-m", "m", "-g", "g", "-o", "o", "-p", "1e-9"], ["motif", "--build", "m", "--n-random", "0"]])
def test_bad_options(argv):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(argv)


def test_list_remote_motifs(tmp_path, capsys):
    assert cli.main(["motif", "--list-remote", "--catalog", str(tmp_path / "c")]) == 0
    assert len(capsys.readouterr().out.split()) == 12


def test_from_files_to_enrichment(spark, tmp_path):
    rnd = random.Random(3)
    core = "ACGA" * 3
    chroms = {f"chr{i}": "".join(rnd.choice("ACGT") for _ in range(6000)) for i in (1, 2)}
    spots = [("chr1", p) for p in range(500, 5500, 500)] + [("chr2", p) for p in range(500, 5500, 500)]
    for c, p in spots:
        s = chroms[c]
        chroms[c] = s[:p] + core + s[p + len(core) :]
    fasta = tmp_path / "g.fa"
    fasta.write_text("".join(f">{c}\n{s}\n" for c, s in chroms.items()))
    genes = tmp_path / "genes.txt"
    genes.write_text("".join(f"0 g{i} chr{i} + 1000 2000 0 0\n" for i in (1, 2)))
    pfms = tmp_path / "m.jaspar"
    bases = "ACGA" * 3
    pfms.write_text(">M1\tcore\n" + "".join(f"{b} [ {' '.join('20' if x == b else '1' for x in bases)} ]\n" for b in "ACGT"))
    bed = tmp_path / "r.bed"
    bed.write_text("".join(f"{c}\t{p - 20}\t{p + 40}\tn\t{i}\t+\n" for i, (c, p) in enumerate(spots)))
    catalog = Catalog(str(tmp_path / "c.ini"))
    jobs.install_genome(spark, catalog, "g", [str(fasta)], str(genes), str(tmp_path / "genome"))
    jobs.install_motifs(catalog, "m", [str(pfms)], str(tmp_path / "motifs"))
    with pytest.raises(ValueError):
        jobs.install_genome(spark, catalog, "g", [str(fasta)])
    with pytest.raises(MissingPwmsError):
        jobs.built_motifs(catalog, "m", "g")
    built = jobs.build_motifs(spark, catalog, "m", "g", n=2000, repeats=2, seed=1)
    assert set(built[0].cutoffs) == {"1e-2", "1e-3"} and built[0].cutoffs["1e-3"] > built[0].cutoffs["1e-2"]
    assert jobs.built_motifs(catalog, "m", "g")[0].cutoffs == built[0].cutoffs
    out = str(tmp_path / "out")
    got = jobs.scan_regions(spark, catalog, str(bed), "m", "g", out, p_value="1e-3", width=60, n_random=3, seed=2, beds=True, profiles=True)
    row = got["enrichment"].first()
    assert row["n_input"] == 20 and row["p_enriched"] < 1e-3 and row["fold_change"] > 2
    number = open(os.path.join(out, "motif_sites_number.xls")).read().splitlines()
    assert number[0] == "chr\tstart\tend\tM1,core" and len(number) == 21 and number[1].startswith("chr1\t481\t540\t")
    assert open(os.path.join(out, "motif_enrichment.xls")).readline().startswith("name\tn_input")
    assert os.listdir(os.path.join(out, "motif_sites")) == ["M1_core_sites.bed"]
    assert got["distances"].count() > 0
    located = jobs.scan_regions(spark, catalog, str(bed), "m", "g", out, p_value="1e-3", width=60, location="promoter", upstream=600, downstream=600, enrich=False)
    assert 0 < located["regions"].count() < 20
    jobs.uninstall(catalog, catalog.motifs, "m")
    assert "m" not in catalog.motifs and not os.path.exists(tmp_path / "motifs")


def test_streams(spark, tmp_path):
    rows = [(i, 0, "ACGATTACG" * 3, None) for i in range(20)]
    df = spark.createDataFrame(rows, "region_id long, w_start long, seq string, arrived timestamp").selectExpr("region_id", "w_start", "seq", "timestamp_seconds(region_id * 60) AS arrived")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = scan_stream(arrivals(spark, str(tmp_path / "in"), 2), A.PWMS, A.CUTOFFS).writeStream.format("memory").queryName("stream_sites").start()
    counts = arrivals_per_window(arrivals(spark, str(tmp_path / "in"), 2)).writeStream.format("memory").queryName("stream_counts").outputMode("complete").start()
    for s in (q, counts):
        s.processAllAvailable()
        s.stop()
    key = lambda d: sorted((r["motif_idx"], r["region_id"], r["start"], r["raw"], r["strand"]) for r in d.collect())
    assert key(spark.table("stream_sites")) == key(scan(df, A.PWMS, cutoffs=A.CUTOFFS, dedup=True)) != []
    assert sum(r["n_regions"] for r in spark.table("stream_counts").collect()) == 20
