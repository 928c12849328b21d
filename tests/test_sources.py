import gzip
import io
import tarfile
import zipfile

import pytest

from helixframe import errors as X
from helixframe.sources import archives, genome, motifs, remote
from helixframe.sources.regions import FORMATS, read_regions, region_format

PFMS = """>ID1.1\tone
A  [ 3 0 1 ]
C  [ 8 0 23 ]
G  [ 2 23 0 ]
T  [ 11 1 1 ]

>ID2.1
1 2
3 4
5 6
7 8
"""


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("bed", "#track\ntrack x\n\nchr1\t10\t20\tn\t5.5\t+\nchr2\t5\t9\nchr2\t5\t9\tn\t.\n", [("chr1", 10, 20, 15, 5.5), ("chr2", 5, 9, 7, None), ("chr2", 5, 9, 7, None)]),
        ("bed3-summit", "# head\nchr1\t10\t20\t13\tx\n", [("chr1", 10, 20, 13, None)]),
        ("macs", "# x\nchr\tstart\tend\nchr1\t11\t20\t9\t4\t7\t33.5\t2\t0.1\n", [("chr1", 10, 20, 14, 33.5)]),
        ("macs2", "#\nchr\tstart\nchr1\t11\t20\t9\t15\t7\t33.5\t2\t0.1\tn\n", [("chr1", 10, 20, 14, 33.5)]),
        ("narrowpeak", "chr1\t10\t20\tn\t100\t.\t1\t2\t3\t4\nchr1\t10\t21\tn\t100\t.\t1\t2\t3\t-1\n", [("chr1", 10, 20, 14, 100.0), ("chr1", 10, 21, 15, 100.0)]),
        ("broadPeak", "chr1\t10\t20\tn\t100\t.\t1\t2\t3\n", [("chr1", 10, 20, 15, 100.0)]),
        ("manorm", "chr\tstart\nchr1\t11\t20\t15\t-1.25\t3\t0.1\n", [("chr1", 10, 20, 14, -1.25)]),
    ],
)
def test_region_formats(spark, tmp_path, name, text, want):
    got = read_regions(spark, put(tmp_path / "r", text), name).orderBy("region_id").collect()
    assert [(r["chrom"], r["start"], r["end"], r["summit"], r["score"]) for r in got] == want
    assert [r["region_id"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize(
    "name, text, line",
    [
        ("bed", "chr1\t1\t5\nchr1\tx\t5\n", 2),
        ("bed", "chr1\t1\t5\n#late\n", 2),
        ("bed", "\nchr1\t1\n", 2),
        ("macs2", "chr1\t1\t5\t3\t2\t1\tbad\n", 1),
        ("narrowpeak", "chr1\t1\t5\tn\t1\t.\t1\t2\t3\n", 1),
    ],
)
def test_bad_lines_are_named(spark, tmp_path, name, text, line):
    with pytest.raises(X.RegionFormatError) as e:
        read_regions(spark, put(tmp_path / "r", text), name)
    assert e.value.line_number == line and e.value.region_format == name


def test_regions_must_start_before_they_end(spark, tmp_path):
    with pytest.raises(ValueError) as e:
        read_regions(spark, put(tmp_path / "r", "chr1\t5\t5\n"))
    assert not isinstance(e.value, X.HelixError)
    with pytest.raises(ValueError):
        region_format("gff")
    assert len(FORMATS) == 7


def test_pfm_text():
    one, two = motifs.parse_pfms(PFMS)
    assert one.values[1] == [8, 0, 23] and one.label == "ID1.1,one"
    assert two.values == [[1, 2], [3, 4], [5, 6], [7, 8]] and two.name == "ID2.1"


@pytest.mark.parametrize(
    "text, line",
    [("A [ 1 ]\n", 1), (">x\nC [ 1 ]\n", 2), (">x\nA [ 1 ]\nC [ a ]\n", 3), (">x\nA [ 1 ]\nC [ 2 ]\n", 4), (">x\nA [ 1 ]\n>y\n", 3), (PFMS + "9 9\n", 12)],
)
def test_bad_pfm_text(text, line):
    with pytest.raises(X.PfmFormatError) as e:
        motifs.parse_pfms(text)
    assert e.value.line_number == line


PWMS = ">a\tb\tPWM\nA [ 0.50000\t-1.00000]\nC [ 0.00000\t 1.00000]\nG [ 0.00000\t 0.00000]\nT [-2.00000\t 0.25000]\nCutoff_p1e-3\t0.5\nCutoff_p1e-4\t0.9\n"


def test_pwm_text_round_trip():
    (m,) = motifs.parse_pwms(PWMS)
    assert m.cutoffs == {"1e-3": 0.5, "1e-4": 0.9} and m.max_raw == 1.5 and m.min_raw == -3.0
    assert motifs.pwm_text([m]) == PWMS and motifs.parse_pwms(PWMS + "\n" + PWMS)[1].values == m.values


@pytest.mark.parametrize("cut", [1, 2, 3, 4, 5])
def test_truncated_pwm_text(cut):
    with pytest.raises(X.PwmFormatError) as e:
        motifs.parse_pwms("\n".join(PWMS.splitlines()[:cut]))
    assert e.value.line_number == cut + 1


@pytest.mark.parametrize("text", [PWMS.replace(">a\tb\tPWM", ">a b PWM"), PWMS.replace("C [", "G ["), PWMS.replace("0.25000", "x"), "Cutoff_p1\t1\n" + PWMS, PWMS.replace("Cutoff_p1e-4", "cutoff")])
def test_bad_pwm_text(text):
    with pytest.raises(X.PwmFormatError):
        motifs.parse_pwms(text)


FASTA = ">chr1 first\nAaTtC\ncGgNn\n>chr2\nAAAaCCccTTtGNNNNN\n>chrX\nAAACCTACNNTnggAC\n>chrM\nAaaaaAAAAAAAnnn\n"


@pytest.mark.parametrize("size", [4, 100])
def test_fasta(spark, tmp_path, size):
    chunks = genome.read_fasta(spark, put(tmp_path / "g.fa", FASTA), size=size)
    assert {r["chrom"]: r["size"] for r in genome.chrom_sizes(chunks).collect()} == {"chr1": 10, "chr2": 17, "chrX": 16, "chrM": 15}
    assert genome.background(chunks).first().asDict() == {"a": 0.3, "c": 0.3, "g": 0.15, "t": 0.25}
    whole = genome.background(chunks, autosomes_only=False).first()
    assert [round(v, 5) for v in whole] == [0.51111, 0.22222, 0.11111, 0.15556]
    asked = spark.createDataFrame([(1, "chr1", 0, 10), (2, "chr2", 3, 9), (3, "chrX", 12, 99), (4, "chr1", 2, 5)], "region_id long, chrom string, w_start long, w_end long")
    got = {r["region_id"]: r["seq"] for r in genome.fetch(asked, chunks, size).collect()}
    assert got == {1: "AaTtCcGgNn", 2: "aCCccT", 3: "ggAC", 4: "TtC"}
    with pytest.raises(Exception, match="chr9"):
        genome.fetch(asked.withColumn("chrom", genome.F.lit("chr9")), chunks, size).collect()
    with pytest.raises(Exception, match="chr9"):
        genome.fetch(asked.limit(1).withColumn("chrom", genome.F.lit("chr9")).withColumn("w_start", genome.F.lit(900)), chunks, size).collect()


def test_no_known_base_has_no_background(spark):
    empty = spark.createDataFrame([("chr1", "NNN")], "chrom string, seq string")
    assert genome.background(empty).first()["a"] is None


def test_genes(spark):
    lines = [(1, "1 g1 chr1 + 100 500 x"), (2, "1 g2 chr1 - 100 500"), (3, "")]
    got = genome.parse_genes(spark.createDataFrame(lines, "line_no int, line string"))
    rows = {r["name"]: r for r in genome.promoters(got, 20, 10).collect()}
    assert (rows["g1"]["tss"], rows["g1"]["p_start"], rows["g1"]["p_end"]) == (100, 80, 110)
    assert (rows["g2"]["tss"], rows["g2"]["p_start"], rows["g2"]["p_end"]) == (500, 490, 520)
    with pytest.raises(Exception, match="strand"):
        genome.parse_genes(spark.createDataFrame([(1, "1 g chr1 * 1 2")], "line_no int, line string")).collect()


def test_background_text():
    shares = {"A": 0.3, "C": 0.3, "G": 0.15, "T": 0.25}
    assert genome.parse_background(genome.background_text(shares)) == shares
    for text, line in (("C\t.1\n", 1), ("A\t.3\nC\tx\n", 2), ("A\t.3\nC .3\n", 2), ("A\t.3\n", 2)):
        with pytest.raises(X.BackgroundFormatError) as e:
            genome.parse_background(text)
        assert e.value.line_number == line


def test_archives(tmp_path):
    out = str(tmp_path / "out")
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(b"one")
    archives.unpack(str(tmp_path / "a.gz"), out)
    assert open(out).read() == "one"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", "1")
        z.writestr("y", "2")
    archives.unpack(str(tmp_path / "a.zip"), out)
    assert open(out).read() == "12"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("x", b"3"), ("y", b"4")):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(data))
    archives.unpack(str(tmp_path / "a.tar.gz"), out)
    assert open(out).read() == "34"
    archives.concatenate([out, out], str(tmp_path / "two"))
    assert open(tmp_path / "two").read() == "3434"
    with pytest.raises(TypeError):
        archives.unpack("a.rar", out)


def test_remote_listings(spark):
    listed = remote.parse_assemblies('<D><DSN><SOURCE id="hg19" version="1"/><DESCRIPTION>Human 2009</DESCRIPTION></DSN><DSN><SOURCE id="mm9"/><DESCRIPTION>Mouse</DESCRIPTION></DSN></D>')
    assert listed == [("hg19", "Human 2009"), ("mm9", "Mouse")]
    assert [r["id"] for r in remote.search(remote.assemblies(spark, listed), "HUM").collect()] == ["hg19"]
    assert len(remote.sequence_urls("hg19")) == 4 and remote.sequence_urls("hg19")[0].endswith("/hg19/bigZips/hg19.fa.gz")
    assert len(remote.jaspar_sets()) == 21
    assert "CORE_plants_redundant_" in remote.pfms_url("jaspar_core", "plants_redundant") and "2020_CNE_" in remote.pfms_url("jaspar_collections", "CNE")
    for database, name in (("jaspar_core", "plants"), ("jaspar_core", "moss_redundant"), ("jaspar_collections", "NONE")):
        with pytest.raises(X.UnknownRemoteMotifsError):
            remote.pfms_url(database, name)

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    def opener(request):
        if "chromFa.zip" not in request.full_url:
            raise OSError
        return Answer()

    assert remote.first_present("hg19", ["hg19"], remote.sequence_urls("hg19"), "sequence", opener).endswith(".zip")
    with pytest.raises(X.MissingRemoteFileError):
        remote.first_present("hg19", ["hg19"], remote.sequence_urls("hg19")[:1], "sequence", opener)
    with pytest.raises(X.UnknownRemoteAssemblyError):
        remote.first_present("xx", ["hg19"], [], "sequence", opener)
