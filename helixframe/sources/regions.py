"""Region files of seven formats as one plan: lines, fields by expressions, checks, typed rows.

A format is a row of FORMATS: which lines are headers, and how start, end, summit and score follow from the fields.
Lines are numbered in file order, so headers count only before the first data line and the first bad line is the one
reported. Numbering needs the file's order: a file is read as one text and exploded within one task a file; region
files have at most millions of lines. Many files are many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.errors import RegionFormatError


def _field(k: int) -> Column:
    return F.get("f", F.lit(k))


def _int(k: int) -> Column:
    return F.trim(_field(k)).try_cast("long")


def _float(k: int) -> Column:
    return F.trim(_field(k)).try_cast("double")


def _absent(_: object = None) -> Column:
    return F.lit(None)


@dataclass(frozen=True)
class RegionFormat:
    """headers: "track", "comment" or "table"; summit and score of None are null; loose: a bad score is null, not an error."""

    headers: str
    start: Callable[[], Column]
    summit: Callable[[], Column] | None = None
    score: Callable[[], Column] | None = None
    loose: bool = False
    summit_optional: bool = False


FORMATS = {
    "bed": RegionFormat("track", lambda: _int(1), score=lambda: _float(4), loose=True),
    "bed3-summit": RegionFormat("comment", lambda: _int(1), summit=lambda: _int(3)),
    "macs": RegionFormat("table", lambda: _int(1) - 1, summit=lambda: _int(4) + _int(1) - 1, score=lambda: _float(6)),
    "macs2": RegionFormat("table", lambda: _int(1) - 1, summit=lambda: _int(4) - 1, score=lambda: _float(6)),
    "narrowpeak": RegionFormat("track", lambda: _int(1), summit=lambda: F.when(_int(9) != -1, _int(1) + _int(9)), score=lambda: _float(4), summit_optional=True),
    "broadpeak": RegionFormat("track", lambda: _int(1), score=lambda: _float(4)),
    "manorm": RegionFormat("table", lambda: _int(1) - 1, summit=lambda: _int(3) - 1, score=lambda: _float(4)),
}


def region_format(name: str) -> RegionFormat:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown region format {name!r}; known: {', '.join(FORMATS)}")
    return FORMATS[name.lower()]


def is_header(line: Column, kind: str) -> Column:
    marked = line.startswith("#")
    if kind == "track":
        return marked | line.startswith("track") | line.startswith("browser")
    if kind == "table":
        return marked | (F.split_part(line, F.lit("\t"), F.lit(1)) == "chr")
    return marked


def parse_region_lines(lines: DataFrame, name: str) -> DataFrame:
    """(file, line_no, line) to (file, line_no, line, chrom, start, end, summit, score, bad).

    `bad` marks data lines that break the format; leading headers and blank lines are gone.
    """
    fmt = region_format(name)
    rows = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line != ''")
    rows = rows.withColumn("header", is_header(F.col("line"), fmt.headers))
    first = F.min(F.when(~F.col("header"), F.col("line_no"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("first", first).filter("line_no >= first").drop("first", "header")
    rows = rows.withColumn("f", F.split("line", "\t"))
    summit = fmt.summit() if fmt.summit else F.lit(None)
    score = fmt.score() if fmt.score else F.lit(None)
    got = rows.select(
        "file",
        "line_no",
        "line",
        _field(0).alias("chrom"),
        fmt.start().alias("start"),
        _int(2).alias("end"),
        summit.cast("long").alias("summit"),
        score.cast("double").alias("score"),
        _int(9).isNull().alias("no_tenth"),
    )
    bad = F.col("start").isNull() | F.col("end").isNull()
    if fmt.summit_optional:
        bad = bad | F.col("no_tenth")
    elif fmt.summit:
        bad = bad | F.col("summit").isNull()
    if fmt.score and not fmt.loose:
        bad = bad | F.col("score").isNull()
    return got.withColumn("bad", bad).drop("no_tenth")


def with_summit(regions: DataFrame) -> DataFrame:
    """Regions without a summit take their middle."""
    return regions.withColumn("summit", F.coalesce("summit", F.floor((F.col("start") + F.col("end")) / 2)).cast("long"))


def summit_inside(regions: DataFrame) -> DataFrame:
    """Add summit_ok: the summit lies in the region; such regions are reported, not dropped."""
    return regions.withColumn("summit_ok", (F.col("start") <= F.col("summit")) & (F.col("summit") < F.col("end")))


def file_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, line) of text files in file order, numbers from 1."""
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def read_regions(spark: SparkSession, path: str, format: str = "bed") -> DataFrame:
    """Typed regions of a file in file order (region_id from 0), summits filled in.

    The first line that breaks the format raises RegionFormatError; a region that doesn't start before its end, ValueError.
    """
    parsed = parse_region_lines(file_lines(spark, path), format)
    wrong = parsed.filter(F.col("bad") | (F.col("start") >= F.col("end"))).orderBy("line_no").first()
    if wrong is not None:
        if wrong["bad"]:
            raise RegionFormatError(wrong["line_no"], wrong["line"], format)
        raise ValueError(f"the region of line {wrong['line_no']} doesn't start before its end: {wrong['line']!r}")
    order = Window.partitionBy("file").orderBy("line_no")
    numbered = parsed.withColumn("region_id", (F.row_number().over(order) - 1).cast("long"))
    return with_summit(numbered).select("region_id", "chrom", "start", "end", "summit", "score")
