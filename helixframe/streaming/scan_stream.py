"""Scans of regions that arrive as files: the same narrow pass on a stream, and running counts with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.matrix import Pwm
from helixframe.operators.scan import scan

ARRIVALS = "region_id long, w_start long, seq string, arrived timestamp"


def arrivals(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Regions with their sequences from Parquet files as they appear."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_stream(stream: DataFrame, pwms: Sequence[Pwm], cutoffs: Sequence[float], strand: str = "both") -> DataFrame:
    """Sites of a stream of regions. Scan and thinning are within a region, so there is no state."""
    return scan(stream, pwms, cutoffs=cutoffs, strand=strand, dedup=True)


def arrivals_per_window(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Regions and bases by time of arrival; state older than the watermark is dropped."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.length("seq")).alias("n_bases"))
