"""What is written: wide tables, BED files, the enrichment table, matrices, background frequencies.

Tables go out by Spark's writers, one folder a table (and one a motif for BED rows), so writing scales with the executors.
`as_file` turns one table into the single text file that other tools expect, streaming its rows in order.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame

from helixframe.functions.matrix import Pwm
from helixframe.operators.sites import bed_rows, wide

NUMBER, SCORE, ENRICHMENT, SITES = "motif_sites_number.xls", "motif_sites_score.xls", "motif_enrichment.xls", "motif_sites"


def as_file(table: DataFrame, path: str, header: Sequence[str] | None = None) -> None:
    """Rows as tab-separated text in the table's order; only a block of rows is held at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        if header is not None:
            f.write("\t".join(header) + "\n")
        for row in table.toLocalIterator():
            f.write("\t".join("" if v is None else str(v) for v in row) + "\n")


def site_tables(out: str, regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm]) -> None:
    """The number and the best score of sites by region and motif."""
    header = ["chr", "start", "end", *(m.label for m in pwms)]
    for name, value in ((NUMBER, "number"), (SCORE, "score")):
        as_file(wide(regions, sites, pwms, value).orderBy("region_id").drop("region_id"), os.path.join(out, name), header)


def site_beds(out: str, regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm]) -> None:
    """One folder of BED rows a motif, in region order within each file."""
    rows = bed_rows(regions, sites, pwms).repartitionByRange("motif_file", "region_id").sortWithinPartitions("motif_file", "region_id", "start")
    rows.select("motif_file", "chrom", "start", "end", "name", "score", "strand").write.mode("overwrite").partitionBy("motif_file").csv(os.path.join(out, SITES), sep="\t")


def site_bed_files(out: str, regions: DataFrame, sites: DataFrame, pwms: Sequence[Pwm]) -> None:
    """One BED file a motif: one sorted pass for all of them, streamed by partition; `site_beds` writes in parallel."""
    rows = bed_rows(regions, sites, pwms).orderBy("motif_file", "region_id", "start")
    os.makedirs(os.path.join(out, SITES), exist_ok=True)
    own = rows.select("motif_file", "chrom", "start", "end", "name", "score", "strand").toLocalIterator()
    for name, group in groupby(own, lambda r: r["motif_file"]):
        with open(os.path.join(out, SITES, f"{name}_sites.bed"), "w") as f:
            f.writelines("\t".join(map(str, r[1:])) + "\n" for r in group)


def enrichment_table(out: str, ranked: DataFrame) -> None:
    columns = ["name", "n_input", "n_control", "fold_change", "p_enriched", "p_depleted", "p_corrected"]
    as_file(ranked.select(*columns), os.path.join(out, ENRICHMENT), columns)
