"""Schemas of the typed tables."""

from __future__ import annotations

REGION = "region_id long, chrom string, start long, end long, summit long, score double"
GENE = "ord long, chrom string, tss long, strand string, name string"
CHROM_SEQ = "chrom string, chunk_id int, chunk_start long, seq string"
BG_FREQ = "a double, c double, g double, t double"
PFM = "motif_idx int, matrix_id string, name string, length int, counts array<array<int>>"
PWM = "motif_idx int, matrix_id string, name string, length int, w array<array<double>>, cutoffs map<string,double>"
SITE = "motif_idx int, region_id long, start long, score double, strand string"
ENRICHMENT = "name string, n_input long, n_control long, fold_change double, p_enriched double, p_depleted double, p_corrected double"
BASES = "ACGT"
