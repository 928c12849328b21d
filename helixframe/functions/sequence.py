"""Expressions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "[-:./*]"


def base_count(seq: Column, base: str) -> Column:
    """Occurrences of a base in either case."""
    return F.length(seq) - F.length(F.translate(seq, base.upper() + base.lower(), ""))


def few_unknown(seq: Column, most: int) -> Column:
    """At most so many N."""
    return base_count(seq, "N") <= most


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def file_name(name: Column) -> Column:
    """A name without characters that file systems treat specially."""
    return F.regexp_replace(name, SPECIAL, "_")
