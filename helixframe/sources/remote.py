"""Public databases of genomes and motifs: what they list and where their files are.

Everything that needs no network is pure: names, validation, addresses, search as a plan. Downloads take an `opener`
(urllib's by default), so that they can be replaced.
"""

from __future__ import annotations

import json
import re
import shutil
from collections.abc import Callable
from urllib.request import Request, urlopen
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.errors import MissingRemoteFileError, UnknownRemoteAssemblyError, UnknownRemoteMotifsError

# Addresses of the UCSC genome archive and of JASPAR 2020, and the sets of the latter.
UCSC_LIST = "https://genome.ucsc.edu/cgi-bin/das/dsn"
UCSC_FILES = "http://hgdownload.soe.ucsc.edu/goldenPath/"
JASPAR = "http://jaspar.genereg.net/"
TAXA = ("vertebrates", "plants", "insects", "nematodes", "fungi", "urochordates")
COLLECTIONS = ("CNE", "PHYLOFACTS", "SPLICE", "POLII", "FAM", "PBM", "PBM_HOMEO", "PBM_HLH", "UNVALIDATED")

Opener = Callable[..., object]


def parse_assemblies(xml: str) -> list[tuple[str, str]]:
    """(id, description) of each source of a DAS listing."""
    sources = ((e.find("SOURCE"), e.find("DESCRIPTION")) for e in ElementTree.fromstring(xml))
    return [(s.get("id"), d.text or "") for s, d in sources if s is not None and d is not None]


def assemblies(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(listed, "id string, description string")


def search(table: DataFrame, keyword: str) -> DataFrame:
    """Assemblies whose id or description holds the keyword, whatever the case."""
    word = keyword.lower()
    return table.filter(F.contains(F.lower("id"), F.lit(word)) | F.contains(F.lower("description"), F.lit(word)))


def sequence_urls(assembly: str) -> list[str]:
    """Places to try, in order."""
    return [f"{UCSC_FILES}{assembly}/bigZips/{name}" for name in (f"{assembly}.fa.gz", "chromFa.tar.gz", f"{assembly}.chromFa.tar.gz", "chromFa.zip")]


def gene_url(assembly: str) -> str:
    return f"{UCSC_FILES}{assembly}/database/refGene.txt.gz"


def first_present(assembly: str, known: list[str], urls: list[str], which: str, opener: Opener = urlopen) -> str:
    """The first address that answers."""
    if assembly not in known:
        raise UnknownRemoteAssemblyError("UCSC", assembly)
    for url in urls:
        try:
            with opener(Request(url, method="HEAD")) as answer:
                if answer.status == 200:
                    return url
        except OSError:
            continue
    raise MissingRemoteFileError("UCSC", assembly, which)


def jaspar_sets() -> list[tuple[str, str]]:
    """(database, name) of all motif sets."""
    core = [("jaspar_core", f"{t}_{kind}") for t in TAXA for kind in ("non-redundant", "redundant")]
    return core + [("jaspar_collections", c) for c in COLLECTIONS]


def pfms_url(database: str, name: str) -> str:
    """Address of a motif set; unknown names raise."""
    if database == "jaspar_core":
        m = re.fullmatch(r"([a-z]+)_(?:non-)?redundant", name)
        if m and m[1] in TAXA:
            return f"{JASPAR}download/CORE/JASPAR2020_CORE_{name}_pfms_jaspar.txt"
    elif database == "jaspar_collections":
        if name in COLLECTIONS:
            return f"{JASPAR}download/collections/JASPAR2020_{name}_pfms_jaspar.txt"
    else:
        raise ValueError(f"unknown motif database {database!r}")
    raise UnknownRemoteMotifsError(database, name)


def motif_info(matrix_id: str, opener: Opener = urlopen) -> dict:
    with opener(f"{JASPAR}api/v1/matrix/{matrix_id}/") as answer:
        return json.load(answer)


def download(url: str, to: str, opener: Opener = urlopen) -> str:
    with opener(url) as answer, open(to, "wb") as f:
        shutil.copyfileobj(answer, f)
    return to
