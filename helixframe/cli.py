"""Command line: config, genome, motif and scan."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from helixframe import __version__
from helixframe.catalog import Catalog
from helixframe.errors import HelixError
from helixframe.sources.regions import FORMATS

log = logging.getLogger("helixframe")


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return n


def natural(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError(f"{text} is negative")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description="Scan sequences for known motifs on Spark.")
    top.add_argument("-v", "--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--verbose", action="store_true", help="show debug messages")
    common.add_argument("--catalog", help="catalog file")

    config = commands.add_parser("config", parents=[common], help="show or change the catalog")
    config.add_argument("--show", action="store_true")
    for kind in ("genome", "motif"):
        config.add_argument(f"--set-default-{kind}", metavar="PATH")
        config.add_argument(f"--get-{kind}", metavar="NAME")
        config.add_argument(f"--set-{kind}", nargs=2, metavar=("NAME", "PATH"))
        config.add_argument(f"--rm-{kind}", metavar="NAME")

    genome = commands.add_parser("genome", parents=[common], help="list, install or remove genomes")
    what = genome.add_mutually_exclusive_group(required=True)
    for flag in ("--list", "--list-remote", "--install"):
        what.add_argument(flag, action="store_true")
    what.add_argument("--search", metavar="KEYWORD")
    what.add_argument("--uninstall", metavar="NAME")
    genome.add_argument("-n", "--name")
    genome.add_argument("-i", "--fasta", nargs="+", metavar="FASTA")
    genome.add_argument("-a", "--annotation", metavar="GENES")
    genome.add_argument("-r", "--remote", metavar="ASSEMBLY")
    genome.add_argument("-o", "--output", metavar="DIR")
    genome.add_argument("--database", choices=["ucsc"], default="ucsc")
    genome.add_argument("--clean", action="store_true", help="remove downloads when installed")

    motif = commands.add_parser("motif", parents=[common], help="list, install, build or remove motif sets")
    what = motif.add_mutually_exclusive_group(required=True)
    for flag in ("--list", "--list-remote", "--install"):
        what.add_argument(flag, action="store_true")
    what.add_argument("--build", metavar="NAME")
    what.add_argument("--uninstall", metavar="NAME")
    motif.add_argument("-n", "--name")
    motif.add_argument("-i", "--pfms", nargs="+", metavar="FILE")
    motif.add_argument("-r", "--remote", metavar="SET")
    motif.add_argument("-o", "--output", metavar="DIR")
    motif.add_argument("--database", choices=["jaspar_core", "jaspar_collections"], default="jaspar_core")
    motif.add_argument("-g", "--genome")
    motif.add_argument("--n-random", type=positive, default=1_000_000)
    motif.add_argument("--n-repeat", type=positive, default=1)
    motif.add_argument("--max-n", type=natural, default=0)
    motif.add_argument("--seed", type=natural)
    motif.add_argument("-t", "--threads", type=positive, default=1, help="cores of a local session")

    scan = commands.add_parser("scan", parents=[common], help="scan regions")
    scan.add_argument("-i", "--input", required=True)
    scan.add_argument("-f", "--format", default="bed", choices=list(FORMATS))
    scan.add_argument("-m", "--motif", required=True)
    scan.add_argument("-g", "--genome", required=True)
    scan.add_argument("-p", "--p-value", default="1e-4", choices=[f"1e-{e}" for e in range(2, 7)])
    scan.add_argument("--loc", choices=["promoter", "distal"])
    scan.add_argument("--upstream", type=natural, default=4000)
    scan.add_argument("--downstream", type=natural, default=2000)
    scan.add_argument("-w", "--window", type=natural, default=1000)
    scan.add_argument("--strand", choices=["both", "+", "-"], default="both")
    scan.add_argument("--no-enrich", action="store_true")
    scan.add_argument("--n-random", type=positive, default=5)
    scan.add_argument("--seed", type=natural)
    scan.add_argument("-c", "--control")
    scan.add_argument("--cf", "--control-format", dest="control_format", default="bed", choices=list(FORMATS))
    scan.add_argument("-t", "--threads", type=positive, default=1, help="cores of a local session")
    scan.add_argument("-o", "--output", required=True)
    scan.add_argument("--site", action="store_true", help="write BED files of sites")
    scan.add_argument("--plot", action="store_true", help="write the data behind profile plots")
    return top


def session(threads: int = 1):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("helixframe").config("spark.ui.enabled", "false")
    if not os.environ.get("SPARK_MASTER") and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{threads}]")
    return builder.getOrCreate()


def _need(top: argparse.ArgumentParser, args: argparse.Namespace, *names: str) -> None:
    missing = [n for n in names if not getattr(args, n)]
    if missing:
        top.error(f"needed here: {', '.join('--' + n for n in missing)}")


def run_config(args: argparse.Namespace, catalog: Catalog) -> None:
    changed = False
    for kind, section in (("genome", catalog.genomes), ("motif", catalog.motifs)):
        if path := getattr(args, f"set_default_{kind}"):
            section.root, changed = path, True
        if pair := getattr(args, f"set_{kind}"):
            section[pair[0]], changed = pair[1], True
        if name := getattr(args, f"rm_{kind}"):
            del section[name]
            changed = True
        if name := getattr(args, f"get_{kind}"):
            print(section[name])
    if args.show:
        for kind, section in (("genome", catalog.genomes), ("motif", catalog.motifs)):
            print(f"[{kind}] {section.root}")
            for name, path in section.names():
                print(f"{name}\t{path}")
    if changed:
        catalog.save()


def _fetched(args: argparse.Namespace, urls: list[str], folder: str) -> list[str]:
    from helixframe.sources.archives import unpack
    from helixframe.sources.remote import download

    os.makedirs(folder, exist_ok=True)
    out = []
    for url in urls:
        path = download(url, os.path.join(folder, os.path.basename(url)))
        if path.endswith((".gz", ".zip")):
            unpack(path, path + ".txt")
            path += ".txt"
        out.append(path)
    return out


def run_genome(top: argparse.ArgumentParser, args: argparse.Namespace, catalog: Catalog) -> None:
    from helixframe import jobs
    from helixframe.sources import remote

    if args.list:
        for name, path in catalog.genomes.names():
            print(f"{name}\t{path}")
    elif args.uninstall:
        jobs.uninstall(catalog, catalog.genomes, args.uninstall)
    elif args.list_remote or args.search is not None:
        with remote.urlopen(remote.UCSC_LIST) as answer:
            listed = remote.parse_assemblies(answer.read().decode())
        word = (args.search or "").lower()
        for name, text in listed:
            if word in name.lower() or word in text.lower():
                print(f"{name}\t{text}")
    else:
        if args.remote and (args.fasta or args.annotation):
            top.error("--remote excludes --fasta and --annotation")
        if args.remote:
            folder = os.path.join(catalog.genomes.root, "_downloads")
            with remote.urlopen(remote.UCSC_LIST) as answer:
                known = [name for name, _ in remote.parse_assemblies(answer.read().decode())]
            seq = remote.first_present(args.remote, known, remote.sequence_urls(args.remote), "sequence")
            gene = remote.first_present(args.remote, known, [remote.gene_url(args.remote)], "gene")
            fasta, genes = _fetched(args, [seq, gene], folder)
            jobs.install_genome(session(), catalog, args.name or args.remote, [fasta], genes, args.output)
            if args.clean:
                import shutil

                shutil.rmtree(folder)
        else:
            _need(top, args, "name", "fasta", "annotation")
            jobs.install_genome(session(), catalog, args.name, args.fasta, args.annotation, args.output)


def run_motif(top: argparse.ArgumentParser, args: argparse.Namespace, catalog: Catalog) -> None:
    from helixframe import jobs
    from helixframe.sources import remote

    if args.list:
        for name, path in catalog.motifs.names():
            print(f"{name}\t{path}")
    elif args.list_remote:
        for database, name in remote.jaspar_sets():
            if database == args.database:
                print(name)
    elif args.uninstall:
        jobs.uninstall(catalog, catalog.motifs, args.uninstall)
    elif args.build:
        _need(top, args, "genome")
        jobs.build_motifs(session(args.threads), catalog, args.build, args.genome, args.n_random, args.n_repeat, args.max_n, args.seed)
    else:
        if args.remote and args.pfms:
            top.error("--remote excludes --pfms")
        files = args.pfms
        if args.remote:
            files = _fetched(args, [remote.pfms_url(args.database, args.remote)], os.path.join(catalog.motifs.root, "_downloads"))
        if not files:
            top.error("needed here: --pfms or --remote")
        name = args.name or args.remote
        if not name:
            top.error("needed here: --name")
        jobs.install_motifs(catalog, name, files, args.output)
        if args.genome:
            jobs.build_motifs(session(args.threads), catalog, name, args.genome, args.n_random, args.n_repeat, args.max_n, args.seed)


def run_scan(args: argparse.Namespace, catalog: Catalog) -> None:
    from helixframe import jobs

    jobs.scan_regions(
        session(args.threads), catalog, args.input, args.motif, args.genome, args.output, region_format=args.format, p_value=args.p_value, location=args.loc, upstream=args.upstream, downstream=args.downstream,
        width=args.window, strand=args.strand, enrich=not args.no_enrich, n_random=args.n_random, seed=args.seed, control_path=args.control, control_format=args.control_format, beds=args.site, profiles=args.plot,
    )


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(name)s %(levelname)s: %(message)s" if args.verbose else "%(message)s")
    try:
        catalog = Catalog(args.catalog)
        if args.command == "config":
            run_config(args, catalog)
        elif args.command == "genome":
            run_genome(top, args, catalog)
        elif args.command == "motif":
            run_motif(top, args, catalog)
        else:
            run_scan(args, catalog)
    except (HelixError, ValueError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
