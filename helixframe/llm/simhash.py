"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: words are runs of bytes other than space and 9-13 after lower-casing A-Z; each 3-word shingle's XXH64
(seed 42) votes on 64 bits. Fingerprints link at `LIMIT` differing bits or fewer; groups are the connected
components of the links.

Links are found between distinct fingerprints. Candidates: the 64 bits lie on a ring of `SEGMENTS` segments; of six,
three are equal in any link, so fingerprints meet by the bits of each choice of three. Pigeonring: in any link some
segment begins a chain of consecutive segments whose l first differ in at most l * LIMIT / SEGMENTS bits
together, for every l; candidates without such a chain are pruned before the full Hamming check. Buckets of two are
checked as expressions. Larger ones, up to `BUCKET` fingerprints, give a spanning forest of their links, found by
breadth-first search over those not yet reached: all pairs are never listed. A bucket beyond that is split
exactly: its free bits are cut in four parts, of which one is equal in any link (4 > LIMIT), and so on; the fourth
split leaves 13 free bits, so at most 8192 distinct fingerprints.

Components come from alternating large-star and small-star rounds over written edge tables, with hubs split by the
skew join. Nothing about single documents reaches the driver.

Defined results: null and empty texts have fingerprint 0 and link like any other; very long texts are read whole, their
votes added up in parts. A bit with as many set as unset votes is 0. A null doc_id takes part; it is a
component's id only if the component has no other. Repeated rows are members each; `deduplicated` keeps one. An empty table
gives an empty table. Columns of any name pass `deduplicated`; fingerprints take doc_id and text alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import per_text, table, written

LIMIT = 3
SEGMENTS = 6
EQUAL = 3
WIDTH = 3
SEED = 42
BUCKET = 8192
#: Shingles whose votes are counted at once.
VOTES = 1 << 16

#: (offset, bits) of the segments on the ring.
RING = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    words = text.lower().split()  # bytes: A-Z only, and white space is 9-13 and 32
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - width]]
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprints(texts: list) -> list[int]:
    """Signed 64-bit fingerprints."""
    return voted((shingle_hashes(text or b"") for text in texts), len(texts))


def voted(hashes: Iterable[list[int]], n: int) -> list[int]:
    """Signed 64-bit fingerprints of n texts from each one's shingle hashes."""
    out = np.zeros(n, np.int64)
    held: list[int] = []
    places: list[int] = []
    starts: list[int] = []

    def count() -> None:
        if not places:
            return
        hashes = np.array(held, np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        sizes = np.diff([*starts, len(held)])
        set_ = (2 * votes > sizes[:, None]).astype(np.uint8)
        out[places] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
        held.clear(), places.clear(), starts.clear()

    for i, got in enumerate(hashes):
        if not got:
            continue
        if len(got) > VOTES:  # one very long text: its votes are added up in parts
            votes = np.zeros(64, np.int64)
            for a in range(0, len(got), VOTES):
                part = np.array(got[a : a + VOTES], np.uint64)
                votes += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits((2 * votes > len(got)).astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)[0]
            continue
        if len(held) + len(got) > VOTES:
            count()
        places.append(i)
        starts.append(len(held))
        held += got
    count()
    return out.tolist()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): h is a hash of the text that tells apart rows of one id."""
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return per_text(slim, "text", lambda texts: {"fp": fingerprints(texts)}, "fp long").select("doc_id", "h", "fp")


# ---------------------------------------------------------------- pigeonring


def ring_passes(diff: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Which differences have a start on the ring whose every chain stays within its share of the limit."""
    n = len(RING)
    d = [np.bitwise_count((diff >> np.uint64(o)) & np.uint64((1 << b) - 1)) for o, b in RING]
    passes = np.zeros(len(diff), bool)
    for i in range(n):
        chain, ok = d[i], d[i] <= limit // n
        for length in range(2, n + 1):
            if not ok.any():
                break
            chain = chain + d[(i + length - 1) % n]
            ok = ok & (chain <= length * limit // n)
        passes |= ok
    return passes


def ring_column(diff: Column, limit: int = LIMIT) -> Column:
    """The same test as an expression on a long."""
    n = len(RING)
    d = [F.bit_count(F.shiftrightunsigned(diff, o).bitwiseAND(F.lit((1 << b) - 1).cast("long"))) for o, b in RING]
    starts = []
    for i in range(n):
        chain, ok = d[i], d[i] <= limit // n
        for length in range(2, n + 1):
            chain = chain + d[(i + length - 1) % n]
            ok = ok & (chain <= length * limit // n)
        starts.append(ok)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks() -> list[int]:
    """Bits of each choice of EQUAL segments."""
    bits = [((1 << b) - 1) << o for o, b in RING]
    return [sum(c) for c in combinations(bits, EQUAL)]


def split_masks(mask: int) -> list[int]:
    """The mask with one of four parts of its free bits added, for each part."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (LIMIT + 1) for k in range(LIMIT + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def forest(fps: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket of distinct fingerprints."""
    left = fps.view(np.uint64).copy()
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            diff = left ^ x
            near = np.flatnonzero(ring_passes(diff, limit))
            near = near[np.bitwise_count(diff[near]) <= limit]
            if len(near):
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                left = np.delete(left, near)
    return [tuple(np.array(e, np.uint64).view(np.int64).tolist()) for e in edges]


# ---------------------------------------------------------------- links and components


def links(unique: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column fp) that span their components."""
    spark = unique.sparkSession
    masks = first_masks()
    rows = unique.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    found: list[DataFrame] = []
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        buckets = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        buckets = written(buckets.filter("n > 1"), "simhash-buckets")
        diff = F.col("a").bitwiseXOR(F.col("b"))
        found.append(buckets.filter((F.col("n") == 2) & ring_column(diff) & (F.bit_count(diff) <= LIMIT)).select("a", "b"))
        sizes = buckets.agg(F.max("n")).first()[0] or 0
        if sizes > 2:
            many = keyed.join(buckets.filter(F.col("n").between(3, bucket)).select("mask", "key"), ["mask", "key"])
            listed = many.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

            def spans(batches):
                import pyarrow as pa

                for batch in batches:
                    edges = [e for fps in batch.column(0) for e in forest(fps.values.to_numpy())]
                    a, b = zip(*[sorted(e) for e in edges]) if edges else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

            found.append(listed.mapInArrow(spans, "a long, b long"))
        if sizes <= bucket:
            break
        # Buckets too large for one task: their fingerprints meet again by more bits.
        children = spark.createDataFrame([(signed(m), [signed(c) for c in split_masks(m)]) for m in masks], "mask long, children array<long>")
        large = keyed.join(buckets.filter(F.col("n") > bucket).select("mask", "key"), ["mask", "key"])
        rows = large.join(F.broadcast(children), "mask").select("fp", F.explode("children").alias("mask")).distinct()
        rows = written(rows, "simhash-split")
        masks = sorted({c for m in masks for c in split_masks(m)})
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the least node that it is connected to."""
    e = written(edges.select("a", "b"), "stars")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: the larger neighbours of every node point to its least neighbour.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node and its smaller neighbours point to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(rows: DataFrame) -> DataFrame:
    """(fp, keeper) of every fingerprint: keeper is the least (null id last, doc_id, h) of its component."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    unique = written(rows.groupBy("fp").agg(F.min(own).alias("least")), "simhash-unique")
    roots = components(links(unique.select("fp"))).withColumnRenamed("node", "fp")
    placed = unique.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "simhash-roots")
    keepers = placed.groupBy("root").agg(F.min("least").alias("keeper"))
    return placed.join(keepers, "root").select("fp", "keeper")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, keeper) of every row: keeper.doc_id is the component's id."""
    rows = written(fingerprinted(docs), "simhash-fp")
    return rows.join(grouped(rows), "fp")


def deduplicated(docs: DataFrame, members: Callable[[DataFrame], DataFrame] = simhash_components) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, then text hash, then all other columns that have an order."""
    rows = written(members(docs).select("doc_id", "h", "keeper"), "simhash-members")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    stay = rows.filter(mine == F.col("keeper")).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    stay = written(stay.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n"), "simhash-stay")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_h"))
    kept = keyed.join(stay.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_h") == F.col("_h")))
    if stay.filter("n > 1").isEmpty():
        return kept.select("row.*")
    # Some kept rows are there more than once; the least of each goes on.
    kinds = [f for f in docs.schema.fields if not re.search("map<|variant|interval", f.dataType.simpleString())]
    order = F.struct(*[F.col(f"row.`{f.name}`").alias(f"c{i}") for i, f in enumerate(kinds)])
    least = kept.filter("n > 1").groupBy("_id", "_h").agg(F.min_by("row", order).alias("row"))
    return kept.filter("n = 1").select("row").unionByName(least.select("row")).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keeper.doc_id").alias("component_id"))
