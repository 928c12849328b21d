"""Near copies by word shingles: links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

Words as for SimHash; a text of fewer words is one shingle. Texts with equal sets are one node. Links are decided by the
whole sets (9 |A and B| >= 4 (|A| + |B|), integers); only the candidates come from keys. One key is the SimHash group:
fingerprints of the five-word shingles, repeats included, linked by the pigeonring filter and Hamming distance as in
`simhash`, and their components. Most pairs at similarity 0.8 differ in more bits than SimHash links, so MinHash adds `BANDS`
keys of `ROWS` minima: a pair at 0.8 shares none of them with probability (1 - 0.8^5)^32 = 3e-6, above it with less.

Candidates are never listed as pairs. Nodes that share keys, directly or over others, make a cluster. Only the texts of
nodes in clusters are read again for their sets. A node weighs as many as its shingles and `EACH` more. A cluster of weight
up to `BLOCK` is decided in one task by breadth-first search. In a larger one every key's nodes meet the key's least node
in blocks of about that weight; keys whose nodes then still lie in several components have all pairs of their blocks decided.
So a group of near copies costs in proportion to its size; a larger key of nodes that are not linked costs as many
copies of each of its sets as it has blocks. A task holds one or two blocks of sets, whatever the lengths of the texts.

Defined results: null and empty texts have the empty set and are copies of each other; very long texts are compared whole;
a similarity of exactly 0.8 links. Rows, ids, ties and keepers are as in `simhash`; repeated rows are members each; an empty
table gives an empty table. Shingles are told apart by 64 bits of hash, sets by 64 bits of hash of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import simhash
from helixframe.llm.common import per_text, small_batches, spare_memory, steps, written

WIDTH = 5
BANDS = 32
ROWS = 5
EACH = 8192
#: Weight of the nodes that meet in one task: 4 million shingles, or 512 short texts.
BLOCK = 1 << 22
_DRAWN = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64).astype(np.uint32)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint32(1)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(np.array(simhash.shingle_hashes(t or b"", WIDTH), np.uint64)) for t in texts]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each of some sets, none of them empty."""
    high = np.concatenate(sets) >> np.uint64(32)
    high = high.astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    minima = np.stack([np.minimum.reduceat((high ^ x) * a, starts) for x, a in zip(_XOR, _TIMES)], axis=1)
    digest = xxhash.xxh3_64_intdigest
    rows = [r.reshape(BANDS, ROWS) for r in minima]
    return np.array([[digest(band.tobytes(), k) for k, band in enumerate(r)] for r in rows], np.uint64).view(np.int64)


def _kernel(texts: list) -> dict:
    spare_memory()
    sets: list[np.ndarray] = []

    def hashes():
        for t in texts:
            got = simhash.shingle_hashes(t or b"", WIDTH)
            sets.append(np.unique(np.array(got, np.uint64)))
            yield got

    prints = simhash.voted(hashes(), len(texts))
    keys: list = [[]] * len(sets)
    full = [i for i, s in enumerate(sets) if len(s)]
    for at in range(0, len(full), 64):
        some = full[at : at + 64]
        for i, own in zip(some, band_keys([sets[i] for i in some])):
            keys[i] = own
    return {"u": _names(sets), "size": [len(s) for s in sets], "keys": keys, "fp": prints}


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits of hash of each set."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links within some distinct sets, as places in the list."""
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(sizes)
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            own, n = sets[x], sizes[x]
            # Of similar sets the smaller has at least 4/5 of the larger one's shingles.
            alike = left[(5 * sizes[left] >= 4 * n) & (4 * sizes[left] <= 5 * n)]
            near = []
            for y in alike.tolist():
                other = sets[y]
                both = np.count_nonzero(own[np.minimum(np.searchsorted(own, other), n - 1)] == other)
                if 9 * both >= 4 * (len(other) + n):
                    near.append(y)
            if near:
                edges += [(x, y) for y in near]
                front += near
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def decided(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that span the components within each group of groups (g, u); sets has u and grams."""
    rows = groups.join(sets, "u").select("g", "u", "grams")
    dealt = rows.repartition("g").sortWithinPartitions("g")

    def run(batches):
        spare_memory()
        last, us, held = None, [], []

        def flush():
            found = linked(held)
            a, b = zip(*pairs) if (pairs := [sorted((us[i], us[j])) for i, j in found if us[i] != us[j]]) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            gs, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g, u, raw in zip(gs, own, batch.column(2)):
                if g != last and us:
                    yield flush()
                    us, held = [], []
                last = g
                us.append(u)
                held.append(np.frombuffer(raw.as_py(), np.uint64))
        if us:
            yield flush()

    return dealt.mapInArrow(run, "a long, b long")


def _blocks(weight: Column, block: int) -> Column:
    return F.ceil(weight / block).cast("int")


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(u, grams) of the nodes in chosen (u, doc_id, h), read from the one text of that id and hash."""
    wanted = chosen.select("u", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    rows = slim.join(wanted.hint("shuffle_hash"), same).select("u", F.col("text").cast("binary").alias("text"))

    def run(batches):
        spare_memory()
        seen = set()  # repeated rows give one set; one that is read twice links like its twin
        for batch in batches:
            for part in steps(batch, "text"):
                us, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                new = [i for i, u in enumerate(us) if u not in seen and not seen.add(u)]
                sets = shingle_sets([texts[i] for i in new])
                grams = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in new], pa.int64()), grams], names=["u", "grams"])

    return rows.mapInArrow(run, "u long, grams binary")


def group_keys(rows: DataFrame) -> DataFrame:
    """(u, key) by SimHash: texts whose fingerprints are linked, directly or over others, share a key; rows has u and fp."""
    pairs = written(rows.select("u", "fp").distinct(), "near-prints")
    roots = simhash.components(simhash.links(written(pairs.select("fp").distinct(), "near-fp"))).withColumnRenamed("node", "fp")
    return pairs.join(roots, "fp", "left").select("u", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))


def links(rows: DataFrame, unique: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: links between distinct sets that span their components; rows has u, keys and fp, unique u, size and least."""
    # MinHash keys of equal sets are equal: they are taken once, counted apart from the join on them.
    alike = written(group_keys(rows), "near-groups")
    keyed = written(rows.select("u", F.explode("keys").alias("key")).unionByName(alike).distinct(), "near-keys")
    met = keyed.groupBy("key").agg(F.min("u").alias("least"), F.max("u").alias("most"))
    met = written(met.filter("least < most").select("key", "least"), "near-met")
    members = written(keyed.join(met, "key"), "near-members")
    stars = written(members.filter("u != least").select(F.col("least").alias("a"), F.col("u").alias("b")).distinct(), "near-stars")
    # Clusters are sought between SimHash groups, each taken as its least node: far fewer edges where copies are many.
    heads = written(alike.join(met, "key").groupBy("u").agg(F.min("least").alias("head")), "near-heads")
    merged = stars
    for end in "ab":
        own = heads.select(F.col("u").alias(end), F.col("head").alias(f"head_{end}"))
        merged = merged.join(own, end, "left").withColumn(f"head_{end}", F.coalesce(f"head_{end}", end))
    merged = merged.filter("head_a != head_b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    roots = written(simhash.components(merged.distinct()), "near-roots").withColumnRenamed("node", "head")
    nodes = written(members.select("u").distinct(), "near-nodes").join(heads, "u", "left").select("u", F.coalesce("head", "u").alias("head"))
    roots = nodes.join(roots, "head", "left").select("u", F.coalesce("root", "head").alias("g"))
    cluster = written(roots.join(unique, "u").select("u", "g", (F.col("size") + EACH).alias("weight"), "least.doc_id", "least.h"), "near-clusters")
    sets = written(texts_of(docs, cluster), "near-sets")
    sizes = written(cluster.groupBy("g").agg(F.sum("weight").alias("weight")), "near-sizes")
    small = cluster.join(sizes.filter(F.col("weight") <= block).select("g"), "g").select("g", "u")
    found = decided(small, sets)
    large = sizes.filter(F.col("weight") > block)
    if large.isEmpty():
        return found.distinct()

    inside = written(cluster.join(large.select("g"), "g").select("u", "weight"), "near-inside")
    stars = stars.join(inside.withColumnRenamed("u", "b"), "b")
    parts = written(stars.groupBy("a").agg(_blocks(F.sum("weight"), block).alias("parts")), "near-parts")
    place = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    rest = stars.join(parts, "a").select(place.alias("g"), F.col("b").alias("u"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.select(F.xxhash64("a", "part").alias("g"), F.col("a").alias("u"))
    found = written(found.unionByName(decided(rest.unionByName(heads), sets)), "near-found")

    roots = written(simhash.components(found), "near-roots").select(F.col("node").alias("u"), "root")
    placed = members.join(inside, "u").join(roots, "u", "left").select("key", "u", "weight", F.coalesce("root", "u").alias("root"))
    placed = written(placed, "near-placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), _blocks(F.sum("weight"), block).alias("parts")).filter("lo < hi")
    apart = placed.join(written(open_.select("key", "parts"), "near-open"), "key").select("key", "u", "parts")
    apart = apart.withColumn("i", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    apart = apart.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))
    return found.unionByName(decided(apart.select(pair.alias("g"), "u"), sets)).distinct()


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, u, keeper) of every row, as simhash_components gives them."""
    with small_batches(docs.sparkSession):
        slim = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        rows = written(per_text(slim, "text", _kernel, "u long, size long, keys array<long>, fp long").drop("text"), "near-rows")
        own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        unique = written(rows.groupBy("u").agg(F.min(own).alias("least"), F.first("size").alias("size")), "near-unique")
        roots = simhash.components(links(rows, unique, docs, block)).withColumnRenamed("node", "u")
        placed = written(unique.join(roots, "u", "left").select("u", "least", F.coalesce("root", "u").alias("root")), "near-placed")
        keepers = placed.groupBy("root").agg(F.min("least").alias("keeper"))
        keepers = written(placed.join(keepers, "root").select("u", "keeper"), "near-keepers")
    return rows.select("doc_id", "h", "u").join(keepers, "u")
