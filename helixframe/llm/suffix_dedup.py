"""Removal of repeated strings: every byte covered by a `LENGTH`-byte string that starts anywhere else too.

Strings are bytes of one text each and are judged on the input. Equal strings have to meet first. Each window of
LENGTH bytes has an anchor: the leftmost least hash of its GRAM-byte substrings, so equal windows have equal anchors;
neighbouring windows mostly share one, which makes a run. Runs (about one to 80 bytes) are counted by anchor, added
up before the shuffle; runs of anchors met once are done. A run whose whole context is met again is repeated in
full, however many copies there are. What is left are different contexts of one anchor (the ends of
repeats): their bytes, one context each, go to shards.

A shard is decided by its suffix array: Larsson-Sadakane refinement in numpy (groups by the first 8 bytes, then
doubling, only groups not yet sorted, until none is left), Kasai's common prefixes in parallel lanes, and runs of
suffixes with LENGTH bytes in common. An anchor with more than `SHARD_ITEMS` contexts is split over several shards; these write the sorted
hashes of the windows that they could not decide, cut in ranges by binary search, and a range's arrays are merged by binary
search again. No key, however frequent, meets in one task.

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing. Very long texts are read whole, in
pieces. Repeated rows of LENGTH bytes or more are removed whole, each of them: ties have no first. An empty table gives an
empty table. Rows keep their other columns. Rows are told apart by 128 bits of hash of the text; a
window is taken for another by 128 bits of hash (whole contexts, cross-shard merging) or by its bytes (within a shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.llm.common import steps, table, written

LENGTH = 200
GRAM = 40
STEP = 1 << 20
SHARD_ITEMS = 8192
SHARD_BYTES = 1 << 20

_SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = 24


# ---------------------------------------------------------------- anchors

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(n, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _powers[size] = tuple(both)
    up, down = _powers[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of the GRAM bytes from each position on."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    n = len(data) - GRAM + 1
    h = (total[GRAM:] - total[:n]) * down[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, anchor hash) of each run in texts laid one after another."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < LENGTH:
        return none
    h = gram_hashes(data)
    packed = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
    least, width = packed, 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])
    anchor = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    text = np.full(len(anchor), -1, np.int64)
    for i in np.flatnonzero(ends - starts >= LENGTH):
        text[starts[i] : ends[i] - LENGTH + 1] = i
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge - 1, [len(anchor) - 1]])
    ok = text[first] >= 0
    first, last = first[ok], last[ok]
    return text[first], anchor[first], first, last, h[anchor[first]]


RUN_FIELDS = "h long, c long, k1 long, k2 long, lo int, hi int, at int"


def run_rows(texts: list) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of texts, h, c, lo, hi, anchor) of all runs; c is a hash of the run's whole context with its place."""
    whole = [t or b"" for t in texts]
    pieces: list[tuple[int, int, bytes]] = []
    for i, t in enumerate(whole):
        for a in range(0, max(len(t) - LENGTH + 1, 0), 4 * STEP):
            pieces.append((i, a, t[a : a + 4 * STEP + LENGTH - 1]))
    held, size = [], 0
    for piece in [*pieces, None]:
        if piece is None or (held and size + len(piece[2]) > 2 * STEP):
            if held:
                joined = b"".join(p[2] for p in held)
                ends = np.cumsum([len(p[2]) for p in held])
                starts = ends - [len(p[2]) for p in held]
                text, anchor, first, last, h = runs(np.frombuffer(joined, np.uint8), starts, ends)
                digest = xxhash.xxh3_64_intdigest
                c = np.array([digest(joined[a : b + LENGTH], p - a) for a, b, p in zip(first.tolist(), last.tolist(), anchor.tolist())], np.uint64)
                shift = np.array([p[1] for p in held])[text] - starts[text]
                yield np.array([p[0] for p in held])[text], h.view(np.int64), c.view(np.int64), first + shift, last + shift, anchor + shift
            held, size = [], 0
        if piece is not None:
            held.append(piece)
            size += len(piece[2])


def anchors(docs: DataFrame) -> DataFrame:
    """RUN_FIELDS of all runs of all rows; docs has k1, k2 and text."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                keys = [part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
                for row, h, c, lo, hi, at in run_rows(part.column(2).to_pylist()):
                    cols = [h, c, keys[0][row], keys[1][row], lo.astype(np.int32), hi.astype(np.int32), at.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[f.split(" ")[0] for f in RUN_FIELDS.split(", ")])

    return docs.select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(run, RUN_FIELDS)


# ---------------------------------------------------------------- suffix arrays


def words8(data: np.ndarray) -> np.ndarray:
    """Big-endian value of the 8 bytes from each position on; zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) with suffixes told apart by at least `depth` bytes (all of them if none), by refinement of groups.

    Only the full order is fit for Kasai's rule: suffixes tied at `depth` lie in the order of their places. rank is the
    place of the last member of a suffix's group; groups of one are sorted and never touched again.
    """
    n = len(data)
    key = words8(data)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    rank = np.empty(n, np.int64)

    def number(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes at sorted places, `new` marking the first of each group; returns the group's sizes by place."""
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(new)))
        rank[sa[places]] = np.repeat(places[begins + sizes - 1], sizes)
        return np.repeat(sizes, sizes)

    places = np.arange(n)
    size = number(places, np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, int)
    k = 8
    while depth is None or k < depth:
        places = places[size > 1]
        if not len(places):
            break
        at = sa[places]
        own = rank[at]
        # Past the end the shorter suffix comes first, so that zero bytes at the end leave no tie.
        ahead = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, n - at - k)
        order = np.argsort(own * (n + 1 + k) + ahead, kind="stable")
        sa[places] = at[order]
        own, ahead = own[order], ahead[order]
        size = number(places, np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])]))
        k *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """By place in the suffix array: bytes in common with the suffix before it, at most cap (Kasai's rule).

    Positions are walked in order, as their common prefix shrinks by one byte at most from one to the next; each lane
    walks a block of its own.
    """
    n = len(data)
    word = words8(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    block = -(-n // lanes)
    start = np.arange(0, n, block)
    h = np.zeros(len(start), np.int64)
    for j in range(block):
        i = start + j
        if i[-1] >= n:
            start, h, i = start[:-1], h[:-1], i[:-1]
            if not len(i):
                break
        phi = before[i]
        h = np.where(phi < 0, 0, np.maximum(h - 1, 0))
        live = np.flatnonzero(phi >= 0)
        while len(live):
            a, b = i[live] + h[live], phi[live] + h[live]
            room = np.minimum(n - np.maximum(a, b), cap - h[live])
            fits = room > 0
            live, a, b, room = live[fits], a[fits], b[fits], room[fits]
            diff = word[a] ^ word[b]
            same = np.where(diff == 0, 8, 0)
            some = diff != 0
            if some.any():  # equal leading bytes of the two words
                d = diff[some]
                lead = np.zeros(len(d), np.int64)
                alive = np.ones(len(d), bool)
                for s in (56, 48, 40, 32, 24, 16, 8, 0):
                    alive &= (d >> np.uint64(s)) & np.uint64(255) == 0
                    lead += alive
                same[some] = lead
            h[live] += np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        plcp[i] = h
    return plcp[sa]


def repeated_starts(items: list[bytes]) -> list[np.ndarray]:
    """For each item, which of its windows of LENGTH bytes occur at another place of the items too."""
    joined = b"".join(items)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(x) for x in items])
    starts = ends - [len(x) for x in items]
    valid = np.zeros(len(data), bool)
    for a, b in zip(starts, ends):
        valid[a : b - LENGTH + 1] = True
    sa, _ = suffix_array(data)
    lcp = common_prefixes(data, sa, LENGTH)
    group = np.cumsum(lcp < LENGTH) - 1
    sorted_valid = valid[sa]
    members = np.bincount(group[sorted_valid], minlength=int(group[-1]) + 1 if len(group) else 0)
    again = np.zeros(len(data), bool)
    again[sa] = sorted_valid & (members[group] > 1)
    return [again[a : b - LENGTH + 1] for a, b in zip(starts, ends)]


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, past last) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ---------------------------------------------------------------- shards

ITEM_FIELDS = "h long, salt int, parts int, c long, m long, k1 long, k2 long, lo int, hi int, context binary"


def contexts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """ITEM_FIELDS: the bytes of each item's context, from one row of its text."""
    wanted = items.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "salt", "parts", "c", "m", "lo", "hi")).alias("wanted"))
    # Written apart from the join, so that a text with many copies can be split; a context that two tasks give links like one,
    # as all of a copied text is repeated anyway.
    wanted = written(wanted, "suffix-wanted")
    joined = docs.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", F.col("text").cast("binary").alias("text"), "wanted")

    def cut(batches):
        seen = set()
        for batch in batches:
            for part in steps(batch, "text"):
                rows: dict[str, list] = {f.split(" ")[0]: [] for f in ITEM_FIELDS.split(", ")}
                for k1, k2, text, wanted_ in zip(*[part.column(i).to_pylist() for i in range(4)]):
                    if (k1, k2) in seen:
                        continue
                    seen.add((k1, k2))
                    for w in wanted_:
                        for name in ("h", "salt", "parts", "c", "m", "lo", "hi"):
                            rows[name].append(w[name])
                        rows["k1"].append(k1)
                        rows["k2"].append(k2)
                        rows["context"].append(text[w["lo"] : w["hi"] + LENGTH])
                yield pa.RecordBatch.from_pydict(rows, schema=ITEM_SCHEMA)

    return joined.mapInArrow(cut, ITEM_FIELDS)


ITEM_SCHEMA = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("parts", pa.int32()), ("c", pa.int64()), ("m", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary())])
#: Of a shard: a decided interval (range null), or the sorted undecided windows of one range of hashes.
SHARD_FIELDS = "k1 long, k2 long, a int, b int, h long, range int, windows binary"
SHARD_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("h", pa.int64()), ("range", pa.int32()), ("windows", pa.binary())])
#: Two hashes of a window, how many of its shard have it (2 for more), the text and the window's start.
WINDOW = np.dtype([("x", "<u8"), ("y", "<u8"), ("m", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i8")])


def range_of(parts: int) -> int:
    """Bits of the hash that name a range: about as many ranges as shards."""
    return max(1, (parts - 1).bit_length())


def shard(rows: list[dict]) -> Iterator[dict]:
    """Decide the windows of one shard; undecided ones of split anchors go on to the merging."""
    for row, again in zip(rows, repeated_starts([r["context"] for r in rows])):
        row["again"] = again
        if row["m"] == 1:
            for a, b in intervals(again):
                yield {"k1": row["k1"], "k2": row["k2"], "a": row["lo"] + a, "b": row["lo"] + b - 1 + LENGTH}
    split: dict[int, list] = {}
    for row in rows:
        if row["parts"] > 1:
            split.setdefault(row["h"], []).append(row)
    for h, own in split.items():
        found = []
        for row in own:
            text, d3, d64 = row["context"], xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
            for s in range(len(row["again"])):
                window = text[s : s + LENGTH]
                found.append((d3(window), d64(window), 2 if row["m"] > 1 or row["again"][s] else 1, row["k1"], row["k2"], row["lo"] + s))
        windows = np.array(found, WINDOW)
        windows = windows[np.lexsort((-windows["m"], windows["y"], windows["x"]))]
        # One of the windows known to be repeated stands for all of its kind.
        fresh = np.concatenate([[True], (windows["x"][1:] != windows["x"][:-1]) | (windows["y"][1:] != windows["y"][:-1])])
        windows = windows[fresh]
        bits = range_of(own[0]["parts"])
        cuts = np.searchsorted(windows["x"], (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)))
        for r, piece in enumerate(np.split(windows, cuts)):
            if len(piece):
                yield {"h": h, "range": r, "windows": piece.tobytes()}


def shards(items: DataFrame) -> DataFrame:
    """SHARD_FIELDS of all shards: items of one (h, salt) are neighbours, and small anchors share a suffix array."""
    dealt = items.repartition("h", "salt").sortWithinPartitions("h", "salt")

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            out = list(shard(held))
            return pa.RecordBatch.from_pylist(out, schema=SHARD_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["h"], row["salt"])
                if key != last and size > SHARD_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row["context"])
                last = key
        if held:
            yield flush()

    return dealt.mapInArrow(run, SHARD_FIELDS)


def merged(pieces: DataFrame) -> DataFrame:
    """(k1, k2, a, b) of windows that several shards of one anchor hold: their sorted arrays of one range, merged."""
    dealt = pieces.select("h", "range", "windows").repartition("h", "range").sortWithinPartitions("h", "range")

    def decide(arrays: list[np.ndarray]) -> list[dict]:
        total, out = arrays[0].copy(), []
        for own in arrays[1:]:
            # Look up each of the shard's windows among those so far by binary search on the hashes.
            at = np.searchsorted(total["x"], own["x"])
            same, probe, rest = np.zeros(len(own), bool), at.copy(), np.arange(len(own))
            while len(rest):
                rest = rest[(probe[rest] < len(total)) & (total["x"][np.minimum(probe[rest], len(total) - 1)] == own["x"][rest])]
                hit = total["y"][probe[rest]] == own["y"][rest]
                same[rest[hit]] = True
                rest = rest[~hit]
                probe[rest] += 1
            out += [own[same & (own["m"] == 1)], (found := total[probe[same]])[found["m"] == 1]]
            total["m"][probe[same]] = 2
            total = np.insert(total, at[~same], own[~same])
        return [{"k1": int(w["k1"]), "k2": int(w["k2"]), "a": int(w["s"]), "b": int(w["s"]) + LENGTH} for part in out for w in part]

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches):
        last, arrays = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["h"], row["range"])
                if key != last and arrays:
                    yield pa.RecordBatch.from_pylist(decide(arrays), schema=schema)
                    arrays = []
                last = key
                arrays.append(np.frombuffer(row["windows"], WINDOW))
        if arrays:
            yield pa.RecordBatch.from_pylist(decide(arrays), schema=schema)

    return dealt.mapInArrow(run, "k1 long, k2 long, a int, b int")


# ---------------------------------------------------------------- operator


def repeated_intervals(keyed: DataFrame) -> DataFrame:
    """(k1, k2, spans): repeated intervals [a, b) of each text that has some, not yet merged."""
    all_runs = written(anchors(keyed), "suffix-anchors")
    # Written apart from the join: a join straight on its own counts would share their exchange, which can't be split
    # where one anchor has many runs.
    met = written(all_runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "suffix-met")
    again = written(all_runs.join(met, "h"), "suffix-again")
    place = F.struct("k1", "k2", "lo", "hi")
    kinds = again.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("place"))
    kinds = written(kinds, "suffix-kinds")
    whole = again.join(kinds.filter("m > 1").select("h", "c"), ["h", "c"])
    found = whole.select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))
    several = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("nc")).filter("nc > 1"), "suffix-several")
    parts = F.ceil(F.col("nc") / SHARD_ITEMS).cast("int")
    items = kinds.join(several, "h").select("h", "c", "m", "place.*", parts.alias("parts"))
    items = items.withColumn("salt", F.pmod(F.col("c"), F.col("parts")).cast("int"))
    decided = written(shards(contexts(items, keyed)), "suffix-shards")
    cross = merged(decided.filter("range is not null"))
    spans = found.unionByName(decided.filter("range is null").select("k1", "k2", "a", "b")).unionByName(cross)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merge(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeats_removed(docs: DataFrame) -> DataFrame:
    """Every row of docs with removed (merged spans of bytes) and kept (the bytes left; null for a null text)."""
    k1, k2 = F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    # Written apart from the join, as above.
    spans = written(repeated_intervals(keyed), "suffix-spans")
    keep = [c for c in docs.columns if c.lower() not in ("removed", "kept")]
    # The row's own columns travel in one struct, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs["text"].cast("binary").alias("raw"), k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "raw", "spans")
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def cut(batches):
        for batch in batches:
            for part in steps(batch, "raw"):
                texts = part.column(1).to_pylist()
                removed = [merge(s) for s in part.column(2).to_pylist()]
                kept = []
                for t, r in zip(texts, removed):
                    at, out = 0, []
                    for a, b in r:
                        out.append(t[at:a])
                        at = b
                    kept.append(None if t is None else b"".join([*out, t[at:]]))
                cols = [part.column(0), pa.array([[{"a": a, "b": b} for a, b in r] for r in removed], spans_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "removed", "kept"])

    schema = StructType(joined.select("row").schema.fields + StructType.fromDDL("removed array<struct<a:int,b:int>>, kept binary").fields)
    return joined.mapInArrow(cut, schema).select("row.*", "removed", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    taken = F.aggregate("removed", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return got.select("doc_id", n.alias("n_bytes"), taken.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


#: The same rows by counting every string of LENGTH bytes, in hexadecimal.
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS s, h FROM t WHERE length(h) >= {2 * LENGTH}),
k AS (SELECT r, s, md5(substr(h, CAST(2 * s + 1 AS INT), {2 * LENGTH})) AS k FROM w),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
marked AS (SELECT r, s, CASE WHEN s - lag(s) OVER o <= {LENGTH} THEN 0 ELSE 1 END AS new FROM again WINDOW o AS (PARTITION BY r ORDER BY s)),
numbered AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS i FROM marked),
spans AS (SELECT r, i, min(s) AS a, max(s) + {LENGTH} AS b FROM numbered GROUP BY r, i),
gaps AS (SELECT r, b AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), {1 << 40}) AS b FROM spans UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (least(b, length(h) // 2) - a) AS BIGINT)), '' ORDER BY a) AS h FROM gaps g JOIN t ON g.r = t.r WHERE b > a AND a < length(h) // 2 GROUP BY g.r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN sums.r IS NULL THEN t.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM t LEFT JOIN sums ON t.r = sums.r LEFT JOIN kept ON t.r = kept.r"""
