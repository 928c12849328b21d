import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from helixframe.llm import simhash as S
from helixframe.llm import suffix_dedup as D


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Component number of each fingerprint of a list, all pairs compared."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_plain_counting():
    texts = [None, "", " ", "One", "one TWO", "É a b c d", "a b c a b c a b c", "x " * 200_000, "the quick brown fox jumps over"]
    assert [f % (1 << 64) for f in S.fingerprints([t and t.encode() for t in texts])] == [slow_fingerprint(t) for t in texts]


def test_every_link_passes_the_ring():
    rnd = random.Random(2)
    diffs = [sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3) for _ in range(3000)] + [0]
    assert S.ring_passes(np.array(diffs, np.uint64)).all()
    masks = [m for m in S.first_masks()]
    assert all(any(d & m == 0 for m in masks) for d in diffs)
    m = masks[7]
    for d in diffs:
        if d & m == 0:
            assert any(d & c == 0 for c in S.split_masks(m))


def clusters(rnd, n):
    fps = set()
    while len(fps) < n:
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(rnd.randint(0, 12)):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            fps.add(base)
    return sorted(fps)


@pytest.mark.parametrize("bucket", [8192, 4])
def test_components_match_all_pairs(spark, bucket):
    """Small buckets force the exact splits."""
    rnd = random.Random(bucket)
    hot = rnd.getrandbits(64)
    fps = sorted(set(clusters(rnd, 250)) | {hot ^ (1 << a) ^ (1 << b) for a in range(0, 8) for b in range(8, 14)})
    unique = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = S.links(unique, bucket)
    roots = {r["node"]: r["root"] for r in S.components(edges).collect()}
    ours = [roots.get(signed(f), signed(f)) for f in fps]
    want = slow_components(fps)
    assert len(set(zip(ours, want))) == len(set(ours)) == len(set(want))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in S.components(chain).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert S.components(chain.limit(0)).count() == 0


def near_copies():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(base + ["end"])), (3, None), (4, ""), (5, "  "), (None, " ".join(base)), (10, " ".join(base))]
    return rows + [(20 + i, " ".join(rnd.choice(words) for _ in range(100))) for i in range(40)]


def test_groups_of_a_table(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = S.simhash_components(df).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, 10**9), 10**9 if i is None else i)
    want = Counter((i, signed(f), least[g]) for (i, _), f, g in zip(rows, fps, groups))
    assert Counter((r["doc_id"], r["fp"], r["keeper"]["doc_id"]) for r in got) == want
    assert S.simhash_components(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")
    kept = S.deduplicated(df).collect()
    groups = dict(zip([t for _, t in rows], slow_components([slow_fingerprint(t) for _, t in rows])))
    assert sorted(groups[r["text"]] for r in kept) == sorted(set(groups.values()))
    assert sum(r["doc_id"] == 10 for r in kept) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "_id"}


# ---------------------------------------------------------------- repeated strings


def slow_removed(texts, n=D.LENGTH):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def test_suffix_arrays_match_sorting():
    rnd = random.Random(5)
    for alphabet in (b"ab", b"a", bytes(range(256))):
        data = bytes(rnd.choice(alphabet) for _ in range(1500))
        sa, _ = D.suffix_array(np.frombuffer(data, np.uint8), 2048)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        lcp = D.common_prefixes(np.frombuffer(data, np.uint8), sa, D.LENGTH, lanes=16)
        for k in range(1, len(sa), 7):
            x, y = data[sa[k] : sa[k] + D.LENGTH], data[sa[k - 1] : sa[k - 1] + D.LENGTH]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_repeated_starts_match_counting():
    rnd = random.Random(6)
    for _ in range(15):
        base = bytes(rnd.choice(b"abc \xff") for _ in range(400))
        items = []
        for _ in range(rnd.randint(1, 8)):
            a = rnd.randint(0, 70)
            x = bytearray(base[a : a + rnd.randint(200, 330)])
            if rnd.random() < 0.7:
                x[rnd.randrange(len(x))] = 65
            items.append(bytes(x) if rnd.random() < 0.8 else b"z" * rnd.randint(200, 300))
        count = Counter(x[i : i + 200] for x in items for i in range(len(x) - 199))
        for x, got in zip(items, D.repeated_starts(items)):
            assert got.tolist() == [count[x[i : i + 200]] > 1 for i in range(len(x) - 199)]


def repeats():
    rnd = random.Random(8)

    def prose(n):
        return "".join(rnd.choice("abcdefg hijklmé ") for _ in range(n))

    shared, line = prose(450), prose(230)
    texts = [prose(900) for _ in range(8)] + [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "xy" * 400]
    texts += [prose(rnd.randint(0, 300)) + shared + prose(rnd.randint(0, 300)) for _ in range(25)]
    texts += [line[: rnd.randint(195, 230)] + prose(50) for _ in range(12)]
    whole = prose(700)
    texts += [whole] * 6 + [whole[:350] + "#" + whole[351:]] * 2 + [whole[k:] for k in range(0, 12, 3)]
    texts.append(prose(400) + shared[:260] + prose(100) + shared[:260])
    return texts


@pytest.mark.parametrize("items, piece", [(8192, 1 << 20), (4, 1 << 10)])
def test_removal_matches_counting(spark, monkeypatch, items, piece):
    """Few items a shard force the cross-shard merging; small steps cut texts in pieces."""
    monkeypatch.setattr(D, "SHARD_ITEMS", items)
    texts = repeats()
    df = spark.createDataFrame([(i if i else None, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    got = D.repeats_removed(df).collect()
    assert len(got) == len(texts)
    want = {t: g for t, g in zip(texts, slow_removed(texts))}
    for r in got:
        gone = np.zeros(len((r["text"] or "").encode()), bool)
        for s in r["removed"]:
            gone[s["a"] : s["b"]] = True
        assert (gone == want[r["text"]]).all()
        assert [(s["a"], s["b"]) for s in r["removed"]] == D.intervals(gone)
        left = np.frombuffer((r["text"] or "").encode(), np.uint8)[~gone].tobytes()
        assert r["kept"] is None if r["text"] is None else bytes(r["kept"]) == left
    assert D.repeats_removed(df.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(D, "STEP", 512)
    seen = np.zeros(len(text) - D.LENGTH + 1, int)
    for _, _, _, lo, hi, at in D.run_rows([text]):
        for a, b, p in zip(lo, hi, at):
            assert a <= b <= p <= a + D._SPAN - 1
            seen[a : b + 1] += 1
    assert (seen == 1).all()
    assert hashlib.sha256(text)


# ---------------------------------------------------------------- near copies


def slow_near(texts):
    """Component number of each text, all pairs of five-word shingle sets compared."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def edited_copies():
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    texts = [None, "", " ", "one two", "One  TWO"]
    for n, edits, copies in ((60, 1, 20), (200, 3, 12), (300, 12, 12), (80, 2, 25)):
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(n)] = rnd.choice(words)
            texts.append(" ".join(own))
    return texts + [" ".join(rnd.choice(words) for _ in range(50)) for _ in range(20)] + texts[5:8]


@pytest.mark.parametrize("block", [1 << 22, 42_000])
def test_near_copies_match_all_pairs(spark, block):
    """Small blocks force the stars and the pairs of blocks."""
    from helixframe.llm import near_copies as N

    texts = edited_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["keeper"]["doc_id"] for r in N.near_components(df, block).collect()}
    groups = slow_near(texts)
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    assert [got[i] for i in range(len(texts))] == [least[g] for g in groups]
    assert N.near_components(df.limit(0)).count() == 0


def test_simhash_groups_are_candidates(spark):
    """Without MinHash keys, texts whose fingerprints SimHash links still meet; the whole sets decide."""
    from pyspark.sql import functions as F

    from helixframe.llm import near_copies as N
    from helixframe.llm.common import per_text

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    base = [rnd.choice(words) for _ in range(600)]
    texts = [base, [*base, "end"], base[:-1], ["again", *base]]  # all near
    texts += [base[:5] * 400 + [f"{k}{w}" for w in base[:60]] for k in "xy"]  # alike fingerprints, other sets
    texts += [[rnd.choice(words) for _ in range(600)] for _ in range(4)]
    texts = [" ".join(t) for t in texts]
    got = N._kernel([t.encode() for t in texts])
    far = lambda i, j: ((got["fp"][i] ^ got["fp"][j]) & (1 << 64) - 1).bit_count()
    assert max(far(0, i) for i in range(4)) <= S.LIMIT and far(4, 5) <= S.LIMIT
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = per_text(df.select("doc_id", "text", F.xxhash64("text").alias("h")), "text", N._kernel, "u long, size long, keys array<long>, fp long")
    rows = rows.withColumn("keys", F.array().cast("array<long>")).cache()
    unique = rows.select("u", "size", F.struct("doc_id", "h").alias("least"))
    place = {u: i for i, u in enumerate(got["u"].tolist())}
    edges = N.links(rows, unique, df).collect()
    assert len(edges) == 3 and {place[n] for e in edges for n in e} == {0, 1, 2, 3}


def test_the_stage_removes_edited_copies(spark):
    import corpus_pipeline

    texts = edited_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == len(set(slow_near(texts)))


def test_stretches_longer_than_the_first_doublings():
    """Pairs that share 260 to 330 bytes among many unique contexts: nothing unique is called repeated."""
    for seed in (2, 8, 11, 12, 13):
        rnd = random.Random(seed)
        prose = lambda n: bytes(rnd.choice(b"etaoin shrdlu") for _ in range(n))
        items = []
        for _ in range(60):
            shared = prose(rnd.randint(260, 330))
            items += [shared + prose(20), shared + prose(20)]
        items += [prose(rnd.randint(200, 280)) for _ in range(300)]
        rnd.shuffle(items)
        count = Counter(x[i : i + 200] for x in items for i in range(len(x) - 199))
        for x, got in zip(items, D.repeated_starts(items)):
            assert got.tolist() == [count[x[i : i + 200]] > 1 for i in range(len(x) - 199)]


def test_suffixes_are_ordered_in_full():
    rnd = random.Random(12)
    for data in (b"\0" * 50, b"ab" * 400, b"x\0\0x\0\0\0", bytes(rnd.choice(b"\0a") for _ in range(700)) + b"\0" * 20, b"q" * 600):
        sa, _ = D.suffix_array(np.frombuffer(data, np.uint8))
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
