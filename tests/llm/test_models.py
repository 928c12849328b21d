import math
import random
import zlib

import numpy as np
import pytest

from helixframe.llm import language_id as G
from helixframe.llm import quality_classifier as C


def test_trees_fit_and_walk_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(C.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    packed = C.fit(x[:2000], y[:2000])
    p = C.predict(packed, x)
    assert ((p[2000:] >= 0.5) == y[2000:]).mean() > 0.95 and p.min() >= 0 and p.max() <= 1

    prior, feature, left, right, roots, threshold, value = packed
    for row in range(0, 3000, 300):
        total = prior
        for node in roots:
            while left[node] != node:
                node = left[node] if x[row, feature[node]] <= threshold[node] else right[node]
            total += value[node]
        assert p[row] == pytest.approx(1 / (1 + math.exp(-total)))


def test_statistics_are_finite():
    x = C.statistics([None, b"", b" ", b"\n\n", b"a", b"word " * 50_000, "é|!".encode()])
    assert np.isfinite(x).all() and not x[:2].any()


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_classifier_of_a_table(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words[:20])))
        if crc(i, 3) != 1:
            labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "x y"), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (7, None), (None, 1), labels[0]], "doc_id long, quality int")
    got = C.classified(df, C.train(df, lab)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and crc(r["doc_id"], 3) == 1]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) > 0.95 * len(held)
    # Labels of the held-out fold change nothing.
    liar = spark.createDataFrame([*labels, *((i, int(i % 3 == 0)) for i in range(300) if crc(i, 3) == 1)], "doc_id long, quality int")
    for a, b in zip(C.train(df, lab), C.train(df, liar)):
        assert np.array_equal(a, b)
    none = C.classified(df, C.train(df, lab.limit(0))).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert C.classified(df.limit(0), C.train(df, lab)).count() == 0


def slow_kneser_ney(text, counts_text):
    """Cross-entropy a character under an interpolated model, by dictionaries."""
    from collections import Counter, defaultdict

    def fold(t):
        out = []
        for ch in t.lower():
            c = ch if ch.isalpha() else " "
            if not (c == " " and (out[-1:] == [" "] or not out)):
                out.append(c)
        return "   " + "".join(out)

    counts = Counter()
    for t in counts_text:
        f = fold(t)
        counts.update(f[i - 3 : i + 1] for i in range(3, len(f)))
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    v = len(levels[1]) + 1
    totals = {n: defaultdict(float) for n in levels}
    kinds = {n: defaultdict(int) for n in levels}
    for n, level in levels.items():
        for g, c in level.items():
            totals[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def prob(g):
        n = len(g)
        if n == 0:
            return 1 / v
        total = totals[n][g[:-1]]
        if not total:
            return prob(g[1:])
        return max(levels[n][g] - 0.75, 0) / total + 0.75 * kinds[n][g[:-1]] / total * prob(g[1:])

    f = fold(text)
    return -sum(math.log(prob(f[i - 3 : i + 1])) for i in range(3, len(f))) / max(len(f) - 3, 1)


def test_model_is_interpolated_kneser_ney():
    import collections

    corpus = ["the cat sat on the mat, the cat", "a hat and the rat sat"]
    codes, starts, _ = G.folded([t.encode() for t in corpus])
    counts = collections.Counter(G.grams(codes, G.ORDER)[G.scored_positions(starts)].tolist())
    model = G.Model([dict(counts)])
    tests = ["the cat", "zzz the", "That Rat!", "x"]
    h, letters = model.entropies([t.encode() for t in tests])
    for t, got in zip(tests, h[:, 0]):
        assert got == pytest.approx(slow_kneser_ney(t, corpus), rel=1e-4)
    assert letters.tolist() == [6, 6, 7, 1]


def test_probabilities_sum_to_one():
    import collections

    codes, starts, _ = G.folded([b"abracadabra alakazam"])
    model = G.Model([dict(collections.Counter(G.grams(codes, G.ORDER)[G.scored_positions(starts)].tolist()))])
    symbols = [*"abrcdlkzm ", "?"]
    total = 0.0
    for s in symbols:
        code = [ord(c) for c in "abr" + ("一" if s == "?" else s)]
        packed = np.array([code[0] << 48 | code[1] << 32 | code[2] << 16 | code[3]], np.uint64)
        total += math.exp(model.log_probs(packed, G.ORDER)[0, 0])
    assert total == pytest.approx(1, rel=1e-3)


def test_languages_of_a_table(spark):
    rnd = random.Random(2)
    parts = {"aa": ["lo", "ra", "mi", "ne"], "bb": ["sch", "ung", "ver", "ich"]}
    rows = []
    for i in range(400):
        lang = "aa" if i % 4 else "bb"
        rows.append((i, lang, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(20))))
    rows += [(500, "aa", None), (501, "bb", ""), (502, None, "lora mine"), (None, "aa", "lora"), (503, "bb", "12 3!"), (504, None, "schungver " * 20_000), (1, *rows[1][1:])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, lang string, text string, score int")
    got = G.identified(df, G.train(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in ("aa", "bb") and 0 <= r["score"] <= 1
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and crc(r["doc_id"], 5) == 0]
    assert len(held) > 40 and all(r["lang_pred"] == r["lang"] for r in held)
    assert next(r for r in got if r["doc_id"] == 504)["lang_pred"] == "bb"
    nothing = G.identified(df, G.train(df.limit(0))).collect()
    assert all(r["lang_pred"] == "und" for r in nothing)


def test_a_model_beyond_the_cells_is_whole(spark):
    """In parts, every n-gram still counts: cross-entropies are those of the interpolated model, rows are the same."""
    rnd = random.Random(7)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(12))
    rows = [(i, "aa" if i % 3 else "bb", text("loramine" if i % 3 else "schungver")) for i in range(60)]
    rows += [(100, None, "lora zzz sch"), (101, "aa", None), (102, "bb", "12 3!"), (103, None, "\U00020000 é"), (100, None, "lora zzz sch")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    trained = G.train(df, cells=500)
    assert isinstance(trained[1], G.Parts) and trained[1].parts > 3
    key = lambda r: (r["doc_id"], r["text"] or "")
    got = sorted(G.identified(df, trained).collect(), key=key)
    want = sorted(G.identified(df, G.train(df)).collect(), key=key)
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == [c for c in want[0].asDict()]
    for a, b in zip(got, want):
        assert (a["doc_id"], a["text"], a["lang"], a["lang_pred"], a["accepted"]) == (b["doc_id"], b["text"], b["lang"], b["lang_pred"], b["accepted"])
        assert a["score"] == pytest.approx(b["score"], rel=1e-3)
        assert a["cross_entropy"] == (None if b["cross_entropy"] is None else pytest.approx(b["cross_entropy"], rel=1e-4))
