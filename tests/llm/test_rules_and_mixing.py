import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing as X
from helixframe.llm import quality_rules as Q

TEXT = "string"
GOOD = " ".join(f"word{i} and then" for i in range(40))
CASES = [
    (1, GOOD),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "a b c a b c a b c " * 30),
    (6, "x\ny\nx\n\n \nx"),
    (7, "#a $b | <c>" * 20),
    (None, GOOD),
    (1, GOOD),
    (8, "é ü ß " * 40),
    (9, "long " * 30_000),
    (10, (" ".join(f"t{i}" for i in range(60)) + " ") * 2 + "end"),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = list(zip(words, words[1:], words[2:]))
    n = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_rules_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in CASES], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    got = Q.quality_rules(df, labels).collect()
    assert len(got) == len(CASES)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
        assert r["kept"] in (True, False) and not (r["kept"] and r["base_failed"])
        assert (r["llr"] is None) == (r["n_words"] == 0)
    assert [r["kept"] for r in got if r["text"] == GOOD] == [True] * 3


def test_work_columns_may_be_taken(spark):
    df = spark.createDataFrame([(1, GOOD, 5, "m")], "doc_id long, text string, _w int, _M string")
    got = Q.quality_rules(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first()
    assert (got["_w"], got["_M"], got["n_words"], got["kept"]) == (5, "m", 120, True)


def test_ratio_is_the_mean_of_the_cells(spark):
    import math

    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, "a c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    buckets = 1 << 12
    got = {r["doc_id"]: r["llr"] for r in Q.quality_rules(docs, labels, buckets).collect()}
    one = lambda t, r: math.log((t + 0.5) / (3 + 0.5 * buckets)) - math.log((r + 0.5) / (7 + 0.5 * buckets))
    two = lambda t, r: math.log((t + 0.5) / (2 + 0.5 * buckets)) - math.log((r + 0.5) / (4 + 0.5 * buckets))
    assert got[1] == pytest.approx((one(2, 3) * 2 + one(1, 1) + two(1, 1) * 2) / 5)
    assert got[2] == pytest.approx((one(0, 2) + one(0, 1) + two(0, 1)) / 3)


def test_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: (r["llr"], r["kept"]) for r in Q.quality_rules(docs, none).collect()}
    assert got == {1: (None, True), 2: (None, False)}
    assert Q.quality_rules(docs.limit(0), none).count() == 0


def mixed(df):
    from helixframe.llm.common import written

    return X.mix(written(X.keyed(df), "t"))


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in X.source_targets(sizes).collect()}
    # 1875 words; weights 3 1 2 3: a, null and b reach their caps, c takes the rest.
    assert got["a"] == 200 and got[None] == 100 and got["b"] == pytest.approx(200) and got["c"] == pytest.approx(1375)
    assert sum(got.values()) == pytest.approx(1.5 * 1250)


def test_mix_near_targets_and_repeatable(spark):
    rows = [(i, "w " * (1 + i % 9), ["a", "b", "b", "b", None][i % 5]) for i in range(3000)] + [(7, None, "a"), (8, "", None), (9, "x y", "b"), (9, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixed(df).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in ("a", "b", None):
        target = next(r["target"] for r in got if r["source"] == s)
        assert abs(taken[s] - target) <= 10
    again = mixed(df.repartition(3))
    key = lambda rows: sorted((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again.collect())


def test_mix_equals_plain_sampling(spark):
    """The bucketed cut takes what sorting each source's documents by key takes."""
    df = spark.createDataFrame([(i, "w " * (1 + i * i % 13), "s" + str(i % 3)) for i in range(600)], "doc_id long, text string, source string")
    keys = X.keyed(df).collect()
    for buckets, few in ((2, 5), (8, 1), (4096, 20_000)):
        got = {r["doc_id"]: r for r in X.mix(spark.createDataFrame(keys), buckets=buckets, few=few).collect()}
        for s in ("s0", "s1", "s2"):
            own = sorted((r for r in keys if r["source"] == s), key=lambda r: r["key"])
            total, target = sum(r["size"] for r in own), got[own[0]["doc_id"]]["target"]
            epochs, run = int(target // total), 0
            rest = target - epochs * total
            for r in own:
                run += r["size"]
                more = epochs < 2 and 2 * run - r["size"] <= 2 * rest
                assert got[r["doc_id"]]["taken"] == r["size"] * (epochs + more)


def test_mix_of_nothing(spark):
    assert mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mixed(spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


def test_equal_rows_are_divided_by_the_cut(spark):
    """Rows of one id and text have one key: as many of them are taken as fit, whatever else stands in the row."""
    rows = [(1, "a b c d", "s", k, "c", -1) for k in range(4)] + [(2, "w " * 8, "t", 0, "c", -1), (None, None, "t", 0, "c", -1), (3, "", None, 0, "c", -1)]
    columns = "doc_id long, text string, source string, copies int, `row` string, key int"
    df = spark.createDataFrame(rows, columns).repartition(3)
    per_row = mixed(df).collect()
    got = X.mixed_documents(df)
    assert got.columns == df.columns and set(got.collect()) <= set(df.collect())
    # 24 words make 36: weights 3 and 1 give s 27, that is one epoch and the three of its four rows whose middle is within 11.
    assert sum(r["taken"] for r in per_row if r["source"] == "s") == 28
    assert sum(r["doc_id"] == 1 for r in got.collect()) == 7
    half = spark.createDataFrame([(1, "a b c d", "s", k, "c", -1) for k in range(5)], columns)
    assert sum(r["taken"] for r in mixed(half).collect()) == 32 and X.mixed_documents(half).count() == 8
    assert X.mixed_documents(df.limit(0)).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for name, f in (("rules", Q.op1_quality_rules), ("mix", X.op7_mixing)):
        plan = f(spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow", plan), name
    assert F is not None
