"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed by an Arrow kernel. The trees are fitted on the driver from the statistics
of at most `MAX_TRAIN` labelled documents (those of the least hash of their id, a documented bound; all if there are fewer),
by histograms of `BINS` quantile bins, and flattened into arrays (feature, threshold, children, value) that a numpy
kernel walks for all rows and trees at once, level by level. Labels of a held-out fold are never read.

Defined results: null and empty texts have zero statistics and get the score of these; a null doc_id is not held out and
never learned from. Several labels of one id count as their mean, 0.5 being left out; of several rows of one id the one of
the least statistics is learned from. Without labels the score is 0.5, and a score of 0.5 predicts 1. Very long texts are
read whole; an empty table gives an empty table. Scores depend on the text alone; equal texts, equal scores. New columns
replace columns of the same name, other columns pass.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import crc_fold, per_text, table

MAX_TRAIN = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
L2 = 1.0
MIN_ROWS = 10

CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "high": bytes(range(128, 256)),
    "space": b" ", "line": b"\n", "stop": b".,;:?", "bang": b"!", "bar": b"|", "mark": b"#*$%&<>{}[]=_~^@+/\\",
}
FEATURES = (*CLASSES, "log_bytes", "log_words", "word_bytes", "longest", "distinct", "repeated", "top", "entropy", "dup_lines", "line_words", "stopped")


def statistics(texts: list) -> np.ndarray:
    """One row of FEATURES for each text (bytes or None)."""
    out = np.zeros((len(texts), len(FEATURES)))
    groups = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        groups[list(members), j] = 1
    for i, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        shares = counts[counts > 0] / n
        row = out[i]
        row[: len(CLASSES)] = counts @ groups / n
        words = text.split()
        k = len(words)
        lines = [x for x in text.split(b"\n") if x]
        row[len(CLASSES) :] = (
            np.log1p(n),
            np.log1p(k),
            (n - counts[32] - counts[10]) / max(k, 1),
            np.log1p(max(map(len, words), default=0)),
            len(set(words)) / max(k, 1),
            sum(map(eq, words, words[1:])) / max(k, 1),
            counts.max() / n,
            -(shares * np.log(shares)).sum(),
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(k / max(len(lines), 1)),
            counts[list(b".!?")].sum() / max(k, 1),
        )
    return out


class Forest:
    """Flattened trees: node arrays of all trees one after another; `roots` has each tree's first node."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self, value: float) -> int:
        n = len(self.feature)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(n)
        self.right.append(n)
        self.value.append(value)
        return n

    def pack(self) -> tuple:
        ints = [np.array(x, np.int32) for x in (self.feature, self.left, self.right, self.roots)]
        return self.prior, *ints, np.array(self.threshold), np.array(self.value)


def predict(packed: tuple, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1; leaves point to themselves, so DEPTH steps reach all."""
    prior, feature, left, right, roots, threshold, value = packed
    at = np.broadcast_to(roots, (len(x), len(roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        go_left = x[rows, feature[at]] <= threshold[at]
        at = np.where(go_left, left[at], right[at])
    return 1 / (1 + np.exp(-(prior + value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> tuple:
    """Boosted trees for the logistic loss, grown level by level from histograms of gradients."""
    if len(y) == 0:
        return Forest(0.0).pack()
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    forest = Forest(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return forest.pack()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), forest.prior)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        root = forest.node(0.0)
        forest.roots.append(root)
        level = {root: np.arange(len(y))}
        for depth in range(DEPTH + 1):
            after = {}
            for node, rows in level.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                forest.value[node] = -RATE * gs / (hs + L2)
                best = (1e-6, None, None)
                if depth < DEPTH and len(rows) >= 2 * MIN_ROWS:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, j]
                        size = len(e) + 1
                        gl = np.bincount(b, g[rows], size).cumsum()[:-1]
                        hl = np.bincount(b, h[rows], size).cumsum()[:-1]
                        nl = np.bincount(b, minlength=size).cumsum()[:-1]
                        gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                        gain[(nl < MIN_ROWS) | (len(rows) - nl < MIN_ROWS)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] is None:
                    score[rows] += forest.value[node]
                    continue
                _, j, k = best
                below = binned[rows, j] <= k
                forest.feature[node], forest.threshold[node] = j, edges[j][k]
                forest.left[node], forest.right[node] = forest.node(0.0), forest.node(0.0)
                forest.value[node] = 0.0
                after[forest.left[node]], after[forest.right[node]] = rows[below], rows[~below]
            level = after
    return forest.pack()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple:
    """Fit on labelled documents outside the held-out fold (crc32 of the id, modulo 3, equal to 1)."""
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("label")).filter("label != 0.5")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), (F.col("label") > 0.5).cast("int").alias("_y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")
    got = per_text(rows, "text", lambda texts: {"x": statistics(texts).tolist()}, "x array<double>")
    # One row an id, however often it is repeated: what comes to the driver is bounded by `most`.
    got = got.groupBy("doc_id", "_y").agg(F.min("x").alias("x")).toPandas()
    if got.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["_y"].to_numpy(float)
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def classified(docs: DataFrame, model: tuple) -> DataFrame:
    """Every row of docs with score and predicted."""

    def kernel(texts: list) -> dict:
        score = predict(model, statistics(texts)) if texts else np.zeros(0)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return per_text(docs, "text", kernel, "score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return classified(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
