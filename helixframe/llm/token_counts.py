"""Token counts by dynamic programming over a trie of pre-tokens.

Texts are split by the public pattern. The distinct pre-tokens of a step that are not remembered go into a trie of their
UTF-8 bytes, laid out level by level from their sorted order; each node gets the best unigram forward score of its prefix
once, for all pre-tokens that begin so, from the open starts of its parent. The scores at the terminals are stored by
pre-token (the lately met ones stay for the next steps), and a document's count is the sum over its pre-tokens. A whole
level is one set of numpy operations. Pre-tokens of more than `bpe.SHARED` bytes are scored by themselves, in memory bounded by
the longest token.

Unigram scores follow the ranks file: the cost of the token of rank r is the integer nearest to
10^6 * (ln(r + 2.7) + ln(sum over all ranks of 1 / (r + 2.7))), Zipf's law with Mandelbrot's offset. The best
segmentation has the least cost, then the fewest tokens; both are integers, so results don't depend on the order.
No tokenizer is trained.

Defined results: null and empty texts have 0 pre-tokens, 0 tokens and cost 0. Repeated rows count each; an empty table
gives an empty table. Texts of any length are read whole, in blocks. New columns replace columns of the same name, other
columns pass.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.bpe import Pieces, default_vocabulary, is_long, parse_ranks
from helixframe.llm.common import per_text, table

#: Pre-tokens remembered in each of two generations.
MAX_PIECES = 200_000
OFFSET = 2.7
#: A score is cost << SHIFT | tokens: one integer that adds up and compares by cost, then by tokens.
SHIFT = 20
TOKENS = (1 << SHIFT) - 1
NONE = 1 << 62


def zipf_costs(n: int, offset: float = OFFSET) -> list[int]:
    total = math.log(math.fsum(1 / (r + offset) for r in range(n)))
    return [round(1e6 * (math.log(r + offset) + total)) for r in range(n)]


class PieceTrie:
    """Forward scores of pre-tokens over the vocabulary's trie (sorted arrays of node << 8 | byte and the node after)."""

    def __init__(self, ranks: dict[bytes, int]):
        costs = zipf_costs(max(ranks.values(), default=-1) + 1)
        after: dict[int, int] = {}
        scores: list[int] = [NONE]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (child := after.get(key)) is None:
                    child = after[key] = len(scores)
                    scores.append(NONE)
                node = child
            scores[node] = costs[rank] << SHIFT | 1
        self.keys = np.array(sorted(after), np.int64)
        self.nodes = np.array([after[k] for k in self.keys.tolist()], np.int64)
        self.score_at = np.array(scores, np.int64)
        self.made = 0

    def children(self, nodes: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have a child by their byte, those children)."""
        key = nodes << 8 | bytes_
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        has = self.keys[at] == key
        return has, self.nodes[at[has]]

    def scores(self, pieces: list[bytes]) -> np.ndarray:
        """Terminal scores of sorted distinct pre-tokens of 1 to SHARED bytes."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        width = int(sizes.max(initial=0))
        grid = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        out = np.full(n, NONE, np.int64)
        live, node_of = np.arange(n), np.zeros(n, np.int64)
        # Open starts of all nodes of the level, by node: place in the vocabulary's trie and score at the start.
        first, size = np.zeros(1, np.int64), np.ones(1, np.int64)
        place, score = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(width):
            longer = sizes[live] > level
            live, node_of = live[longer], node_of[longer]
            byte = grid[live, level].astype(np.int64)
            new = np.ones(len(live), bool)
            new[1:] = (node_of[1:] != node_of[:-1]) | (byte[1:] != byte[:-1])
            parent, own = node_of[new], byte[new]
            node_of = np.cumsum(new) - 1
            self.made += len(parent)
            # Every node goes on from the open starts of its parent.
            counts = size[parent]
            owner = np.repeat(np.arange(len(parent)), counts)
            at = np.arange(len(owner)) + np.repeat(first[parent] - (np.cumsum(counts) - counts), counts)
            has, place = self.children(place[at], own[owner])
            owner, score = owner[has], score[at[has]]
            best = np.full(len(parent), NONE, np.int64)
            cost = self.score_at[place]
            ends = cost < NONE
            np.minimum.at(best, owner[ends], score[ends] + cost[ends])
            spelled = np.flatnonzero(best < NONE)
            owner = np.concatenate([owner, spelled])
            order = np.argsort(owner, kind="stable")
            place = np.concatenate([place, np.zeros(len(spelled), np.int64)])[order]
            score = np.concatenate([score, best[spelled]])[order]
            size = np.bincount(owner, minlength=len(parent))
            first = np.cumsum(size) - size
            done = sizes[live] == level + 1
            out[live[done]] = best[node_of[done]]
        if (out >= NONE).any():
            raise ValueError("the vocabulary can't spell this text")
        return out

    def alone(self, piece: bytes) -> tuple[int, int]:
        """(cost, tokens) of one pre-token of any length."""
        place, score = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cost = tokens = 0
        for byte in piece:
            has, place = self.children(place, np.full(len(place), byte, np.int64))
            score = score[has]
            own = self.score_at[place]
            best = int((score + own).min(initial=NONE, where=own < NONE))
            if best < NONE:
                # Scores are kept relative to the best one, so that they stay small.
                more = (best + (TOKENS >> 1) & TOKENS) - (TOKENS >> 1)
                cost, tokens = cost + (best - more >> SHIFT), tokens + more
                score = score - best
                place, score = np.append(place, 0), np.append(score, 0)
        if not len(place) or place[-1]:
            raise ValueError("the vocabulary can't spell this text")
        return cost, tokens


class Counter:
    """Counts of whole texts over one ranks file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.trie = PieceTrie(ranks)
        self.pieces = Pieces(pattern, lambda new: self.trie.scores(new).tolist(), MAX_PIECES)

    def counts(self, texts: list) -> list[tuple[int, int, int]]:
        """(pre-tokens, tokens, cost) of each text."""
        total = np.zeros((len(texts), 3), np.int64)
        for who, flat, sizes in self.pieces.groups(texts):
            distinct = set(flat)
            long = set(filter(is_long, distinct))
            score = self.pieces.values(distinct - long)
            if long:
                score = score | dict.fromkeys(long, 0)
            got = np.fromiter(map(score.__getitem__, flat), np.int64, len(flat))
            place = np.repeat(who, sizes)
            np.add.at(total[:, 0], who, sizes)
            for k, values in ((1, got & TOKENS), (2, got >> SHIFT)):
                total[:, k] += np.bincount(place, values, len(texts)).astype(np.int64)
            if long:
                alone = {p: self.trie.alone(p.encode("utf-8", "surrogateescape")) for p in long}
                for i, p in zip(place.tolist(), flat):
                    if p in alone:
                        total[i, 2] += alone[p][0]
                        total[i, 1] += alone[p][1]
        return [tuple(t) for t in total.tolist()]


_made: dict[str, Counter] = {}


def counter(data: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Counter(parse_ranks(data), pattern)
    return _made[key]


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every row of docs with n_pretokens, n_tokens and cost (micro-nats of the best segmentation)."""
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    with open(path or own_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or own_pattern

    def kernel(texts: list) -> dict:
        got = counter(data.value, pattern).counts(texts)
        return {n: [g[i] for g in got] for i, n in enumerate(("n_pretokens", "n_tokens", "cost"))}

    return per_text(docs, "text", kernel, "n_pretokens long, n_tokens long, cost long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_pretokens", "n_tokens", "cost")
