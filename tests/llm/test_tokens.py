import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import bpe as B
from helixframe.llm import token_counts as T

PATH, PATTERN = B.default_vocabulary()
RANKS = B.parse_ranks(open(PATH, "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = B.Tokenizer(RANKS, PATTERN)
TEXTS = [None, "", " ", "hello world", "naïve café – 東京 😀", "a" * 50_000, "x\ny" * 1000, "don't STOP!!", "<|endoftext|>", "\u0000‍"]


def ids(packed):
    return list(memoryview(packed).cast("I")) if packed else []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encode_like_the_library(text):
    packed = OURS.encode(text.encode())
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert OURS.decode(packed) == text


def texts_of(rnd, n):
    signs = ["abc", " ", "  ", "\n", "\t ", "\u00a0", " \u2003 ", "é", "ß日", "1", "23 ", "!", "'s", "'ll ", "the", "ing", "\x1c ", "x" * 70, "-"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_blocks_and_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "MAX_PIECES", 3)
    monkeypatch.setattr(B, "BLOCK", 7)
    small, counts, whole = B.Tokenizer(RANKS, PATTERN), T.Counter(RANKS, PATTERN), T.Counter(RANKS, ".|\n|" + PATTERN)
    counts.pieces.most = 3
    texts = texts_of(random.Random(1), 300)
    for i, packed in [(i, small.encode(t.encode())) for i, t in enumerate(texts)]:
        assert ids(packed) == LIBRARY.encode_ordinary(texts[i])
    monkeypatch.setattr(B, "BLOCK", 1 << 20)
    plain = T.Counter(RANKS, PATTERN)
    raw = [t.encode() for t in texts]
    assert counts.counts(raw) == plain.counts(raw) == [plain.counts([t])[0] for t in raw]
    assert whole.pieces.cut is False


def test_streamed_pieces_survive_small_tables(monkeypatch):
    monkeypatch.setattr(B, "MAX_STATES", 5)
    monkeypatch.setattr(B, "MAX_MOVES", 9)
    monkeypatch.setattr(B, "WINDOW", 16)
    machine, rnd = B.Transducer(RANKS), random.Random(2)
    for _ in range(60):
        piece = "".join(rnd.choice("abcdeé日nrstheing") for _ in range(rnd.randint(1, 120))).encode()
        assert machine.encode(piece) == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode_ordinary(piece.decode()))
        assert len(machine.states) <= 5 and len(machine.moves) <= 9


def test_output_lags_by_a_bounded_lookahead():
    machine, done, k = B.Transducer(RANKS), 0, 0
    longest = max(map(len, RANKS))
    piece = b"antidisestablishmentarianism" * 20
    for out in machine.stream(piece, window=1):
        k = min(k + 1, len(piece))
        done += sum(len(machine.bytes_of[i]) for i in out)
    assert done == len(piece)
    ends, state = [], 0
    for byte in piece:
        move = machine.step(state, byte)
        state = move >> B.ID_BITS
        ends.append(move & B.NO_TOKEN)
        settled = sum(len(machine.bytes_of[i]) for i in machine.settled(ends, state))
        assert len(ends) - settled <= 2 * longest


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_utf8_machine_is_whole_decoding(data, cuts):
    machine, at, out = B.Utf8Machine(), 0, ""
    for c in [*sorted(cuts), len(data)]:
        out += machine.feed(data[at : max(c, at)])
        at = max(c, at)
    assert out + machine.finish() == data.decode("utf-8", "replace")


def test_tokens_of_a_table(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)] + [(3, "hello world", "own")], "doc_id long, text string, N_Tokens string")
    got = B.bpe_tokens(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = LIBRARY.encode_ordinary(r["text"] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(raw).hexdigest() and r["decoded_ok"]
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = B.decode_tokens(B.bpe_tokens(df)).collect()
    assert all(r["decoded_text"] == (r["text"] or "") for r in back)
    assert B.bpe_tokens(df.limit(0)).count() == 0


def slow_count(piece, costs):
    best = [(0, 0)] + [None] * len(piece)
    for j in range(1, len(piece) + 1):
        options = [(best[i][0] + costs[piece[i:j]], best[i][1] + 1) for i in range(j) if best[i] is not None and piece[i:j] in costs]
        best[j] = min(options) if options else None
    return best[-1]


def test_counts_match_plain_programming(spark):
    import regex

    by_rank = T.zipf_costs(max(RANKS.values()) + 1)
    costs = {t: by_rank[r] for t, r in RANKS.items()}
    texts = [t if t is None or len(t) < 3000 else t[:300] for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.token_counts(df).collect():
        pieces = [p.encode() for p in regex.findall(PATTERN, r["text"] or "")]
        want = [slow_count(p, costs) for p in pieces]
        assert (r["n_pretokens"], r["cost"], r["n_tokens"]) == (len(pieces), sum(w[0] for w in want), sum(w[1] for w in want))
    assert T.token_counts(df.limit(0)).count() == 0


def test_trie_shares_prefixes():
    trie = T.PieceTrie(RANKS)
    trie.scores([b" international", b" internet"])
    assert trie.made == len(b" international") + len(b"et")
    for piece in (b"x" * 300, "日本語".encode() * 40, b"antidisestablishment" * 9):
        costs = dict(zip(sorted(RANKS, key=RANKS.get), T.zipf_costs(len(RANKS))))
        assert trie.alone(piece) == slow_count(piece, costs)
    with pytest.raises(ValueError):
        T.PieceTrie({b"a": 0}).scores([b"b"])
    with pytest.raises(ValueError):
        T.PieceTrie({b"a": 0}).alone(b"ab")
