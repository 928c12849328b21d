"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

A piece (one match of the split pattern) is read byte by byte. Its encoding is the only token sequence whose
adjacent pairs are all stable, a pair being stable if merging its joined bytes gives back the pair; so the
encoding of every prefix ends in one token, found from the encodings of shorter prefixes. A state of the
transducer holds what the future can still depend on: the start positions whose remaining bytes are a prefix of
some token, each as a node of the vocabulary's trie with the token that ends at the start. A move reads a byte and gives
the token that the prefix ends in. The tokens on which the encodings up to all open starts agree are final: they are
emitted after a lookahead bounded by the longest token. The merge order is the ranks'.

The distinct pieces of a step that are not remembered are read together: states are determinised level by level for all
their prefixes at once (equal sets of open starts are one state), in numpy; nothing of it outlives the step. Pieces of more
than `SHARED` bytes are streamed one by one over states and moves made when first met and kept, up to `MAX_STATES` and
`MAX_MOVES`; then that table is dropped and built anew, also within a piece, which changes no result.

Of the public pattern no match goes over a space that follows a character other than white space, so texts are cut there
into blocks; other patterns are matched over the whole text. Ids of pieces met lately are remembered.

Decoding joins the tokens' bytes and runs an incremental UTF-8 state machine over the chunks, so that a chunk
may end inside a character.

Defined results: a null text is the empty text: no tokens, the hash of no bytes. Texts of any length are read
whole, in blocks of about `BLOCK` characters that end at such a space; equal texts, equal rows; an empty table gives an
empty table. New columns replace columns of the same name, other columns pass. The ranks file (fixed size) is read on the
driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import per_text, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_STATES = 50_000
MAX_MOVES = 100_000
MAX_STABLE = 100_000
#: Pairs of tokens whose stability is kept.
MAX_PAIRS = 2_000_000
#: Pieces remembered in each of two generations.
MAX_PIECES = 200_000
#: Longer pieces are neither remembered nor read together with others.
SHARED = 64
#: Characters of text whose pieces are looked up together.
BLOCK = 1 << 20
CHUNK_TOKENS = 1 << 16
NEVER = 1 << 62
NONE = -1
#: Bits of a token id within a packed state entry or move; NO_TOKEN stands for the start of the piece.
ID_BITS = 24
NO_TOKEN = (1 << ID_BITS) - 1
#: Bytes of a piece read between two emissions.
WINDOW = 1 << 12

#: A space after a character that is none.
BORDER = re.compile(r"(?<=\S) ")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text cut before borders, each after about `size` characters."""
    at = 0
    while len(text) - at > size and (m := BORDER.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Tokens are their ids; bytes read since an open start are a node of the vocabulary's trie.

    A state is a tuple of (node << ID_BITS | token before the start), longest first, the current position being the open
    start at the root; `moves` has state << 8 | byte -> next state << ID_BITS | token that the prefix ends in.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= NO_TOKEN:
            raise ValueError(f"token ids must be below {NO_TOKEN}")
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.size_of = {i: len(token) for token, i in ranks.items()}
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [NONE]
        self.depth: list[int] = [0]
        trie, nodes = self.trie, 1
        for token, i in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                key = node << 8 | byte
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = nodes
                    nodes += 1
                    self.token_at.append(NONE)
                    self.depth.append(depth)
            self.token_at[node] = i
        self.checked = bytearray(nodes)
        self.keys = np.array(sorted(trie), np.int64)
        self.nodes = np.array([trie[k] for k in self.keys.tolist()], np.int64)
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.sizes[list(self.size_of)] = list(self.size_of.values())
        self.pairs, self.held, self.fresh = np.zeros(0, np.int64), np.zeros(0, bool), []
        self.token_of, self.seen = np.full(nodes, NONE, np.int64), np.zeros(nodes, bool)
        self.spines: dict[bytes, tuple[list, list]] = {}
        self.stable: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        first = (NO_TOKEN,)
        self.states, self.number, self.moves = [first], {first: 0}, {}

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The merge rule itself: the lowest rank first, leftmost on ties, until so many parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranked = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while len(parts) > until and (best := min(ranked)) != NEVER:
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranked[i]
            if i < len(ranked):
                ranked[i] = self.ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                ranked[i - 1] = self.ranks.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def reached(self, node: int) -> int:
        """The token at a node, or NONE; a token that no merge makes can't end a prefix."""
        token = self.token_at[node]
        if token != NONE and not self.checked[node]:
            self.checked[node] = 1
            data = self.bytes_of[token]
            if len(data) > 1 and len(self.merge(data)) > 1:
                token = self.token_at[node] = NONE
        return token

    def edges(self, token: bytes) -> tuple[list, list]:
        """The parts that stand at the left and at the right end of a token while it is merged, with when each arises."""
        if (known := self.spines.get(token)) is None:
            if len(token) == 1:
                known = [(token, 0)], [(token, 0)]
            else:
                a, b = self.merge(token, 2)
                made = (token, self.ranks[token])
                known = [*self.edges(a)[0], made], [*self.edges(b)[1], made]
            self.spines[token] = known
        return known

    def is_stable(self, a: int, b: int) -> bool:
        """No merge crosses the border of tokens a and b while they are merged, nor after."""
        key = a << 32 | b
        if (known := self.stable.get(key)) is None:
            if len(self.stable) >= MAX_STABLE:
                self.stable.clear()
            known = self.stable[key] = self.border_holds(self.edges(self.bytes_of[a])[1], self.edges(self.bytes_of[b])[0])
        return known

    def border_holds(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            after_x = left[i + 1][1] if i + 1 < len(left) else NEVER
            after_y = right[j + 1][1] if j + 1 < len(right) else NEVER
            crossing = self.ranks.get(left[i][0] + right[j][0], NEVER)
            if crossing < after_x and crossing <= after_y and crossing != NEVER:
                return False
            if after_x == NEVER == after_y:
                return True
            if after_x <= after_y:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> int:
        """Make the move of a state on a byte: next state << ID_BITS | token that the prefix ends in."""
        trie, found, still = self.trie, NONE, []
        for entry in self.states[state]:
            child = trie.get(entry >> ID_BITS << 8 | byte)
            if child is None:
                continue
            prior = entry & NO_TOKEN
            if found == NONE and (token := self.reached(child)) != NONE and (prior == NO_TOKEN or self.is_stable(prior, token)):
                found = token
            still.append(child << ID_BITS | prior)
        if found == NONE:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        still.append(found)
        key = tuple(still)
        after = self.number.get(key)
        if after is None:
            if full := len(self.moves) >= MAX_MOVES or len(self.states) >= MAX_STATES:
                self.reset()
            after = self.number[key] = len(self.states)
            self.states.append(key)
            if full:  # the state come from has no number any more
                return after << ID_BITS | found
        self.moves[state << 8 | byte] = got = after << ID_BITS | found
        return got

    def known_tokens(self, nodes: np.ndarray) -> np.ndarray:
        """reached() of many nodes."""
        new = np.unique(nodes[~self.seen[nodes]])
        for node in new.tolist():
            self.token_of[node] = self.reached(node)
        self.seen[new] = True
        return self.token_of[nodes]

    def all_stable(self, priors: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """is_stable() of many pairs; nothing before a token is stable."""
        pairs = priors << 32 | tokens
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        unknown = self.pairs[at] != pairs if len(self.pairs) else np.ones(len(pairs), bool)
        out = np.ones(len(pairs), bool)
        if len(self.pairs):
            out = self.held[at]
        if unknown.any():
            new, back = np.unique(pairs[unknown], return_inverse=True)
            held = np.array([a == NO_TOKEN or self.is_stable(a, b) for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())], bool)
            out[unknown] = held[back]
            self.fresh.append((new, held))
        return out

    def keep_pairs(self) -> None:
        """Sort what all_stable() found into the table of known pairs."""
        new, first = np.unique(np.concatenate([self.pairs, *[p for p, _ in self.fresh]]), return_index=True)
        held = np.concatenate([self.held, *[h for _, h in self.fresh]])[first]
        most = len(new) <= MAX_PAIRS
        self.pairs, self.held, self.fresh = (new, held, []) if most else (new[:0], held[:0], [])
        self.stable.clear()

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of sorted distinct pieces of 1 to SHARED bytes."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        width = int(sizes.max(initial=0))
        grid = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ends = np.zeros((n, width), np.int64)
        live, state = np.arange(n), np.zeros(n, np.int64)
        # Open starts of all states of the level, by state, longest first: node and token before the start.
        first, size = np.zeros(1, np.int64), np.ones(1, np.int64)
        node, prior = np.zeros(1, np.int64), np.full(1, NO_TOKEN, np.int64)
        for level in range(width):
            longer = sizes[live] > level
            live, state = live[longer], state[longer]
            moves, after = np.unique(state << 8 | grid[live, level], return_inverse=True)
            source, byte = moves >> 8, moves & 255
            counts = size[source]
            owner = np.repeat(np.arange(len(moves)), counts)
            at = np.arange(len(owner)) + np.repeat(first[source] - (np.cumsum(counts) - counts), counts)
            key = node[at] << 8 | byte[owner]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[place] == key
            owner, node, prior = owner[has], self.nodes[place[has]], prior[at[has]]
            token = self.known_tokens(node)
            full = np.flatnonzero(token != NONE)
            full = full[self.all_stable(prior[full], token[full])]
            which, where = np.unique(owner[full], return_index=True)
            if len(which) < len(moves):
                raise ValueError("a byte is not in the vocabulary")
            found = token[full[where]]
            owner = np.concatenate([owner, which])
            order = np.argsort(owner, kind="stable")
            node = np.concatenate([node, np.zeros(len(which), np.int64)])[order]
            prior = np.concatenate([prior, found])[order]
            size = np.bincount(owner, minlength=len(moves))
            first = np.cumsum(size) - size
            ends[live, level] = found[after]
            state = after
        out = np.zeros((n, width), np.uint32)
        left, filled = sizes.copy(), np.full(n, width)
        open_ = np.flatnonzero(left)
        while len(open_):
            token = ends[open_, left[open_] - 1]
            filled[open_] -= 1
            out[open_, filled[open_]] = token
            left[open_] -= self.sizes[token]
            open_ = open_[left[open_] > 0]
        self.keep_pairs()
        raw, row = out.astype("<u4").tobytes(), 4 * width
        return [raw[i * row + 4 * f : (i + 1) * row] for i, f in enumerate(filled.tolist())]

    def backwards(self, ends: list[int], stop: int) -> list[int]:
        """Tokens of the prefix of `stop` bytes, the last one first; ends has the token each longer prefix ends in."""
        out, size = [], self.size_of
        while stop > 0:
            token = ends[stop - 1]
            out.append(token)
            stop -= size[token]
        return out

    def settled(self, ends: list[int], state: int) -> list[int]:
        """Tokens that the encodings up to all open starts of a state begin with."""
        n, depth = len(ends), self.depth
        paths = [self.backwards(ends, n - depth[entry >> ID_BITS])[::-1] for entry in self.states[state]]
        low, high = min(paths), max(paths)
        same = 0
        while same < len(low) and low[same] == high[same]:
            same += 1
        return low[:same]

    def stream(self, piece: bytes, window: int = WINDOW) -> Iterator[list[int]]:
        """Ids of a piece, those settled after every `window` bytes, then the rest."""
        state, ends = 0, []
        for at in range(0, len(piece), window):
            for byte in piece[at : at + window]:
                move = self.moves.get(state << 8 | byte)
                if move is None:
                    move = self.step(state, byte)
                state = move >> ID_BITS
                ends.append(move & NO_TOKEN)
            done = self.settled(ends, state)
            if done:
                yield done
                del ends[: sum(map(self.size_of.__getitem__, done))]
        yield self.backwards(ends, len(ends))[::-1]

    def encode(self, piece: bytes) -> bytes:
        """Packed ids of one piece."""
        if (token := self.ranks.get(piece)) is not None:
            return token.to_bytes(4, "little")
        if len(piece) > WINDOW:
            return b"".join(array("I", ids).tobytes() for ids in self.stream(piece))
        state, ends, get = 0, [], self.moves.get
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                move = self.step(state, byte)
                get = self.moves.get
            state = move >> ID_BITS
            ends.append(move & NO_TOKEN)
        return array("I", self.backwards(ends, len(ends))[::-1]).tobytes()


class Utf8Machine:
    """Incremental UTF-8 decoder: `feed` returns the whole characters so far and holds back an unfinished one.

    States are the number of continuation bytes still missing with the range allowed for the next one; bulk bytes
    are decoded together, the machine walks the last three bytes of a chunk only. Bad bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def missing(lead: int) -> int:
        """Continuation bytes after a lead byte; 0 if it is ASCII or can't lead."""
        return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def follows(lead: int, second: int) -> bool:
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        return low <= second <= high

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            if self.missing(byte) >= back and (back == 1 or self.follows(byte, data[len(data) - back + 1])):
                cut = len(data) - back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Pieces:
    """Splits texts and keeps a value for each piece, made by `make` for many new ones at once.

    Values are kept in two generations: what is met again moves to the younger one.
    """

    def __init__(self, pattern: str, make: Callable[[list[bytes]], list], most: int):
        self.find = regex.compile(pattern).findall
        self.cut = pattern == public_pattern()
        self.make, self.most = make, most
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def values(self, pieces: set[str]) -> dict[str, object]:
        """Values of these pieces (and of others)."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older, coded = self.known, self.older, {}
        for p in pieces:
            if p not in known:
                if (value := older.get(p)) is None:
                    coded[p.encode("utf-8", "surrogateescape")] = p
                else:
                    known[p] = value
        new = sorted(coded)
        made = dict(zip(map(coded.__getitem__, new), self.make(new))) if new else {}
        if len(made) > self.most:
            return known | made
        known |= made
        return known

    def groups(self, texts: list) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """(texts, their pieces laid one after another, number of each): about BLOCK characters together."""
        who, flat, sizes, held = [], [], [], 0
        for i, text in enumerate(texts):
            whole = (text or b"").decode("utf-8", "surrogateescape")
            for block in blocks(whole) if self.cut else [whole]:
                own = self.find(block)
                who.append(i)
                flat += own
                sizes.append(len(own))
                held += len(block)
                if held > BLOCK:
                    yield who, flat, sizes
                    who, flat, sizes, held = [], [], [], 0
        if who:
            yield who, flat, sizes


def is_long(piece: str) -> bool:
    """More than SHARED bytes; a character has 4 at most."""
    return len(piece) > SHARED // 4 and len(piece.encode("utf-8", "surrogateescape")) > SHARED


class Tokenizer:
    """Encoder and decoder of whole texts over one ranks file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = machine = Transducer(ranks)
        self.bytes_of = [machine.bytes_of.get(i, b"") for i in range(max(machine.bytes_of, default=-1) + 1)]
        self.pieces = Pieces(pattern, machine.encode_many, MAX_PIECES)

    def packed(self, texts: list) -> Iterator[tuple[int, bytes]]:
        """(number of the text, packed ids of its next block) of UTF-8 texts, in order."""
        for who, flat, sizes in self.pieces.groups(texts):
            distinct = set(flat)
            long = set(filter(is_long, distinct))
            of = self.pieces.values(distinct - long)
            if long:
                of = of | {p: self.machine.encode(p.encode("utf-8", "surrogateescape")) for p in long}
            got, at = list(map(of.__getitem__, flat)), 0
            for i, n in zip(who, sizes):
                yield i, b"".join(got[at : at + n])
                at += n

    def encode(self, text: bytes) -> bytes:
        return b"".join(packed for _, packed in self.packed([text]))

    def decode_chunks(self, packed: bytes, size: int = CHUNK_TOKENS) -> Iterator[bytes]:
        ids = memoryview(packed).cast("I") if len(packed) else ()
        for i in range(0, len(ids), size):
            yield b"".join(map(self.bytes_of.__getitem__, ids[i : i + size]))

    def decode(self, packed: bytes) -> str:
        machine = Utf8Machine()
        return "".join([*map(machine.feed, self.decode_chunks(packed)), machine.finish()])


def public_pattern() -> str | None:
    """The pattern whose matches keep to borders."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.PATTERN


_made: dict[str, Tokenizer] = {}


def tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """One tokenizer a worker and vocabulary."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(parse_ranks(data), pattern)
    return _made[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


TOKEN_FIELDS = {"n_tokens": "long", "token_ids": "binary", "ids_sha256": "string", "decoded_sha256": "string", "decoded_ok": "boolean"}


def bpe_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, columns: tuple[str, ...] = tuple(TOKEN_FIELDS)) -> DataFrame:
    """Every row of docs with n_tokens, token_ids (packed), ids_sha256, decoded_sha256 and decoded_ok, or those of `columns`.

    decoded_ok: the streaming decoder gave back well-formed UTF-8 equal to the text.
    """
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    with open(path or own_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or own_pattern

    def kernel(texts: list) -> dict:
        t = tokenizer(data.value, pattern)
        keep, check, decode = "token_ids" in columns, "decoded_ok" in columns, "decoded_ok" in columns or "decoded_sha256" in columns
        out: dict[str, list] = {c: [] for c in TOKEN_FIELDS}
        for i, own in groupby(t.packed(texts), lambda x: x[0]):
            text, n, held, same, at = texts[i] or b"", 0, [], True, 0
            ids_sha, sha, machine = hashlib.sha256(), hashlib.sha256(), Utf8Machine()
            for _, packed in own:
                n += len(packed) // 4
                ids_sha.update(packed)
                if keep:
                    held.append(packed)
                for chunk in t.decode_chunks(packed) if decode else ():
                    sha.update(chunk)
                    if check:
                        got = machine.feed(chunk).encode()
                        same &= text[at : at + len(got)] == got
                        at += len(got)
            if check:
                same &= text[at:] == machine.finish().encode()
            row = (n, b"".join(held), ids_sha.hexdigest(), sha.hexdigest(), same)
            for c, value in zip(TOKEN_FIELDS, row):
                out[c].append(value)
        return out

    return per_text(docs, "text", kernel, ", ".join(f"{c} {TOKEN_FIELDS[c]}" for c in columns))


def decode_tokens(rows: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """Every row with `decoded_text` of its packed ids; null ids give null."""
    with open(path or default_vocabulary()[0], "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    def kernel(packed: list) -> dict:
        t = tokenizer(data.value, ".")
        return {"decoded_text": [None if p is None else t.decode(p) for p in packed]}

    return per_text(rows, ids, kernel, "decoded_text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe_tokens(docs, columns=columns).select("doc_id", *columns)
