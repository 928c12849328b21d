import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import media_ogg as O
from helixframe.llm import pii as P


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum_is_the_formats():
    for n in (0, 1, 5, 300):
        data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
        assert O.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [64, 255 * 64, 3968, 4032, 65024, 400_000, 255 * 4000])
def test_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    samples, n_bytes, found = O.read_audio(O.mux(data, n - 1))
    assert samples == data and n_bytes == n - 1 and found["end"] == n


def test_damage_is_found_and_contained():
    data = bytes(range(256)) * 2000
    media = bytearray(O.mux(data, len(data)))
    media[70_000] ^= 1
    got = O.demux(bytes(media))
    assert any("checksum" in e for e in got.errors)
    whole = {data[i : i + O.PACKET] for i in range(0, len(data), O.PACKET)}
    assert all(p in whole for p in got.streams[O.AUDIO].packets[1:])
    with pytest.raises(ValueError):
        O.read_audio(bytes(media))
    assert O.demux(b"junk").errors and O.demux(bytes(media[:500])).errors
    assert not O.demux(b"").streams


def test_media_of_a_table(spark):
    texts = [None, "", "x", "é" * 40, "a" * 64, "long " * 60_000, "x"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r["doc_id"]: r for r in O.media_digest(O.text_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["error"] is None
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
    assert got[2]["feature"] == got[6]["feature"] and got[2]["media"] == got[6]["media"] and got[0]["media"] == got[1]["media"]
    packets = O.media_packets(O.text_media(df)).filter("doc_id = 5").orderBy("packet").collect()
    assert b"".join(bytes(p["data"]) for p in packets).rstrip(b"\0") == texts[5].encode()
    assert packets[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(packets, packets[1:]))
    bad = O.media_digest(spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray())], "doc_id long, media binary")).collect()
    assert {r["doc_id"]: r["error"] is not None for r in bad} == {1: False, 2: True, 3: False}
    assert O.media_digest(O.text_media(df.limit(0))).count() == 0


def brute(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_detectors_match_the_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("a@.1 5-+(4b_0%") for _ in range(rnd.randint(0, 60)))
        assert P.detect(t) == brute(t)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("раul@exаmple.com hi", "email", "раul@exаmple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ x", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("host 192[.]168[.]1[.]5 up", "ip", "192[.]168[.]1[.]5"),
        ("bob@​example.com", "email", "bob@​example.com"),
    ],
)
def test_disguises(text, kind, found):
    base, spans = P.find(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)] and not base


@pytest.mark.parametrize("text", ["meet at home dot", "seven eight people at one two", "the cat sat at the mat", "un dos", "zero"])
def test_clean_text_is_left_alone(text):
    assert P.find(text) == ([], [])


def test_very_long_texts_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "a." * 100_000 + "@x", "+1" + "(" * 100_000, "one " * 50_000, "а" * 100_000, "a at b." * 30_000):
        P.find(t)


def test_pii_of_a_table(spark):
    rows = [(1, "a b@c.de +1 (212) 555-0100 x", "u"), (2, None, "v"), (3, "", "v"), (1, "a b@c.de +1 (212) 555-0100 x", "u"), (4, "joe [at] x [dot] org, 10.0.0.1", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.pii_spans(df).collect()
    assert len(got) == 5
    for r in got:
        base = brute(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(P.listed(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in base) for k in P.KINDS]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    red = {r["doc_id"]: r for r in P.redacted_documents(docs).collect()}
    assert red[1]["text"] == "a [EMAIL] [PHONE] x" and red[1]["n_chars"] == 19 and red[2]["text"] is None and red[4]["text"] == "[EMAIL], [IP]"
    assert P.pii_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write john [dot] doe [at] example [dot] com now", "email", "john [dot] doe [at] example [dot] com"),
        ("to jane dot smith at mail dot org.", "email", "jane dot smith at mail dot org"),
        ("a dot b (dot) c dot d@mail dot org", "email", "a dot b (dot) c dot d@mail dot org"),
        ("x joe [ @ ] mail.org", "email", "joe [ @ ] mail.org"),
        ("call plus onefivefivefiveonetwothreefourfivesixseven ok", "phone", "plus onefivefivefiveonetwothreefourfivesixseven"),
    ],
)
def test_disguises_before_the_at_sign_and_without_gaps(text, kind, found):
    assert [(k, text[a:b]) for k, a, b in P.find(text)[1]] == [(kind, found)]


def test_long_chains_of_dots_are_linear():
    for t in ("a dot " * 20_000 + "b at c dot org", "a dot b at c dot d " * 10_000, "a dot b@c " * 20_000):
        P.find(t)


PIECES = ["john", "dot", " dot ", " [dot] ", "(.)", " ", "at", " at ", " [at] ", "@", "mail", ".", "..", "org", "one two three four", "uno punto dos punto tres punto cuatro", "plus ", "fouroneonefive", "1", "192", "​", "а", "٣", " ", "\n", "x_y", "7", "{@}", "seven"]


def test_skipping_the_rewriting_changes_nothing(monkeypatch):
    """What may_change() lets go unread has nothing to find."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(20_000)]
    got = [P.find(t) for t in texts]
    monkeypatch.setattr(P, "may_change", lambda text: True)
    assert got == [P.find(t) for t in texts] and any(len(a) < len(b) for a, b in got)


def test_characters_far_from_a_disguise_change_nothing():
    for text in ("mi ip uno punto dos punto tres punto cuatro fin", "one point two point three point four", "jo [dot] e [at] mail [dot] org"):
        plain = P.find(text)[1]
        assert plain and all(P.find(text + tail)[1] == plain for tail in (" ", " dot", " а"))
    long = "a" * 400
    for name in (long + "7", "7" + long, long + ".b"):
        assert P.find(f"{name} at mail.org")[1] == [("email", 0, len(name) + 12)]
    assert P.find(f"{long} [dot] b [at] mail [dot] org")[1] == [("email", 0, 400 + len(" [dot] b [at] mail [dot] org"))]


def slow_map(text, passes):
    """Rewriting with one source span a character, edit by edit."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]
    for edits in passes:
        for a, b, sign in reversed(edits):
            chars[a:b] = [(c, chars[a][1], chars[b - 1][2]) for c in sign]
    return "".join(c for c, _, _ in chars), [(a, b) for _, a, b in chars]


def test_offsets_match_one_span_a_character():
    rnd = random.Random(6)
    for _ in range(2000):
        text = "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 40)))
        r, passes, n = P.Rewritten(text), [], len(text)
        for _ in range(3):
            cuts = sorted(rnd.sample(range(n + 1), min(2 * rnd.randint(0, 4), (n + 1) // 2 * 2)))
            edits = [(a, b, rnd.choice(["", "X", "Y"])) for a, b in zip(cuts[::2], cuts[1::2])]
            passes.append(edits)
            r.apply([e[0] for e in edits], [e[1] for e in edits], [e[2] for e in edits])
            n = len(r.text)
        want, spans = slow_map(text, passes)
        assert r.text == want and [r.span(i, i + 1) for i in range(len(want))] == spans


def test_a_very_long_text_takes_little_room():
    import tracemalloc

    text = "clean words go here аnd so on " * 160_000 + "joe [at] mail [dot] org"
    tracemalloc.start()
    assert P.find(text)[1] == [("email", len(text) - 23, len(text))]
    assert tracemalloc.get_traced_memory()[1] < 20 * len(text)
    tracemalloc.stop()


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    good = " ".join(f"word{i} and then" for i in range(40))
    names = ["doc_id", "lang", "source", "text", "n_chars", "spans", "redacted", "kept", "n_words", "llr", "_w", "_m", "row", "copies", "key", "size", "h", "u", "keys", "n", "_id", "_h", "own_id", "cut", "target", "text_bytes", "n_email"]
    rows = [(i, "en", "s", t, 1, *(f"{n}{i}" for n in names[5:])) for i, t in ((1, good), (2, good + " mail joe@mail.org now"), (2, good + " mail joe@mail.org now"), (3, None))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names[5:]))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")

    class Spark:
        read = type("R", (), {"parquet": staticmethod(lambda path: labels)})

    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(Spark if name == "quality rules" else spark, df, "")
        assert got.columns == names, name
        got = got.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names[5:]), name
