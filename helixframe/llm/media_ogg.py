"""Media columns in Ogg: pages with checksums, packets from lacing values, streams by serial number, timestamps.

`mux` writes a payload of 8-bit samples as two multiplexed logical streams: an audio stream (a header packet, then
packets of `PACKET` samples; granule position = samples up to the end of the last packet that ends in the page) and
an index stream with the number of bytes before padding. `demux` verifies each page's CRC-32 (polynomial
0x04c11db7, not reflected, start 0), reassembles packets from the lacing values across pages, separates the
streams by serial number and derives each packet's time from the granule positions. A page that fails its
checksum is skipped to the next capture pattern and reported; packets it would have continued are dropped and
reported, never joined wrongly.

Defined results: a null text is the empty text, stored as one block of zero bytes. Serial numbers are constants, so
equal texts give equal media. A null or empty media value gives no streams and no error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import per_text, table

BLOCK = 64
RATE = 8000
PACKET = 4000
AUDIO, INDEX = 1, 2
MAGIC = b"PCMU8\0\1\0"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: zlib's reflected CRC over mirrored bytes, mirrored back."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paged(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); 255 lacing values a page at most.

    The first packet has the first page to itself.
    """
    number, lacing, body, granule, continued = 0, bytearray(), [], -1, False

    def page(last: bool) -> bytes:
        flags = CONTINUED * continued | FIRST * (number == 0) | LAST * last
        return page_bytes(flags, granule, serial, number, bytes(lacing), b"".join(body))

    for k, (packet, end) in enumerate(packets):
        segments = len(packet) // 255 + 1
        values = b"\xff" * (segments - 1) + bytes([len(packet) % 255])
        at = done = 0
        while done < segments:
            room = min(255 - len(lacing), segments - done)
            part = values[done : done + room]
            size = sum(part)
            lacing += part
            body.append(packet[at : at + size])
            at, done = at + size, done + room
            whole = done == segments
            if whole:
                granule = end
            final = whole and k == len(packets) - 1
            if len(lacing) == 255 or final or (whole and k == 0):
                yield page(final)
                number, lacing, body, granule, continued = number + 1, bytearray(), [], -1, not whole


def mux(payload: bytes, n_bytes: int) -> bytes:
    audio = [(MAGIC + struct.pack("<II", RATE, PACKET), 0)]
    for i in range(0, len(payload), PACKET):
        audio.append((payload[i : i + PACKET], min(i + PACKET, len(payload))))
    index = [(b"INDEX\0\0\0", 0), (struct.pack("<QQ", n_bytes, len(payload)), 0)]
    one, two = list(paged(audio, AUDIO)), list(paged(index, INDEX))
    # First pages of all streams come before any other page; the index then sits after the first audio data.
    return b"".join([one[0], two[0], *one[1:2], *two[1:], *one[2:]])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end, -1 where its page tells none for it.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    partial: list[bytes] = field(default_factory=list)
    next_page: int = 0
    ended: bool = False


@dataclass
class Demuxed:
    streams: dict[int, Stream]
    errors: list[str]


def demux(data: bytes) -> Demuxed:
    streams: dict[int, Stream] = {}
    errors: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            errors.append(f"no page at {at}")
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        n = data[at + 26] if at + 27 <= len(data) else 0
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if len(data) < at + 27 or len(page) < size or struct.unpack_from("<I", page, 22)[0] != checksum(page[:22] + b"\0\0\0\0" + page[26:]):
            errors.append(f"bad checksum at {at}")
            at = data.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        flags, granule, serial, number = struct.unpack_from("<BqII", page, 5)
        s = streams.setdefault(serial, Stream(serial))
        lost = number != s.next_page
        if lost:
            errors.append(f"stream {serial}: page {s.next_page} is missing")
            s.partial = []
        broken = flags & CONTINUED and not s.partial
        if not flags & CONTINUED and s.partial:
            errors.append(f"stream {serial}: a packet was cut")
            s.partial = []
        body, done = 27 + n, []
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                part, body, run = page[body : body + run], body + run, 0
                if broken:  # the rest of a packet whose beginning is lost
                    errors.append(f"stream {serial}: a packet's beginning is lost")
                    broken, s.partial = False, []
                    continue
                done.append(b"".join([*s.partial, part]))
                s.partial = []
        if run and not broken:
            s.partial.append(page[body : body + run])
        s.packets += done
        s.granules += [-1] * (len(done) - 1) + [granule] * bool(done)
        s.pages += 1
        s.next_page = number + 1
        s.ended |= bool(flags & LAST)
        at += size
    errors += [f"stream {s.serial}: no last page" for s in streams.values() if not s.ended]
    return Demuxed(streams, errors)


def packet_times(s: Stream, rate: int) -> list[tuple[int, int]]:
    """(first, past last) sample of each data packet of an audio stream.

    Only a page's last packet has a granule position; those before it follow from their sizes, counted back.
    """
    ends: list[int] = []
    granule = None
    for packet, g in zip(reversed(s.packets[1:]), reversed(s.granules[1:])):
        if g >= 0:
            granule = g
        ends.append(granule if granule is not None else -1)
        if granule is not None:
            granule -= len(packet)
    ends.reverse()
    return [(e - len(p), e) for p, e in zip(s.packets[1:], ends)]


def read_audio(media: bytes) -> tuple[bytes, int, dict]:
    """(samples, bytes before padding, what was found) of a stored value; raises ValueError if it is damaged."""
    got = demux(media)
    if got.errors:
        raise ValueError("; ".join(got.errors))
    audio, index = got.streams[AUDIO], got.streams[INDEX]
    head = audio.packets[0]
    if head[:8] != MAGIC:
        raise ValueError("not an 8-bit audio stream")
    rate, _ = struct.unpack("<II", head[8:16])
    n_bytes, stored = struct.unpack("<QQ", index.packets[1])
    times = packet_times(audio, rate)
    samples = b"".join(audio.packets[1:])
    if len(samples) != stored or any(a[1] != b[0] for a, b in zip(times, times[1:])) or times[0][0] != 0:
        raise ValueError("granule positions do not follow the packets")
    return samples, n_bytes, {"rate": rate, "pages": audio.pages + index.pages, "packets": len(times), "end": times[-1][1]}


def features(samples: bytes, found: dict) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    power = int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"rate={found['rate']};pages={found['pages']};packets={found['packets']};seconds={found['end'] / found['rate']:.6f};"
        f"peak={int(np.abs(x).max())};rms={(power / len(x)) ** 0.5:.6f};crossings={crossings};mean={float(x.mean()):.6f}"
    )


def text_media(docs: DataFrame) -> DataFrame:
    """Every row with its text as Ogg media: column media (binary)."""

    def kernel(texts: list) -> dict:
        out = []
        for text in texts:
            text = text or b""
            out.append(mux(text + bytes(-len(text) % BLOCK if text else BLOCK), len(text)))
        return {"media": out}

    return per_text(docs, "text", kernel, "media binary")


def media_digest(rows: DataFrame, media: str = "media") -> DataFrame:
    """Every row with what its stored media holds: sizes, hashes, features; `error` where it is damaged."""
    fields = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "error": "string"}

    def kernel(values: list) -> dict:
        out: dict[str, list] = {name: [] for name in fields}
        for value in values:
            row = dict.fromkeys(fields)
            if value:
                row |= {"media_bytes": len(value), "media_sha256": hashlib.sha256(value).hexdigest()}
                try:
                    samples, n_bytes, found = read_audio(value)
                    row |= {"n_bytes": n_bytes, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-BLOCK:]), "feature": features(samples, found)}
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    row["error"] = str(e) or type(e).__name__
            for name in fields:
                out[name].append(row[name])
        return out

    return per_text(rows, media, kernel, ", ".join(f"{n} {t}" for n, t in fields.items()))


def media_packets(rows: DataFrame, media: str = "media", stream: int = AUDIO) -> DataFrame:
    """One row for each data packet of a logical stream: the other columns, packet number, start and end in seconds, data."""

    def kernel(values: list) -> dict:
        out = []
        for value in values:
            got = demux(value or b"").streams.get(stream)
            times = packet_times(got, RATE) if got else []
            out.append([{"packet": i, "start": a / RATE, "end": b / RATE, "data": p} for i, ((a, b), p) in enumerate(zip(times, got.packets[1:] if got else []))])
        return {"packets": out}

    listed = per_text(rows, media, kernel, "packets array<struct<packet:int,start:double,end:double,data:binary>>")
    keep = [c for c in rows.columns if c.lower() != "packets"]
    return listed.select(*[f"`{c}`" for c in keep if c != media], F.inline("packets"))


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = media_digest(text_media(docs).drop("text"))
    return digest.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
