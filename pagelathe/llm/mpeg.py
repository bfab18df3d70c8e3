"""Media columns: MPEG audio streams as binary values, their frames, tags, tables and checksums."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of MPEG-1 Layer III: bit rates (kbit/s) by index, sampling rates (Hz) by index, samples of a frame.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152


@lru_cache(1)
def _crc_table() -> list[int]:
    """CRC-16 of each byte, by the polynomial 0x8005."""
    table = list(range(256))
    for i in table:
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        table[i] = c
    return table


@lru_cache(4096)
def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 as MPEG audio has it, most significant bit first."""
    table = _crc_table()
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    """What a frame header says."""

    rate: int
    bitrate: int
    length: int
    side: int
    protected: bool


@lru_cache(4096)
def header(h: bytes) -> Header | None:
    """An MPEG-1 Layer III header's fields, or None where these four bytes are none."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xFE != 0xFA or not 0 < h[2] >> 4 < 15 or h[2] >> 2 & 3 == 3 or h[3] & 3 == 2:
        return None
    rate, kbit = RATES[h[2] >> 2 & 3], BITRATES[h[2] >> 4]
    return Header(rate, kbit, 144_000 * kbit // rate + (h[2] >> 1 & 1), 17 if h[3] >> 6 == 3 else 32, not h[1] & 1)


@lru_cache(64)
def _start(index: int, protected: bool) -> bytes:
    """Header (mono, 48 kHz), checksum and empty side information of a frame."""
    h = bytes((0xFF, 0xFA | (not protected), index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return h + (crc16(h[2:] + side).to_bytes(2, "big") if protected else b"") + side


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


ROOM = {i: 3 * BITRATES[i] - 23 for i in range(1, 15)}


def pack(payload: bytes) -> bytes:
    """A stream that carries the payload losslessly in its frames' ancillary bytes: a tag with the payload's length, a frame with the variable-bit-rate table, and checksummed frames without audio of their own.

    Frames have the highest bit rate, the last one the lowest that holds what is left.
    """
    sizes, left = [14] * (len(payload) // ROOM[14]), len(payload) % ROOM[14]
    if left or not sizes:
        sizes.append(next(i for i in range(1, 15) if ROOM[i] >= left))
    frames, at = [], 0
    for i in sizes:
        body = payload[at : at + ROOM[i]]
        frames.append(_start(i, True) + body + bytes(ROOM[i] - len(body)))
        at += ROOM[i]
    total = 192 + sum(map(len, frames))
    n = len(frames)
    ends = [192]
    for f in frames:
        ends.append(ends[-1] + len(f))
    table = bytes(min(255, 256 * ends[p * n // 100] // total) for p in range(100))
    tag = b"Xing" + (0xF).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + table + (0).to_bytes(4, "big")
    info = _start(5, False) + tag
    info += crc16(info).to_bytes(2, "big")
    private = b"payload\0" + len(payload).to_bytes(8, "big")
    body = b"PRIV" + len(private).to_bytes(4, "big") + bytes(2) + private
    return b"ID3\x03\0\0" + _synchsafe(len(body)) + body + info + bytes(192 - len(info)) + b"".join(frames)


@dataclass
class Stream:
    """What a parsed stream holds."""

    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad: int = 0
    skipped: int = 0
    tag_bytes: int = 0
    table_frames: int = -1
    table_bytes: int = -1
    table_ok: bool = False

    @property
    def seconds(self) -> float:
        """Exact duration: samples over rate."""
        return self.samples / self.rate if self.rate else 0.0


def _tags(data: bytes) -> tuple[int, int]:
    """End of the leading tags, and the payload length that a private frame gives, or -1."""
    at, length = 0, -1
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and not any(b & 0x80 for b in data[at + 6 : at + 10]):
        size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        end, k = at + 10 + size, at + 10
        while k + 10 <= min(end, len(data)) and data[k]:
            n = int.from_bytes(data[k + 4 : k + 8], "big")
            if data[k : k + 4] == b"PRIV" and data[k + 10 : k + 18] == b"payload\0":
                length = int.from_bytes(data[k + 18 : k + 26], "big")
            k += 10 + n
        at = end + 10 * (data[at + 5] >> 4 & 1)
    return at, length


def parse(data: bytes | None) -> Stream:
    """Frames of a stream. A trailing tag counts where a frame ends right before it. After damage the next header is looked for that another one follows, or the end; frames whose checksum fails count as bad, and their bytes stay in the payload."""
    data = data or b""
    out = Stream()
    at, length = _tags(data)
    out.tag_bytes, parts, n = min(at, len(data)), [], len(data)
    end, tag = n, n - 128 if data[-128:-125] == b"TAG" else -1
    synced = False
    while at + 4 <= end:
        if synced and at == tag:
            break
        h = header(data[at : at + 4])
        if h and (at + h.length > end or not synced and at + h.length not in (tag, end) and not header(data[at + h.length : at + h.length + 4])):
            h = None
        if not h:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        synced = True
        skip = 4 + 2 * h.protected + h.side
        frame = data[at : at + h.length]
        if not out.offsets and out.table_frames < 0 and frame[skip : skip + 4] in (b"Xing", b"Info"):
            k, flags = skip + 8, int.from_bytes(frame[skip + 4 : skip + 8], "big")
            if flags & 1:
                out.table_frames, k = int.from_bytes(frame[k : k + 4], "big"), k + 4
            if flags & 2:
                out.table_bytes, k = int.from_bytes(frame[k : k + 4], "big"), k + 4
            k += 100 * bool(flags & 4) + 4 * bool(flags & 8)
            out.table_ok = crc16(frame[:k]) == int.from_bytes(frame[k : k + 2], "big")
        else:
            if h.protected and crc16(frame[2:4] + frame[6:skip]) != int.from_bytes(frame[4:6], "big"):
                out.bad += 1
            out.offsets.append(at)
            out.samples += SAMPLES
            out.rate = h.rate
            parts.append(frame[skip:])
        at += h.length
    out.payload = b"".join(parts)
    if 0 <= length <= len(out.payload):
        out.payload = out.payload[:length]
    return out


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text as UTF-8, zero-padded to a positive multiple of 64 bytes, in a stream. Null texts are empty; equal texts give equal streams; repeated rows stay; other columns play no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_bytes": list(map(len, raw)), "media": [pack(b + bytes(64 * max(1, -(-len(b) // 64)) - len(b))) for b in raw]})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(rows: DataFrame) -> DataFrame:
    """What the stored bytes of media() hold, read back: payload and stream digests, samples, rate, frame seek offsets and a feature string. A null or foreign stream has no frames and an empty payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc, n, m in x[["doc_id", "n_bytes", "media"]].itertuples(index=False):
                m = m or b""
                s = parse(m)
                seek = hashlib.md5(",".join(map(str, s.offsets)).encode()).hexdigest()[:12]
                feature = f"layer=3;rate={s.rate};frames={len(s.offsets)};table={s.table_frames};table_ok={int(s.table_ok)};samples={s.samples};ms={s.samples * 1000 // s.rate if s.rate else 0};bad={s.bad};skipped={s.skipped};seek={seek}"
                out.append((doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, s.samples, s.rate, s.offsets))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "frame_offsets"])

    return rows.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate long, frame_offsets array<long>")
