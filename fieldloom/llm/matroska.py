"""Matroska files as a media column.

Writer: a payload of 8-bit samples becomes one PCM track in a Matroska file
(EBML header, Segment with Info, Tracks, Clusters of SimpleBlocks, Cues). Frames
have 192 bytes; blocks lace up to 8 of them. Parser: variable-length EBML
elements, clusters of known or unknown size, BlockGroups and SimpleBlocks with
no, Xiph, fixed or EBML lacing, and cues give a packet table with track,
timestamp, byte range and key flag. The frames of a lace follow each other by
the track's DefaultDuration; without one they share the block's time.

Null text is empty: its payload is one frame of spaces. Repeated rows repeat.
A damaged file raises ValueError in parse(); packets() gives such a row, or a
null one, no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME, LACE, PER_CLUSTER, RATE = 192, 8, 64, 8000
# Element ids of the Matroska format.
EBML, SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
FRAME_TIME = 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_PLACE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOCTYPE, DOCVERSION, READVERSION = 0x4282, 0x4287, 0x4285
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(key: int, x: float) -> bytes:
    return element(key, struct.pack(">d", x))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The lacing header and frames; kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    head = b"" if kind == 0 else bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3 and len(frames) > 1:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def write(payload: bytes, lacing: int = 2) -> bytes:
    """A Matroska file of the payload; time unit: one frame."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    unit = FRAME * 1_000_000_000 // RATE
    info = element(INFO, number(SCALE, unit) + real(DURATION, float(len(frames))))
    audio = element(AUDIO, real(FREQUENCY, float(RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(FRAME_TIME, unit) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, points = bytearray(info + tracks), b""
    step = LACE if lacing else 1
    for c in range(0, len(frames), step * PER_CLUSTER):
        points += element(POINT, number(CUE_TIME, c) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_PLACE, len(body))))
        blocks = number(TIME, c)
        for i in range(c, min(c + step * PER_CLUSTER, len(frames)), step):
            part = frames[i : i + step]
            kind = 3 if lacing == 2 and len(part[-1]) != len(part[0]) else lacing  # fixed lacing needs equal frames
            blocks += element(SIMPLE, vint(1) + struct.pack(">hB", i - c, 0x80 | kind << 1) + laced(part, kind))
        body += element(CLUSTER, blocks)
    body += element(CUES, points)
    head = element(EBML, element(DOCTYPE, b"matroska") + number(DOCVERSION, 4) + number(READVERSION, 2))
    return head + element(SEGMENT, bytes(body))


def _vint(data: bytes, at: int, marked: bool) -> tuple[int, int, bool]:
    """Value, next place and whether all value bits are set."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("cut short")
    value = raw & (1 << 7 * width) - 1
    return (raw if marked else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, stop: frozenset = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte of the element, of its body, end); a body of unknown size ends at an id in stop or at end."""
    while at < end:
        begin = at
        key, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at, False)
        if unknown:
            last = at
            for k, b, _, e in elements(data, at, end):
                if k in TOP and key == CLUSTER:
                    break
                last = e
            stop_at = last
        else:
            stop_at = at + size
        if stop_at > end:
            raise ValueError("an element ends after its parent")
        yield key, begin, at, stop_at
        at = stop_at


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of a block's frames."""
    track, at, _ = _vint(data, at, False)
    rel, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, rel, flags, [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    elif kind == 3:
        for i in range(count - 1):
            before = at
            n, at, _ = _vint(data, at, False)
            sizes.append(n if i == 0 else sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a laced frame ends after its block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, rel, flags, out


def parse(data: bytes) -> tuple[list[tuple[int, int, int, int, bool]], list[tuple[int, int, int]], int]:
    """Packets (track, time in ns, offset, size, key), cues (time in ns, track, byte place) and the time scale."""
    top = list(elements(data, 0, len(data)))
    segment = next(((b, e) for k, _, b, e in top if k == SEGMENT), None)
    if segment is None or top[0][0] != EBML:
        raise ValueError("not a Matroska file")
    uint = lambda b, e: int.from_bytes(data[b:e], "big")
    scale, packets, cues = 1_000_000, [], []
    inside = list(elements(data, *segment))
    entries = [{i: uint(p, q) for i, _, p, q in elements(data, x, y) if i in (NUMBER, FRAME_TIME)} for key, _, b, e in inside if key == TRACKS for k, _, x, y in elements(data, b, e) if k == ENTRY]
    each = {t[NUMBER]: t.get(FRAME_TIME, 0) for t in entries}
    for key, _, b, e in inside:
        if key == INFO:
            scale = next((uint(x, y) for k, _, x, y in elements(data, b, e) if k == SCALE), scale)
        elif key == CLUSTER:
            base = 0
            for k, _, x, y in elements(data, b, e):
                if k == TIME:
                    base = uint(x, y)
                blocks = [(x, y, None)] if k == SIMPLE else []
                if k == GROUP:
                    inner = list(elements(data, x, y))
                    blocks = [(p, q, all(j != REFERENCE for j, *_ in inner)) for i, _, p, q in inner if i == BLOCK]
                for p, q, is_key in blocks:
                    track, rel, flags, ranges = frames_of(data, p, q)
                    packets += [(track, (base + rel) * scale + i * each.get(track, 0), at, n, bool(flags & 0x80) if is_key is None else is_key) for i, (at, n) in enumerate(ranges)]
        elif key == CUES:
            for k, _, x, y in elements(data, b, e):
                if k == POINT:
                    parts = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                    place = {i: uint(p, q) for i, _, p, q in elements(data, *parts[POSITIONS])}
                    cues.append((uint(*parts[CUE_TIME]) * scale, place[CUE_TRACK], segment[0] + place[CUE_PLACE]))
    return packets, cues, scale


def packets(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, seq, track, time_ns, byte_offset, size, is_key): the packet table of a binary column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[key], b[column]):
                try:
                    found = parse(bytes(data))[0] if data is not None else []
                except (ValueError, IndexError, KeyError, struct.error):
                    found = []
                yield pd.DataFrame([(k, i, *p) for i, p in enumerate(found)], columns=[key, "seq", "track", "time_ns", "byte_offset", "size", "is_key"]).astype({key: "Int64"})

    return files.select(key, column).mapInPandas(run, f"{key} bigint, seq bigint, track bigint, time_ns bigint, byte_offset bigint, size bigint, is_key boolean")


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_column(docs: DataFrame, lacing: int = 2, with_media: bool = False) -> DataFrame:
    """Write each text as a file, read its packets back and derive digests and a feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = write(raw + b" " * (-len(raw) % FRAME if raw else FRAME), lacing)
                found, cues, _ = parse(media)
                back = b"".join(media[at : at + n] for _, _, at, n, _ in found)
                loud = np.frombuffer(back, np.uint8).astype(np.int64)
                turns = int(np.count_nonzero(np.diff(loud > 128)))
                feature = f"packets={len(found)};clusters={len(cues)};end_ns={found[-1][1]};sum={int(loud.sum())};peak={int(loud.max())};turns={turns}"
                row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                out.append((*row, media) if with_media else row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in (DIGESTS + ", media x" * with_media).split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, DIGESTS + ", media binary" * with_media)
