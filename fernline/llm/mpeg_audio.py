"""MPEG audio columns: writing and reading MPEG-1, -2 and -2.5 streams.

Reading (`parse`), of Layers I, II and III: skips an ID3v2 tag (with its extended header, footer and unsynchronisation),
resynchronises on frame headers (a header counts when the frame it announces is followed by another header of the same kind, by
a tag or by the end; of free-format frames, which don't say how long they are, the distance of two headers does), reads the variable-bitrate
table (Xing, Info or VBRI), the encoder's delay and padding and an ID3v1 tag, verifies the frames' CRC-16 (of Layers I and III;
those of Layer II are counted as unchecked), and gives exact durations (samples and rate, with delay and padding taken off) and the
byte offset of every frame.

Writing (`pack`): stores bytes losslessly in the ancillary data of silent MPEG-2 Layer III frames (16 kHz,
mono, 576 samples a frame), 576 bytes a frame and so one byte a sample, after a frame with the
variable-bitrate table. The last frame has a higher bitrate than the others.

Defined cases: a null or empty text is one frame of filling bytes; a null or broken stream has no frames; bytes
that belong to no frame are counted and skipped; equal texts give equal columns; texts of any length are taken whole, one at a time; ids
may be null or repeat, each row has its own result; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK, FILL = 576, 255
#: Fixed values of the format: kbit/s by bitrate index, for MPEG-1 and for MPEG-2 and -2.5, by layer; Hz by rate index for MPEG-1.
MPEG1_L1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
MPEG1_L2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
MPEG1_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_L1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
MPEG2_L3 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int  # 0: free format
    rate: int
    channels: int
    length: int  # 0: free format
    samples: int
    side: int  # bytes after header and checksum that the checksum covers; -1: not known
    pad: int

    def like(self, other: Header | None) -> bool:
        return other is not None and (self.version, self.layer, self.rate, self.kbps == 0) == (other.version, other.layer, other.rate, other.kbps == 0)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """A frame header, or None if the four bytes aren't one."""
    if four not in _headers:
        if len(_headers) > 65_536:
            _headers.clear()
        _headers[four] = _header(four)
    return _headers[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = ((MPEG1_L1, MPEG1_L2, MPEG1_L3) if version == 1 else (MPEG2_L1, MPEG2_L3, MPEG2_L3))[layer - 1][index]
    hz, pad = RATES[rate] // {1: 1, 2: 2, 25: 4}[version], four[2] >> 1 & 1
    mode, samples = four[3] >> 6, 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    slot = 4 if layer == 1 else 1
    length = (samples // 8 // slot * kbps * 1000 // hz + pad) * slot if kbps else 0
    if layer == 3:
        side = (17 if mode == 3 else 32) if version == 1 else (9 if mode == 3 else 17)
    elif layer == 1:  # four bits of allocation for each band and channel; from the bound on, channels share them
        bound = (four[3] >> 4 & 3) * 4 + 4 if mode == 1 else 32
        side = 16 if mode == 3 else bound + (32 - bound) // 2
    else:
        side = -1
    return Header(version, layer, not four[1] & 1, kbps, hz, 1 if mode == 3 else 2, length, samples, side, pad * slot)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005 from 0xFFFF."""
    if (c := _crcs.get(data)) is None:
        c = 0xFFFF
        for x in data:
            c = (c << 8 ^ _CRC[(c >> 8) ^ x]) & 0xFFFF
        if len(_crcs) < 4096:
            _crcs[data] = c
    return c


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    channels: int = 0
    layer: int = 0
    bad_crc: int = 0
    unchecked: int = 0
    skipped: int = 0
    kbps: set[int] = field(default_factory=set)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] | None = None
    toc: bytes = b""

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding, where the stream tells them."""
        return max(0, self.samples - (self.vbr or {}).get("delay", 0) - (self.vbr or {}).get("padding", 0))

    @property
    def seconds(self) -> float:
        return self.played / self.rate if self.rate else 0.0


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Length of an ID3v2 tag at the start; its text frames go to ``tags``."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return 0
    size, version, flags = _synchsafe(data[6:10]), data[3], data[5]
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4 and version >= 3:
        at = _synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + name_size].isalnum():
        raw = body[at + name_size : at + 2 * name_size]
        n = int.from_bytes(raw, "big") if version < 4 else _synchsafe(raw)
        part = body[at + head : at + head + n]
        if version == 4 and (flags & 0x80 or body[at + 9] & 2):
            part = part.replace(b"\xff\x00", b"\xff")
        if body[at : at + 1] == b"T" and part:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(part[0], "latin-1")
            tags[body[at : at + name_size].decode("ascii", "replace")] = part[1:].decode(code, "replace").rstrip("\0")
        at += head + n
    return 10 + size + (10 if flags & 0x10 else 0)


def _vbr_table(data: bytes, at: int, h: Header) -> tuple[dict[str, int], bytes] | None:
    """The Xing, Info or VBRI table of a frame: frames and bytes where given, delay and padding, and the seek points."""
    p = at + 4 + 32
    if data[p : p + 4] == b"VBRI":
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", data[p + 10 : p + 26].ljust(16, b"\0"))
        out = {"frames": frames, "bytes": size, "quality": int.from_bytes(data[p + 8 : p + 10], "big"), "scale": scale, "frames_per_point": per}
        return out, data[p + 26 : p + 26 + entries * width]
    p = at + 4 + 2 * h.protected + h.side
    if h.layer != 3 or data[p : p + 4] not in (b"Xing", b"Info"):
        return None
    flags, p, out, toc = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {}, b""
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
    if flags & 4:
        toc, p = data[p : p + 100], p + 100
    if flags & 8:
        out["quality"], p = int.from_bytes(data[p : p + 4], "big"), p + 4
    if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h.length:
        both = int.from_bytes(data[p + 21 : p + 24], "big")
        out["delay"], out["padding"] = both >> 12, both & 0xFFF
    return out, toc


def _free_length(data: bytes, at: int, h: Header, end: int) -> int:
    """Length of a free-format frame without its padding: up to the next header of the kind; 0 if there is none."""
    p = data.find(b"\xff", at + 4, end)
    while 0 <= p and p + 4 <= end:
        if h.like(header(data[p : p + 4])):
            return p - at - h.pad
        p = data.find(b"\xff", p + 1, end)
    return 0


def parse(data: bytes | None) -> Stream:
    """Frames, tags, tables and checksums of a stream. The frame with the variable-bitrate table holds no sound and is not counted."""
    s = Stream()
    if not data:
        return s
    at, end = min(len(data), _id3v2(data, s.tags)), len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                s.tags.setdefault(name, text)
    first, synced, free = True, False, 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        length = 0
        if h is not None:
            if h.length:
                length = h.length
            else:
                free = free if synced and free else _free_length(data, at, h, end)
                length = free + h.pad if free else 0
        if length and at + length <= end and not synced and at + length != end:
            if at + length + 4 > end or not h.like(header(data[at + length : at + length + 4])):
                length = 0
        if not length or at + length > end:
            # resynchronise on the next byte that can begin a header
            synced, skip = False, data.find(b"\xff", at + 1, end)
            skip = end if skip < 0 else skip
            s.skipped += skip - at
            at = skip
            continue
        synced = True
        if h.protected:
            if h.side < 0:
                s.unchecked += 1
            elif crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                s.bad_crc += 1
        if first and (table := _vbr_table(data, at, h)):
            s.vbr, s.toc = table
        else:
            s.offsets.append(at)
            s.lengths.append(length)
            s.samples += h.samples
            s.kbps.add(h.kbps)
        s.rate, s.channels, s.layer, first = h.rate, h.channels, h.layer, False
        at += length
    s.skipped += max(0, end - at)
    return s


def _frame_start(kbps: int) -> bytes:
    """Header, checksum and side information of a silent protected frame of the written kind."""
    head = bytes((0xFF, 0xF2, MPEG2_L3.index(kbps) << 4 | 2 << 2, 0xC0))
    side = bytes(9)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


#: Bitrates of the written frames (648 and 720 bytes): all but the last, and the last.
USUAL, FINAL = 144, 160
_USUAL_START, _FINAL_START = _frame_start(USUAL), _frame_start(FINAL)
USUAL_LENGTH, FINAL_LENGTH = 648, 720
_USUAL_PAD, _FINAL_PAD = bytes(USUAL_LENGTH - len(_USUAL_START) - BLOCK), bytes(FINAL_LENGTH - len(_FINAL_START) - BLOCK)


def pack(payload: bytes) -> bytes:
    """A stream that carries ``payload`` (a positive multiple of BLOCK bytes)."""
    n = len(payload) // BLOCK
    if not n or len(payload) % BLOCK:
        raise ValueError(f"a payload is a positive multiple of {BLOCK} bytes")
    total = USUAL_LENGTH * n + FINAL_LENGTH  # with the table's frame
    toc = bytes(min(255, 256 * (USUAL_LENGTH + min(i * n // 100, n - 1) * USUAL_LENGTH) // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    parts = [_USUAL_START + table + bytes(USUAL_LENGTH - len(_USUAL_START) - len(table))]
    view = memoryview(payload)
    for i in range(n - 1):
        parts += (_USUAL_START, view[i * BLOCK : (i + 1) * BLOCK], _USUAL_PAD)
    parts += (_FINAL_START, view[(n - 1) * BLOCK :], _FINAL_PAD)
    return b"".join(parts)


def unpack(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a packed stream, read from its parsed frames."""
    view, skip = memoryview(data), len(_USUAL_START)
    return b"".join([view[o + skip : o + skip + BLOCK] for o in (stream or parse(data)).offsets])


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes((FILL,)) * (-len(text) % BLOCK if text else BLOCK)


def feature(s: Stream) -> str:
    """Duration, bitrates, checks and a digest of the seek offsets, as one line."""
    seek = zlib.crc32(struct.pack(f">{len(s.offsets)}Q", *s.offsets))
    return f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};channels={s.channels};kbps={'/'.join(map(str, sorted(s.kbps)))};vbr_frames={(s.vbr or {}).get('frames', -1)};bad_crc={s.bad_crc};skipped={s.skipped};seek_crc32={seek}"


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as a stream, read it back, and describe both.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and of the stream read back the
    exact duration in seconds and the seek offset of every frame.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seconds double, offsets array<bigint>"
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "offsets"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]

    def one(text: bytes | None) -> tuple:
        media = pack(payload_of(text))
        stream = parse(media)
        back = unpack(media, stream)
        return len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream.seconds, stream.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 128):
                rows = [one(t.as_py()) for t in b.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[j] for r in rows], kinds[j]) for j in range(len(names))]], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def audio_index(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with a column ``audio``: what reading the streams in a binary column gives, seek offsets included."""
    kind = "frames bigint, samples bigint, rate int, seconds double, channels int, layer int, bad_crc bigint, unchecked bigint, skipped bigint, tags map<string,string>, vbr_frames bigint, vbr_bytes bigint, offsets array<bigint>"

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("seconds", pa.float64()), ("channels", pa.int32()), ("layer", pa.int32()), ("bad_crc", pa.int64()), ("unchecked", pa.int64()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("offsets", pa.list_(pa.int64()))]
        for b in batches:
            rows = []
            for x in b:
                s = parse(x.as_py())
                rows.append((len(s.offsets), s.samples, s.rate, s.seconds, s.channels, s.layer, s.bad_crc, s.unchecked, s.skipped, list(s.tags.items()), (s.vbr or {}).get("frames"), (s.vbr or {}).get("bytes"), s.offsets))
            yield pa.StructArray.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return media.withColumn("audio", F.arrow_udf(read, "struct<" + ",".join(f"{a}:{b}" for a, b in (x.split(" ") for x in kind.split(", "))) + ">")(F.col(column)))
