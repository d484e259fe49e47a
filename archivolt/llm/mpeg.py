"""Media columns of MPEG audio: frames, tags, variable-bitrate tables, checksums, seek offsets.

A media column is a binary column that holds one MPEG audio file a row. `read`
is the reader of one file, `media_columns` applies it to a table; `payload_media`
makes such a column from texts, whose bytes travel in the ancillary data of
silent Layer III frames and come back unchanged.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the format: kilobits a second by (MPEG-1?, layer), sampling rates by version, samples a frame.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
SYNC = re.compile(rb"\xff[\xe0-\xff]")

UNIT, PER_BATCH = 64, 1 << 23
SIDE = 32  # the writer makes MPEG-1 Layer III of two channels at 48 kHz


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    side: int  # bytes of side information after the header (Layer III)

    def like(self, other: Header) -> bool:
        """Whether both can be of one stream."""
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None: reserved values, and the free format, whose frames tell no length."""
    if len(four) < 4:
        return None
    bits = int.from_bytes(four, "big")
    version, layer, rate, kbps = VERSIONS.get(bits >> 19 & 3), 4 - (bits >> 17 & 3), bits >> 10 & 3, bits >> 12 & 15
    if bits >> 21 != 0x7FF or version is None or layer == 4 or rate == 3 or kbps in (0, 15) or bits & 3 == 2:
        return None
    first, mono, padded = version == "1", bits >> 6 & 3 == 3, bits >> 9 & 1
    kbps, rate = BITRATES[first, layer][kbps - 1], RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    length = (12_000 * kbps // rate + padded) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padded
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not bits >> 16 & 1, kbps, rate, length, samples, side)


@lru_cache(maxsize=2)
def crc_table(reflected: bool) -> np.ndarray:
    """Steps of the 16-bit checksum by x¹⁶ + x¹⁵ + x² + 1, for bytes read from their high or their low bit."""
    steps = []
    for n in range(256):
        c = n if reflected else n << 8
        for _ in range(8):
            c = (c >> 1 ^ 0xA001 if c & 1 else c >> 1) if reflected else (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        steps.append(c)
    return np.array(steps, np.uint16)


def frame_crcs(rows: np.ndarray) -> np.ndarray:
    """Checksums of frames, a row of bytes each, as their headers announce them."""
    table, crc = crc_table(False), np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << 8) ^ table[(crc >> 8) ^ column]
    return crc


@lru_cache(maxsize=64)
def after_zeros(count: int) -> tuple[np.ndarray, np.ndarray]:
    """What `count` more zero bytes make of a checksum, by its low and by its high byte: the map is linear."""
    if count == 1:
        crc = np.arange(256, dtype=np.uint16)
        return crc_table(True), crc
    low, high = after_zeros(count // 2)
    both = [low[t & 0xFF] ^ high[t >> 8] for t in (low, high)]
    if count % 2:
        both = [(t >> 8) ^ crc_table(True)[t & 0xFF] for t in both]
    return both[0], both[1]


def tag_crc(data: bytes) -> int:
    """The same checksum of a table frame's first 190 bytes, byte by byte."""
    table, crc = _steps(), 0
    for byte in data:
        crc = crc >> 8 ^ table[(crc ^ byte) & 0xFF]
    return crc


@lru_cache(maxsize=1)
def _steps() -> list[int]:
    return crc_table(True).tolist()


def music_crc(data: bytes, width: int = 32) -> int:
    """The checksum of a whole file's frames, zero at the start, over `width` bytes at a time and joined in pairs."""
    table, n = crc_table(True), max(1, -(-len(data) // width))
    rows = 1 << (n - 1).bit_length()  # zero bytes in front change nothing
    grid = np.frombuffer(data.rjust(rows * width, b"\0"), np.uint8).reshape(rows, width)
    crc = np.zeros(rows, np.uint16)
    for column in grid.T:
        crc = (crc >> 8) ^ table[(crc ^ column) & 0xFF]
    span = width
    while len(crc) > 1:
        low, high = after_zeros(span)
        crc = low[crc[::2] & 0xFF] ^ high[crc[::2] >> 8] ^ crc[1::2]
        span *= 2
    return int(crc[0])


def synchsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * k for k, x in enumerate(reversed(b)))


def to_synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def id3_text(body: bytes) -> str:
    """The text of a text frame; parts after a terminator are joined by '='."""
    text = body[1:].decode(ENCODINGS.get(body[:1] and body[0], "latin-1"), "replace")
    return "=".join(p for p in text.split("\0") if p)


def id3v2(data: bytes, at: int = 0) -> tuple[int, list[tuple[str, str]]]:
    """Length of the ID3v2 tag at a place (0: none) and its text frames; damaged frames end the list."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or head[3] not in (2, 3, 4) or max(head[6:10]) > 127:
        return 0, []
    size, flags, major = synchsafe(head[6:10]), head[5], head[3]
    body, total = data[at + 10 : at + 10 + size], 10 + size + (10 if flags & 0x10 else 0)
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and len(body) >= 4:
        body = body[(synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")) :]
    out, p, wide = [], 0, 6 if major == 2 else 10
    while p + wide <= len(body) and body[p]:
        name = body[p : p + (3 if major == 2 else 4)].decode("latin-1")
        raw = body[p + 3 : p + 6] if major == 2 else body[p + 4 : p + 8]
        n = synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        content = body[p + wide : p + wide + n]
        if n == 0 or len(content) < n:
            break
        if major == 4 and body[p + 9] & 0x02:
            content = content.replace(b"\xff\x00", b"\xff")
        if name[0] == "T":
            out.append((name, id3_text(content)))
        p += wide + n
    return min(total, len(data) - at), out


def tail_tags(data: bytes) -> tuple[int, list[tuple[str, str]]]:
    """Where the frames end, before an ID3v1 tag and an APE tag in front of it, and the tags' fields."""
    end, out = len(data), []
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        fields = {"title": data[end + 3 : end + 33], "artist": data[end + 33 : end + 63], "album": data[end + 63 : end + 93], "year": data[end + 93 : end + 97]}
        out += [("id3v1:" + k, t) for k, v in fields.items() if (t := v.split(b"\0")[0].decode("latin-1").strip())]
    foot = data[max(0, end - 32) : end]
    if len(foot) == 32 and foot[:8] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", foot[12:24])
        start = end - size
        if 0 <= start and size >= 32:
            p = start
            for _ in range(count):
                if p + 8 > end - 32 or (stop := data.find(b"\0", p + 8, end - 32)) < 0:
                    break
                n, kind = struct.unpack("<II", data[p : p + 8])
                if stop + 1 + n > end - 32:
                    break
                if kind & 6 == 0:
                    out.append(("ape:" + data[p + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")))
                p = stop + 1 + n
            end = max(0, start - (32 if flags & 0x80000000 else 0))
    return end, out


@dataclass
class Table:
    """What a variable-bitrate table says; None where it says nothing."""

    kind: str
    frames: int | None = None
    size: int | None = None
    toc: tuple[int, ...] = ()
    delay: int = 0
    padding: int = 0
    music_crc: int | None = None
    tag_crc_ok: bool | None = None


def vbr_table(frame: bytes, h: Header) -> Table | None:
    """The Xing, Info or VBRI table in a stream's first frame, with the encoder's extension if it is there."""
    at = next((p for p in (4 + h.side, 6 + h.side) if h.layer == 3 and frame[p : p + 4] in (b"Xing", b"Info")), None)
    if at is not None and len(frame) >= at + 8:
        out, flags, p = Table(frame[at : at + 4].decode()), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            out.size, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc, p = tuple(frame[p : p + 100]), p + 100
        if flags & 8:
            p += 4
        if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 36:
            gaps = int.from_bytes(frame[p + 21 : p + 24], "big")
            out.delay, out.padding = gaps >> 12, gaps & 0xFFF
            out.music_crc = int.from_bytes(frame[p + 32 : p + 34], "big")
            out.tag_crc_ok = tag_crc(frame[: p + 34]) == int.from_bytes(frame[p + 34 : p + 36], "big")
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, delay, _, size, frames, n, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        steps = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(n)]
        return Table("VBRI", frames, size, tuple(steps), delay)
    return None


@dataclass
class Audio:
    """An MPEG audio file as it was read."""

    first: Header | None = None
    offsets: list[int] = field(default_factory=list)  # of all frames with sound, in bytes
    kbps: list[int] = field(default_factory=list)
    samples: int = 0
    skipped: int = 0  # bytes between, before and after frames that are neither frame nor tag
    resyncs: int = 0
    table: Table | None = None
    tags: list[tuple[str, str]] = field(default_factory=list)
    checked: int = 0
    crc_failed: int = 0
    music_crc_ok: bool | None = None
    payload: bytes = b""


def followed(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame of the same stream, a tag or nothing comes after the frame at a place."""
    after = at + h.length
    then = header(data[after : after + 4])
    return after == len(data) or (then is not None and then.like(h)) or data[after : after + 3] == b"ID3"


def next_frame(data: bytes, at: int, end: int, like: Header | None) -> int:
    """The next place from `at` on with a frame of the stream that another follows, or `end`."""
    for m in SYNC.finditer(data, at, end):
        h = header(data[m.start() : m.start() + 4])
        if h is not None and (like is None or h.like(like)) and m.start() + h.length <= end and (m.start() + h.length == end or followed(data, m.start(), h)):
            return m.start()
    return end


def read(data: bytes) -> Audio:
    """Read a file from end to end; what is no frame and no tag is passed over and counted.

    Frames are found by their headers. At a place without one, reading goes on
    at the next place where two fitting headers stand a frame apart, or where
    one frame fills the rest. A frame cut off by the end of the file is no
    frame, and a tag inside a frame no tag. Empty and foreign bytes give no
    frames, whatever they hold.
    """
    out, at, main, music = Audio(), 0, [], []
    tail, tail_texts = tail_tags(data)
    protected: dict[int, list[int]] = {}
    sure = False  # the place was found by a search
    while at < len(data):
        h = header(data[at : at + 4])
        end = at + (h.length if h else 0)
        if h is None or end > len(data) or not (sure or (out.first is not None and h.like(out.first) and end <= tail) or ((out.first is None or h.like(out.first)) and (end == tail or followed(data, at, h)))):
            tag, texts = id3v2(data, at)
            if tag:
                at, out.tags = at + tag, out.tags + texts
                continue
            if at == tail:
                out.tags += tail_texts
                break
            stop = tail if tail > at else len(data)
            place = next_frame(data, at + 1, stop, out.first)
            sure = place < stop
            out.resyncs += sure
            out.skipped += place - at
            at = place
            continue
        sure = False
        if out.first is None:
            out.first = h
            out.table = vbr_table(data[at:end], h)
            if out.table is not None:
                at = end
                continue
        if h.protected:
            protected.setdefault(h.side, []).append(at)
        out.offsets.append(at)
        out.kbps.append(h.kbps)
        out.samples += h.samples
        main.append(data[at + 4 + (2 if h.protected else 0) + h.side : end])
        music.append(data[at:end])
        at = end
    for side, places in protected.items():
        if out.first.layer == 3:  # the checksum of the other layers spans bits of the sound itself
            raw, p = np.frombuffer(data, np.uint8), np.array(places)[:, None]
            spans = np.concatenate([raw[p + np.arange(2, 4)], raw[p + np.arange(6, 6 + side)]], axis=1)
            told = raw[p[:, 0] + 4].astype(np.uint16) << 8 | raw[p[:, 0] + 5]
            out.checked += len(places)
            out.crc_failed += int((frame_crcs(spans) != told).sum())
    if out.table is not None and out.table.music_crc is not None:
        out.music_crc_ok = music_crc(b"".join(music)) == out.table.music_crc
        out.samples -= min(out.samples, out.table.delay + out.table.padding)
    out.payload = b"".join(main)
    size = next((t.split("=", 1)[1] for k, t in out.tags if k == "TXXX" and t.startswith("payload=")), "")
    out.payload = out.payload[: int(size)] if size.isdecimal() else b""
    return out


def frame_head(kbps: int, protected: bool) -> bytes:
    return struct.pack(">I", 0xFFFA0000 | (0 if protected else 1) << 16 | (BITRATES[True, 3].index(kbps) + 1) << 12 | 1 << 10)


@lru_cache(maxsize=16)
def silent_head(kbps: int) -> bytes:
    """Header, checksum and side information of a frame without sound."""
    head = frame_head(kbps, True)
    crc = frame_crcs(np.frombuffer(head[2:] + bytes(SIDE), np.uint8)[None])
    return head + struct.pack(">H", int(crc[0])) + bytes(SIDE)


def write(payload: bytes) -> bytes:
    """A file of silent frames that carries payload in its ancillary data.

    An ID3v2 tag tells the payload's length. A table frame gives the number of
    frames and bytes, a hundred seek points and the checksums. Frames are of the
    highest bitrate, but for the last, which is of the lowest that holds the rest.
    """
    sizes = {k: 3 * k - 6 - SIDE for k in BITRATES[True, 3]}  # bytes free in a frame of so many kilobits a second
    most = max(sizes.values())
    parts, starts, at = [], [], 0
    while at < len(payload) or not parts:
        rest = payload[at : at + most]
        kbps = min(k for k, n in sizes.items() if n >= len(rest))
        parts.append((silent_head(kbps), rest.ljust(sizes[kbps], b"\0")))
        at += most
    frames = [head + body for head, body in parts]
    place = 3 * 64
    for f in frames:
        starts.append(place)
        place += len(f)
    toc = bytes(min(255, 256 * starts[k * len(frames) // 100] // place) for k in range(100))
    head = frame_head(64, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), place) + toc + struct.pack(">I", 0)
    lame = b"LAME3.100" + bytes(12) + b"\0\0\0" + bytes(4) + struct.pack(">I", place)
    music = b"".join(frames)
    table = head + lame + struct.pack(">H", music_crc(music))
    table += struct.pack(">H", tag_crc(table))
    text = b"\3payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + to_synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + to_synchsafe(len(tag)) + tag + table + music


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def feature(a: Audio) -> str:
    """What was read, in one line: format, exact duration, frames, seek offsets, tables and checks."""
    h, t = a.first, a.table
    if h is None:
        return "none"
    seeks = zlib.crc32(np.array(a.offsets, "<u8").tobytes())
    toc = "none" if t is None else f"{t.kind}:{t.frames}:{t.size}:{zlib.crc32(bytes(x & 255 for x in t.toc)):08x}"
    checks = f"{a.checked - a.crc_failed}/{a.checked},{a.music_crc_ok},{t and t.tag_crc_ok}"
    bits = f"{min(a.kbps)}-{max(a.kbps)}" if a.kbps else "0"
    return f"mpeg{h.version} layer{h.layer} {h.rate}Hz samples={a.samples} frames={len(a.offsets)} kbps={bits} seeks={seeks:08x} toc={toc} crc={checks} skipped={a.skipped} tags={len(a.tags)}"


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
INFO = pa.struct(
    [("version", pa.string()), ("layer", pa.int32()), ("rate", pa.int32()), ("samples", pa.int64()), ("seconds", pa.float64())]
    + [("frame_offsets", pa.list_(pa.int64())), ("tags", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))]
    + [("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("music_crc_ok", pa.bool_())]
    + [("skipped", pa.int64()), ("resyncs", pa.int64()), ("payload", pa.binary()), ("feature", pa.string())]
)
INFO_DDL = (
    "struct<version:string,layer:int,rate:int,samples:bigint,seconds:double,frame_offsets:array<bigint>,tags:array<struct<name:string,value:string>>,"
    "table_frames:bigint,table_bytes:bigint,crc_checked:bigint,crc_failed:bigint,music_crc_ok:boolean,skipped:bigint,resyncs:bigint,payload:binary,feature:string>"
)


def info(data: bytes | None) -> dict | None:
    """The columns of one file; null for null."""
    if data is None:
        return None
    a = read(data)
    h, t = a.first, a.table
    return {
        "version": h and h.version, "layer": h and h.layer, "rate": h and h.rate, "samples": a.samples, "seconds": a.samples / h.rate if h else 0.0,
        "frame_offsets": a.offsets, "tags": [{"name": k, "value": v} for k, v in a.tags], "table_frames": t and t.frames, "table_bytes": t and t.size,
        "crc_checked": a.checked, "crc_failed": a.crc_failed, "music_crc_ok": a.music_crc_ok, "skipped": a.skipped, "resyncs": a.resyncs, "payload": a.payload, "feature": feature(a),
    }


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of some megabytes each, so that what a task holds does not grow with a batch."""
    start = total = 0
    for n, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + size > PER_BATCH:
            yield batch.slice(start, n - start)
            start, total = n, 0
        total += size
    yield batch.slice(start)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _runs(batch, "text"):
            made = [padded(t.as_py()) for t in run.column("text")]
            yield pa.record_batch([run.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], schema=MEDIA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _runs(batch, "media"):
            found = pa.array([info(m.as_py()) for m in run.column("media")], INFO)
            yield pa.RecordBatch.from_arrays([*run.columns, found], names=[*run.schema.names, "audio"])


def payload_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG audio file; a null text is empty.

    n_bytes counts the text's bytes without the zeros that fill it up. Rows are
    independent: repeated rows give repeated results, a null doc_id stays null,
    other columns are not read, an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def media_columns(rows: DataFrame) -> DataFrame:
    """Rows with a column `media`, and `audio`: what its MPEG audio file holds.

    Durations are exact: samples of the frames there are, less the encoder's
    delay and padding where they are told. frame_offsets are the places to seek
    to, in bytes. Null media have null audio; bytes without a frame give no
    format, no offsets and a duration of 0. A column `audio` of rows is replaced.
    """
    kept = rows.drop("audio")
    return kept.mapInArrow(_read, StructType([*kept.schema.fields, *StructType.fromDDL(f"audio {INFO_DDL}").fields]))


def op11_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` as MPEG audio, read back; odd rows as in payload_media."""
    read_back = media_columns(payload_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    payload = F.col("audio.payload")
    return read_back.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -UNIT, UNIT)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "audio.feature", "audio.samples", "audio.seconds",
    )
