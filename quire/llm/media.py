"""ISO media containers: written with sample tables, and read by walking nested boxes.

A payload is stored as uncompressed 8-bit mono sound. A sample of the track is a frame of 64 bytes; 64 frames make a
chunk, whose first frame is a sync sample. Reading follows moov/trak/mdia/minf/stbl, joins the sample tables (stts,
stsc, stsz, stco or co64, stss) and gives codec, duration and the byte ranges of the sync samples; nothing is decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns

FRAME, CHUNK, RATE = 64, 64, 8000
#: Boxes that hold boxes.
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(fmt: str, rows: list) -> bytes:
    return struct.pack(">I", len(rows)) + b"".join(struct.pack(fmt, *r) for r in rows)


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def write(payload: bytes) -> bytes:
    """A file that holds payload, whose length is a positive multiple of 64, as one sound track."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    runs = [(1, CHUNK, 1)] if frames % CHUNK == 0 else [(1, frames, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, frames % CHUNK, 1)]
    kind = full(b"stsd", struct.pack(">I", 1), box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)))
    starts = np.arange(chunks, dtype=np.int64) * FRAME * CHUNK

    def head(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        where = (starts + first).astype(">u8" if wide else ">u4").tobytes()
        stbl = box(
            b"stbl", kind, full(b"stts", table(">II", [(frames, FRAME)])), full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK + 1).astype(">u4").tobytes()),
            full(b"stsc", table(">III", runs)), full(b"stsz", struct.pack(">II", FRAME, frames)), full(b"co64" if wide else b"stco", struct.pack(">I", chunks), where),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        media = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1)
        mdia = box(b"mdia", media, full(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQI4xQ8xHHH2x", 0, 0, 1, len(payload), 0, 0, 0x100), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, len(payload), 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    data = box(b"mdat", payload)
    size = len(head(0))
    first = size + len(data) - len(payload)
    made = head(first)
    if len(made) != size:
        made = head(first + len(made) - size)
    return made + data


def walk(data: memoryview) -> tuple[dict[bytes, tuple[int, int]], list[dict[bytes, tuple[int, int]]]]:
    """The bodies of the boxes outside tracks and of those in each track, nested ones too: the first of each kind.

    A stack holds what is left to walk, so boxes may be nested to any depth.
    """
    outside: dict[bytes, tuple[int, int]] = {}
    tracks: list[dict[bytes, tuple[int, int]]] = []
    left = [(0, len(data), outside)]
    while left:
        start, end, owner = left.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        left.append((stop, end, owner))
        if kind == b"trak":
            owner = {}
            tracks.append(owner)
        owner.setdefault(kind, (body, stop))
        if kind in NESTED:
            left.append((body, stop, owner))
    return outside, tracks


def read(data: bytes) -> dict:
    """Codec, time scale, duration, number of samples, the sync samples' byte ranges and all samples' (offset, size) of the first track.

    Every count is checked against the bytes of its box or of the file before anything of that size is made.
    """
    view = memoryview(data)
    tracks = walk(view)[1]
    if not tracks:
        raise ValueError("no track")
    found = tracks[0]

    def rows(kind: bytes, dtype: str, width: int = 1) -> np.ndarray:
        if kind not in found:
            return np.zeros((0, width), np.int64)
        at, stop = found[kind]
        n = struct.unpack_from(">I", view, at + 4)[0]
        if at + 8 + n * width * np.dtype(dtype).itemsize > stop:
            raise ValueError(f"more rows than {kind!r} has bytes")
        return np.frombuffer(view, dtype, n * width, at + 8).reshape(n, width).astype(np.int64)

    at = found[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
    codec = bytes(view[(d := found[b"stsd"][0] + 8) + 4 : d + 8]).decode("latin-1")
    at, stop = found[b"stsz"]
    same, n = struct.unpack_from(">II", view, at + 4)
    if n * (same or 1) > len(data) or not same and at + 12 + 4 * n > stop:
        raise ValueError("more samples than bytes")
    sizes = np.full(n, same, np.int64) if same else np.frombuffer(view, ">u4", n, at + 12).astype(np.int64)
    where = rows(b"co64", ">u8")[:, 0] if b"co64" in found else rows(b"stco", ">u4")[:, 0]
    runs = rows(b"stsc", ">u4", 3)
    times = rows(b"stts", ">u4", 2)
    chunks = np.diff(np.append(runs[:, 0], len(where) + 1))
    if (chunks < 0).any() or int(chunks @ runs[:, 1]) != n or int(times[:, 0].sum()) != n:
        raise ValueError("sample tables disagree")
    per = np.repeat(runs[:, 1], chunks)
    chunk = np.repeat(np.arange(len(where)), per)
    before = np.cumsum(sizes) - sizes
    first = np.concatenate(([0], np.cumsum(per)[:-1])) if len(per) else per
    offset = where[chunk] + before - before[first[chunk]]
    if n and (int((offset + sizes).max()) > len(data) or int(offset.min()) < 0):
        raise ValueError("a sample leaves the file")
    sync = rows(b"stss", ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(sync) and int(sync.min()) < 0:
        raise ValueError("a sync sample has no number")
    return {
        "codec": codec, "timescale": scale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()),
        "offset": offset, "size": sizes, "keyframes": np.stack((offset[sync], sizes[sync]), 1),
    }


def payload(data: bytes, offset: np.ndarray, size: np.ndarray) -> bytes:
    """The stored bytes of samples in order; neighbours are read in one go."""
    if not len(offset):
        return b""
    cut = np.flatnonzero(offset[1:] != offset[:-1] + size[:-1]) + 1
    a, z = np.append(0, cut), np.append(cut, len(offset)) - 1
    return b"".join(data[s:e] for s, e in zip(offset[a].tolist(), (offset[z] + size[z]).tolist(), strict=True))


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with the file that holds a text's bytes. A null or empty text is stored as one frame of zeros."""
    make = lambda texts: [[write(padded((x or "").encode("utf-8"))) for x in texts]]
    return add_columns(df, text, [T.StructField(out, T.BinaryType())], make)


RANGE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])
TRACK = T.StructType(
    [
        T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()),
        T.StructField("samples", T.LongType()), T.StructField("keyframes", T.ArrayType(RANGE)), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("error", T.StringType()),
    ]
)


def probe(df: DataFrame, media: str = "media", out: str = "track") -> DataFrame:
    """df with what the boxes of a file say of its first track, and hashes of the samples' stored bytes.

    Null media: null. A file that can't be followed has only `error`. The media column goes on.
    """

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        try:
            track = read(data)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return {"error": f"{type(e).__name__}: {e}"}
        stored = payload(data, track["offset"], track["size"])
        return {
            "codec": track["codec"], "timescale": track["timescale"], "duration": track["duration"], "samples": len(track["size"]),
            "keyframes": [{"offset": a, "size": b} for a, b in track["keyframes"].tolist()], "payload_bytes": len(stored),
            "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-FRAME:]),
        }

    return add_columns(df, media, [T.StructField(out, TRACK)], lambda files: [list(map(one, files))])


def digest(documents: DataFrame) -> DataFrame:
    """For each document the payload as read back, the stored form, and the track's features in one string."""
    text = F.coalesce("text", F.lit(""))
    track = probe(store(documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))).drop("text"))
    ranges = F.array_join(F.transform("track.keyframes", lambda x: F.concat_ws("+", x.offset.cast("string"), x.size.cast("string"))), ",")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("track.codec")),
        F.concat(F.lit("seconds="), F.format_string("%.3f", F.col("track.duration") / F.col("track.timescale"))),
        F.concat(F.lit("samples="), F.col("track.samples").cast("string")),
        F.concat(F.lit("keyframes="), F.size("track.keyframes").cast("string")),
        F.concat(F.lit("ranges="), F.sha2(ranges.cast("binary"), 256)),
    )
    return track.select(
        "doc_id", "n_bytes", "track.payload_bytes", "track.payload_sha256", "track.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        "track.codec", "track.duration", "track.keyframes",
    )
