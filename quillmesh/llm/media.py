"""ISO media containers (ISO/IEC 14496-12): write, walk and index media columns.

``encode_media`` stores bytes losslessly as uncompressed 8x8 RGB frames (192
8-bit samples each) in a one-track container. ``media_features`` walks the
nested boxes of any container, decodes the sample tables of one track (the
first video track, else the first track) and the runs of its movie fragments
with numpy, and returns codec, duration and the byte ranges of the key frames;
the payload is never decoded.

Edge cases: null bytes or text count as empty and give one frame of spaces;
null or malformed containers, also those that claim more samples than their
bytes can hold or nest without end, give null features and a message in
``media_error``; other input columns are ignored, so clashing names are safe;
equal bytes give equal containers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Batches, table

WIDTH = HEIGHT = 8
FRAME = WIDTH * HEIGHT * 3
TIMESCALE = 25
GOP = 30
CHUNK = 64
#: Boxes that hold further boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"])
#: Size of an mdat header: always the 64-bit form, so that no payload is too large.
MDAT_HEADER = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
HDLR = full_box(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"frames\0")
VMHD = full_box(b"vmhd", 0, 1, bytes(8))
DINF = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
STSD = full_box(
    b"stsd", 0, 0, struct.pack(">I", 1),
    box(b"raw ", struct.pack(">6xH16xHHIIIH32xHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, 24, -1)),
)


def mux(payload: bytes) -> bytes:
    """A container holding ``payload``, whose length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    if frames == 0 or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    tables = [
        STSD,
        full_box(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
        full_box(b"stss", 0, 0, struct.pack(">I", -(-frames // GOP)), np.arange(1, frames + 1, GOP, dtype=">u4").tobytes()),
        full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
    ]
    mdhd = full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0))
    tkhd = full_box(b"tkhd", 0, 3, struct.pack(">IIIII8xhhH2x", 0, 0, 1, 0, frames, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
    mvhd = full_box(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    starts = np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)

    def moov(base: int) -> bytes:
        offsets = full_box(b"co64", 0, 0, struct.pack(">I", chunks), (starts + base).astype(">u8").tobytes())
        stbl = box(b"stbl", *tables, offsets)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, HDLR, box(b"minf", VMHD, DINF, stbl))))

    base = len(FTYP) + len(moov(0)) + MDAT_HEADER
    return b"".join([FTYP, moov(base), struct.pack(">I4sQ", 1, b"mdat", MDAT_HEADER + len(payload)), payload])


class Node:
    """A box: where its body lies, and the boxes in it by kind."""

    def __init__(self, kind: bytes, at: int, body: int, end: int):
        self.kind, self.at, self.body, self.end = kind, at, body, end
        self.children: list[Node] = []

    def all(self, kind: bytes) -> list[Node]:
        return [x for x in self.children if x.kind == kind]

    def find(self, *path: bytes) -> Node | None:
        """The first box at the end of the path."""
        node: Node | None = self
        for kind in path:
            node = next(iter(node.all(kind)), None) if node else None
        return node

    def need(self, *path: bytes) -> Node:
        if (node := self.find(*path)) is None:
            raise ValueError(f"no {path[-1].decode('latin1')} box")
        return node


def walk(data: bytes) -> Node:
    """The tree of boxes, walked with a stack of its own, so that depth costs no recursion."""
    root = Node(b"", 0, 0, len(data))
    open_ = [(root, 0)]
    while open_:
        parent, start = open_.pop()
        if start >= parent.end:
            continue
        if parent.end - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if parent.end - start < 16:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = parent.end if size == 0 else start + size
        if stop > parent.end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        node = Node(kind, start, body, stop)
        parent.children.append(node)
        open_.append((parent, stop))
        if kind in CONTAINERS:
            open_.append((node, body))
    return root


def _ints(data: bytes, at: int, end: int, count: int, width: int = 1, kind: str = ">u4") -> np.ndarray:
    need = count * width * np.dtype(kind).itemsize
    if at + need > end:
        raise ValueError("truncated sample table")
    return np.frombuffer(data, kind, count * width, at).astype(np.int64).reshape(count, width)


class Track:
    """The samples of one track as flat arrays: its sample tables, then its movie fragments."""

    def __init__(self, data: bytes):
        self.data = data
        root = walk(data)
        moov = root.need(b"moov")
        tracks = moov.all(b"trak")
        if not tracks:
            raise ValueError("no trak box")
        video = [t for t in tracks if (h := t.find(b"mdia", b"hdlr")) and data[h.body + 8 : h.body + 12] == b"vide"]
        trak = (video or tracks)[0]
        mdhd = trak.need(b"mdia", b"mdhd")
        if data[mdhd.body] == 1:
            self.timescale, self.duration = struct.unpack_from(">IQ", data, mdhd.body + 20)
        else:
            self.timescale, self.duration = struct.unpack_from(">II", data, mdhd.body + 12)
        stbl = trak.need(b"mdia", b"minf", b"stbl")
        stsd = stbl.need(b"stsd")
        self.codec = data[stsd.body + 12 : stsd.body + 16].decode("latin1").strip()
        self.width, self.height = struct.unpack_from(">HH", data, stsd.body + 40) if video and stsd.end >= stsd.body + 44 else (0, 0)
        self._tables(stbl)
        tkhd = trak.find(b"tkhd")
        if tkhd is not None:
            track_id = self._u32(tkhd.body + (20 if data[tkhd.body] == 1 else 12))
            mvex = moov.find(b"mvex")
            defaults = {self._u32(x.body + 4): struct.unpack_from(">III", data, x.body + 12) for x in (mvex.all(b"trex") if mvex else [])}
            for moof in root.all(b"moof"):
                base = moof.at
                for traf in moof.all(b"traf"):
                    base = self._fragment(moof, traf, track_id, base, defaults)
        if len(self.sizes) and (int((self.offsets + self.sizes).max()) > len(data) or int(self.offsets.min()) < 0):
            raise ValueError("a sample lies past the end")
        if not self.duration:
            self.duration = self.media_duration

    def _u32(self, at: int) -> int:
        return struct.unpack_from(">I", self.data, at)[0]

    def _tables(self, stbl: Node) -> None:
        data, u32 = self.data, self._u32
        stts = stbl.need(b"stts")
        times = _ints(data, stts.body + 8, stts.end, u32(stts.body + 4), 2)
        co64 = stbl.find(b"co64")
        offsets = co64 or stbl.need(b"stco")
        chunk = _ints(data, offsets.body + 8, offsets.end, u32(offsets.body + 4), 1, ">u8" if co64 else ">u4")[:, 0]
        stsc = stbl.need(b"stsc")
        runs = _ints(data, stsc.body + 8, stsc.end, u32(stsc.body + 4), 3)
        if len(runs) and (runs[0, 0] != 1 or (np.diff(np.append(runs[:, 0], len(chunk) + 1)) < 0).any()):
            raise ValueError("stsc is out of order")
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
        if (small := stbl.find(b"stz2")) and not stbl.find(b"stsz"):
            field, count, same = data[small.body + 7], u32(small.body + 8), 0
        else:
            stsz = stbl.need(b"stsz")
            same, count = u32(stsz.body + 4), u32(stsz.body + 8)
        # before anything of that size is made: all samples lie in the bytes present
        if count * max(same, 1) > len(data) and (same or not small):
            raise ValueError("more samples than the bytes can hold")
        if times[:, 0].sum() != count:
            raise ValueError("stts and the sample sizes disagree")
        if per.sum() != count or len(per) != len(chunk):
            raise ValueError("stsc and the sample sizes disagree")
        if small and not stbl.find(b"stsz"):
            self.sizes = self._compact(small, field, count)
        else:
            self.sizes = np.full(count, same, np.int64) if same else _ints(data, stsz.body + 12, stsz.end, count)[:, 0]
        self.media_duration = int((times[:, 0] * times[:, 1]).sum())
        before = np.append(0, np.cumsum(self.sizes))
        first = np.cumsum(per) - per
        self.chunk_ranges = np.stack([chunk, before[first + per] - before[first]], 1)
        self.offsets = np.repeat(chunk - before[first], per) + before[:-1]
        if stss := stbl.find(b"stss"):
            self.keys = _ints(data, stss.body + 8, stss.end, u32(stss.body + 4))[:, 0] - 1
        else:
            self.keys = np.arange(count)
        if len(self.keys) and (self.keys.min() < 0 or self.keys.max() >= count):
            raise ValueError("stss names a sample that does not exist")

    def _compact(self, box_: Node, field: int, count: int) -> np.ndarray:
        """The sizes of a stz2 box: fields of 4, 8 or 16 bits."""
        if field == 16:
            return _ints(self.data, box_.body + 12, box_.end, count, 1, ">u2")[:, 0]
        if field == 8:
            return _ints(self.data, box_.body + 12, box_.end, count, 1, "u1")[:, 0]
        if field != 4:
            raise ValueError("stz2 has an unknown field size")
        pairs = _ints(self.data, box_.body + 12, box_.end, -(-count // 2), 1, "u1")[:, 0]
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count]

    def _fragment(self, moof: Node, traf: Node, track_id: int, base: int, defaults: dict[int, tuple[int, int, int]]) -> int:
        """Adds the samples of one track fragment; returns where data without an offset of its own goes on."""
        data = self.data
        tfhd = traf.need(b"tfhd")
        flags, at = self._u32(tfhd.body) & 0xFFFFFF, tfhd.body + 8
        own = self._u32(tfhd.body + 4)
        duration, size, marks = defaults.get(own, (0, 0, 0))
        if flags & 0x020000:
            base = moof.at
        if flags & 0x01:
            (base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 * bool(flags & 0x02)
        if flags & 0x08:
            duration, at = self._u32(at), at + 4
        if flags & 0x10:
            size, at = self._u32(at), at + 4
        if flags & 0x20:
            marks, at = self._u32(at), at + 4
        follow = base
        for trun in traf.all(b"trun"):
            flags, count, at = self._u32(trun.body) & 0xFFFFFF, self._u32(trun.body + 4), trun.body + 8
            start = follow
            if flags & 0x01:
                start, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first = None
            if flags & 0x04:
                first, at = self._u32(at), at + 4
            fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
            if count * max(1, size if 0x200 not in fields else 1) > len(data):
                raise ValueError("more samples than the bytes can hold")
            rows = _ints(data, at, trun.end, count, len(fields)) if fields else np.zeros((count, 0), np.int64)
            column = lambda f, other: rows[:, fields.index(f)] if f in fields else np.full(count, other, np.int64)  # noqa: B023, E731
            sizes, lengths, kinds = column(0x200, size), column(0x100, duration), column(0x400, marks).copy()
            if first is not None and count:
                kinds[0] = first
            follow = start + int(sizes.sum())
            if own == track_id:
                # bit 16: not a sync sample
                self.keys = np.append(self.keys, len(self.sizes) + np.flatnonzero((kinds & 0x10000) == 0))
                self.offsets = np.append(self.offsets, start + np.cumsum(sizes) - sizes)
                self.sizes = np.append(self.sizes, sizes)
                self.chunk_ranges = np.concatenate([self.chunk_ranges, [[start, int(sizes.sum())]]])
                self.media_duration += int(lengths.sum())
        return follow

    def payload(self, data: bytes) -> bytes:
        """The stored samples in order, read chunk by chunk."""
        return b"".join(data[a : a + n] for a, n in self.chunk_ranges.tolist())


def pad(raw: bytes) -> bytes:
    """``raw`` with spaces appended up to a positive multiple of a frame."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME)


def encode_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text or binary value stored in a container of its own."""
    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = raw.as_py()
                media = mux(pad(raw))
                out.add((i, len(raw), media), len(media))
                if out.full():
                    yield from out.take()
        yield from out.take()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    made = rows.mapInArrow(run, "id long, n_bytes long, media binary")
    return made.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "media")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_s double, n_samples long, keyframes array<struct<sample:long,offset:long,length:long>>, media_error string"
)
RANGE = pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def describe(media: bytes | None) -> tuple:
    """The columns of FEATURES for one container."""
    if media is None:
        return (None,) * 10 + ("no media",)
    sums = (len(media), hashlib.sha256(media).hexdigest())
    try:
        track = Track(media)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return (None, None, None, *sums, None, None, None, None, None, str(e))
    payload = track.payload(media)
    keys = [
        {"sample": s, "offset": o, "length": n}
        for s, o, n in zip(track.keys.tolist(), track.offsets[track.keys].tolist(), track.sizes[track.keys].tolist(), strict=True)
    ]
    ranges = zlib.crc32(np.stack([track.offsets[track.keys], track.sizes[track.keys]], 1).astype("<i8").tobytes())
    n = len(track.sizes)
    feature = f"{track.codec} {track.width}x{track.height} {track.media_duration}/{track.timescale}s samples={n} keyframes={len(keys)} ranges={ranges:08x}"
    seconds = track.duration / track.timescale if track.timescale else None
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *sums, feature, track.codec, seconds, n, keys, None)


def media_features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` (numeric id columns) with the FEATURES of each container."""
    schema = pa.schema(
        [(f"k{i}", pa.int64()) for i in range(len(keep))]
        + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        + [("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", RANGE), ("media_error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for b in batches:
            ids = [b.column(i).to_pylist() for i in range(len(keep))]
            for j, media in enumerate(b.column(len(keep))):
                row = describe(media.as_py())
                out.add((*(c[j] for c in ids), *row), 512 + 32 * len(row[9] or ()))
                if out.full():
                    yield from out.take()
        yield from out.take()

    rows = df.select(*(F.col(c).cast("long").alias(f"k{i}") for i, c in enumerate(keep)), F.col(media_col).alias("media"))
    made = rows.mapInArrow(run, ", ".join(f"k{i} long" for i in range(len(keep))) + ", " + FEATURES)
    return made.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *[c.split()[0] for c in FEATURES.replace("array<struct<sample:long,offset:long,length:long>>", "x").split(", ")])


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored in a container, read back and described."""
    return media_features(encode_media(table(spark, sf_dir, "documents")))
