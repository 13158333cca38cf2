"""Removal of repeated byte strings by external suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Equal strings must meet in one shard, so shards
are cut by content: each window of LENGTH bytes is named by the least hash of
its GRAM-byte grams, runs of windows of one name form a piece, and names are
dealt to shards. Equal windows have equal names, so no match is lost.

1. ``cut_parts``: documents are packed into parts of some megabytes.
2. ``name_parts``: a part's names, each once, with its least id, go to shards.
3. ``survivors``: shards tell parts which of their names occur under two ids.
4. ``pieces``: a part's pieces of those names, equal ones folded into one with
   its least id, go to shards.
5. ``matches``: a shard's pieces run through external induced sorting
   (induced.py) with common prefixes capped at LENGTH; suffixes linked by full
   prefixes hold one window, and its least id decides for every piece.
6. ``strip``: parts apply what shards found to their documents.

A part sends each name and each piece once, however often it occurs there, so
that a passage of a third of all documents is a row or two a part. Shards and
parts exchange one blob each; parts grow with the number of shards and the
shards' number has a bound, so that blobs stay in proportion to the input.
Shards are read in batches and may be far larger than memory: what exceeds
MEMORY lies on disk.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH keep
all; a string repeated within one document alone stays; repeated rows have the
same id, so neither removes the other; a null id counts as larger than any
other; matches never cross documents; an empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Batches, discard, free_shuffles, materialise, small_batches, table
from quillmesh.llm.induced import WORK, Disk, suffixes

LENGTH = 50
GRAM = 16
#: Bytes of text to a shard, about, and the most shards there are: beyond them shards grow.
SHARD_BYTES = 8 << 20
SHARDS = 1 << 14
#: Bytes of documents to a part, at most for few shards; and the bytes that a blob of a part for a shard stands for, at least.
PART_BYTES = 6 << 20
BLOB_BYTES = 4 << 10
#: Bytes of a row group of parts and blobs.
ROW_GROUP = 16 << 20
#: Shards, at least; and half the least number of parts.
LEAST = 16
#: Bytes of documents hashed at a time.
CHUNK_BYTES = 256 << 10
#: Bytes of tuples that a shard holds while it sorts, and bytes of distinct pieces that it folds at a time.
MEMORY = 128 << 20
FOLD_BYTES = 64 << 20
#: Slices of a shard's names that are matched one after the other, at most, and names that a slice holds at least; powers of two.
SLICES = 16
SLICE_NAMES = 1 << 20
#: Rows and bytes of an Arrow batch of blobs; a row of a part is megabytes.
BLOB_ROWS = 256
BATCH_BYTES = 4 << 20
NULL_ID = (1 << 63) - 1
#: Windows hashed at a time, and odd factors of their hash.
HASHED = 256 << 10
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def names(buf: np.ndarray) -> np.ndarray:
    """The name of the window at each position of a byte array of at least LENGTH bytes."""
    words = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text index, start, windows) of every piece of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none.astype(np.uint64), none, none, none
    v = names(buf)
    cut = np.concatenate([[True], v[1:] != v[:-1]])
    for edge in (offsets, offsets + sizes - LENGTH + 1):
        cut[edge[(edge >= 0) & (edge < len(cut))]] = True
    start = np.flatnonzero(cut)
    windows = np.diff(np.append(start, len(v)))
    doc = np.searchsorted(offsets, start, side="right") - 1
    start_in = start - offsets[doc]
    ok = start_in <= sizes[doc] - LENGTH
    return v[start[ok]], doc[ok], start_in[ok], windows[ok]


def put(out: Batches, *row) -> None:
    """Adds a row, in which numpy arrays stand for their bytes."""
    raw = tuple(v.tobytes() if isinstance(v, np.ndarray) else v for v in row)
    out.add(raw, sum(len(v) for v in raw if isinstance(v, bytes)))


def schema_of(numbers: str, blobs: str) -> tuple[pa.Schema, str]:
    """An Arrow schema of long and binary columns, and the same for Spark."""
    fields = [(n, "long", pa.int64()) for n in numbers.split()] + [(n, "binary", pa.binary()) for n in blobs.split()]
    return pa.schema([(n, t) for n, _, t in fields]), ", ".join(f"{n} {kind}" for n, kind, _ in fields)


def narrow(a: np.ndarray) -> np.ndarray:
    """Ids in four bytes each where they all fit, in eight otherwise; ``wide`` reads them."""
    return a.astype("<u4") if len(a) == 0 or (a.min() >= 0 and a.max() < 1 << 32) else a.astype("<i8")


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8" if len(raw) == 8 * n else "<u4").astype(np.int64)


def cut_parts(docs: DataFrame, part_bytes: int) -> DataFrame:
    """(part, ids, sizes, raw, doc_ids): documents in parts of about ``part_bytes``, their texts compressed."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId() << 32
        ids, texts, names_, size = [], [], [], 0

        def give() -> pa.RecordBatch:
            keys = np.array([NULL_ID if i is None else i for i in ids], "<i8")
            sizes = np.fromiter(map(len, texts), "<i8", len(texts))
            arrays = [pa.array([v], t) for v, t in ((part, pa.int64()), (keys.tobytes(), pa.binary()), (sizes.tobytes(), pa.binary()), (press.compress(b"".join(texts)), pa.binary()))]
            own = pa.concat_arrays(names_)
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["part", "ids", "sizes", "raw", "doc_ids"])

        for b in batches:
            for k, i in enumerate(b.column(0).to_pylist()):
                ids.append(i)
                texts.append(b.column(1)[k].as_py())
                names_.append(b.column(2)[k : k + 1])
                size += len(texts[-1])
                if size >= part_bytes:
                    yield give()
                    part, ids, texts, names_, size = part + 1, [], [], [], 0
        if ids:
            yield give()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), "doc_id")
    return rows.mapInArrow(run, f"part long, ids binary, sizes binary, raw binary, doc_ids array<{kind.simpleString()}>")


class Part:
    """The documents of a part, their pieces, and its names in the order in which shards see them."""

    def __init__(self, ids: bytes, sizes: bytes, raw: bytes, shards: int):
        import zstandard

        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(self.sizes.sum()) + 1)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.shards = shards

    def text(self, k: int) -> bytes:
        return self.raw[self.offsets[k] : self.offsets[k] + self.sizes[k]]

    def find(self) -> None:
        """Pieces (doc, start, windows, name) and the distinct names, by shard and name."""
        found = []
        first = 0
        ends = np.cumsum(self.sizes)
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK_BYTES)))
            v, doc, start, windows = runs_of([self.text(k) for k in range(first, last)])
            found.append((v, (doc + first).astype(np.int32), start, windows))
            first = last
        v, self.doc, self.start, self.windows = (np.concatenate(x) for x in zip(*found, strict=True))
        # the shard stands in the upper half, so that names are sorted by shard
        mixed = v * np.uint64(0x9FB21C651E98DF25)
        self.shard_of = lambda key: ((key >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)
        shard = self.shard_of(mixed)
        order = np.lexsort((mixed, shard))
        head = np.flatnonzero(np.concatenate([[True], mixed[order][1:] != mixed[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        self.keys = mixed[order][head]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        self.order, self.head = order, head
        self.edges = np.searchsorted(shard[order][head], np.arange(self.shards + 1)) if len(head) else np.zeros(self.shards + 1, np.int64)

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """The least id of each name, and whether it has others here."""
        if not len(self.head):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        own = self.ids[self.doc[self.order]]
        lo, hi = np.minimum.reduceat(own, self.head), np.maximum.reduceat(own, self.head)
        return lo, lo != hi


NAMES, NAMES_SQL = schema_of("shard part n", "name least more")


def name_parts(parts: DataFrame, shards: int) -> DataFrame:
    """(shard, part, n, name, least, more): a part's names for each shard, sorted, with their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(NAMES)
        for b in batches:
            for row in b.to_pylist():
                part = Part(row["ids"], row["sizes"], row["raw"], shards)
                part.find()
                lo, more = part.least()
                for s in np.flatnonzero(np.diff(part.edges)).tolist():
                    at = slice(int(part.edges[s]), int(part.edges[s + 1]))
                    put(out, s, row["part"], at.stop - at.start, part.keys[at].astype("<u8"), narrow(lo[at]), np.packbits(more[at]))
                    if out.full():
                        yield from out.take()
        yield from out.take()

    return parts.select("part", "ids", "sizes", "raw").mapInArrow(run, NAMES_SQL)


class Shelf:
    """Byte strings on disk, by number."""

    def __init__(self):
        self.file, self.at = tempfile.TemporaryFile(), [0]  # noqa: SIM115

    def add(self, raw: bytes) -> None:
        self.file.write(raw)
        self.at.append(self.at[-1] + len(raw))

    def get(self, k: int, lo: int = 0, hi: int | None = None) -> bytes:
        end = self.at[k + 1] if hi is None else self.at[k] + hi
        self.file.seek(self.at[k] + lo)
        return self.file.read(end - self.at[k] - lo)


KEPT, KEPT_SQL = schema_of("part shard n", "keep")


def survivors(names_: DataFrame) -> DataFrame:
    """(part, shard, n, keep): a bit for each name of a part, whether it occurs under two ids anywhere."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard's names lie on disk and are matched a slice at a time; as each blob is sorted, a slice is a range of it
        names_on, least_on = Shelf(), Shelf()
        blobs: list[tuple[int, int, int]] = []
        more: list[np.ndarray] = []
        cuts: list[np.ndarray] = []
        bounds = np.arange(1, SLICES, dtype=np.uint64) * np.uint64((1 << 64) // SLICES)
        for b in batches:
            for row in b.to_pylist():
                n = row["n"]
                v = np.frombuffer(row["name"], "<u8")
                cuts.append(np.concatenate([[0], np.searchsorted(v, bounds), [n]]))
                names_on.add(row["name"])
                least_on.add(wide(row["least"], n).tobytes())
                blobs.append((row["part"], row["shard"], n))
                more.append(np.unpackbits(np.frombuffer(row["more"], np.uint8), count=n).astype(bool))
        # few names are matched in fewer slices
        step = SLICES
        while step > 1 and sum(n for *_, n in blobs) * step > SLICE_NAMES * SLICES:
            step //= 2
        for s in range(0, SLICES, step):
            spans_ = [(k, int(c[s]), int(c[s + step])) for k, c in enumerate(cuts) if c[s] < c[s + step]]
            if not spans_:
                continue
            v = np.concatenate([np.frombuffer(names_on.get(k, 8 * a, 8 * z), "<u8") for k, a, z in spans_])
            lo = np.concatenate([np.frombuffer(least_on.get(k, 8 * a, 8 * z), "<i8") for k, a, z in spans_])
            two = np.concatenate([more[k][a:z] for k, a, z in spans_])
            order = np.argsort(v, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
            keep = np.minimum.reduceat(lo[order], head) != np.maximum.reduceat(lo[order], head)
            keep |= np.logical_or.reduceat(two[order], head)
            two[order] = np.repeat(keep, np.diff(np.append(head, len(v))))
            at = 0
            for k, a, z in spans_:
                more[k][a:z] = two[at : at + z - a]
                at += z - a
        out = Batches(KEPT)
        for (part, shard, n), kept in zip(blobs, more, strict=True):
            if kept.any():
                put(out, part, shard, n, np.packbits(kept))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return names_.groupBy("shard").applyInArrow(run, KEPT_SQL)


SENT, SENT_SQL = schema_of("kind shard part n", "size least bytes")


def pieces(parts: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """Kind 0: (shard, part, n, size, least, bytes), the distinct pieces of a part for a shard with their least ids.

    Kind 1: (part, n, size, least, bytes), the documents, starts and piece numbers of the part's own occurrences.
    """

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        import zstandard

        out, done = Batches(SENT), []
        press = zstandard.ZstdCompressor(level=1)
        for row in rows.to_pylist() if replies.num_rows else ():
            part = Part(row["ids"], row["sizes"], row["raw"], shards)
            part.find()
            keep = np.zeros(len(part.keys), bool)
            for r in replies.to_pylist():
                a = int(part.edges[r["shard"]])
                keep[a : a + r["n"]] = np.unpackbits(np.frombuffer(r["keep"], np.uint8), count=r["n"])
            live = np.flatnonzero(keep[part.of])
            if not len(live):
                continue
            shard = part.shard_of(part.keys)[part.of[live]]
            live = live[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            at, size = part.offsets[part.doc[live]] + part.start[live], part.windows[live] + LENGTH - 1
            edges = np.searchsorted(shard, np.arange(shards + 1))
            number = np.empty(len(live), np.int64)
            raw, first = part.raw, 0
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(int(edges[s]), int(edges[s + 1]))
                folded: dict[bytes, int] = {}
                each = np.array([folded.setdefault(raw[a : a + n], len(folded)) for a, n in zip(at[own].tolist(), size[own].tolist(), strict=True)])
                least = np.full(len(folded), NULL_ID)
                np.minimum.at(least, each, part.ids[part.doc[live[own]]])
                sizes = np.fromiter(map(len, folded), "<u4", len(folded))
                put(out, 0, s, row["part"], len(folded), sizes, narrow(least), press.compress(b"".join(folded)))
                number[own] = first + each
                first += len(folded)
            put(out, 1, None, row["part"], len(live), size.astype("<u4"), part.doc[live].astype("<u4"), press.compress(np.column_stack([part.start[live], number]).astype("<i8").tobytes()))
            done += out.take()
        return pa.Table.from_batches(done, SENT)

    return parts.select("part", "ids", "sizes", "raw").groupBy("part").cogroup(kept.groupBy("part")).applyInArrow(run, SENT_SQL)


class Pieces:
    """The distinct pieces of a shard: a text of symbols (bytes plus 2, each piece ended by 1), starts, and least ids."""

    def __init__(self, disk: Disk, total: int, count: int):
        self.symbols = disk.array(total + count + 1 + LENGTH, np.int16)
        self.starts = disk.array(count, np.int64)
        self.ids = disk.array(count, np.int64)
        self.n = self.k = 0

    def add(self, texts: list[bytes], ids: np.ndarray) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)
        block = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 2
        block[ends - 1] = 1
        self.symbols[self.n : self.n + len(block)] = block
        self.starts[self.k : self.k + len(texts)] = self.n + ends - sizes - 1
        self.ids[self.k : self.k + len(texts)] = ids
        self.n += len(block)
        self.k += len(texts)

    def take(self, symbols: np.ndarray, lo: np.ndarray, sizes: np.ndarray, ids: np.ndarray, step: int) -> None:
        """Adds the spans of ``symbols`` from ``lo`` on, about ``step`` symbols at a time."""
        ends = np.cumsum(sizes + 1)
        self.starts[: len(lo)] = ends - sizes - 1
        self.ids[: len(lo)] = ids
        first = 0
        while first < len(lo):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + step)))
            n = sizes[first:last] + 1
            at = np.repeat(lo[first:last] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            block = symbols[at]
            block[np.cumsum(n) - 1] = 1
            self.symbols[self.n : self.n + len(block)] = block
            self.n += len(block)
            first = last
        self.k = len(lo)


def window_hashes(symbols: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH symbols from each place on, by doubling; symbols are bytes plus 2."""
    h = symbols.astype(np.uint64)
    n, out, done = 1, None, 0
    while n <= LENGTH:
        if LENGTH & n:
            # spans of 2, 16 and 32 symbols make up the 50
            out = h if out is None else (out[: len(h) - done] * FACTORS[0]) ^ h[done:]
            done += n
        if n * 2 <= LENGTH:
            a = h[:-n] * FACTORS[1]
            a += h[n:]
            a ^= a >> np.uint64(29)
            a *= FACTORS[2]
            h = a
        n *= 2
    out = out[: len(symbols) - LENGTH + 1] * FACTORS[2]
    return out ^ (out >> np.uint64(32))


def standing_twice(own: Pieces, disk: Disk) -> tuple[np.ndarray, np.ndarray] | None:
    """Runs (from, to) of places whose windows stand twice in a shard's pieces; None if too many may.

    A table by window hash is filled once to see which of its bits are met
    twice; the hashes that have those bits are then compared whole. Equal
    windows have equal hashes, so that none that stands twice is left out; the
    sort decides on what the hashes leave.
    """
    bits = min(max(own.n * 4, 1 << 16), disk.memory // 4).bit_length() - 1
    shift = np.uint64(64 - bits)
    last = own.n - LENGTH + 1

    def windows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, hash) of the windows that hold no end of a piece."""
        for k in range(0, last, HASHED):
            block = np.asarray(own.symbols[k : min(k + HASHED, last) + LENGTH - 1])
            ends = np.concatenate([[0], np.cumsum(block == 1, dtype=np.int32)])
            at = np.flatnonzero(ends[LENGTH:] == ends[:-LENGTH])
            yield at + k, window_hashes(block)[at]

    met, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    for _, h in windows():
        h = np.sort(h >> shift)
        twice[h[met[h]]] = True
        twice[h[1:][h[1:] == h[:-1]]] = True
        met[h] = True
    del met
    places, hashes, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for at, h in windows():
        hit = np.flatnonzero(twice[h >> shift])
        places.append(at[hit])
        hashes.append(h[hit])
        n += len(hit)
        if n > disk.memory // WORK:
            return None
    del twice
    place, h = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    place = place[hit]
    cut = np.flatnonzero(np.diff(place) > 1)
    return (place[np.append(0, cut + 1)], place[np.append(cut, -1)] + 1) if len(place) else (place, place)


def flags_of(own: Pieces, disk: Disk) -> np.ndarray:
    """``held_elsewhere``, for which only the runs of windows that may stand twice are sorted."""
    runs = standing_twice(own, disk)
    if runs is None:
        return held_elsewhere(own, disk)
    lo, hi = runs
    flags = disk.array(own.n + 1, bool)
    if not len(lo):
        return flags
    sizes = hi - lo + LENGTH - 1
    few = Pieces(disk, int(sizes.sum()), len(lo))
    ids = own.ids[np.searchsorted(own.starts[: own.k], lo, side="right") - 1]
    few.take(own.symbols, lo, sizes, ids, disk.block)
    found = held_elsewhere(few, disk)
    a, e = runs_of_flags(found, disk.block)
    run = np.searchsorted(few.starts[: few.k], a, side="right") - 1
    moved = lo[run] - few.starts[run]
    for x, y in zip((a + moved).tolist(), (e + moved).tolist(), strict=True):
        flags[x:y] = True
    return flags


def held_elsewhere(own: Pieces, disk: Disk) -> np.ndarray:
    """A flag for each symbol: whether the window that starts there also stands in a piece of a smaller id."""
    flags = disk.array(own.n + 1, bool)
    starts, ids = own.starts[: own.k], own.ids[: own.k]
    ends = np.append(starts[1:], own.n) - 1
    of = disk.array(own.n, np.int32)
    of[starts[1:]] = 1
    np.cumsum(of, out=of)
    for blocks in suffixes(own.symbols, own.n + 1, 257, LENGTH, disk):
        group = _Group(flags)
        for pos, lcp in blocks:
            piece = of[pos]
            whole = ends[piece] - pos >= LENGTH
            # suffixes of fewer symbols than a window are equal to none
            group.feed(pos, ids[piece], whole, lcp >= LENGTH)
        group.close()
    return flags


class _Group:
    """Suffixes that share a window, as they come in blocks: those of a larger id than the least are flagged."""

    def __init__(self, flags: np.ndarray):
        self.flags = flags
        self.pos: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.least = NULL_ID

    def feed(self, pos: np.ndarray, own: np.ndarray, whole: np.ndarray, linked: np.ndarray) -> None:
        head = np.flatnonzero(~(linked & whole))
        if not len(head):
            self._hold(pos, own, whole)
            return
        self._hold(pos[: head[0]], own[: head[0]], whole[: head[0]])
        self.close()
        last = int(head[-1])
        if last > head[0]:
            a = int(head[0])
            first = head[:-1] - a
            low = np.minimum.reduceat(own[a:last], first)
            low = np.repeat(low, np.diff(head))
            self.flags[pos[a:last][(low < own[a:last]) & whole[a:last]]] = True
        self._hold(pos[last:], own[last:], whole[last:])

    def _hold(self, pos: np.ndarray, own: np.ndarray, whole: np.ndarray) -> None:
        if len(pos):
            self.pos.append(pos[whole])
            self.own.append(own[whole])
            self.least = min(self.least, int(own.min()))

    def close(self) -> None:
        for pos, own in zip(self.pos, self.own, strict=True):
            self.flags[pos[own > self.least]] = True
        self.pos, self.own, self.least = [], [], NULL_ID


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


FOUND, FOUND_SQL = schema_of("kind part shard n", "least count ranges")


def matches(sent: DataFrame, memory: int = MEMORY, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """(kind 0, part, shard, n, least, count, ranges): for each piece of a part its least id anywhere, and the runs of bytes to cut where it stands under that id."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shelf, sizes_on, least_on = Shelf(), Shelf(), Shelf()
        blobs: list[tuple[int, int, int]] = []
        total = count = 0
        for b in batches:
            for row in b.to_pylist():
                shelf.add(row["bytes"])
                sizes_on.add(row["size"])
                least_on.add(wide(row["least"], row["n"]).tobytes())
                blobs.append((row["part"], row["shard"], row["n"]))
                total += int(np.frombuffer(row["size"], "<u4").sum(dtype=np.int64))
                count += row["n"]
        disk = Disk(memory)
        unpress = zstandard.ZstdDecompressor()
        own = Pieces(disk, total, count)
        # which distinct piece each blob's pieces are
        number = [disk.array(n, np.int64) for _, _, n in blobs]
        passes = -(-total // fold_bytes)
        for p in range(passes):
            folded: dict[bytes, int] = {}
            low: list[int] = []
            for k, (_, _, n) in enumerate(blobs):
                raw, at = unpress.decompress(shelf.get(k)), 0
                for j, (size, i) in enumerate(zip(np.frombuffer(sizes_on.get(k), "<u4").tolist(), np.frombuffer(least_on.get(k), "<i8").tolist(), strict=True)):
                    piece = raw[at : at + size]
                    at += size
                    if passes > 1 and hash(piece) % passes != p:
                        continue
                    d = folded.setdefault(piece, len(folded))
                    if d == len(low):
                        low.append(i)
                    elif i < low[d]:
                        low[d] = i
                    number[k][j] = own.k + d
            if folded:
                own.add(list(folded), np.array(low, np.int64))
        flags = flags_of(own, disk) if own.k else np.zeros(1, bool)
        lo, hi = runs_of_flags(flags, disk.block)
        of = np.searchsorted(own.starts[: own.k], lo, side="right") - 1
        out = Batches(FOUND)
        for k, (part, shard, _) in enumerate(blobs):
            least = np.frombuffer(least_on.get(k), "<i8")
            low = own.ids[number[k]]
            # a piece that stands under a smaller id elsewhere goes whole; its runs matter to the least id alone
            ask = np.flatnonzero(low == least)
            heads = np.searchsorted(of, number[k][ask])
            n_runs = np.zeros(len(least), np.int64)
            n_runs[ask] = np.searchsorted(of, number[k][ask], side="right") - heads
            m = n_runs[ask]
            at = np.repeat(heads, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            base = own.starts[of[at]]
            pairs = np.column_stack([lo[at] - base, hi[at] - base + LENGTH - 1])
            put(out, 0, part, shard, len(least), narrow(low), n_runs.astype("<u4"), pairs.astype("<u4"))
            if out.full():
                yield from out.take()
        yield from out.take()
        disk.close()

    return sent.filter("kind = 0").select("shard", "part", "n", "size", "least", "bytes").groupBy("shard").applyInArrow(run, FOUND_SQL)


def runs_of_flags(flags: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``spans`` of flags that may lie on disk; the last flag is never set."""
    los, his = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(step, 1 << 16)
    for k in range(0, len(flags), step):
        lo, hi = spans(np.asarray(flags[k : k + step]))
        if len(lo) and len(his[-1]) and his[-1][-1] == k and lo[0] == 0:  # goes on from the block before
            his[-1] = his[-1][:-1]
            lo = lo[1:]
        los.append(lo + k)
        his.append(hi + k)
    return np.concatenate(los), np.concatenate(his)


def unite(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (start, end) rows."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1]]))
    return np.column_stack([ranges[first, 0], reach[np.append(first[1:] - 1, len(ranges) - 1)]])


def strip(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept_sha256) of every row; ``removed`` holds the runs."""
    kind = parts.schema["doc_ids"].dataType.elementType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cuts_of(part: Part, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(doc, [start, end]) of all ranges to cut, by doc."""
        import zstandard

        own = next((r for r in replies if r["kind"] == 1), None)
        if own is None:
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        said = sorted((r for r in replies if r["kind"] == 0), key=lambda r: r["shard"])
        doc = np.frombuffer(own["least"], "<u4").astype(np.int64)
        where = np.frombuffer(zstandard.ZstdDecompressor().decompress(own["ranges"]), "<i8").reshape(-1, 2)
        start, number = where[:, 0], where[:, 1]
        size = np.frombuffer(own["count"], "<u4").astype(np.int64)
        low = np.concatenate([wide(r["least"], r["n"]) for r in said])
        count = np.concatenate([np.frombuffer(r["count"], "<u4") for r in said]).astype(np.int64)
        ranges = np.concatenate([np.frombuffer(r["ranges"], "<u4") for r in said]).astype(np.int64).reshape(-1, 2)
        before = np.cumsum(count) - count
        ids = part.ids[doc]
        # under a larger id than its least a piece goes whole; under its least, only what a smaller id holds elsewhere
        over = np.flatnonzero(ids > low[number])
        least = np.flatnonzero(ids == low[number])
        n = count[number[least]]
        use = np.repeat(least, n)
        at = np.repeat(before[number[least]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        docs = np.concatenate([doc[over], doc[use]])
        pairs = np.concatenate([np.column_stack([start[over], start[over] + size[over]]), start[use][:, None] + ranges[at]])
        order = np.argsort(docs, kind="stable")
        return docs[order], pairs[order]

    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for r, row in enumerate(rows.select(["ids", "sizes", "raw"]).to_pylist()):
            part = Part(row["ids"], row["sizes"], row["raw"], 1)
            docs, pairs = cuts_of(part, replies.to_pylist())
            edges = np.searchsorted(docs, np.arange(len(part.ids) + 1))
            gone, runs_, digests = [], [], []
            for k in range(len(part.ids)):
                raw = part.text(k)
                cuts_ = unite(pairs[edges[k] : edges[k + 1]]).tolist()
                digest, at = hashlib.sha256(), 0
                for a, e in cuts_:
                    digest.update(raw[at:a])
                    at = e
                digest.update(raw[at:])
                gone.append(sum(e - a for a, e in cuts_))
                runs_.append([{"start": a, "end": e} for a, e in cuts_])
                digests.append(digest.hexdigest())
            out.append(pa.table({"doc_id": rows.column("doc_ids")[r].values, "n_bytes": pa.array(part.sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(runs_, pair), "kept_sha256": pa.array(digests, pa.string())}))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string"
    return parts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES, memory: int = MEMORY) -> DataFrame:
    """What ``strip`` returns, for all rows of ``docs``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary"))).alias("n")).first().n or 0
    shards = min(SHARDS, max(LEAST, -(-total // shard_bytes)))
    size = min(max(part_bytes, shards * BLOB_BYTES), -(-total // (2 * LEAST)) + 1)
    with small_batches(spark):
        parts = materialise(cut_parts(docs, size), "parts", ROW_GROUP)
    with small_batches(spark, BLOB_ROWS, BATCH_BYTES):
        kept = materialise(survivors(name_parts(parts, shards)), "survivors")
        free_shuffles(spark)
        sent = materialise(pieces(parts, kept, shards), "pieces", ROW_GROUP)
        discard(kept)
        free_shuffles(spark)
        own = sent.filter("kind = 1").select("kind", "part", "shard", "n", "least", F.col("size").alias("count"), F.col("bytes").alias("ranges"))
        found = materialise(matches(sent, memory), "matches").unionByName(own)
        free_shuffles(spark)
    return strip(parts, found)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by a 50-byte string of a document with a smaller id."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


#: Every window of every document, by hand; for tables whose windows a machine can hold.
ORACLE_OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NULL_ID}) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)
), low AS (
  SELECT s, min(id) AS low FROM w GROUP BY s HAVING min(id) < max(id)
), hits AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM w JOIN low USING (s) WHERE id > low)
), runs AS (
  SELECT r, run, min(i) AS a, max(i) + {LENGTH} AS e FROM hits GROUP BY r, run
), kept AS (
  SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(e) AS last, sum(e - a)::BIGINT AS gone, count(*) AS spans
  FROM (SELECT runs.*, d.h, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs JOIN d USING (r)) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
