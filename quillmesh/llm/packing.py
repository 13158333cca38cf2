"""Packing documents into sequences as a cutting-stock problem solved by column generation.

A document is its ids and an end id. It is cut into full pieces of a whole
sequence and one rest. The histogram of rests (fewer lengths than a sequence
has tokens, whatever the size of the input) is the demand of a linear program
over patterns; a knapsack dynamic program prices new patterns until none
improves. Pattern counts are rounded down, the few rests left over are placed
best-fit decreasing, and documents, ranked within their length, take their
places through a table of a few thousand slots.

Lengths are priced in bars of WIDTH tokens, rounded up, as long as that adds no
more than ROUNDING to the tokens; shorter rests get narrower bars, down to
single tokens, which are exact.

Edge cases: null and empty texts are the end id alone; repeated rows get a
place each; rows of equal length are ranked by a hash of id and start, then by
both; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import Batches, materialise, table
from quillmesh.llm.tokens import END, VOCABULARY, Encoder

CAPACITY = 1024
#: Column generation ends when the dual bound shows that it can save no more than this share.
GAP = 1e-3
#: Tokens to a bar of the length histogram at most: patterns are priced on lengths rounded up to it.
WIDTH = 8
#: Share of the tokens that rounding may add; where it would add more, bars are halved.
ROUNDING = 0.01
#: Shares of the best duals so far in the duals that are priced, tried in turn: they keep the duals from swinging.
SMOOTHING = (0.9, 0.6, 0.0)
#: Parts that the ranks within a length are counted in, at least, and pieces to a part beyond that: no length is one task.
RANK_PARTS = 256
PART_PIECES = 100_000


def price(duals: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern by an unbounded-knapsack dynamic program, as (value, counts)."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    known = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best, value_c = -1, value[c - 1]
        if n := known[c]:
            gains = duals[:n] + value[c - lengths[:n]]
            k = int(gains.argmax())
            if gains[k] > value_c + 1e-12:
                best, value_c = k, gains[k]
        value[c], took[c] = value_c, best
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(lengths[took[c]])
    return float(value[capacity]), counts


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A small product without the threads of a linear-algebra library."""
    return (matrix * vector).sum(1)


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots."""
    m = len(matrix)
    a = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(a[k:, k]).argmax())
        a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        rest = a[:, k].copy()
        rest[k] = 0
        a -= np.outer(rest, a[k])
    return a[:, m:]


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of the linear program min sum x, patterns.T x = demand, x >= 0.

    Revised simplex with a dense basis inverse and smoothed duals. ``lengths`` are sorted and distinct.
    """
    m = len(lengths)
    patterns = np.diag(capacity // lengths).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = times(inverse, demand)
    # lengths over capacity are feasible duals: their bound is the area
    centre = lengths / capacity
    bound = float((demand * centre).sum())
    for step in range(20 * m + 100):
        if step and step % 500 == 0:
            inverse = invert(patterns.T)
            x = np.maximum(times(inverse, demand), 0)
        if x.sum() <= bound * (1 + gap):
            break
        duals = inverse.sum(0)
        for share in SMOOTHING:
            mixed = share * centre + (1 - share) * duals
            value, column = price(mixed, lengths, capacity)
            if (new := float((demand * mixed).sum()) / max(1.0, value)) > bound:
                bound, centre = new, mixed / max(1.0, value)
            if (duals * column).sum() > 1 + 1e-9:
                break
        else:
            break
        direction = times(inverse, column)
        positive = np.flatnonzero(direction > 1e-9)
        ratios = x[positive] / direction[positive]
        out = positive[int(ratios.argmin())]
        theta = ratios.min()
        x = np.maximum(x - theta * direction, 0)
        x[out] = theta
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[out] = column
    return patterns, x


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Patterns of (length index, number) with multiplicities, placing items best-fit decreasing."""
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for k in range(len(lengths) - 1, -1, -1):
        n = int(lengths[k])
        for _ in range(int(counts[k])):
            room = next((r for r in range(n, capacity + 1) if rooms[r]), None)
            items = rooms[room].pop() if room is not None else []
            items.append(k)
            rooms[(capacity if room is None else room) - n].append(items)
    found: dict[tuple[tuple[int, int], ...], int] = {}
    for bin_ in (b for r in rooms for b in r):
        ks, ns = np.unique(bin_, return_counts=True)
        key = tuple(zip(ks.tolist(), ns.tolist(), strict=True))
        found[key] = found.get(key, 0) + 1
    return found


def bar_width(lengths: np.ndarray, counts: np.ndarray, most: int = WIDTH, share: float = ROUNDING) -> int:
    """The widest bars, ``most`` tokens or a half, quarter... of it, whose rounding adds at most ``share`` to the tokens."""
    width = most
    while width > 1 and ((-lengths % width) * counts).sum() > share * (lengths * counts).sum():
        width //= 2
    return width


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, lo, hi, first sequence, offset, tokens of the sequence) and the number of sequences.

    Ranks lo..hi-1 of a length go to consecutive sequences, one to each.
    ``width`` 1 prices exact lengths; by default ``bar_width`` chooses.
    """
    if not histogram:
        return [], 0
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    taken = np.zeros(len(lengths), np.int64)
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(copies: list[list[tuple[int, int, int]]], total: int) -> None:
        """``copies``: for each member of a pattern, runs (length index, first rank, number) that add up to ``total``."""
        nonlocal sequence
        cuts = sorted({0, total, *(int(c) for runs in copies for c in np.cumsum([n for _, _, n in runs]))})
        at = [[0, 0] for _ in copies]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = [(runs[k][0], runs[k][1] + used) for runs, (k, used) in zip(copies, at, strict=True)]
            fill, offset = sum(int(lengths[i]) for i, _ in now), 0
            for i, rank in now:
                slots.append((int(lengths[i]), rank, rank + hi - lo, sequence + lo, offset, fill))
                offset += int(lengths[i])
            for runs, pos in zip(copies, at, strict=True):
                pos[1] += hi - lo
                if pos[1] == runs[pos[0]][2]:
                    pos[:] = [pos[0] + 1, 0]
        sequence += total

    def take(members: np.ndarray, wanted: int) -> list[tuple[int, int, int]]:
        runs = []
        for i in members.tolist():
            if (n := min(wanted, int(left[i]))) > 0:
                runs.append((i, int(taken[i]), n))
                left[i] -= n
                taken[i] += n
                wanted -= n
        return runs

    width = bar_width(lengths, left) if width is None else width
    bins, of = np.unique(-(-lengths // width), return_inverse=True)
    demand = np.bincount(of, weights=left).astype(np.int64)
    patterns, amounts = solve(bins, demand, capacity // width)
    members = [np.flatnonzero(of == k) for k in range(len(bins))]
    for row, n_times in zip(patterns, np.floor(amounts + 1e-6).astype(np.int64).tolist(), strict=True):
        used = np.flatnonzero(row)
        have = np.array([left[members[k]].sum() for k in used])
        n_times = min([n_times, *(have // row[used]).tolist()])
        if n_times > 0:
            place([take(members[k], n_times) for k in used[::-1] for _ in range(int(row[k]))], n_times)
    for key, n_times in sorted(best_fit(lengths, left, capacity).items()):
        place([take(np.array([k]), n_times) for k, per in key[::-1] for _ in range(per)], n_times)
    return slots, sequence


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy): full pieces and the rest of each row.

    ``copy`` numbers the rows of one id within a task, so that a hot id is many keys.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        seen: dict = {}
        for b in batches:
            out = Batches(pa.schema([("doc_id", b.schema.field(0).type), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "copy"))]))
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                copy = seen[i] = seen.get(i, -1) + 1
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    out.add((i, a, len(part), zlib.crc32(part.tobytes()), len(ids), copy))
                if out.full():
                    yield from out.take()
            yield from out.take()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all rows with sequence_id, offset and sequence_tokens (before padding)."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, vocabulary), "pieces")
    parts = max(RANK_PARTS, -(-cut.count() // PART_PIECES))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(parts)).cast("int"))
    counts = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # capacity rows at most
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    slots, sequences = plan(histogram, capacity)
    if full:
        slots.append((capacity, 0, full, sequences, 0, capacity))
    by_length: dict[int, list] = {}
    for n, *slot in slots:
        by_length.setdefault(n, []).append(tuple(slot))
    # slots are bounded by capacity (a few for each length)
    places = spark.createDataFrame(sorted(by_length.items()), "length long, slots array<struct<lo:long,hi:long,first:long,offset:long,fill:long>>")
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start")) - 1
    ranked = cut.withColumn("own", own).join(base, ["length", "part"]).join(F.broadcast(places), "length")
    placed = ranked.withColumn("rank", F.col("base") + F.col("own")).withColumn("s", F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("s.first") + F.col("rank") - F.col("s.lo")).alias("sequence_id"), F.col("s.offset").alias("offset"), F.col("s.fill").alias("sequence_tokens"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
