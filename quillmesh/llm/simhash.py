"""SimHash near-duplicates: fingerprints and a binary-trie self-join within a Hamming budget.

Rows with one fingerprint form a class. Classes meet by the pigeonhole
principle: of six bit blocks, two fingerprints with at most four differing
bits agree on two, so each of the 15 block pairs deals the classes to shards
by the bits of those blocks. In a shard the permuted fingerprints are sorted,
which is a binary trie laid flat; pairs of its nodes are walked together,
adding up differing bits, and are left as soon as they exceed the budget.
Shards return a spanning forest of their links, never all pairs; stars joins
the forests.

Edge cases: null and empty texts, and texts of white space, have fingerprint
zero and are linked like any other; texts of fewer words than a shingle hash
as one; repeated rows share a component; a null id never names a component
unless it has no other id; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, table
from quillmesh.llm.components import stars

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Bits of the six blocks; any BUDGET errors leave two of them untouched.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Classes dealt to a shard, about.
SHARD_ROWS = 50_000
#: Node pairs with no more members than this on either side are compared directly.
LEAF = 64


def fingerprint(raw: bytes | None) -> int:
    """The 64-bit SimHash of a text's bytes."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of each row with fp, the fingerprint as a signed long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep)) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(n)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col("text").cast("binary").alias("__raw")).mapInArrow(run, schema)


def permute(fp: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """The bits with the two blocks of ``pair`` moved to the top."""
    starts = np.concatenate([[0], np.cumsum(BLOCKS)])
    order = [*pair, *(i for i in range(len(BLOCKS)) if i not in pair)]
    out = np.zeros_like(fp)
    for i in order:
        width = np.uint64(BLOCKS[i])
        part = (fp >> np.uint64(64 - starts[i + 1])) & ((np.uint64(1) << width) - np.uint64(1))
        out = (out << width) | part
    return out


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def one(self, lo: int, hi: int) -> int:
        """The root that all of lo..hi-1 share, or -1."""
        r = self.root(lo)
        return r if all(self.root(i) == r for i in range(lo + 1, hi)) else -1


def trie_links(keys: np.ndarray, bit: int, forest: Forest, base: int, budget: int = BUDGET) -> None:
    """Joins, in ``forest``, sorted keys that differ in at most ``budget`` of the bits below ``bit``.

    A node is a range of ``keys`` that share their upper bits. Pairs of nodes
    wait on a stack, with the position of their next bit and the errors so far;
    a node's own halves come before the pair of them, so that members already
    in one component cut the walk short.
    """
    stack = [(0, len(keys), 0, len(keys), bit, 0)]
    while stack:
        a0, a1, b0, b1, bit, err = stack.pop()
        if a0 >= a1 or b0 >= b1 or (a0 == b0 and a1 - a0 < 2):
            continue
        small = a1 - a0 <= LEAF and b1 - b0 <= LEAF
        if small or bit == 0:
            near = np.bitwise_count(keys[a0:a1, None] ^ keys[None, b0:b1]) <= budget
            for i, j in zip(*np.nonzero(np.triu(near, 1) if a0 == b0 else near), strict=True):
                forest.union(base + a0 + int(i), base + b0 + int(j))
            continue
        if a0 != b0:
            r = forest.one(base + a0, base + a1)
            if r >= 0 and r == forest.one(base + b0, base + b1):
                continue
        one = np.uint64(1) << np.uint64(bit - 1)
        am = a0 + int(np.searchsorted((keys[a0:a1] & one) > 0, True))
        if a0 == b0:
            stack += [(a0, am, am, a1, bit - 1, err + 1), (am, a1, am, a1, bit - 1, err), (a0, am, a0, am, bit - 1, err)]
            continue
        bm = b0 + int(np.searchsorted((keys[b0:b1] & one) > 0, True))
        if err < budget:
            stack += [(a0, am, bm, b1, bit - 1, err + 1), (am, a1, b0, bm, bit - 1, err + 1)]
        stack += [(a0, am, b0, bm, bit - 1, err), (am, a1, bm, b1, bit - 1, err)]


def shard_forest(fp: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root fingerprint) of one shard: a spanning forest."""
    fp = np.unique(fp)
    keys = permute(fp, pair)
    order = np.argsort(keys)
    fp, keys = fp[order], keys[order]
    low = 64 - BLOCKS[pair[0]] - BLOCKS[pair[1]]
    top = keys >> np.uint64(low)
    edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
    forest = Forest(len(fp))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo > 1:
            trie_links(keys[lo:hi], low, forest, lo)
    roots = np.fromiter((forest.root(i) for i in range(len(fp))), np.int64, len(fp))
    moved = roots != np.arange(len(fp))
    return fp[moved], fp[roots[moved]]


def links(classes: DataFrame, n: int) -> DataFrame:
    """(u, v): spanning forests of the links among ``n`` distinct fingerprints fp."""
    pairs = list(combinations(range(len(BLOCKS)), 2))
    starts = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    bits = lambda i: F.shiftrightunsigned("fp", 64 - starts[i + 1]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
    shards = max(1, -(-n // SHARD_ROWS))
    deal = F.array(*[F.struct(F.lit(k).alias("pair"), F.pmod(F.xxhash64(bits(i), bits(j)), F.lit(shards)).alias("shard")) for k, (i, j) in enumerate(pairs)])
    dealt = classes.select("fp", F.explode(deal).alias("d")).select("fp", "d.pair", "d.shard")

    def join(key: tuple, batch: pa.Table) -> pa.Table:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        u, v = shard_forest(fp, pairs[key[0].as_py()])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("pair", "shard").applyInArrow(join, "u long, v long")


def group(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, class_fp, component_id) for each distinct fp of rows(id, fp): least linked fp and id."""
    classes = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    joined = stars(links(classes, classes.count()))
    mapped = materialise(classes.join(joined.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("class_fp")), "mapped")
    ids = materialise(mapped.groupBy("class_fp").agg(F.min("least").alias("component_id")), "components")
    # both sides written: a component of very many classes can be split
    return materialise(mapped.join(ids, "class_fp").select("fp", "class_fp", "component_id"), "groups")


def simhash_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row with fp, class_fp and component_id (``keep`` holds doc_id)."""
    rows = materialise(with_fingerprint(docs, keep), "fingerprints")
    return rows.join(group(rows), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
