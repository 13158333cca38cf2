"""Approximate nearest neighbours by inner product: one HNSW graph a shard, results merged.

Equal vectors form a class, so that copies neither crowd a graph nor a result;
each class keeps its few smallest ids, which is all that a result can hold.
Classes are dealt to shards by hash: SHARDS of them, whatever the input, until
shards reach the size that a task can hold, so that a query's cost grows with
the logarithm of a shard. A shard's graph is a hierarchical navigable small
world, built by batched insertion and stored as flat arrays: one row of ids,
vectors, levels and a neighbour table for each layer. Every query visits every
shard, and a shard is copied only where more than QUERY_ROWS queries ask it; a
walk keeps ``EF`` best nodes and expands the nearest of them, and a shard
returns one short list a query. Inner products become distances by one added
coordinate.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids; repeated rows count once; only
vectors of one length are compared; with fewer candidates than ``K`` all are
returned; equal scores go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, table

K = 20
#: Shards of an index, and classes that a shard holds at least and at most (64 numbers each: about 1 kB in all).
SHARDS = 8
LEAST_ROWS, MOST_ROWS = 1024, 1 << 20
#: Queries that one task takes to a shard, and rows of one vector that are named together.
QUERY_ROWS = 1 << 16
MEMBERS = 2048
#: Bytes of marks for visited nodes that a batch of walks holds.
SEEN_BYTES = 64 << 20
#: Neighbours on upper layers, and on the lowest.
M, M0 = 16, 32
#: Up to so many classes in a shard, new nodes are compared with all of it.
EXACT_ROWS = 1 << 14
EF_BUILD = 80
EF = 96
#: Best nodes that a step of a walk expands together.
WIDTH = 4
BATCH = 256
SEED = 11


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of ``a`` with its rows of ``b``."""
    return np.matmul(b, a[:, :, None])[:, :, 0]


class Graph:
    """Layers of neighbour tables (-1: none) over unit-length augmented vectors."""

    def __init__(self, vectors: np.ndarray):
        v = vectors.astype(np.float64)
        norms = np.sqrt((v * v).sum(1))
        top = norms.max() if len(norms) else 1.0
        rest = np.sqrt(np.maximum(top * top - norms * norms, 0))
        self.points = (np.column_stack([v, rest]) / top).astype(np.float32)
        self.scale = top
        n = len(v)
        draws = np.random.default_rng(SEED).random(n)
        self.levels = np.minimum((-np.log(1 - draws) / np.log(M)).astype(np.int64), 6)
        if n:
            self.levels[0] = self.levels.max()  # the entry point
        self.tables = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]

    def walk(self, layer: int, queries: np.ndarray, seeds: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found for each query from its seeds, nearest first; -1 fills up."""
        table, points = self.tables[layer], self.points
        b, n = len(queries), len(points)
        rows = np.arange(b)[:, None]
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        ids[:, : seeds.shape[1]] = seeds
        sims[:, : seeds.shape[1]] = np.where(seeds >= 0, dots(queries, points[seeds]), -np.inf)
        open_ = ids >= 0
        seen = np.zeros((b, n + 1), bool)
        seen[rows, ids] = True
        seen[:, n] = True  # where -1 points
        width = min(WIDTH, ef)
        live = np.arange(b)
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            pick = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < ef else np.argsort(-score, axis=1)[:, :width]
            some = np.take_along_axis(score, pick, 1) > -np.inf
            go = some.any(1)
            live, pick, some = live[go], pick[go], some[go]
            if not len(live):
                break
            at = live[:, None]
            open_[at, pick] = False
            near = np.where(some[:, :, None], table[ids[at, pick]], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[at, near]
            near = np.where(fresh, near, -1)
            seen[at, near] = True
            got = dots(queries[live], points[near])
            got = np.where(near >= 0, got, -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], got], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & (sims[live] > -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(np.where(sims > -np.inf, ids, -1), order, 1), np.take_along_axis(sims, order, 1)

    def diverse(self, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """At most ``most`` of each row's nodes (nearest first): those nearer to the row than to a node already taken."""
        b, c = ids.shape
        pts = self.points[ids]
        between = np.matmul(pts, pts.transpose(0, 2, 1))
        keep = np.zeros((b, c), bool)
        count = np.zeros(b, np.int64)
        for k in range(c):
            blocked = (keep & (between[:, k] > sims[:, k, None])).any(1)
            keep[:, k] = (ids[:, k] >= 0) & ~blocked & (count < most)
            count += keep[:, k]
        # fill up with the nearest that were passed over
        rank = np.where(keep, np.arange(c), np.where(ids >= 0, c + np.arange(c), 3 * c))
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def link(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Stores the neighbours of new nodes and the links back, pruned to the table's width."""
        table = self.tables[layer]
        most = table.shape[1]
        table[new, : chosen.shape[1]] = chosen
        src, dst = np.repeat(new, chosen.shape[1]), chosen.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(nodes), int(counts.max())), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
        for lo in range(0, len(nodes), BATCH):
            own = nodes[lo : lo + BATCH]
            ids = np.concatenate([table[own].astype(np.int64), back[lo : lo + BATCH]], 1)
            sims = np.where(ids >= 0, dots(self.points[own], self.points[ids]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            table[own] = self.diverse(sims, ids, most)

    def nearest_of(self, layer: int, new: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """The EF_BUILD nearest of the first ``done`` nodes of a layer to each new one, nearest first, by comparing all."""
        known = np.flatnonzero(self.levels[:done] >= layer)
        sims = self.points[new] @ self.points[known].T
        width = min(EF_BUILD, len(known))
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        sims = np.take_along_axis(sims, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return known[np.take_along_axis(best, order, 1)], np.take_along_axis(sims, order, 1)

    def build(self) -> Graph:
        """Inserts the nodes in batches. A new node's candidates are found by a walk, or, in a small shard, where that is cheaper, among all."""
        n, done = len(self.points), 1
        batch = max(16, min(BATCH, SEEN_BYTES // max(n, 1)))
        while done < n:
            new = np.arange(done, min(n, done + min(batch, max(1, done // 4))))
            queries = self.points[new]
            seeds = np.zeros((len(new), 1), np.int64)
            for layer in range(len(self.tables) - 1, -1, -1):
                member = self.levels[new] >= layer
                if n <= EXACT_ROWS:
                    if member.any():
                        found, sims = self.nearest_of(layer, new[member], done)
                        self.link(layer, new[member], self.diverse(sims, found, M))
                    continue
                found, sims = self.walk(layer, queries, seeds, EF_BUILD if member.any() else 1)
                if member.any():
                    chosen = self.diverse(sims[member], found[member], M)
                    self.link(layer, new[member], chosen)
                seeds = found[:, :1]
            done = int(new[-1]) + 1
        return self

    def search(self, queries: np.ndarray, k: int, ef: int = EF) -> np.ndarray:
        """Positions of about the k largest inner products of each query, -1 where there are fewer."""
        if not len(self.points):
            return np.full((len(queries), k), -1)
        q = np.column_stack([queries, np.zeros(len(queries))])
        q = (q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None]).astype(np.float32)
        seeds = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.tables) - 1, 0, -1):
            seeds = self.walk(layer, q, seeds, 1)[0]
        return self.walk(0, q, seeds, max(ef, k))[0][:, :k]


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (vec_id, vec) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(vector_col).cast("array<double>")
    took = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    return took.filter(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)).distinct()


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, vec): the distinct vectors, each with its k + 1 smallest ids."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vec", F.size("vec").alias("dim"))


def build_index(classes: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """One row a shard: its ids and vectors, the levels, and a flat neighbour table for each layer.

    ``shard_rows`` fixes the classes to a shard; by default there are SHARDS shards of a length of vector.
    """
    n = F.count("*")
    wanted = F.ceil(n / shard_rows) if shard_rows else F.greatest(F.least(F.lit(SHARDS), F.ceil(n / LEAST_ROWS)), F.ceil(n / MOST_ROWS))
    sizes = classes.groupBy("dim").agg(wanted.cast("int").alias("shards"))
    dealt = classes.select("rep", "ids", "vec", "dim").join(F.broadcast(sizes), "dim")  # a row for each length of vector
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        lists = rows.column("ids").combine_chunks()
        vectors = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        g = Graph(vectors).build()
        flat = lambda a, t: np.ascontiguousarray(a, t).tobytes()
        return pa.table({
            "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([rows.num_rows], pa.int64()),
            "members": pa.array([flat(lists.value_lengths().to_numpy(), "<i4")], pa.binary()), "ids": pa.array([flat(lists.flatten().to_numpy(), "<i8")], pa.binary()),
            "vectors": pa.array([flat(vectors, "<f8")], pa.binary()), "levels": pa.array([flat(g.levels, "<i8")], pa.binary()),
            "neighbours": pa.array([[flat(t, "<i4") for t in g.tables]], pa.list_(pa.binary())),
        })

    schema = "dim int, shard int, n long, members binary, ids binary, vectors binary, levels binary, neighbours array<binary>"
    return dealt.groupBy("dim", "shard").applyInArrow(build, schema)


class Shard:
    """A stored shard: its vectors, its graph, and the ids of each class."""

    def __init__(self, row: dict):
        n = row["n"]
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, row["dim"])
        self.graph = Graph(self.vectors)
        self.graph.levels = np.frombuffer(row["levels"], "<i8")
        self.graph.tables = [np.frombuffer(t, "<i4").reshape(n, -1) for t in row["neighbours"]]
        self.ids = np.split(np.frombuffer(row["ids"], "<i8"), np.cumsum(np.frombuffer(row["members"], "<i4"))[:-1])

    def best(self, queries: np.ndarray, k: int, ef: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the ``k`` nearest ids of each query, best first, ties to smaller ids."""
        out = []
        step = max(16, min(BATCH, SEEN_BYTES // max(len(self.vectors), 1)))
        for lo in range(0, len(queries), step):
            part = queries[lo : lo + step]
            for q, found in zip(part, self.graph.search(part, k, ef), strict=True):
                hits = found[found >= 0].tolist()
                scores = (self.vectors[hits] * q).sum(1)
                ids = [self.ids[h] for h in hits]
                scores, ids = np.repeat(scores, [len(x) for x in ids]), np.concatenate([*ids, np.zeros(0, np.int64)])
                order = np.lexsort((ids, -scores))[:k]
                out.append((scores[order], ids[order]))
        return out


BEST = "array<struct<s:double,vec_id:long>>"


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, best): for each of queries(q, vec, dim) its ``k`` nearest ids in all shards as (-score, id), nearest first."""
    shards = index.select(F.col("dim").alias("d"), F.col("shard").alias("at"))
    blocks = max(1, -(-queries.count() // query_rows))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    # every query visits every shard
    asked = queries.select("q", "vec", "dim", block).join(shards, F.col("dim") == F.col("d")).select("q", "vec", "block", F.col("d").alias("dim"), F.col("at").alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())]))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, best = np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            names = right.column("q").to_numpy()
            queries_ = right.column("vec").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            best = Shard(left.to_pylist()[0]).best(queries_, k, ef)
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([*(-s for s, _ in best), np.zeros(0)])), pa.array(np.concatenate([*(i for _, i in best), np.zeros(0, np.int64)]))], fields=list(kind.value_type)
        )
        ends = np.concatenate([[0], np.cumsum([len(s) for s, _ in best])]).astype(np.int32)
        return pa.table({"q": pa.array(names, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(ends), flat)})

    hits = graphs.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(search, f"q long, best {BEST}")
    return hits.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, ef: int = EF, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on vec_id) holds for, its k nearest others."""
    took = materialise(valid(rows, id_col, vector_col), "vectors")
    classes = materialise(classes_of(took, k), "classes")
    index = materialise(build_index(classes, shard_rows), "index")
    asked = took.filter(is_query)
    # rows of one vector come in groups, so that a vector of very many rows is few rows where it meets its class and its result
    group = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // MEMBERS)))).alias("group")
    grouped = asked.groupBy("vec", group).agg(F.collect_list("vec_id").alias("members"))
    named = materialise(grouped.join(classes.select("vec", F.col("rep").alias("q")), "vec").select("q", "members"), "queries")
    queries = classes.select(F.col("rep").alias("q"), "vec", "dim").join(named.select("q").distinct(), "q", "left_semi")
    best = search_index(index, queries, k + 1, ef)
    dealt = named.join(best, "q").repartition("members")
    own = dealt.select(F.explode("members").alias("query_id"), "best")
    own = own.select("query_id", F.slice(F.filter("best", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("p", "c")).select("query_id", (F.col("p") + 1).alias("rank"), "c.vec_id", (-F.col("c.s")).alias("score"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

