"""Vectors and neighbour graphs: normalisation, exact nearest neighbours, mean aggregation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.numeric import dot, l2_normalise


def standardise(df: DataFrame, id_col: str, vector: str, train: Column) -> DataFrame:
    """(id, z): vectors standardised with mean and population deviation of the training rows; a constant dimension is 0."""
    each = df.select(id_col, train.alias("__train"), F.posexplode(vector).alias("k", "x"))
    fit = each.filter("__train").groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # a row for each dimension
    z = each.join(F.broadcast(fit), "k").select(id_col, "k", F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))
    return z.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda e: e["z"]).alias("z"))


def knn_edges(nodes: DataFrame, id_col: str, vector: str, k: int, others: DataFrame | None = None, block_rows: int = 8192) -> DataFrame:
    """(src, dst, rank, cos): the k most similar ``others`` (by default all nodes but itself) of each node, ties to the smaller id.

    Exact, so every node meets every other, in blocks: a matrix product for each
    pair of blocks, of which a node keeps its k best, and the blocks' winners
    are merged; memory is two blocks whatever the size of the table.
    """
    import numpy as np
    import pyarrow as pa

    if k <= 0:
        raise ValueError("k must be positive")
    blocks = max(1, -(-max(nodes.count(), 0 if others is None else others.count()) // block_rows))
    unit = lambda df, name: df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), l2_normalise(F.col(vector)).alias("v")).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = unit(nodes, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = unit(nodes if others is None else others, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out: dict[str, list] = {"src": [], "dst": [], "cos": []}
        if x.num_rows and y.num_rows:
            ids, vs = (t.column("id").to_numpy() for t in (x, y)), (t.column("v").combine_chunks() for t in (x, y))
            (xi, yi), (xv, yv) = ids, (v.flatten().to_numpy().reshape(len(v), -1) for v in vs)
            order = np.argsort(yi)
            yi, yv = yi[order], yv[order]
            width = min(k + 1, len(yi))
            for lo in range(0, len(xi), 256):
                part = xv[lo : lo + 256]
                near = part @ yv.T
                # the product rounds otherwise than the sum that decides: all that could be among the best are summed again
                floor = np.partition(near, len(yi) - width, axis=1)[:, len(yi) - width] - 1e-9
                rows, cols = np.nonzero(near >= floor[:, None])
                cos = (yv[cols] * part[rows]).sum(1)
                src, dst = xi[lo + rows], yi[cols]
                other = src != dst
                src, dst, cos = src[other], dst[other], cos[other]
                best_first = np.lexsort((dst, -cos, src))
                src, dst, cos = src[best_first], dst[best_first], cos[best_first]
                head = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
                place = np.arange(len(src)) - np.repeat(head, np.diff(np.append(head, len(src))))
                keep = place < k
                for name, values in (("src", src), ("dst", dst), ("cos", cos)):
                    out[name].append(values[keep])
        out = {name: np.concatenate(v) if v else [] for name, v in out.items()}
        return pa.table({"src": pa.array(out["src"], pa.int64()), "dst": pa.array(out["dst"], pa.int64()), "cos": pa.array(out["cos"], pa.float64())})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "src long, dst long, cos double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("cos"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions; repeats stay."""
    pair = edges.select("src", "dst")
    return pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def attach(new: DataFrame, base: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """Directed edges from the k nearest base nodes to each new node."""
    return knn_edges(new, id_col, vector, k, base).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rank")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, mean): the mean vector over incoming edges; zeros for an isolated node. Vectors are summed whole, before the shuffle as well."""
    sources = nodes.select(F.col(id_col).alias("src"), array_to_vector(F.col(vector)).alias("__x"))
    means = edges.select("src", "dst").join(sources, "src").groupBy("dst").agg(vector_to_array(Summarizer.mean(F.col("__x"))).alias("mean"))
    joined = nodes.select(F.col(id_col), F.col(vector).alias("__v")).join(means, F.col(id_col) == F.col("dst"), "left")
    return joined.select(id_col, F.coalesce("mean", F.transform("__v", lambda x: F.lit(0.0))).alias("mean"))


def layer(nodes: DataFrame, edges: DataFrame, id_col: str, vector: str, own: list[list[float]], other: list[list[float]], bias: list[float], relu: bool = True) -> DataFrame:
    """(id, vector): own x + other mean(neighbours) + bias, through a rectifier. The weights are small matrices, row by row."""
    means = neighbour_mean(nodes, edges, id_col, vector)
    both = nodes.select(id_col, vector).join(means, id_col)
    row = lambda w: F.array(*map(F.lit, map(float, w)))
    outs = [dot(F.col(vector), row(a)) + dot(F.col("mean"), row(b)) + F.lit(float(c)) for a, b, c in zip(own, other, bias, strict=True)]
    return both.select(id_col, F.array(*[F.greatest(o, F.lit(0.0)) if relu else o for o in outs]).alias(vector))


def softmax(logits: Column) -> Column:
    """The softmax of an array, shifted by its maximum."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def classify(nodes: DataFrame, edges: DataFrame, id_col: str, vector: str, layers: list[tuple[list, list, list]], head: tuple[list, list]) -> DataFrame:
    """(id, p): class probabilities of each node after the layers (own, other, bias) and a linear head (weights, bias)."""
    out = nodes.select(id_col, vector)
    for own, other, bias in layers:
        out = layer(out, edges, id_col, vector, own, other, bias)
    weights, bias = head
    logits = F.array(*[dot(F.col(vector), F.array(*map(F.lit, map(float, w)))) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])
    return out.select(id_col, softmax(logits).alias("p"))
