"""Token counts from flat unindexed token files by a separator scan.

A token file is a bare run of fixed-width ids; every document ends with an
end-of-document id and nothing tells where. The file is read in blocks that
ignore documents. Each block is searched for the separator with numpy and
gives its positions; a prefix scan over the block summaries (tokens,
separators, last separator) stitches documents that cross blocks.
``read_files`` takes blocks from raw files; ``write_stream`` makes shards of
documents and keeps their blocks compressed, as raw ids take more room than
the texts they come from.

Edge cases: null and empty texts are a lone separator and count 0 tokens;
ids of special tokens cannot come from text; a stream that does not end with a
separator gives a last row with ``terminated`` false; repeated rows count each;
an empty table or file gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, table
from quillmesh.llm.tokens import VOCABULARY, Encoder

SEPARATOR = 50256
DTYPE = "<u2"
#: Bytes of a block. Blocks are the unit of work; ``read_files`` reads files of up to 2 GB, the limit of Spark's binary reader.
BLOCK_BYTES = 256 << 10
#: Ids of documents to a row of the manifest.
MANIFEST_ROWS = 4096


def write_stream(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest): one flat token shard a partition, and the ids of its documents in order.

    blocks(shard, block, data) hold nothing but ids; manifest(shard, ordinal, doc_id).
    """
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, special=False)
        shard = TaskContext.get().partitionId()
        end = np.array([SEPARATOR], DTYPE).tobytes()
        buffer, block, ids, first = bytearray(), 0, [], 0
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(v, schema, strict=True)], schema=schema)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                buffer += encode(text.as_py() or "").astype(DTYPE).tobytes()
                buffer += end
                ids.append(i)
                while len(buffer) >= block_bytes:
                    yield row(shard, block, bytes(buffer[:block_bytes]), None, None)
                    del buffer[:block_bytes]
                    block += 1
                if len(ids) == MANIFEST_ROWS:
                    yield row(shard, None, None, first, ids)
                    first, ids = first + len(ids), []
        if buffer:
            yield row(shard, block, bytes(buffer), None, None)
        if ids:
            yield row(shard, None, None, first, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = materialise(rows.mapInArrow(run, "shard long, block long, data binary, first long, ids array<long>"), "tokens")
    named = both.filter("ids IS NOT NULL").select("shard", "first", F.posexplode("ids").alias("k", "doc_id"))
    return both.filter("data IS NOT NULL").select("shard", "block", "data"), named.select("shard", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")


def read_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """blocks(shard, block, data) of raw token files; the shard is the file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                for k, at in enumerate(range(0, len(raw), block_bytes)):
                    yield pa.RecordBatch.from_pydict({"shard": [name], "block": pa.array([k], pa.int64()), "data": pa.array([bytes(raw[at : at + block_bytes])], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "shard string, block long, data binary")


def search(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """(shard, block, n_tokens, ends): the positions of separators in each block."""
    kind = blocks.schema["shard"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, found = [], []
            for data in b.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype)
                tokens.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), ends], names=["shard", "block", "n_tokens", "ends"])

    return blocks.select("shard", "block", "data").mapInArrow(run, f"shard {kind}, block long, n_tokens long, ends array<long>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """(shard, ordinal, start, n_tokens, terminated): every document of the streams, without its separator."""
    found = materialise(search(blocks, separator, dtype), "ends")
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = found.select("shard", "block", "n_tokens", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    base = summary.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    scanned = base.select(
        "shard", "block", "base", "n_tokens", "n_ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        # where the document begins that is open when the block begins
        F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)).alias("open"),
        F.lead("block").over(W.partitionBy("shard").orderBy("block")).isNull().alias("final"),
        (F.col("base") + F.coalesce(F.col("last"), F.lit(-1)) + 1).alias("after"),
    )
    ends = found.select("shard", "block", "ends").join(scanned, ["shard", "block"])
    each = ends.select("shard", "base", "open", "ordinal", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    closed = each.select("shard", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    begun = F.when(F.col("n_ends") > 0, F.col("after")).otherwise(F.col("open"))
    left = F.col("base") + F.col("n_tokens") - begun
    tail = scanned.filter("final").filter(left > 0).select("shard", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), begun.alias("start"), left.alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(tail)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat token shards of the documents."""
    blocks, manifest = write_stream(table(spark, sf_dir, "documents"))
    return count_tokens(blocks).join(manifest, ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal", "start")
