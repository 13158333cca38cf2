"""What the operators of this subpackage share: inputs, intermediate tables, row batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of results gathered before an Arrow batch goes back to the JVM.
FLUSH_BYTES = 4 << 20
FLUSH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder, and
    a cluster its warehouse, which it shares as well.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        named = f"file://{tempfile.mkdtemp(prefix='quillmesh-')}"
        sc.setCheckpointDir(named)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: Folders of the intermediate tables of this process that are still there, oldest first.
_MADE: list[str] = []


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there to ask."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is already gone: nothing left to ask
        return


def materialise(df: DataFrame, tag: str, row_group: int | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and lets one result feed several
    consumers without being computed again. The table is there until it is
    discarded, or the session ends. ``row_group`` bounds the bytes that readers
    load at once, for rows that are megabytes each.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/quillmesh-{uuid.uuid4().hex}"
    _MADE.append(folder)
    atexit.register(_drop, spark, folder)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(f"{folder}/{tag}")
    made = spark.read.schema(df.schema).parquet(f"{folder}/{tag}")
    made.quillmesh_folder = folder
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables whose consumers have all been written; other frames are left alone."""
    for t in tables:
        folder = getattr(t, "quillmesh_folder", None)
        if folder in _MADE:
            _MADE.remove(folder)
            _drop(t.sparkSession, folder)


def made_so_far() -> int:
    return len(_MADE)


def discard_since(n: int, keep: DataFrame) -> None:
    """Deletes the tables made after the first ``n``, but for ``keep``, when that has been written."""
    for folder in _MADE[n:]:
        if folder != keep.quillmesh_folder:
            _MADE.remove(folder)
            _drop(keep.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> Iterator[None]:
    """Fewer rows, or ``size`` bytes, to an Arrow batch while a stage runs whose rows are whole texts."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key, value in wanted.items() if value}
    for key in before:
        spark.conf.set(key, str(wanted[key]))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice finished shuffles, so that executors delete their files."""
    import gc
    import time

    # a first round lets go of the plans, a second of the shuffles that they held
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class Batches:
    """Collects rows as columns and hands out Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, row: tuple, weight: int = 64) -> None:
        for c, v in zip(self.columns, row, strict=True):
            c.append(v)
        self.bytes += weight

    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES or len(self.columns[0]) >= FLUSH_ROWS

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            self.columns = [[] for _ in self.schema]
            self.bytes = 0
