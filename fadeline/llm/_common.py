"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers by at most 4 MB at a time: texts can be long, and a batch is held twice on each side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def short_reads(spark: SparkSession) -> None:
    """Read Parquet by 512 rows at a time: a reader holds all texts of a batch in one array, which doubles as it grows; with 4,096
    rows of long texts that is tens of MB in one piece."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and give what it held back to the system.

    A heap otherwise keeps the size of the hungriest step so far, and buffers outside of it stay until the heap's
    own collector happens to find them; both add to what Python workers need. As many short tasks as there are cores at
    once: that each executor gets one isn't sure, and nothing depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Look-up tables that operators keep in a worker process between batches.
KEPT: list[dict] = []


def forget() -> None:
    """Empty the tables that other operators have left in this worker process, which Spark uses again and again."""
    for table in KEPT:
        table.clear()
    trim()


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give_back(0)


def gathered(batches: Iterator[pa.RecordBatch], least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``least`` bytes: the more words at once, the fewer distinct ones in all."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Integer columns of one length as compressed bytes; the first one must ascend and travels as differences."""
    first = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_columns(packed: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` columns that ``pack_columns`` packed."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(n, 8, -1)
    first, *rest = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw)
    return [np.cumsum(first), *rest]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none a temporary folder is set for it, on one machine (tests); on a cluster, which
    wouldn't share it, that is an error.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="fadeline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and return it as read back.

    Cuts the lineage: a lost executor costs a re-read of files, never a recomputation.
    """
    at = f"{shared_folder(df.sparkSession)}/fadeline/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/fadeline/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """``delete``, and let Spark drop finished shuffles' files.

    Spark's cleaner removes the files of shuffles that the driver's garbage collector has found
    unreachable, so the disk that a long query takes is that of its largest step, not of all steps.
    """
    delete(*tables)
    gc.collect()
    SparkSession.getActiveSession()._jvm.System.gc()


#: Bits of the filter by which most rows skip a join; it is at most 2**17 rows of 12 bytes, whatever the input.
FILTER_BITS = 1 << 22


def sieve(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is certainly not in the one column of ``ids``, all others); null keys count as not in it.

    A bit map over the hashes of ``ids`` is sent out, so that only the others need take part in the shuffle of a
    join: rows that it clears stay where they are. Where the map is full, it clears none.
    """
    name, cell = free_name(rows, "__id"), free_name(rows, "__cell")
    ids = ids.toDF(name).filter(F.col(name).isNotNull())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{c}`), 32) AS INT))")
    cells = ids.select(F.floor(place(name) / 32).alias(cell), bit(name).alias("bit")).groupBy(cell).agg(F.bit_or("bit").alias(f"{cell}bits"))
    marked = rows.withColumn(cell, F.floor(place(key) / 32)).join(F.broadcast(cells), cell, "left")  # at most FILTER_BITS / 32 rows
    maybe = F.coalesce(F.col(f"{cell}bits").bitwiseAND(bit(key)) != 0, F.lit(False)) & F.col(key).isNotNull()
    return marked.filter(~maybe).select(*rows.columns), marked.filter(maybe).select(*rows.columns)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` isn't in the one column of ``gone``; null keys stay. Wide rows that the sieve clears aren't shuffled."""
    sure, unsure = sieve(rows, key, gone)
    name = free_name(rows, "__gone")
    return sure.unionByName(unsure.join(gone.toDF(name), F.col(key) == F.col(name), "left_anti"))


def row_key(*columns: str) -> Column:
    """A 64-bit name of what a row holds in ``columns``: equal contents, equal names; a null is a content like others."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that ``df`` doesn't use as a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
