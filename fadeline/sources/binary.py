"""Vector, time, id and graph files in fixed binary layouts, read in parallel by byte ranges.

Readers for layouts of equal records go through Hadoop's fixed-length input, so any store that Spark
can read works. ``fbin`` has a header that breaks the alignment and is read by a Python data source
from paths that all executors can open. All readers give explicit ids: a file's row order is the id.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_NUMBERS = {"float": ("<f4", pa.float32()), "double": ("<f8", pa.float64()), "int": ("<i4", pa.int32()), "uint": ("<u4", pa.int64()), "bigint": ("<i8", pa.int64()), "ubigint": ("<u8", pa.int64())}


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(id, raw) of a file of equal records; a length that doesn't divide the file raises."""
    length = _length(spark, path)
    if size <= 0 or length % size:
        raise ValueError(f"{path}: {length} bytes aren't records of {size}")
    rows = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    return spark.createDataFrame(rows, "id bigint, raw binary")


def _length(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def _arrays(records: DataFrame, kind: str, width: int, skip: int = 0, check: int | None = None, name: str = "vec") -> DataFrame:
    dtype, arrow = _NUMBERS[kind]
    sql = {"float": "float", "double": "double", "int": "int"}.get(kind, "bigint")

    def decode(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(b["raw"].to_pylist()), np.uint8).reshape(len(b), -1)
            if check is not None and len(b) and (np.ascontiguousarray(raw[:, :4]).view("<i4") != check).any():
                raise ValueError("a row's own length differs from the file's")
            flat = np.ascontiguousarray(raw[:, skip:]).view(dtype).astype(arrow.to_pandas_dtype()).ravel()
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat, arrow))
            yield pa.RecordBatch.from_arrays([b["id"], values], names=["id", name])

    return records.mapInArrow(decode, f"id bigint, `{name}` array<{sql}>")


def read_raw(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vec): headerless float32 rows."""
    return _arrays(_records(spark, path, 4 * dim), "float", dim)


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vec): each row preceded by its length, which must be ``dim``."""
    return _arrays(_records(spark, path, 4 * dim + 4), "float", dim, skip=4, check=dim)


def read_fbin(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(id, vec): a header of row count and dimension, then float32 rows."""
    register(spark)
    return spark.read.format("fadeline_vectors").option("kind", "fbin").option("dim", str(dim or 0)).load(path)


def read_vectors(spark: SparkSession, path: str, fmt: str, dim: int) -> DataFrame:
    return {"raw": read_raw, "fvecs": read_fvecs, "fbin": read_fbin}[fmt](spark, path, dim)


def count_vectors(spark: SparkSession, path: str, fmt: str, dim: int) -> int:
    """Rows of a valid file; 0 if its layout doesn't fit."""
    try:
        return read_vectors(spark, path, fmt, dim).count()
    except Exception as e:  # noqa: BLE001
        if isinstance(e, (ValueError, OSError)) or "differs" in str(e) or "isn't" in str(e) or "aren't" in str(e):
            return 0
        raise


def read_scalars(spark: SparkSession, path: str, kind: str = "float", name: str = "ts_days", rows: int | None = None) -> DataFrame:
    """(id, name): one number per row; ``rows`` asserts how many."""
    size = np.dtype(_NUMBERS[kind][0]).itemsize
    if rows is not None and _length(spark, path) != rows * size:
        raise ValueError(f"{path} doesn't hold {rows} numbers")
    return _arrays(_records(spark, path, size), kind, 1, name="v").select("id", F.col("v")[0].alias(name))


def read_ground_truth(spark: SparkSession, path: str, width: int, kind: str = "bigint", base_rows: int | None = None) -> DataFrame:
    """(qid, rank, id) from rows of ``width`` ids; ids outside the base raise when read."""
    size = np.dtype(_NUMBERS[kind][0]).itemsize
    long = _arrays(_records(spark, path, width * size), kind, width, name="ids").select(F.col("id").alias("qid"), F.posexplode("ids").alias("rank", "id"))
    long = long.select("qid", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("id").cast("bigint").alias("id"))
    if base_rows is not None:
        bad = (F.col("id") < 0) | (F.col("id") >= base_rows)
        long = long.withColumn("id", F.when(bad, F.raise_error(F.lit("an id lies outside the base"))).otherwise(F.col("id")))
    return long


def read_knng(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(src, rank, dst) from rows of a degree (which must be ``k``) and ``k`` unsigned ids."""
    long = _arrays(_records(spark, path, 4 * (k + 1)), "uint", k, skip=4, check=k, name="ids").select(F.col("id").alias("src"), F.posexplode("ids").alias("rank", "dst"))
    return long.select("src", (F.col("rank") + 1).cast("bigint").alias("rank"), "dst")


def read_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id): one id per line of a text file."""
    rows = spark.sparkContext.textFile(path).zipWithIndex().map(lambda r: (r[1], int(r[0])))
    return spark.createDataFrame(rows, "pos bigint, id bigint")


# ---- data source --------------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, file: str, first: int, last: int, at: int, dim: int, skip: int):
        self.file, self.first, self.last, self.at, self.dim, self.skip = file, first, last, at, dim, skip


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, dim: int, block: int):
        self.path, self.kind, self.dim, self.block = path.removeprefix("file://"), kind, dim, block

    def partitions(self) -> list[_Range]:
        size, head, skip, dim = os.path.getsize(self.path), 0, 0, self.dim
        if self.kind == "fbin":
            with open(self.path, "rb") as f:
                rows, own = struct.unpack("<II", f.read(8))
            if dim and dim != own or 8 + rows * own * 4 != size:
                raise ValueError(f"{self.path} isn't {rows} rows of {own}")
            head, dim = 8, own
        elif self.kind == "fvecs":
            skip = 4
        width = dim * 4 + skip
        if not width or (size - head) % width:
            raise ValueError(f"{self.path} isn't made of rows of {width} bytes")
        n, step = (size - head) // width, max(1, self.block // width)
        return [_Range(self.path, a, min(n, a + step), head, dim, skip) for a in range(0, n, step)]

    def read(self, p: _Range) -> Iterator[pa.RecordBatch]:
        width = p.dim * 4 + p.skip
        with open(p.file, "rb") as f:
            f.seek(p.at + p.first * width)
            raw = np.frombuffer(f.read((p.last - p.first) * width), np.uint8).reshape(-1, width)
        if p.skip and (np.ascontiguousarray(raw[:, :4]).view("<i4") != p.dim).any():
            raise ValueError("a row's own length differs from the file's")
        flat = np.ascontiguousarray(raw[:, p.skip :]).view("<f4").ravel()
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, p.dim), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.first, p.last)), vec], names=["id", "vec"])


class _Part(WriterCommitMessage):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class _Writer(DataSourceWriter):
    """Parts in partition order; on commit they are renamed to part-00000 and so on, on abort removed."""

    def __init__(self, path: str, column: str, dtype: str):
        self.path, self.column, self.dtype = path.removeprefix("file://"), column, dtype

    def write(self, rows) -> _Part:
        from pyspark import TaskContext

        t = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        file, n = f"{self.path}/.tmp-{t.partitionId():05d}-{t.attemptNumber()}", 0
        with open(file, "wb") as f:
            for r in rows:
                f.write(np.asarray(r[self.column], self.dtype).tobytes())
                n += 1
        return _Part(file, n)

    def commit(self, messages) -> None:
        for i, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.file)):
            os.replace(m.file, f"{self.path}/part-{i:05d}")
        open(f"{self.path}/_SUCCESS", "w").close()

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.file):
                os.remove(m.file)


class VectorSource(DataSource):
    """``spark.read.format("fadeline_vectors")`` with kind raw, fvecs or fbin, and dim; and the ordered binary sink."""

    @classmethod
    def name(cls) -> str:
        return "fadeline_vectors"

    def schema(self) -> str:
        return "id bigint, vec array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("kind", "raw"), int(self.options.get("dim", "0")), int(self.options.get("block", str(32 << 20))))

    def writer(self, schema, overwrite) -> _Writer:
        return _Writer(self.options["path"], self.options.get("column", "vec"), self.options.get("dtype", "<f4"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)


def write_ordered(rows: DataFrame, path: str, column: str, dtype: str, order: list[str]) -> None:
    """One column's numbers in the order of ``order``, as parts that concatenate to the flat file."""
    register(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(column).write.format("fadeline_vectors").option("column", column).option("dtype", dtype).mode("append").save(path)


def write_raw(rows: DataFrame, path: str) -> None:
    write_ordered(rows, path, "vec", "<f4", ["id"])


def write_times(rows: DataFrame, path: str) -> None:
    write_ordered(rows, path, "ts_days", "<f4", ["id"])


def write_clusters(rows: DataFrame, path: str) -> None:
    write_ordered(rows, path, "cluster_id", "<i4", ["id"])


def write_row_ids(rows: DataFrame, path: str) -> None:
    write_ordered(rows, path, "source_row", "<u8", ["id"])


def write_ground_truth(gt: DataFrame, path: str) -> None:
    """Fixed-width rows of ids; queries with unequal numbers of results raise."""
    wide = gt.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    if wide.select(F.size("ids")).distinct().limit(2).count() > 1:
        raise ValueError("queries have unequal numbers of results")
    write_ordered(wide, path, "ids", "<i8", ["qid"])


def write_knng(edges: DataFrame, path: str) -> None:
    wide = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("ids"))
    wide = wide.withColumn("row", F.concat(F.array(F.size("ids").cast("bigint")), "ids"))
    write_ordered(wide, path, "row", "<u4", ["src"])


def flat_file(path: str) -> str:
    """The parts of an ordered export as one file beside them, for readers that want one."""
    path = path.removeprefix("file://")
    with open(f"{path}.bin", "wb") as out:
        for p in sorted(x for x in os.listdir(path) if x.startswith("part-")):
            with open(f"{path}/{p}", "rb") as f:
                while block := f.read(1 << 22):
                    out.write(block)
    return f"{path}.bin"


def write_manifest(spark: SparkSession, path: str, kind: str, report: DataFrame | dict, **more) -> dict:
    """A JSON manifest from a one-row report; what it says is returned too."""
    body = {"schema": kind} | (report if isinstance(report, dict) else report.first().asDict()) | more
    spark.createDataFrame([(json.dumps(body, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return body


def read_manifest(spark: SparkSession, path: str, kind: str) -> dict:
    """The manifest, if it is of the kind asked for; another kind raises."""
    body = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    if body.get("schema") != kind:
        raise ValueError(f"{path} is a manifest of kind {body.get('schema')}")
    return body


def parse_key_values(text: str) -> dict[str, str]:
    """``key=value`` lines; a repeated key raises, blank lines and ``#`` comments don't count."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if not (line := line.strip()) or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq or key in out:
            raise ValueError(f"{'repeated' if eq else 'malformed'}: {line}")
        out[key] = value
    return out
