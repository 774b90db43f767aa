"""Shared pieces of the text operators: session helpers, Arrow access, 64-bit hashing in numpy.

All numpy hashing here is a pure function of content, so a task that is run
again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
C1, C2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
ARROW_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounded Arrow batches, and a checkpoint folder: the cluster's; a new one only on one machine (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder, which goes when the application ends."""
    prepare(spark)
    sc, jvm = spark.sparkContext, spark._jvm
    root = f"{sc._jsc.sc().getCheckpointDir().get()}/scratch"
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path.getParent())  # it is named for this application alone
    return f"{root}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files, broadcasts and driver memory of plans that are done: Spark frees them as their objects are collected."""
    gc.collect()
    spark._jvm.System.gc()
    trim()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: cuts lineage, and is compressed, unlike checkpoint()."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, codec: str = "snappy", n: int | None = None) -> DataFrame:
    """df as Parquet in the shared folder, bucketed: later joins on key move the other side alone."""
    spark, name, path = df.sparkSession, f"b_{uuid.uuid4().hex}", scratch(df.sparkSession)
    df.write.bucketBy(n or n_shuffle(spark), key).option("path", path).option("compression", codec).option("parquet.compression.codec.zstd.level", "9").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives freed memory of a Python worker back to the system: workers are reused, by other operators too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---------------------------------------------------------------- Arrow


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty; offsets start at 0."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named text column of each has about `size` bytes; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


# ---------------------------------------------------------------- hashing


def mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name for each pair of 64-bit names."""
    with np.errstate(over="ignore"):
        x = a * C1
        x += b
        x ^= U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U64(31)
        x *= C2
        x ^= x >> U64(29)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(0x632BE59BD9B4E019)) * C1
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


BYTE_NAMES = splitmix(256, 1)
POSITION = splitmix(4096, 2) | U64(1)


def segments(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the sorted, disjoint, non-empty segments."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    total = int(length.sum())
    with np.errstate(over="ignore"):
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(total) - np.repeat(first, length)
        value = BYTE_NAMES[data[within + np.repeat(start, length)]]
        long = within >= len(POSITION)
        weight = POSITION[within & (len(POSITION) - 1)]
        if long.any():
            weight[long] = mix(within[long].astype(U64), weight[long]) | U64(1)
        value *= weight
        value ^= value >> U64(32)
        out = np.add.reduceat(value, first)
    return mix(out, length.astype(U64), 7)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: start and end in data, and how many words each text has."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside.view(np.int8))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    joint = cut & inside[:-1] & inside[1:]  # a word that ends where the next text's first begins
    start = np.flatnonzero((edge == 1) | joint)
    end = np.flatnonzero((edge == -1) | joint)
    return start, end, np.diff(np.searchsorted(start, off))


def runs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


# ---------------------------------------------------------------- keys that land one to a partition


def murmur_int(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of INT values."""
    rot = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        k = rot(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(np.uint32(seed) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def slots(n: int) -> np.ndarray:
    """INT keys, the i-th of which repartition(n, key) puts into partition i."""
    found, at = np.full(n, -1, np.int32), 0
    while (found < 0).any():
        ids = np.arange(at, at + 16 * n, dtype=np.int32)
        to = np.mod(murmur_int(ids).astype(np.int64), n)
        new = np.full(n, -1, np.int32)
        new[to[::-1]] = ids[::-1]
        found = np.where(found < 0, new, found)
        at += 16 * n
    return found


def in_rows(batches: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(batches, schema=schema)


def only(df: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """The named columns with their types; others, whatever they are called, don't matter."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols])
