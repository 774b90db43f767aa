"""The mergeable operators as streaming queries. Each takes a streaming DataFrame and gives one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.sketch import bloom_bits, registers
from lodestone.session import ensure_checkpoints


def word_count(stream: DataFrame, word: str) -> DataFrame:
    """Complete or update mode; state: a row for each word."""
    return stream.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def distinct_registers(stream: DataFrame, item: str, n_buckets: int = 64, seed: int = 246) -> DataFrame:
    """Complete mode; state: at most n_buckets rows."""
    return registers(stream, item, n_buckets, seed)


def filter_bits(stream: DataFrame, item: str, n_bits: int, k: int, seed: int = 246) -> DataFrame:
    """Append mode; state: at most n_bits rows."""
    return bloom_bits(stream, item, n_bits, k, seed)


def first_seen(stream: DataFrame, item: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each item once: the exact distinct stream. With a time column state is dropped after the watermark (an extension)."""
    if time is None:
        return stream.dropDuplicates([item])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([item])


def windowed_count(stream: DataFrame, item: str, time: str, length: str, late: str = "1 hour") -> DataFrame:
    """Counts by item and tumbling window, with a watermark (an extension: the originals have no event time)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(item).alias("item")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "item", "n")


class Reservoir:
    """For foreachBatch: keeps the k rows with the least draw of all batches, in a Parquet folder.

    The newest turn before the batch's own is read from the folder, so a query
    that starts again from its checkpoint goes on with the sample it had, and a
    batch that comes again changes nothing.
    """

    def __init__(self, path: str, k: int, key: str, draw: Callable):
        self.path, self.k, self.key, self.draw = path, k, key, draw

    def turns(self, spark: SparkSession) -> list[int]:
        """The batches whose sample is complete."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("draw", self.draw(F.col(self.key)))
        before = [t for t in self.turns(batch.sparkSession) if t < batch_id]
        if before:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{self.path}/{before[-1]}"))
        rows.dropDuplicates([self.key]).orderBy("draw", self.key).limit(self.k).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")

    def sample(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{self.turns(spark)[-1]}").drop("draw")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is there and gives the result table, which lies in the checkpoint folder."""
    spark, path = stream.sparkSession, f"{ensure_checkpoints(stream.sparkSession)}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:  # in complete mode each batch has the whole table
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={batch_id}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").select(*stream.columns)


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet file or folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")
