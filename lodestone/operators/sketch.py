"""Sketches with bounded state: Bloom filters, distinct counts by bit patterns, reservoir samples.

State is a small table that merges by distinct or max, so the same plans run in
batch and in streams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import seeded, trailing_zeros

RULES = ("mean", "median", "mean-then-median", "median-then-mean")
PHI = 0.77351  # fixed value: the correction of Flajolet and Martin


# ---------------------------------------------------------------- Bloom filter


def optimal_k(n_bits: int, n_items: int) -> int:
    return max(1, round(n_bits / n_items * math.log(2)))


def expected_fp_rate(n_items, n_bits: int, k: int) -> Column:
    """(1 - e^(-k n / m))^k."""
    n = n_items if isinstance(n_items, Column) else F.lit(float(n_items))
    return F.pow(1 - F.exp(-n * k / n_bits), F.lit(float(k)))


def bit_positions(item: Column, n_bits: int, k: int, seed: int) -> Column:
    return F.array(*[F.pmod(seeded(f"{seed}-{i}", item), F.lit(n_bits)) for i in range(k)])


def bloom_bits(items: DataFrame, item: str, n_bits: int, k: int, seed: int = 246) -> DataFrame:
    """(bit): the bits that are set, at most n_bits rows."""
    return items.select(F.explode(bit_positions(F.col(item), n_bits, k, seed)).alias("bit")).distinct()


def bloom_contains(probe: DataFrame, item: str, bits: DataFrame, n_bits: int, k: int, seed: int = 246) -> DataFrame:
    """probe's different items with `hit`: whether all their bits are set. No false negatives."""
    asked = probe.select(F.col(item).cast("string").alias("item")).distinct().select("item", F.explode(F.array_distinct(bit_positions(F.col("item"), n_bits, k, seed))).alias("bit"))
    marked = asked.join(bits.select("bit", F.lit(1).alias("on")), "bit", "left")
    return marked.groupBy("item").agg(F.every(F.col("on").isNotNull()).alias("hit"))


def bloom_quality(inserted: DataFrame, absent: DataFrame, item: str, n_bits: int, k: int, seed: int = 246) -> DataFrame:
    """(n_in, n_absent, false_negatives, false_positives, fp_rate, expected, fill, memory_bits)."""
    bits = bloom_bits(inserted, item, n_bits, k, seed)
    ask = lambda df, name: bloom_contains(df, item, bits, n_bits, k, seed).agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.sum(F.col("hit").cast("bigint")), F.lit(0)).alias(f"{name}_hits"))
    sums = ask(inserted, "in").join(F.broadcast(ask(absent, "absent"))).join(F.broadcast(bits.agg(F.count("*").alias("set"))))
    return sums.select(
        "n_in",
        "n_absent",
        (F.col("n_in") - F.col("in_hits")).alias("false_negatives"),
        F.col("absent_hits").alias("false_positives"),
        F.try_divide(F.col("absent_hits").cast("double"), F.col("n_absent")).alias("fp_rate"),
        expected_fp_rate(F.col("n_in").cast("double"), n_bits, k).alias("expected"),
        (F.col("set") / n_bits).alias("fill"),
        F.lit((n_bits + 7) // 8 * 8).cast("bigint").alias("memory_bits"),
    )


# ---------------------------------------------------------------- distinct counts


def power_of_two(n: int) -> int:
    return 1 << (max(1, n).bit_length() - 1)


def registers(items: DataFrame, item: str, n_buckets: int = 64, seed: int = 246) -> DataFrame:
    """(bucket, r): the largest number of trailing zeros among the hashes of a bucket; untouched buckets are absent."""
    n = power_of_two(n_buckets)
    p = n.bit_length() - 1
    h = seeded(seed, F.col(item))
    hashed = items.select(h.bitwiseAND(F.lit(n - 1)).cast("int").alias("bucket"), F.shiftrightunsigned(h, p).alias("lane"))
    return hashed.groupBy("bucket").agg(F.max(trailing_zeros(F.col("lane"), 60 - p)).alias("r"))


def combine(regs: DataFrame, n_buckets: int, rule: str, groups: int = 4) -> DataFrame:
    """(estimate): PHI * buckets * the rule over 2^r (0 for untouched buckets); groups are contiguous."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    n = power_of_two(n_buckets)
    size = max(1, n // groups)
    every = regs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    val = every.join(F.broadcast(regs), "bucket", "left").select("bucket", F.coalesce(F.pow(F.lit(2.0), F.col("r")), F.lit(0.0)).alias("v"))
    inner, outer = (rule.split("-then-") * 2)[:2] if "then" in rule else (None, rule)
    of = {"mean": F.avg, "median": F.median}
    if inner:
        val = val.groupBy(F.floor(F.col("bucket") / size).alias("g")).agg(of[inner]("v").alias("v"))
    return val.agg(of[outer]("v").alias("v")).select((F.lit(PHI) * n * F.col("v")).alias("estimate"))


def distinct_estimate(items: DataFrame, item: str, n_buckets: int = 64, seed: int = 246, rule: str = "median-then-mean") -> DataFrame:
    """(estimate): within twice the truth; 0 for no items."""
    return combine(registers(items, item, n_buckets, seed), n_buckets, rule)


def by_size(items: DataFrame, item: str, draw: Column, sizes: tuple[int, ...], n_buckets: int = 64, seed: int = 246, rule: str = "median-then-mean") -> DataFrame:
    """(size, n, exact, estimate, ratio): exact and estimated distinct counts of growing parts of items.

    A row is in all parts of a size above its draw (0 or more). Registers are made
    once by draw and merged by the largest, as are first draws of the exact count.
    """
    spark, drawn = items.sparkSession, items.withColumn("draw", draw)
    rows = drawn.groupBy("draw").agg(F.count("*").alias("n"))
    first = drawn.groupBy(F.col(item)).agg(F.min("draw").alias("draw")).groupBy("draw").agg(F.count("*").alias("exact"))
    level = F.broadcast(spark.createDataFrame([(s,) for s in sizes], "size int"))
    upto = lambda df, col: df.join(level, F.col("draw") < F.col("size")).groupBy("size").agg(F.sum(col).alias(col))
    n, p = power_of_two(n_buckets), power_of_two(n_buckets).bit_length() - 1
    h = seeded(seed, F.col(item))
    hashed = drawn.select("draw", h.bitwiseAND(F.lit(n - 1)).cast("int").alias("bucket"), F.shiftrightunsigned(h, p).alias("lane"))
    regs = hashed.groupBy("draw", "bucket").agg(F.max(trailing_zeros(F.col("lane"), 60 - p)).alias("r")).cache()
    out = None
    for s in sizes:
        part = regs.where(F.col("draw") < s).groupBy("bucket").agg(F.max("r").alias("r"))
        one = combine(part, n_buckets, rule).select(F.lit(s).alias("size"), "estimate")
        out = one if out is None else out.unionByName(one)
    return upto(rows, "n").join(upto(first, "exact"), "size").join(out, "size").select("size", "n", "exact", "estimate", F.try_divide(F.col("estimate"), F.col("exact")).alias("ratio"))


# ---------------------------------------------------------------- samples


def reservoir(items: DataFrame, k: int, key: str, seed: int = 246) -> DataFrame:
    """A uniform sample of k rows, the same for a seed whatever the partitions: those with the smallest hash of seed and key. Fewer rows: all."""
    return items.withColumn("draw", seeded(seed, F.col(key))).orderBy("draw", key).limit(k).drop("draw")


def uniformity(counts: DataFrame, n: str = "n") -> DataFrame:
    """(spread): (max - min) / mean of how often each item was drawn."""
    return counts.agg(F.try_divide(F.max(n) - F.min(n), F.avg(n)).alias("spread"))
