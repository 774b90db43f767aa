"""Synthetic inputs, made in parallel from hashed row numbers: the same for a seed whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashing import seeded


def uniform(seed: str, key: Column | str) -> Column:
    """In [0, 1)."""
    return seeded(seed, F.col(key) if isinstance(key, str) else key) / F.lit(float(1 << 60))


def below(n: int, seed: str, key: Column | str) -> Column:
    return F.pmod(seeded(seed, F.col(key) if isinstance(key, str) else key), F.lit(max(1, n)))


def normal(seed: str, key: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(f"{seed}r", key))) * F.cos(2 * F.pi() * uniform(f"{seed}t", key))


def words(spark: SparkSession, n: int = 200_000, vocabulary: int = 20_000, seed: int = 246) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("w"), below(vocabulary, f"{seed}w", "id").cast("string")).alias("word"))


def near_duplicate_sets(spark: SparkSession, n: int = 2120, items: int = 60, vocabulary: int = 5000, seed: int = 246) -> DataFrame:
    """(doc, items): of every 2,120 sets 120 are copies of others with 4 to 14 items exchanged."""
    base = n - n * 120 // 2120
    of = F.when(F.col("id") < base, F.col("id")).otherwise(below(base, f"{seed}c", "id"))
    swaps = F.when(F.col("id") < base, F.lit(0)).otherwise(4 + below(11, f"{seed}s", "id")).cast("int")
    drawn = lambda tag, who, lo, hi: F.transform(F.sequence(lo, hi), lambda i: below(vocabulary, f"{seed}{tag}", F.concat_ws("-", who.cast("string"), i.cast("string"))))
    rows = spark.range(n).select("id", of.alias("of"), swaps.alias("swaps"))
    kept = drawn("i", F.col("of"), F.col("swaps") + 1, F.lit(items))
    new = F.when(F.col("swaps") > 0, drawn("n", F.col("id"), F.lit(1), F.col("swaps"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(F.col("id").alias("doc"), F.array_distinct(F.concat(kept, new)).alias("items"))


def key_stream(spark: SparkSession, n: int, distinct_ratio: float = 0.4, seed: int = 246) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("key-"), below(max(1, int(n * distinct_ratio)), f"{seed}k", "id").cast("string")).alias("key"))


def filter_keys(spark: SparkSession, inserted: int = 8_000, absent: int = 200_000) -> DataFrame:
    one = lambda n, word, flag: spark.range(n).select(F.concat(F.lit(word), F.col("id").cast("string")).alias("key"), F.lit(flag).alias("inserted"))
    return one(inserted, "user:", True).unionByName(one(absent, "ghost:", False))


def web_graph(spark: SparkSession, n: int = 1200, dead: int = 12, seed: int = 246) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): Pareto out-degrees of 3 to 40, targets that favour small ids, `dead` nodes without links, and a trap of two."""
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    degree = F.least(F.lit(40), F.floor(F.pow(1 - uniform(f"{seed}d", "id"), F.lit(-1 / 1.6))) + 3).cast("int")
    live = spark.range(n).where((F.col("id") >= dead) & (F.col("id") < n - 2))
    links = live.select("id", F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    target = F.floor(F.pow(uniform(f"{seed}t", F.concat_ws("-", F.col("id").cast("string"), F.col("k").cast("string"))), F.lit(2.0)) * n)
    edges = links.select(name(F.col("id")).alias("src"), name(target).alias("dst")).where("src <> dst").distinct()
    trap = spark.createDataFrame([(f"n{n - 2}", f"n{n - 1}"), (f"n{n - 1}", f"n{n - 2}")], "src string, dst string")
    return spark.range(n).select(name(F.col("id")).alias("id")), edges.unionByName(trap)


def hot_edges(spark: SparkSession, nodes: int = 50_000, avg_out: int = 8, hot: int = 200, seed: int = 246) -> DataFrame:
    """(src, dst): a multigraph; each node has at least one edge, 30 % of the edges go to the first `hot` nodes."""
    rows = spark.range(nodes).select("id", F.explode(F.sequence(F.lit(1), (1 + below(2 * avg_out - 2, f"{seed}o", "id")).cast("int"))).alias("k"))
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("k").cast("string"))
    return rows.select(F.col("id").alias("src"), F.when(uniform(f"{seed}h", key) < 0.3, below(min(hot, nodes), f"{seed}a", key)).otherwise(below(nodes, f"{seed}b", key)).alias("dst"))


def zipf_baskets(spark: SparkSession, n: int = 20_000, items: int = 2_000, planted: int = 25, seed: int = 246) -> DataFrame:
    """(basket_id, items): about 20 draws with weight (i + 1)^-0.8, then a set; 8 % hold a planted pair."""
    size = F.greatest(F.lit(2), F.round(20 + 4 * normal(f"{seed}z", F.col("id")))).cast("int")
    key = lambda i: F.concat_ws("-", F.col("id").cast("string"), i.cast("string"))
    draw = F.transform(F.sequence(F.lit(1), size), lambda i: F.floor(F.pow(uniform(f"{seed}i", key(i)), F.lit(5.0)) * items))
    pair = below(planted, f"{seed}p", "id")
    extra = F.when(uniform(f"{seed}e", "id") < 0.08, F.array(below(items, f"{seed}x", pair), below(items, f"{seed}y", pair))).otherwise(F.array().cast("array<bigint>"))
    return spark.range(n).select(F.col("id").alias("basket_id"), F.array_distinct(F.concat(draw, extra)).alias("items"))


def blobs(spark: SparkSession, n: int = 20_000, dims: int = 20, centres: int = 12, sigma: float = 1.2, seed: int = 246) -> DataFrame:
    """(id, p): Gaussian clouds around centres in [-20, 20)^dims."""
    axis = F.sequence(F.lit(1), F.lit(dims))
    c = below(centres, f"{seed}c", "id")
    p = F.transform(axis, lambda a: 40 * uniform(f"{seed}m", F.concat_ws("-", c.cast("string"), a.cast("string"))) - 20 + sigma * normal(f"{seed}n", F.concat_ws("-", F.col("id").cast("string"), a.cast("string"))))
    return spark.range(n).select("id", p.alias("p"))


def cube(spark: SparkSession, n: int = 1000, dims: int = 1000, seed: int = 246) -> DataFrame:
    """(id, p): uniform in the unit cube."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda a: uniform(f"{seed}u", F.concat_ws("-", F.col("id").cast("string"), a.cast("string")))).alias("p"))
