"""Frequent items, pairs and rules over baskets in long form (basket, item); a basket is a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1_000_003  # fixed values: the pair hash (x * MULTIPLIER + y) mod BUCKETS
MULTIPLIER = 1_299_709


def long_form(baskets: DataFrame, basket: str = "basket_id", items: str = "items") -> DataFrame:
    return baskets.select(F.col(basket).alias("basket"), F.explode(F.array_distinct(items)).alias("item"))


def frequent_items(baskets: DataFrame, support: int) -> DataFrame:
    """(item, n) with n >= support."""
    return baskets.distinct().groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def pairs_of(baskets: DataFrame) -> DataFrame:
    """(basket, a, b), a < b: made within each basket's sorted set, so that one shuffle does."""
    sets = baskets.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("s")).where(F.size("s") > 1)
    first = sets.select("basket", "s", F.posexplode("s").alias("at", "a"))
    return first.select("basket", "a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))


def counted(pairs: DataFrame, support: int = 0) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def surviving(baskets: DataFrame, support: int) -> DataFrame:
    """Baskets without the items that aren't frequent: these can't be in a frequent pair."""
    return baskets.join(frequent_items(baskets, support).select("item"), "item", "left_semi").select("basket", "item")


def frequent_pairs(baskets: DataFrame, support: int) -> DataFrame:
    """(a, b, n): pairs by A-Priori, which forms pairs of frequent items only."""
    return counted(pairs_of(surviving(baskets, support)), support)


def pair_counters(baskets: DataFrame, support: int) -> DataFrame:
    """(support, frequent_pairs, peak_counters): peak_counters is how many different pairs are counted."""
    c = counted(pairs_of(surviving(baskets, support)))
    return c.agg(F.lit(support).cast("bigint").alias("support"), F.count(F.when(F.col("n") >= support, 1)).alias("frequent_pairs"), F.count("*").alias("peak_counters"))


def support_sweep(baskets: DataFrame, supports: list[int]) -> DataFrame:
    """pair_counters for many supports from one pair table: a pair is counted at a support if both its items reach it."""
    one = frequent_items(baskets, 1)
    c = counted(pairs_of(baskets)).join(one.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    each = F.explode(F.array(*[F.lit(s).cast("bigint") for s in supports])).alias("support")
    return c.select("n", F.least("na", "nb").alias("least"), each).groupBy("support").agg(F.count(F.when(F.col("n") >= F.col("support"), 1)).alias("frequent_pairs"), F.count(F.when(F.col("least") >= F.col("support"), 1)).alias("peak_counters"))


def association_rules(baskets: DataFrame, support: int, min_confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence, lift) of both directions, by confidence."""
    pairs, items = frequent_pairs(baskets, support), frequent_items(baskets, support)
    both = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n").unionByName(pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "n"))
    total = baskets.agg(F.count_distinct("basket").alias("total"))
    joined = both.join(items.select(F.col("item").alias("antecedent"), F.col("n").alias("na")), "antecedent").join(items.select(F.col("item").alias("consequent"), F.col("n").alias("nb")), "consequent").join(F.broadcast(total))
    conf = F.col("n") / F.col("na")
    return joined.select("antecedent", "consequent", conf.alias("confidence"), (conf / (F.col("nb") / F.col("total"))).alias("lift")).where(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "antecedent", "consequent")


# ---------------------------------------------------------------- hash buckets


def bucket(a: str = "a", b: str = "b", buckets: int = BUCKETS):
    return F.pmod(F.col(a).cast("bigint") * MULTIPLIER + F.col(b).cast("bigint"), F.lit(buckets))


def frequent_buckets(baskets: DataFrame, support: int, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): buckets that pairs of all items fill often enough; at most `buckets` rows. Items are numbers."""
    return pairs_of(baskets).groupBy(bucket(buckets=buckets).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= support)


def bucket_candidates(baskets: DataFrame, support: int, buckets: int = BUCKETS) -> DataFrame:
    """(basket, a, b) of frequent items in frequent buckets: what the second pass has to count."""
    pairs = pairs_of(surviving(baskets, support)).withColumn("bucket", bucket(buckets=buckets))
    return pairs.join(frequent_buckets(baskets, support, buckets).select("bucket"), "bucket", "left_semi").select("basket", "a", "b")


def bucket_pairs(baskets: DataFrame, support: int, buckets: int = BUCKETS) -> DataFrame:
    """The same pairs as frequent_pairs, with fewer counters."""
    return counted(bucket_candidates(baskets, support, buckets), support)


# ---------------------------------------------------------------- chunks


def chunk_candidates(baskets: DataFrame, support: int) -> DataFrame:
    """(a, b) frequent in some chunk at the support scaled to it; baskets has a column chunk.

    A pair that is frequent on the whole is frequent in at least one chunk. The
    comparison n * total >= support * size is in whole numbers.
    """
    sizes = baskets.groupBy("chunk").agg(F.count_distinct("basket").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    chunk_of = baskets.select("basket", "chunk").distinct()
    local = pairs_of(baskets.select("basket", "item")).join(chunk_of, "basket").groupBy("chunk", "a", "b").agg(F.count("*").alias("n"))
    return local.join(sizes, "chunk").join(F.broadcast(total)).where(F.col("n") * F.col("total") >= F.lit(support) * F.col("size")).select("a", "b").distinct()


def chunk_pairs(baskets: DataFrame, support: int) -> DataFrame:
    """Candidates of the chunks counted over all baskets: no pair is missed, none is false."""
    return counted(pairs_of(baskets.select("basket", "item")).join(chunk_candidates(baskets, support), ["a", "b"], "left_semi"), support)


def set_difference(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(missing, extra) between two pair tables."""
    f, t = found.select("a", "b"), truth.select("a", "b")
    return t.exceptAll(f).agg(F.count("*").alias("missing")).join(F.broadcast(f.exceptAll(t).agg(F.count("*").alias("extra"))))
