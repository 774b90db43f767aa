"""Set similarity: Jaccard, minhash signatures, banding, exact and banded self-joins.

Documents are (doc, items) with an array of BIGINT items; pairs are (i, j), i < j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import PRIME, affine_family, md5_60


def shingles(docs: DataFrame, width: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, items): the different `width`-word shingles of each text as 31-bit numbers; shorter texts have one shingle, blank ones none."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \n\t]+"), lambda x: x != "")

    def sets(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= width, F.array(F.array_join(w, " "))).otherwise(several)

    once = F.transform(F.array(words), sets)[0]  # a variable of transform() is computed once; a column would be for each shingle
    return docs.select(F.col(doc).alias("doc"), F.array_distinct(F.transform(once, lambda s: F.pmod(md5_60(s), F.lit(1 << 31)))).alias("items"))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def distinct_sets(sets: DataFrame) -> DataFrame:
    """(doc, items): one representative, the smallest doc, of each different set; empty sets are out. Copies make no pairs."""
    return sets.where(F.size("items") > 0).groupBy(F.sort_array("items").alias("items")).agg(F.min("doc").alias("doc")).select("doc", "items")


def membership(sets: DataFrame) -> DataFrame:
    """(doc, representative) for each set that isn't empty: what distinct_sets() has put together. Items are compared by their SHA-256."""
    keyed = sets.where(F.size("items") > 0).select("doc", F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("h"))
    return keyed.join(keyed.groupBy("h").agg(F.min("doc").alias("representative")), "h").select("doc", "representative")


def columns_from_matrix(cells: DataFrame) -> DataFrame:
    """(doc, items) of the cells (row, col, v) that aren't 0."""
    return cells.where("v <> 0").groupBy(F.col("col").alias("doc")).agg(F.sort_array(F.collect_set(F.col("row").cast("bigint"))).alias("items"))


def signatures(sets: DataFrame, n: int = 120, seed: int = 246, family: list[tuple[int, int]] | None = None, modulus: int = PRIME) -> DataFrame:
    """(doc, sig): for each affine hash the least value over the items; an empty set has nulls. No shuffle."""
    pairs = family or affine_family(n, seed)
    table = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in pairs])
    least = F.transform(table, lambda h: F.array_min(F.transform("items", lambda x: (h["a"] * x + h["b"]) % F.lit(modulus))))
    return sets.select("doc", least.alias("sig"))


def bands_of(n: int, bands: int) -> list[tuple[int, int]]:
    """(first, length) of each band, first from 1; rows that are left over go to the last band."""
    bands = min(bands, n)
    if bands <= 0:
        return []
    rows = n // bands
    return [(k * rows + 1, rows if k < bands - 1 else n - k * rows) for k in range(bands)]


def candidates(sigs: DataFrame, n: int, bands: int) -> DataFrame:
    """Pairs whose signatures agree in all rows of a band. Sets without items pair with each other, as their signatures are equal."""
    cut = bands_of(n, bands)
    if not cut:
        return sigs.sparkSession.createDataFrame([], "i bigint, j bigint")
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.array_join(F.slice("sig", at, size), ",", "-").alias("key")) for k, (at, size) in enumerate(cut)])
    keyed = sigs.select("doc", F.inline(keys))
    a, b = keyed.select("band", "key", F.col("doc").alias("i")), keyed.select("band", "key", F.col("doc").alias("j"))
    return a.join(b, ["band", "key"]).where("i < j").select("i", "j").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, similarity=jaccard) -> DataFrame:
    """(i, j, sim) of the pairs that reach the threshold."""
    a, b = sets.select(F.col("doc").alias("i"), F.col("items").alias("a")), sets.select(F.col("doc").alias("j"), F.col("items").alias("b"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", similarity(F.col("a"), F.col("b")).alias("sim")).where(F.col("sim") >= threshold)


def banded_pairs(sets: DataFrame, threshold: float, n: int = 120, bands: int = 40, seed: int = 246, similarity=jaccard) -> DataFrame:
    """Similar pairs by signatures, bands and an exact check: no false pairs, few missed."""
    return verified(candidates(signatures(sets, n, seed), n, bands), sets, threshold, similarity)


def exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs that reach a threshold above 0, by prefix filtering: no product of documents, no pair missed.

    Items are ordered from rare to frequent. Two sets with similarity t share an
    item among the first |a| - ceil(t |a|) + 1 of each, so only these meet.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    long = sets.select("doc", F.explode(F.array_distinct("items")).alias("item"))
    order = long.groupBy("item").agg(F.count("*").alias("n"))
    ranked = long.join(order, "item").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("o")).select("doc", F.size("o").alias("size"), F.col("o.item").alias("o"))
    prefix = ranked.select("doc", "size", F.explode(F.slice("o", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1)).alias("item"))
    a = prefix.select("item", F.col("doc").alias("i"), F.col("size").alias("m"))
    b = prefix.select("item", F.col("doc").alias("j"), F.col("size").alias("n"))
    pairs = a.join(b, "item").where((F.col("i") < F.col("j")) & (F.col("m") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("m") * threshold - 1e-9)).select("i", "j").distinct()
    return verified(pairs, sets, threshold)


def every_pair(sets: DataFrame, threshold: float, similarity=jaccard) -> DataFrame:
    """The reference for small inputs and thresholds of 0: each pair is compared."""
    a, b = sets.select(F.col("doc").alias("i"), F.col("items").alias("a")), sets.select(F.col("doc").alias("j"), F.col("items").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", similarity(F.col("a"), F.col("b")).alias("sim")).where(F.col("sim") >= threshold)


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_found, n_truth, n_both, recall, precision); recall is 1 without truth, precision 1 without finds."""
    both = found.select("i", "j").withColumn("f", F.lit(1)).join(truth.select("i", "j").withColumn("t", F.lit(1)), ["i", "j"], "full")
    sums = both.agg(F.count("f").alias("n_found"), F.count("t").alias("n_truth"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("n_both"))
    ratio = lambda n: F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col(n)), F.lit(1.0))
    return sums.select("*", ratio("n_truth").alias("recall"), ratio("n_found").alias("precision"))


def estimate(a: Column, b: Column) -> Column:
    """Share of positions in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def s_curve(similarity: Column, rows: int, bands: int) -> Column:
    """Chance that a pair becomes a candidate: 1 - (1 - s^rows)^bands."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))


def step(rows: int, bands: int) -> float:
    """The similarity at which the curve is steepest, about."""
    return (1 / bands) ** (1 / rows)
