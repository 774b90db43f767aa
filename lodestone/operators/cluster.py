"""k-means: assignment, update, the loop, seeding, and the loop that skips distances by bounds.

Points are (id, p) with an array of DOUBLE; centroids are a list on the driver,
as there are few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import seeded
from lodestone.session import ensure_checkpoints

Centroids = list[tuple[float, ...]]
EPSILON = 1e-12


def euclidean(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    return F.sqrt(squared(a, b))


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def literal(centroids: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def distances(point: Column, centroids: Sequence[Sequence[float]]) -> Column:
    return F.transform(literal(centroids), lambda c: euclidean(point, c))


def nearest(dist: Column, epsilon: float = 0.0) -> Column:
    """Position of the least distance, from 0; ties to the lower. With epsilon a later one must be nearer by more than that."""
    if not epsilon:
        return (F.array_position(dist, F.array_min(dist)) - 1).cast("int")
    start = F.struct(F.lit(math.inf).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    fold = F.aggregate(dist, start, lambda s, d: F.struct(F.when(d < s["best"] - epsilon, d).otherwise(s["best"]).alias("best"), F.when(d < s["best"] - epsilon, s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")))
    return fold["at"]


def assign(points: DataFrame, centroids: Sequence[Sequence[float]], epsilon: float = 0.0) -> DataFrame:
    """(id, p, label): no shuffle."""
    return points.select("id", "p", distances(F.col("p"), centroids).alias("d")).select("id", "p", nearest(F.col("d"), epsilon).alias("label"))


def update(labelled: DataFrame, k: int, previous: Centroids | None = None) -> Centroids:
    """Mean of each cluster by axis; an empty cluster keeps its previous centroid."""
    sums = labelled.select("label", F.posexplode("p").alias("axis", "x")).groupBy("label", "axis").agg(F.avg("x").alias("m"))
    rows: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # clusters times axes
        rows.setdefault(r.label, {})[r.axis] = r.m
    out = []
    for j in range(k):
        if j in rows:
            out.append(tuple(rows[j][a] for a in sorted(rows[j])))
        elif previous is None:
            raise ValueError(f"cluster {j} is empty")
        else:
            out.append(tuple(previous[j]))
    return out


def sse(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(sse): sum of squared distances to the nearest centroid."""
    return points.select(F.array_min(F.transform(literal(centroids), lambda c: squared(F.col("p"), c))).alias("d")).agg(F.sum("d").alias("sse"))


def sizes(labelled: DataFrame) -> DataFrame:
    """(label, n, extent): extent is the largest range of an axis."""
    axes = labelled.select("label", F.posexplode("p").alias("axis", "x")).groupBy("label", "axis").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("e"))
    return axes.groupBy("label").agg(F.max("n").alias("n"), F.max("e").alias("extent"))


# ---------------------------------------------------------------- seeding


def random_start(points: DataFrame, k: int, seed: int = 246) -> Centroids:
    """k different rows: those with the least hash of seed and id."""
    return [tuple(r.p) for r in points.orderBy(seeded(seed, F.col("id")), "id").limit(k).collect()]


def spread_start(points: DataFrame, k: int, seed: int = 246) -> Centroids:
    """k-means++: each next centroid is drawn in proportion to the squared distance to the nearest one so far.

    The draw is exact and needs no global order: the row with the least
    -ln(u) / d^2 wins, with u from a hash of seed, round and id. If all distances
    are 0 a row not yet taken is drawn; with none left, ValueError.
    """
    chosen: list[tuple[int, tuple[float, ...]]] = []
    for i in range(k):
        u = (seeded(f"{seed}-{i}", F.col("id")) + 0.5) / F.lit(float(1 << 60))
        left = points.where(~F.col("id").isin([c[0] for c in chosen])) if chosen else points
        d = F.array_min(F.transform(literal([c[1] for c in chosen]), lambda c: squared(F.col("p"), c))) if chosen else F.lit(1.0)
        row = left.select("id", "p", u.alias("u"), d.alias("d")).orderBy(F.when(F.col("d") > 0, -F.log("u") / F.col("d")).asc_nulls_last(), "u").limit(1).collect()
        if not row:
            raise ValueError("fewer points than clusters")
        chosen.append((row[0].id, tuple(row[0].p)))
    return [c[1] for c in chosen]


# ---------------------------------------------------------------- loops


@dataclass(frozen=True)
class Clustering:
    """labelled: (id, p, label); iterations counts the last pass without change; distances: how many were computed."""

    centroids: Centroids
    labelled: DataFrame
    iterations: int
    distances: int


def kmeans(points: DataFrame, k: int, init: str | Centroids = "k-means++", seed: int = 246, max_iter: int = 100, epsilon: float = 0.0) -> Clustering:
    """Lloyd's loop; converges when no label changes."""
    if max_iter < 1:
        raise ValueError("max_iter is at least 1")
    if isinstance(init, str):
        starts = {"random": random_start, "k-means++": spread_start}
        if init not in starts:
            raise ValueError(f"unknown init {init}")
        centroids = starts[init](points, k, seed)
    else:
        centroids = [tuple(c) for c in init]
    points, old, n = points.select("id", "p").cache(), None, 0
    total = points.count()
    for n in range(1, max_iter + 1):
        now = assign(points, centroids, epsilon).cache()
        changed = total if old is None else old.select("id", F.col("label").alias("was")).join(now, "id").where("was <> label").count()
        centroids = update(now, k, centroids)
        if old is not None:
            old.unpersist()
        old = now
        if not changed:
            break
    return Clustering(centroids, old, n, n * k * total)


def bounded_kmeans(points: DataFrame, init: Centroids, max_iter: int = 50) -> Clustering:
    """The same labels as kmeans() from the same start, with far fewer distances.

    Each point carries an upper bound of the distance to its centroid and a lower
    bound of that to any other. Where the upper one is under the lower one, or
    under half the way from the centroid to the next, no distance is computed;
    else the upper bound is made exact, and if that doesn't do all are computed.
    """
    if max_iter < 1:
        raise ValueError("max_iter is at least 1")
    spark, k = points.sparkSession, len(init)
    ensure_checkpoints(spark)
    centroids = [tuple(c) for c in init]
    inf = F.lit(math.inf)
    state = points.select("id", "p", F.lit(-1).alias("label"), inf.alias("upper"), F.lit(0.0).alias("lower"))
    counted, n = 0, 0
    for n in range(1, max_iter + 1):
        half = F.array(*[F.lit(min((math.dist(a, b) for j, b in enumerate(centroids) if j != i), default=math.inf) / 2) for i, a in enumerate(centroids)])
        bound = F.greatest("lower", F.when(F.col("label") < 0, F.lit(-1.0)).otherwise(F.get(half, F.col("label"))))
        first = state.withColumn("bound", bound).withColumn("keep", F.col("upper") <= F.col("bound"))
        own = F.when(F.col("keep") | (F.col("label") < 0), F.col("upper")).otherwise(euclidean(F.col("p"), F.get(literal(centroids), F.col("label"))))
        tight = first.withColumn("near", own).withColumn("stay", F.col("keep") | (F.col("near") <= F.col("bound")))
        scan = tight.withColumn("d", F.when(~F.col("stay"), distances(F.col("p"), centroids)))
        best = nearest(F.col("d"))
        others = F.array_min(F.transform("d", lambda d, i: F.when(i == best, inf).otherwise(d)))
        cost = F.when(F.col("keep"), 0).otherwise(F.when(F.col("label") < 0, 0).otherwise(1) + F.when(F.col("stay"), 0).otherwise(k))
        new = scan.select("id", "p", F.col("label").alias("was"), F.when(F.col("stay"), F.col("label")).otherwise(best).alias("label"), F.when(F.col("stay"), F.col("near")).otherwise(F.array_min("d")).alias("upper"), F.when(F.col("stay"), F.col("lower")).otherwise(others).alias("lower"), cost.alias("cost")).checkpoint()
        cost_sum, changed = new.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.count(F.when(F.col("was") != F.col("label"), 1))).first()
        counted += cost_sum
        after = update(new, k, centroids)
        moved = [math.dist(a, b) for a, b in zip(centroids, after)]
        centroids = after
        state = new.select("id", "p", "label", (F.col("upper") + F.get(F.array(*[F.lit(m) for m in moved]), F.col("label"))).alias("upper"), F.greatest(F.lit(0.0), F.col("lower") - F.lit(max(moved, default=0.0))).alias("lower"))
        if not changed:
            break
    return Clustering(centroids, state.select("id", "p", "label"), n, int(counted))


# ---------------------------------------------------------------- concentration of distances


def concentration(points: DataFrame, dims: list[int], pairs: int = 20_000, seed: int = 246) -> DataFrame:
    """For each number of leading axes: statistics of the distances of drawn pairs of rows; ids count from 0 without gaps. Pairs of a row with itself are dropped."""
    spark = points.sparkSession
    n = points.count()
    draw = spark.range(pairs).select(F.pmod(seeded(f"{seed}-a", F.col("id")), F.lit(max(1, n))).alias("i"), F.pmod(seeded(f"{seed}-b", F.col("id")), F.lit(max(1, n))).alias("j")).where("i <> j")
    both = draw.join(points.select(F.col("id").alias("i"), F.col("p").alias("a")), "i").join(points.select(F.col("id").alias("j"), F.col("p").alias("b")), "j")
    each = both.select("a", "b", F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim")).select("dim", euclidean(F.slice("a", F.lit(1), F.col("dim")), F.slice("b", F.lit(1), F.col("dim"))).alias("d"))
    stats = each.groupBy("dim").agg(F.count("*").alias("pairs"), F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("stdev"))
    return stats.select("*", F.try_divide(F.col("most") - F.col("least"), F.col("least")).alias("contrast"), F.try_divide(F.col("stdev"), F.col("mean")).alias("relative_stdev"))
