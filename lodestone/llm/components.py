"""Connected components of a graph given as edges, without a driver-side or single-task step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, stored, trim

BLOCK = 1 << 20  # bytes of values that are compared with each other at once


def smallest_label(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of an edge (a, b) reaches.

    Alternates large-star and small-star steps, each two narrow shuffles, until
    every edge joins a node to its component's smallest; that takes about the
    logarithm of the longest path. A hub is never gathered: its smallest
    neighbour comes from a partial aggregate, and the join that follows can be
    split by Spark where it is skewed. Each step is stored.
    """
    spark = edges.sparkSession
    link = stored(edges.select("a", "b").where("a <> b"))
    seen = None
    for turn in range(rounds):
        if turn % 4 == 3:
            release(spark)
        link = stored(step(step(link, True), False))
        state = link.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    stars = link.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def covering(member: DataFrame, values: DataFrame, measure: Callable[[DataFrame], DataFrame], between: Callable, limit: float, keys: list[str]) -> DataFrame:
    """Edges (a, b), a > b, with the components that all pairs of nodes with a common key and a distance of at most `limit` have.

    member: keys and node, each once. values: node, value and size (bytes).
    measure(pairs) gives (a, b, d) for the rows of (a, b); it may leave out pairs
    that are beyond the limit. between(xs, ys) gives the distances of two Arrow
    arrays of values, as a matrix.

    Each group is compared with one leader, drawn by key, so that a node of
    several groups meets several leaders; this makes less pairs than there are
    members. Where a group has stayed apart, its nodes outside the main part are
    compared with all of it in blocks of about BLOCK bytes: no pairs are made,
    and a node sends one link for each part that it reaches. So no link is missed.
    That last pass grows with (nodes near no leader) x (size of their groups).
    """
    size = member.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", *keys)).alias("lead")).where("n > 1").drop("n")
    member = stored(member.join(size, keys))
    stars = member.where("node <> lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()
    label = stored(smallest_label(measure(stars).where(F.col("d") <= limit)))
    part = member.join(label, "node", "left").select(*keys, "node", F.coalesce("label", "node").alias("label"))
    main = part.groupBy(*keys, "label").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart = stored(part.join(main, keys).join(values.select("node", "size"), "node"))
    total = apart.groupBy(*keys).agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    apart = apart.join(total, keys).withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))).join(values.select("node", "value"), "node")
    packed = lambda df, name: df.groupBy(*keys, "block").agg(F.collect_list(F.struct("node", "label", "value")).alias(name)).drop("block")
    both = packed(apart.where("label <> main"), "xs").join(packed(apart, "ys"), keys).select("xs", "ys")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (xn, xl, xv), (yn, yl, yv) = ([c.field(f) for f in range(3)] for c in (batch.column(k)[i].values for k in (0, 1)))
                xn, xl, yn, yl = (c.to_numpy() for c in (xn, xl, yn, yl))
                r, c = np.nonzero((between(xv, yv) <= limit) & (xl[:, None] != yl[None, :]))
                _, first = np.unique(np.stack([xn[r], yl[c]]), axis=1, return_index=True)
                r, c = r[first], c[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(xn[r], yn[c])), pa.array(np.minimum(xn[r], yn[c]))], schema=schema)
        trim()

    found = both.mapInArrow(compare, "a bigint, b bigint").distinct()
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a > b").unionByName(found)


def step(link: DataFrame, large: bool) -> DataFrame:
    """Edges come and go as (larger, smaller). Large star: larger neighbours of a node move to its smallest; small star: the smaller ones and itself."""
    if large:
        both = link.select("a", "b").unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = link.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.explode(F.array(F.struct("b", F.col("m")), F.struct(F.col("a").alias("b"), F.col("m")))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return moved.where("a <> b").distinct()
