"""Link analysis on an edge table (src, dst) and a node table (id); no matrix is ever built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ensure_checkpoints

EVERY = 5  # steps between checkpoints


@dataclass(frozen=True)
class Ranks:
    """ranks: (id, rank); iterations: steps that were taken; delta: sum of changes in the last; deltas: in each."""

    ranks: DataFrame
    iterations: int
    delta: float | None
    deltas: tuple[float, ...] = ()


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge that leaves them."""
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def prepared(nodes: DataFrame, edges: DataFrame, multigraph: bool) -> DataFrame:
    """(src, dst, share): share of a node's rank that an edge carries. Without multigraph, repeated edges count once."""
    if not multigraph:
        edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    return edges.join(out, "src").select("src", "dst", (1 / F.col("deg")).alias("share"))


def pagerank(nodes: DataFrame, edges: DataFrame, beta: float = 0.85, iterations: int = 100, tol: float | None = 1e-10, teleport: bool = True, multigraph: bool = False) -> Ranks:
    """PageRank with teleport; what dead ends hold is spread over all nodes.

    Starts at 1/n; stops when the sum of changes is under tol (None: never) and
    returns the new ranks. Without teleport rank neither jumps nor comes back from
    dead ends. The node table is the universe: nodes without in-links keep their
    base. Edges that leave or reach a node outside it raise an error. Each step
    joins the ranks to the edges, whose partitioning by src is kept, sums by dst
    and takes one small aggregate to the driver; every few steps are checkpointed.
    """
    spark = nodes.sparkSession
    ensure_checkpoints(spark)
    nodes = nodes.select("id").distinct().cache()
    n = nodes.count()
    links = prepared(nodes, edges, multigraph).repartition("src").cache()
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id")))
    if ends.join(nodes, "id", "left_anti").limit(1).count():
        raise KeyError("an edge has an end outside the node table")
    if n == 0:
        return Ranks(nodes.select("id", F.lit(0.0).alias("rank")), 0, None)
    sources = links.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
    state = nodes.join(sources, "id", "left").select("id", F.coalesce("out", F.lit(False)).alias("out"), F.lit(1.0 / n).alias("rank")).cache()
    leak = state.agg(F.sum(F.when(~F.col("out"), F.col("rank")))).first()[0] or 0.0
    delta, done, deltas = None, 0, []
    for done in range(1, iterations + 1):
        base = (beta * leak / n + (1 - beta) / n) if teleport else 0.0
        push = F.lit(beta if teleport else 1.0) * F.col("rank") * F.col("share")
        flow = links.join(state, links.src == state.id).groupBy(F.col("dst").alias("id")).agg(F.sum(push).alias("flow"))
        new = state.join(flow, "id", "left").select("id", "out", (F.coalesce("flow", F.lit(0.0)) + F.lit(base)).alias("rank"), F.col("rank").alias("old"))
        new = new.checkpoint() if done % EVERY == 0 else new.cache()
        delta, leak = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(~F.col("out"), F.col("rank"))), F.lit(0.0))).first()
        deltas.append(delta)
        state.unpersist()
        state = new.select("id", "out", "rank") if done % EVERY == 0 else new.drop("old")
        if tol is not None and teleport and delta < tol:
            break
    return Ranks(state.select("id", "rank"), done if iterations else 0, delta, tuple(deltas))


def convergence(nodes: DataFrame, edges: DataFrame, betas: tuple[float, ...] = (0.5, 0.7, 0.85, 0.95, 0.99), tols: tuple[float, ...] = (1e-10,), iterations: int = 500, k: int = 10) -> DataFrame:
    """(beta, tol, iterations, delta, top): steps until the sum of changes is under each tolerance; null where it never is.

    One run for each beta, to the smallest tolerance; top: its k first ids.
    """
    rows = []
    for beta in betas:
        got = pagerank(nodes, edges, beta, iterations, min(tols))
        top = [str(r.id) for r in top_ranks(got.ranks, k).collect()]
        for tol in tols:
            step = next((i for i, d in enumerate(got.deltas) if d < tol), None)
            rows.append((beta, tol, None if step is None else step + 1, None if step is None else got.deltas[step], top))
    return nodes.sparkSession.createDataFrame(rows, "beta double, tol double, iterations int, delta double, top array<string>")


def top_ranks(ranks: DataFrame, k: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "id").limit(k)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(total_a, total_b, l1, worst) of two rank tables."""
    both = a.select("id", F.col("rank").alias("a")).join(b.select("id", F.col("rank").alias("b")), "id", "full").na.fill(0.0)
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.sum("a").alias("total_a"), F.sum("b").alias("total_b"), F.sum(d).alias("l1"), F.max(d).alias("worst"))


def memory_floats(n: int) -> dict[str, int]:
    """Numbers held by a dense matrix and by two rank vectors."""
    return {"dense": n * n, "sparse": 2 * n}
