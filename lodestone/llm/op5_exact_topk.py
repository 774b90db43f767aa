"""Exact top-k by inner product on a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.repeats import rows_of
from lodestone.llm.common import in_rows, prepare, read_table, stored

PIVOTS = 16
ANNULI = 4  # per pivot
SAMPLE = 4096  # rows that pivots and annuli are fitted on
BLOCK = 1024  # vectors in a block of the index
ASKED = 256  # queries in a block of queries
SLACK = 1e-6  # relative: far above the rounding of distances in doubles


# ---------------------------------------------------------------- vectors


def whole_numbers(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) for each component; vectors that are null, or hold null or non-finite components, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return table.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    most = int(np.abs(v).max(initial=0))
    kind = "b" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return kind.encode() + v.astype({"b": "<i2", "i": "<i4", "q": "<i8"}[kind]).tobytes()


def unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {b"b": "<i2", b"i": "<i4", b"q": "<i8"}[raw[:1]], offset=1).astype(np.int64).reshape(-1, dim)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by doubles where these are exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 1 << 52:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return x @ q.T


# ---------------------------------------------------------------- index


class Index:
    """Pivots and annuli in the space where every vector gets one more component that makes all norms equal.

    There the nearest vectors of a query (extra component 0) are those with the
    largest inner product: |q - x|^2 = |q|^2 + top - 2 q.x, with `top` the
    largest squared norm. A vector is keyed by its nearest pivot and the distance
    to it; cell = pivot * ANNULI + annulus.
    """

    def __init__(self, sample: np.ndarray, top: float, pivots: int = PIVOTS, annuli: int = ANNULI):
        self.top, self.annuli = top, annuli
        x = self.lift(sample)
        chosen = [int(np.argmax(x[:, -1]))] if len(x) else []
        d = self.far(x, x[chosen[0]]) if chosen else None
        while chosen and len(chosen) < min(pivots, len(x)) and d.max() > 0:  # farthest first
            chosen.append(int(np.argmax(d)))
            d = np.minimum(d, self.far(x, x[chosen[-1]]))
        self.pivots = x[chosen]
        near, dist = self.key(sample)
        self.edges = np.array([np.quantile(dist[near == p], np.arange(1, annuli) / annuli) if (near == p).any() else np.arange(1.0, annuli) for p in range(len(chosen))]).reshape(len(chosen), annuli - 1)

    @staticmethod
    def far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - p) ** 2).sum(axis=1))

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        f = v.astype(np.float64)
        extra = np.zeros(len(f)) if query else np.sqrt(np.maximum(0.0, self.top - (f * f).sum(axis=1)))
        return np.concatenate([f, extra[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        sq = (x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(sq, 0.0))

    def key(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lift(v))
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, dist = self.key(v)
        return near * self.annuli + (dist[:, None] > self.edges[near]).sum(axis=1), dist

    def bounds(self, q: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest inner product that a vector of each cell can have with each query, by the triangle inequality."""
        f = self.lift(q, query=True)
        d = self.distances(f)[:, cell // self.annuli]
        gap = np.maximum(0.0, np.maximum(d - high, low - d))
        most = (f * f).sum(axis=1)[:, None] + self.top
        return (most - gap * gap) / 2 + SLACK * (most + 1)


INDEX = pa.schema([("cell", pa.int32()), ("sub", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
INDEX_DDL = "cell int, sub bigint, ids binary, v binary, n bigint, low double, high double"


def build(vectors: DataFrame, index: Index, dim: int) -> DataFrame:
    """The index: blocks of at most BLOCK vectors of one cell, however many the cell has."""

    def make(batches):
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId() << 32, 0, {}

        def out(cell, parts):
            nonlocal n
            ids, v, d = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(d, kind="stable")
            for at in range(0, len(ids), BLOCK):
                m = order[at : at + BLOCK]
                yield in_rows([{"cell": cell, "sub": task + n, "ids": ids[m].tobytes(), "v": packed(v[m]), "n": len(m), "low": float(d[m[0]]), "high": float(d[m[-1]])}], INDEX)
                n += 1

        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(b.column(1), dim)
            cell, d = index.cells(v)
            for c in np.unique(cell).tolist():
                m = cell == c
                held.setdefault(c, []).append((ids[m], v[m], d[m]))
                if sum(len(x[0]) for x in held[c]) >= 4 * BLOCK:
                    yield from out(c, held.pop(c))
        for c, parts in held.items():
            yield from out(c, parts)

    return vectors.mapInArrow(make, INDEX_DDL)


def in_blocks(queries: DataFrame, index: Index, dim: int) -> DataFrame:
    """Queries in blocks of ASKED, neighbours in the index side by side."""

    def make(batches):
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out():
            nonlocal n
            ids, v, cell = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(cell, kind="stable")
            for at in range(0, len(ids), ASKED):
                m = order[at : at + ASKED]
                yield in_rows([{"sub": task + n, "ids": ids[m].tobytes(), "v": packed(v[m])}], BLOCKED)
                n += 1

        for b in batches:
            v = matrix(b.column(1), dim)
            held.append((b.column(0).to_numpy(), v, index.cells(v)[0]))
            size += len(v)
            if size >= 128 * ASKED:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return queries.mapInArrow(make, "sub bigint, ids binary, v binary")


BLOCKED = pa.schema([("sub", pa.int64()), ("ids", pa.binary()), ("v", pa.binary())])
ASK = pa.schema([("cell", pa.int32()), ("asked", pa.int64()), ("qids", pa.binary()), ("q", pa.binary()), ("bound", pa.binary())])
ASK_DDL = "cell int, asked bigint, qids binary, q binary, bound binary"


def merged(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id bigint, vec_id bigint, score bigint"


def compare(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries against blocks of the index; a query whose k-th score so far beats the bound is left out."""
    held: dict[int, tuple] = {}
    for r in rows_of(batches):
        qids, q = np.frombuffer(r["qids"], np.int64), unpacked(r["q"], dim)
        old = held.get(r["asked"])
        if old and len(old[0]):  # what can't reach a query's k-th score so far is over for it
            at = np.searchsorted(old[0], qids, "right") - 1
            full = (at >= k - 1) & (old[0][np.maximum(at - k + 1, 0)] == qids) & (old[0][np.maximum(at, 0)] == qids)
            go = ~full | (np.frombuffer(r["bound"], np.float64) >= old[2][np.maximum(at, 0)])
            if not go.any():
                continue
            qids, q = qids[go], q[go]
        ids, v = np.frombuffer(r["ids"], np.int64), unpacked(r["v"], dim)
        s = scores(v, q)
        s_ok = qids[None, :] != ids[:, None]
        kth = min(k, len(ids))
        at = np.argpartition(np.where(s_ok, -s, np.iinfo(np.int64).max), kth - 1, axis=0)[:kth] if len(ids) > k else None
        if at is None:
            row, col = np.nonzero(s_ok)
        else:  # all that reach the k-th score, so that ties are settled by id
            floor = np.take_along_axis(np.where(s_ok, s, np.iinfo(np.int64).min), at, axis=0).min(axis=0)
            row, col = np.nonzero(s_ok & (s >= floor[None, :]))
        qi, vi, sc = merged(qids[col], ids[row], s[row, col], k)
        if old:
            qi, vi, sc = merged(np.concatenate([old[0], qi]), np.concatenate([old[1], vi]), np.concatenate([old[2], sc]), k)
        held[r["asked"]] = (qi, vi, sc)
        if len(held) > 64:
            a = next(iter(held))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop(a)], schema=FOUND)
    for got in held.values():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], schema=FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    vectors and queries have vec_id and v (array of whole numbers, one length).
    Rows with the query's own id are not its candidates; of repeated ids each row
    counts. Ties go to the smaller id. Fewer than k candidates give fewer rows.

    The index is fitted on a bounded sample and holds every row. A query first
    sees the annulus that it falls into; its k-th score there is a floor. Then
    the annuli whose bound reaches the floor are taken; the others aren't read. Neither side is collected: blocks of queries meet
    blocks of the index, and the driver sees a few numbers a cell.
    """
    spark = prepare(vectors.sparkSession)
    top = vectors.select(F.size("v").alias("d"), F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e).alias("sq")).agg(F.max("sq"), F.max("d"), F.min("d")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if top[0] is None:
        return empty
    if top[1] != top[2]:
        raise ValueError("vectors differ in length")
    dim = top[1]
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    index = Index(np.array([r.v for r in rows], np.int64).reshape(-1, dim), float(top[0]))
    stock = stored(build(vectors.select("vec_id", "v"), index, dim))
    cells = stock.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell").collect()  # at most PIVOTS * ANNULI rows
    cell, low, high = (np.array([r[i] for r in cells], t) for i, t in ((0, np.int64), (1, np.float64), (2, np.float64)))
    ask = stored(in_blocks(queries.select("vec_id", "v"), index, dim))

    def send(r: dict, cols: list, bound: np.ndarray, of: np.ndarray) -> list[dict]:
        q, ids = unpacked(r["v"], dim), np.frombuffer(r["ids"], np.int64)
        out = []
        for c in cols:
            m = np.flatnonzero(of[:, c])
            if len(m):
                out.append({"cell": int(cell[c]), "asked": r["sub"], "qids": ids[m].tobytes(), "q": packed(q[m]), "bound": bound[m, c].tobytes()})
        return out

    def home(batches):
        for r in rows_of(batches):
            bound = index.bounds(unpacked(r["v"], dim), cell, low, high)
            of = np.zeros(bound.shape, bool)
            of[np.arange(len(of)), bound.argmax(axis=1)] = True
            yield in_rows(send(r, range(len(cell)), bound, of), ASK)

    def rest(batches):
        for r in rows_of(batches):
            ids, floor = np.frombuffer(r["ids"], np.int64), {x["query_id"]: x["floor"] for x in r["floors"] or []}
            bound = index.bounds(unpacked(r["v"], dim), cell, low, high)
            need = np.array([floor.get(i, -np.inf) for i in ids.tolist()])
            yield in_rows(send(r, range(len(cell)), bound, bound >= need[:, None]), ASK)

    def met(asked: DataFrame) -> DataFrame:
        both = asked.join(stock.select("cell", "ids", F.col("v"), "n"), "cell")
        return both.select("asked", "qids", "q", "bound", "ids", "v").mapInArrow(lambda b: compare(b, dim, k), FOUND_DDL)

    first = met(ask.mapInArrow(home, ASK_DDL))
    ranked = lambda f: f.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    floors = ranked(first).where(F.size("best") >= k).select("query_id", F.expr(f"-best[{k - 1}].s").alias("floor"))
    spread = ask.mapInArrow(names_of, "sub bigint, query_id bigint")
    held = spread.join(floors, "query_id").groupBy("sub").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
    final = met(ask.join(held, "sub", "left").mapInArrow(rest, ASK_DDL))
    return ranked(final).select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def names_of(batches):
    for r in rows_of(batches):
        ids = np.unique(np.frombuffer(r["ids"], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["sub"])), pa.array(ids)], names=["sub", "query_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
