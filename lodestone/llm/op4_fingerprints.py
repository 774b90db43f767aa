"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import U64, mix, n_shuffle, only, prepare, read_table, runs, segments, slots, splitmix, words

BINS = 256  # a power of two; a bin stores its low 8 bits
BITS = 8
SHINGLE = 5
TRIES = 128
CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 1000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and the text of each; fewer words than `width` make one shingle, no words none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, count = words(data, runs(np.fromiter(map(len, texts), np.int64, len(texts))))
    w, off = segments(data, start, end), runs(count)
    doc = np.repeat(np.arange(len(texts)), count)
    if len(w) >= width:
        h = w[: len(w) - width + 1]
        for k in range(1, width):
            h = mix(h, w[k : len(w) - width + 1 + k], k)
        at = np.arange(len(h))
        ok = at + width <= off[doc[: len(h)] + 1]
        h, of = h[ok], doc[: len(ok)][ok]
    else:
        h, of = w[:0], doc[:0]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        x = w[off[short]]
        for k in range(1, width):
            more = count[short] > k
            x[more] = mix(x[more], w[off[short[more]] + k], k)
        h, of = np.concatenate([h, mix(x, count[short].astype(U64), 77)]), np.concatenate([of, short])
    return h, of


def donors(bins: int, tries: int) -> np.ndarray:
    """For each try and empty bin the bin that it asks for a value: the same for all documents."""
    return (splitmix(bins * tries, 5) % U64(bins)).astype(np.int64).reshape(tries, bins)


def bin_minima(h: np.ndarray, of: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """The least hash in each bin of each of n texts, empty bins filled by optimal densification; without shingles all EMPTY.

    An empty bin asks other bins, in an order drawn by hashing its number and the
    try, and takes the value of the first that wasn't empty itself. If `TRIES`
    fail, which takes a text of a few shingles, it takes the next to the right.
    """
    got = np.full(n * bins, EMPTY)
    np.minimum.at(got, of * bins + (h >> U64(64 - bins.bit_length() + 1)).astype(np.int64), h)
    got = got.reshape(n, bins)
    full = got != EMPTY
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    out = got.copy()
    for ask in donors(bins, TRIES):
        if not len(row):
            return out
        src = ask[col]
        ok = full[row, src]
        out[row[ok], col[ok]] = got[row[ok], src[ok]]
        row, col = row[~ok], col[~ok]
    step = 1
    while len(row):
        src = (col + step) % bins
        ok = full[row, src]
        out[row[ok], col[ok]] = got[row[ok], src[ok]]
        row, col, step = row[~ok], col[~ok], step + 1
    return out


def fingerprint(texts: list[bytes], bins: int = BINS, width: int = SHINGLE) -> np.ndarray:
    """The low 8 bits of each bin; a text without words has zeros."""
    low = bin_minima(*shingles(texts, width), len(texts), bins)
    return np.where(low == EMPTY, 0, (low * U64(0x9E3779B97F4A7C15) >> U64(40)) & U64((1 << BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity by row: equal bins, less those that are equal by chance in 2^-8 of unequal ones."""
    chance = 1.0 / (1 << BITS)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprints(docs: DataFrame, bins: int = BINS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): a row for a row; null text has no words."""

    def make(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK_DOCS):
                part = b.slice(at, CHUNK_DOCS)
                fp = fingerprint([(t or "").encode() for t in part.column(1).to_pylist()], bins, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes().hex() for r in fp], pa.string())], names=["doc_id", "fingerprint"])

    prepare(docs.sparkSession)
    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(make, "doc_id bigint, fingerprint string")


# ---------------------------------------------------------------- each document with the next


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, text), dealt and sorted so that the next document follows in the same partition.

    Contiguous ranges of doc_id, with about as many rows each, make a partition
    each. The first document of a range is sent to the range before, too (tail
    = 1), that of the first range to the last one. The ranges are cut at
    approximate quantiles, so ids far from the others, or in clumps, don't make
    them uneven; rows of one id, or without one, are in one range. What the driver
    sees and what is broadcast has a row for each partition, whatever the size of
    docs.
    """
    spark = docs.sparkSession
    n, base = n_shuffle(spark), only(docs, ("doc_id", "bigint"), ("text", "string"))
    keyed = base.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 8 * n))).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    keyed = keyed.withColumn("range", F.aggregate(jumps, F.lit(0), lambda at, j: F.when(F.get(bounds, at + j - 1) <= F.col("key"), at + j).otherwise(at)))
    ranges = sorted(tuple(r) for r in keyed.groupBy("range").agg(F.min("key")).collect())
    to = slots(n).tolist()
    rows = [(r, to[k % n], least, to[(k - 1) % len(ranges) % n]) for k, (r, least) in enumerate(ranges)]
    table = F.broadcast(spark.createDataFrame(rows, "range int, part int, head bigint, before int"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    both = F.when(F.col("key") == F.col("head"), F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    dealt = keyed.join(table, "range").select(F.inline(both), "key", "doc_id", "text", F.xxhash64("text").alias("h"))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "tail", "key", "h").select("part", "tail", "doc_id", "text")


NEXT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
NEXT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, bins: int = BINS, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike these and the next document's are.

    The edited text has its last floor(n/4) code points replaced by the first as
    many, or all, of the next document by ascending doc_id; the first follows the
    last. Null text is empty. Rows of one doc_id follow each other by a hash of
    their text (rows that tie there are equal); a null doc_id comes first. One
    row alone is its own next; an empty table gives no rows. Two texts without
    words are alike (1), one with and one without are not (0).
    """
    prepare(docs.sparkSession)

    def flush(rows: list[tuple], follow: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [follow]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
        raw, raw2 = [t.encode() for t in texts], [t.encode() for t in edited]
        a, b = fingerprint(raw, bins, width), fingerprint(raw2, bins, width)
        word = np.array([bool(t.split()) for t in raw])
        word2 = np.array([bool(t.split()) for t in raw2])
        one = lambda x, y, p, q: np.where(p == q, likeness(x, y), 0.0)
        cols = [[i for i, _ in rows], list(map(len, texts[:-1])), [hashlib.sha256(t).hexdigest() for t in raw2], [r.tobytes().hex() for r in a[:-1]], [r.tobytes().hex() for r in b], one(a[:-1], b, word[:-1], word2), one(a[:-1], a[1:], word[:-1], word[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, NEXT.types)], schema=NEXT)

    def make(batches):
        part, rows, size, closed = None, [], 0, False
        for b in batches:
            for p, tail, i, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t or ""
                if p != part:
                    part, closed = p, False
                if closed:
                    continue
                if rows and (tail or size > CHUNK_BYTES or len(rows) >= CHUNK_DOCS):
                    yield flush(rows, t)
                    rows, size = [], 0
                closed = bool(tail)
                if not tail:
                    rows.append((i, t))
                    size += len(t)

    return in_order(docs).mapInArrow(make, NEXT_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))
