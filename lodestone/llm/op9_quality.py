"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import U64, mix, only, pieces, prepare, read_table, segments, stored, utf8

BUCKETS = 1 << 14
SAMPLE = 20_000  # labelled rows, at most, that the target model and the cut are fitted on
SEED = 9
SMOOTH = 1.0
MARGIN = 2.0

KIND = np.ones(256, np.int8)  # 1: letters, digits, _ and all bytes beyond ASCII; 2: other signs; 0: white space
KIND[:128] = 2
KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = 1
KIND[[0x20, *range(0x09, 0x0E)]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, sign runs and pairs of them of each text, and the text of each bucket. A pair of equals has a bucket of its own."""
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(data))
    keep = kind[at] > 0
    at, end = at[keep], end[keep]
    h = segments(LOWER[data], at, end)
    doc = np.searchsorted(off, at, "right") - 1
    two = np.where(h[:-1] == h[1:], U64(0), mix(h[:-1], h[1:], 3))
    same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    return np.concatenate([(h % U64(BUCKETS)), two[same] % U64(BUCKETS)]).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket comes up in all rows of docs."""

    def make(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches, "text", 2 << 20):
            total += np.bincount(ngrams(*utf8(b.column(0)))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in only(docs, ("text", "string")).mapInArrow(make, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


@dataclass(frozen=True)
class Ratio:
    """weight: log of target over raw probability by bucket; cut: least mean weight of an accepted text."""

    weight: np.ndarray
    cut: float


def log_probability(n: np.ndarray) -> np.ndarray:
    return np.log((n + SMOOTH) / (n.sum() + SMOOTH * len(n)))


def weights(docs: DataFrame, weight: np.ndarray, keep: list[str] = ()) -> DataFrame:
    """docs' doc_id with log_weight (sum over n-grams), n_grams and noise (standard Gumbel, from the row's own content). Whole numbers in the columns of keep come along, last."""
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64()), ("noise", pa.float64()), *[(c, pa.int64()) for c in keep]])

    def make(batches):
        for b in pieces(batches, "text", 2 << 20):
            data, off = utf8(b.column(1))
            bucket, doc = ngrams(data, off)
            n = b.num_rows
            total, size = np.bincount(doc, weight[bucket], n), np.bincount(doc, minlength=n)
            raw = data.tobytes()
            u = np.array([zlib.crc32(raw[x:y], zlib.crc32(str((SEED, i)).encode())) for i, x, y in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist())], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(size.astype(np.int64)), pa.array(-np.log(-np.log((u + 0.5) / 2**32))), *b.columns[2:]], schema=schema)

    more = [(c, "bigint") for c in keep]
    return only(docs, ("doc_id", "bigint"), ("text", "string"), *more).mapInArrow(make, ", ".join(["doc_id bigint, log_weight double, n_grams bigint, noise double", *map(" ".join, more)]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ratio:
    """The two models and the cut.

    raw: counted over all of docs. target: counted over the texts labelled 1 in a
    sample of at most `sample` labelled ids (those whose hashed id is smallest); an
    id with both labels counts as 1.
    cut: the mean log ratio that best parts the labels of the sample, both kinds
    weighing alike, less a margin, so that doubtful texts stay. Without labels of
    both kinds everything is accepted.
    """
    spark = prepare(docs.sparkSession)
    some = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    table = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality) for r in some.collect()], "doc_id bigint, label int"))
    known = stored(only(docs, ("doc_id", "bigint"), ("text", "string")).join(table, "doc_id"))
    raw, target = counts(docs), counts(known.where("label = 1"))
    if not target.any() or not raw.any():
        return Ratio(np.zeros(BUCKETS), -np.inf)
    weight = log_probability(target) - log_probability(raw)
    w = weights(known.select("doc_id", "text"), weight).join(table, "doc_id").where("n_grams > 0").select((F.col("log_weight") / F.col("n_grams")).alias("m"), "label").collect()
    good, bad = np.sort([r.m for r in w if r.label == 1]), np.sort([r.m for r in w if r.label == 0])
    if not len(good) or not len(bad):
        return Ratio(weight, -np.inf)
    at = np.unique(np.concatenate([good, bad]))
    lost, let = np.searchsorted(good, at, "left") / len(good), 1 - np.searchsorted(bad, at, "left") / len(bad)
    best = at[np.argmin(4 * lost + let)]
    below = good[good < best]
    return Ratio(weight, float(best - 0.02) if len(below) < len(good) else -np.inf)


def resample(docs: DataFrame, ratio: Ratio, k: int | None = None, keep: list[str] = ()) -> DataFrame:
    """(doc_id, log_weight, n_grams, score, key, accepted) for each row of docs.

    score = n_grams * (mean log ratio - cut), the log weight against that of a text
    that just passes; key = score + Gumbel noise. The k rows with the largest keys
    are accepted: a sample without replacement in proportion to exp(score). k is
    the number of rows with score >= -MARGIN where it isn't given: rows that pass
    are hardly ever lost to the noise. Noise comes from
    doc_id and text, so equal rows have equal keys and are taken or left together
    (then more than k may be taken). Texts without n-grams (null, empty) score 0;
    null ids are rows like others. Whole numbers in the columns of keep come along,
    last.
    """
    spark = prepare(docs.sparkSession)
    cut = ratio.cut if np.isfinite(ratio.cut) else -1e3
    scored = stored(weights(docs, ratio.weight, keep).withColumn("score", F.col("log_weight") - F.col("n_grams") * F.lit(cut)).withColumn("key", F.col("score") + F.col("noise")))
    if k is None:
        k = scored.where(F.col("score") >= F.lit(-MARGIN)).count()
    edge = kth(scored, k)
    return scored.select("doc_id", "log_weight", "n_grams", "score", "key", (F.col("key") >= F.lit(edge)).alias("accepted"), *keep)


def kth(scored: DataFrame, k: int, width: int = 4096) -> float:
    """The k-th largest key, by counts over ever finer stretches: what reaches the driver doesn't grow."""
    lo, hi, n = scored.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n == 0 or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    for _ in range(6):
        step = (hi - lo) / width
        if step <= 0 or lo + step <= lo:
            break
        rows = scored.where(F.col("key").between(lo, hi)).groupBy(F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(step)), F.lit(width - 1)).alias("c")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("c")).collect()
        for r in rows:
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if lo == hi:
            break
    if lo == hi:
        return lo
    rest = scored.where(F.col("key").between(lo, hi)).groupBy("key").count().orderBy(F.desc("key")).limit(width).collect()
    for r in rest:
        above += r["count"]
        if above >= k:
            return r.key
    return lo


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] = ()) -> DataFrame:
    return resample(docs, fit(docs, labels), keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
