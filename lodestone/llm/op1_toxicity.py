"""Toxicity severity by cumulative-link ordinal regression on sparse words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import U64, only, pieces, prepare, read_table, segments, utf8

BUCKETS = 1 << 20
SAMPLE = 20_000  # labelled rows, at most, that the model is fitted on
FEATURES = 4096
GRADES = 4

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each different word of each text; words are runs of letters, lower case, signs around them dropped."""
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    edge = np.diff(kind)
    joint = cut & (kind[:-1] > 0) & (kind[1:] > 0)
    at, end = np.flatnonzero((edge == 1) | joint), np.flatnonzero((edge == -1) | joint)
    bucket = segments(LOWER[data], at, end) % U64(BUCKETS)
    doc = (np.searchsorted(off, at, "right") - 1).astype(U64)
    pair = np.unique(doc * U64(BUCKETS) + bucket)
    return (pair // U64(BUCKETS)).astype(np.int64), (pair % U64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(weight . x - threshold[k]); the weights are shared by the ordered thresholds."""

    bucket: np.ndarray  # sorted
    weight: np.ndarray
    threshold: np.ndarray

    def beyond(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - z[:, None], -50, 50)))

    def linear(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        if not len(self.bucket):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.bucket, bucket), len(self.bucket) - 1)
        hit = self.bucket[at] == bucket
        return np.bincount(doc[hit], self.weight[at[hit]], n)


def screened(doc: np.ndarray, bucket: np.ndarray, high: np.ndarray, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share among the rows with a high grade differs from that among the others by over 6 standard errors, and their log odds."""
    n1, n0 = int(high.sum()), int((~high).sum())
    df = np.bincount(bucket, minlength=BUCKETS)
    d1 = np.bincount(bucket[high[doc]], minlength=BUCKETS)
    p, p1, p0 = df / (n1 + n0), d1 / max(1, n1), (df - d1) / max(1, n0)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(1, n1) + 1 / max(1, n0)))
    some = np.flatnonzero((df >= 3) & (np.abs(z) > 6))
    some = np.sort(some[np.argsort(-np.abs(z[some]), kind="stable")][:most])
    return some, np.log((d1[some] + 0.5) / (n1 + 1)) - np.log((df - d1)[some] + 0.5) + np.log(n0 + 1)


def fit_ordinal(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int = GRADES, steps: int = 400, ridge: float = 1e-3) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam on all rows at once; thresholds stay ordered as sums of exponentials."""
    some, _ = screened(doc, bucket, grade > 0)
    n, k = len(grade), grades - 1
    at = np.minimum(np.searchsorted(some, bucket), max(0, len(some) - 1)) if len(some) else np.zeros(len(bucket), np.int64)
    hit = some[at] == bucket if len(some) else np.zeros(len(bucket), bool)
    doc, at = doc[hit], at[hit]
    share = np.clip([(grade > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(1 / share - 1)
    par = np.concatenate([np.zeros(len(some)), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        w, th = par[: len(some)], np.cumsum(np.concatenate([[par[len(some)]], np.exp(par[len(some) + 1 :])]))
        z = np.bincount(doc, w[at], n)
        tail = 1 / (1 + np.exp(np.clip(th[None, :] - z[:, None], -50, 50)))
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-9)
        dz = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
        dth = np.zeros(k)
        for j in range(k):
            up, down = grade == j + 1, grade == j
            dth[j] = (slope[up, j + 1] / p[up]).sum() / n - (slope[down, j + 1] / p[down]).sum() / n
        g = np.concatenate([np.bincount(at, dz[doc], len(some)) + ridge * w / max(1, n) * 10, [dth.sum()], [np.exp(par[len(some) + 1 + j]) * dth[j + 1 :].sum() for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(some, par[: len(some)], np.cumsum(np.concatenate([[par[len(some)]], np.exp(par[len(some) + 1 :])])))


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: the labelled ids whose hash is smallest; ids with several labels take the largest, with several texts that with the smallest hash."""
    spark = prepare(docs.sparkSession)
    some = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    table = F.broadcast(spark.createDataFrame([tuple(r) for r in some], "doc_id bigint, y int"))

    def make(batches):
        for b in pieces(batches, "text", 2 << 20):
            doc, bucket = features(*utf8(b.column(1)))
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows = [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    rows = only(docs, ("doc_id", "bigint"), ("text", "string")).join(table, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    got = sorted(one.mapInArrow(make, "doc_id bigint, y int, x binary").collect(), key=lambda r: r.doc_id)
    x = [np.frombuffer(r.x, np.int32) for r in got]
    return np.repeat(np.arange(len(x)), [len(a) for a in x]), np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64), np.array([r.y for r in got], np.int64)


def severity_grades(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 0 to grades - 1 from a yes/no label: rows labelled 0 have grade 0, the others are parted into equal classes by how many screened toxic words they hold."""
    some, odds = screened(doc, bucket, toxic > 0)
    some = some[odds > 0]
    hits = np.bincount(doc[np.isin(bucket, some)], minlength=len(toxic))
    out = np.zeros(len(toxic), np.int64)
    yes = np.flatnonzero(toxic > 0)
    order = yes[np.argsort(hits[yes], kind="stable")]
    out[order] = 1 + np.arange(len(order)) * (grades - 1) // max(1, len(order))
    return out


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each row of docs.

    severity: expected grade, the sum of P(grade > k); grade: the likeliest; p_toxic
    = P(grade > 0); toxic: that is at least a half. Null and empty texts have no
    features, like a text of unknown words; null and repeated ids are rows like
    others.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])

    def make(batches):
        for b in pieces(batches, "text", 2 << 20):
            doc, bucket = features(*utf8(b.column(1)))
            tail = model.beyond(model.linear(doc, bucket, b.num_rows))
            p = -np.diff(np.concatenate([np.ones((len(tail), 1)), tail, np.zeros((len(tail), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tail.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(tail[:, 0]), pa.array(tail[:, 0] >= 0.5)], schema=schema)

    prepare(docs.sparkSession)
    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(make, "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean")


def fit(docs: DataFrame, labels: DataFrame, grade: str | None = None, label: str = "toxic", grades: int = GRADES) -> Ordinal:
    """The model from labelled grades (column `grade`), or from a yes/no column `label` by severity_grades()."""
    doc, bucket, y = sampled(docs, labels, grade or label)
    if not len(y):
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.arange(1.0, grades))
    return fit_ordinal(doc, bucket, np.clip(y, 0, grades - 1) if grade else severity_grades(doc, bucket, y, grades), grades)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
