"""What op6_simhash.kept() needs of word shingles: wide SimHash prints, MinHash bands that propose pairs, exact sets that decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, mix, pieces, runs, segments, splitmix, trim, utf8, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4  # a pair of similarity 0.8 shares no band with chance (1 - 0.8^4)^32, 5 in 10^8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SALT, FACTOR = splitmix(BANDS * ROWS, 11), splitmix(BANDS * ROWS, 12) | U64(1)
PRINT = 4  # 64-bit words of a wide print
MARKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64())), ("print", pa.list_(pa.int64()))])


def shingled(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their offsets by text, a 64-bit name of each text's words in order). Case is that of ASCII; a text of fewer words is one shingle, a blank one has none and name 0."""
    data = LOWER[raw]
    start, end, n = words(data, off)
    h, first = segments(data, start, end), runs(n)
    k = np.where(n <= width, np.minimum(n, 1), n - width + 1)
    out = runs(k)
    at = np.arange(out[-1]) - np.repeat(out[:-1] - first[:-1], k)
    last = np.repeat(first[1:], k)
    g = np.zeros(len(at), U64)
    for j in range(width):
        here = at + j < last
        g[here] = mix(g[here], h[at[here] + j], 5)
    name = np.zeros(len(n), U64)
    if len(h):
        place = mix(h, (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(U64), 6)
        name[n > 0] = mix(np.add.reduceat(place, first[:-1][n > 0]), n[n > 0].astype(U64), 8)
    return g, out, name


def bands(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys for each text with shingles: ROWS smallest hashes, each of another hash function, in one name."""
    at = off[:-1][np.diff(off) > 0]
    out = np.zeros((len(at), BANDS), U64)
    if not len(at):
        return out
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((g ^ SALT[i]) * FACTOR[i], at)
            out[:, i // ROWS] = mix(out[:, i // ROWS], least, 9)
    return out


def wide_prints(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """PRINT words of SimHash for each text with shingles: a bit is 1 if it is set in over half of the different shingles' hashes."""
    ends = [(x, y) for x, y in zip(off[:-1].tolist(), off[1:].tolist()) if y > x]
    out = np.zeros((len(ends), PRINT), U64)
    for i, (x, y) in enumerate(ends):
        h = np.unique(g[x:y])
        count = np.zeros(64 * PRINT, np.int64)
        for at in range(0, len(h), 1 << 13):
            some = h[at : at + (1 << 13)]
            words = np.stack([mix(some, U64(k + 1), 21) for k in range(PRINT)], axis=1)
            count += np.unpackbits(words.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out[i] = np.packbits(2 * count > len(h), bitorder="little").view(U64)
    return out


def marks(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, class, bands, print) for each row of (row, doc_id, text); blank and null texts have class 0 and neither bands nor print."""

    def make(batches):
        for b in pieces(batches, "text", 1 << 20):
            g, off, name = shingled(*utf8(b.column(2)), width)
            many = np.diff(off) > 0
            lists = []
            for flat, n in ((bands(g, off), BANDS), (wide_prints(g, off), PRINT)):
                lists.append(pa.ListArray.from_arrays(pa.array(runs(np.where(many, n, 0)).astype(np.int32)), pa.array(flat.reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name.view(np.int64)), *lists], schema=MARKS)

    cols = [F.col("row").cast("bigint").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(make, "row bigint, doc_id bigint, class bigint, bands array<bigint>, print array<bigint>")


def measured(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, d) for the rows (a, b) of pairs: the Jaccard distance of their texts' shingle sets. texts: (node, text), each node once."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t")

    def compare(batches):
        for b in batches:
            for p in pieces(iter([b]), "s", 1 << 20):
                sides = [shingled(*utf8(p.column(c)), width)[:2] for c in (2, 3)]
                d = np.zeros(p.num_rows)
                for i in range(p.num_rows):
                    x, y = (np.unique(g[off[i] : off[i + 1]]) for g, off in sides)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    d[i] = 1 - common / max(1, len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(d)], names=["a", "b", "d"])
        trim()

    return both.mapInArrow(compare, "a bigint, b bigint, d double")


def between(xs: pa.Array, ys: pa.Array, width: int) -> np.ndarray:
    """The Jaccard distances of two arrays of texts, as a matrix."""
    (x, xo, _), (y, yo, _) = shingled(*utf8(xs), width), shingled(*utf8(ys), width)
    sets = [np.unique(y[i:j]) for i, j in zip(yo[:-1], yo[1:])]
    size = np.array([len(s) for s in sets])
    every = np.concatenate([np.zeros(0, U64), *sets])
    known, code = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    out = np.ones((len(xs), len(ys)))
    for k, (i, j) in enumerate(zip(xo[:-1], xo[1:])):
        one = np.unique(x[i:j])
        has = np.zeros(len(known) + 1, bool)
        at = np.searchsorted(known, one)
        at = at[known[np.minimum(at, len(known) - 1)] == one] if len(known) else at[:0]
        has[at] = True
        common = np.bincount(owner[has[code]], minlength=len(sets))
        out[k] = 1 - common / np.maximum(1, len(one) + size - common)
    return out
