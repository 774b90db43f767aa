"""Word-level deduplication: documents meet on winnowed anchors, matches are extended both ways (see repeats.py)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import read_table, runs, segments, words
from lodestone.llm.repeats import repeats, shape

LENGTH = 35
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
DDL = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def cut_words(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Removes each word that a window of `length` words covers whose sequence also starts anywhere else.

    Seeds are the winnowed anchors of the word sequence with the words to their
    right; seeds that repeat are extended to both sides, and matches of the
    window's length or more are the maximal repeats that are cut. Words are
    `[^\\x20\\x09-\\x0D]+`, as they are. A row gives a row: doc_id (null and
    repeated ones as they are), n_words, n_removed, n_spans, kept (the other
    words joined by a space, UTF-8) and its SHA-256. Null or blank text has no
    words; shorter texts are kept whole; an empty table gives none.
    """

    def symbols(data, off):
        start, end, count = words(data, off)
        return segments(data, start, end), runs(count), (start, end)

    def finish(ids, data, off, soff, extra, covered):
        start, end = extra
        kept = []
        for i in range(len(ids)):
            a, b = soff[i], soff[i + 1]
            raw, c = data[off[i] : off[i + 1]].tobytes(), covered[a:b]
            if c.any():
                at = np.flatnonzero(~c) + a
                kept.append(b" ".join([raw[x:y] for x, y in zip((start[at] - off[i]).tolist(), (end[at] - off[i]).tolist())]))
            else:
                kept.append(b" ".join(raw.split()))
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        first = soff[:-1][np.diff(soff) > 0]
        edge[first] = covered[first]
        gone, spans = np.concatenate(([0], np.cumsum(covered))), np.concatenate(([0], np.cumsum(edge)))
        return [ids, np.diff(soff), np.diff(gone[soff]), np.diff(spans[soff]), kept if with_text else [None] * len(ids), [hashlib.sha256(k).hexdigest() for k in kept]]

    return repeats(docs, shape(length, 4, 6), symbols, finish, DDL, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_words(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")
