"""Byte-level deduplication by prefix-free parsing (see repeats.py for the method)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import BYTE_NAMES, read_table
from lodestone.llm.repeats import repeats, shape

LENGTH = 200
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def cut_bytes(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """Removes each byte that a `length`-byte string covers which also starts anywhere else.

    docs needs doc_id and text; other columns are ignored. A row gives a row: its
    doc_id (null and repeated ones as they are), n_bytes, n_removed, n_spans
    (maximal removed runs), kept (remaining bytes; null without with_bytes) and
    their SHA-256. Null text is empty; texts shorter than `length` are kept
    whole; of equal texts of that length or more nothing is kept; an empty
    table gives none. All copies are judged on the input: no copy is favoured.
    """

    def symbols(data, off):
        return BYTE_NAMES[data], off, None

    def finish(ids, data, off, soff, _, covered):
        keep = ~covered
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        start = off[:-1][np.diff(off) > 0]
        edge[start] = covered[start]
        gone, spans = np.concatenate(([0], np.cumsum(covered))), np.concatenate(([0], np.cumsum(edge)))
        kept = [data[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]].tobytes() for i in range(len(ids))]
        return [ids, np.diff(off), np.diff(gone[off]), np.diff(spans[off]), kept if with_bytes else [None] * len(ids), [hashlib.sha256(k).hexdigest() for k in kept]]

    return repeats(docs, shape(length, 16, 20), symbols, finish, DDL, OUT)


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut_bytes() with what is left as text; a character of which bytes were removed goes whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])

    def make(batches):
        for b in batches:
            texts = [k.decode("utf-8", "ignore") for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], schema=schema)

    return cut_bytes(docs, length).select("doc_id", "kept", "n_removed").mapInArrow(make, "doc_id bigint, text string, n_removed bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_bytes(read_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
