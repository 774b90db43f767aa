"""Exact repeats of a fixed length over a whole corpus: prefix-free parsing with names in place of bytes.

The corpus is a set of symbol sequences (bytes, or words). Position p repeats
if the window of `length` symbols that starts there also starts anywhere
else. Removing what such windows cover is the operator behind the byte and
the word deduplication.

1. Parse. Hashes of short grams roll over each sequence; the smallest in each
   run of `reach` places triggers a phrase boundary (an anchor). Boundaries
   depend on the content in the window alone, so equal windows are cut alike.
2. Dictionary. Every stretch gets a name by doubling: the name of 2k symbols is
   made of the names of its halves, as in prefix-doubling construction of
   suffix arrays, but by a 64-bit hash, which needs no global ranks. Any
   stretch then has a name at once from two overlapping halves.
3. Corpus order. Phrases are dealt by name; each task sorts the names it gets.
   Neighbours with equal names are the suffixes whose common prefix reaches the
   compared length; where only that matters, order by name and order by bytes
   have the same runs. What no neighbour equals can't lie in a repeat: of all
   that follows, most text is gone.
4. Extension. For each kept anchor two kinds of names go round again: that of
   the whole stretch of all its windows (if it repeats, all of them do), and for
   chunks of windows that of the symbols they share. A chunk found in one kind
   of stretch only is settled by that stretch; where different stretches share a
   chunk, near the edges of repeats, one anchor of each kind of stretch has its
   windows compared by the full name.

Rows that cross the network are packed arrays, each name once per flush of a
task: a name that a third of all documents hold arrives once from each task.
Names are 64 bits; two different windows of a billion have the same name with
probability below 1 in 30.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, bucketed, in_rows, mix, n_shuffle, only, pieces, prepare, runs, slots, stored, trim, utf8

FLUSH = 1 << 20  # names that a task gathers before it sends them
BLOCK = 1 << 20  # bytes of text in a block
POS = U64(26)  # low bits of a trigger's key that hold its place: a document has under 2^26 symbols more than a block


@dataclass(frozen=True)
class Shape:
    """length: of a window; reach: places that a trigger is chosen from; gram: symbols hashed for it; chunk: windows that share a name."""

    length: int
    reach: int
    gram: int
    chunk: int

    def __post_init__(self):
        if min(self.length, self.reach, self.gram, self.chunk) < 1 or self.reach + self.gram - 1 > self.length or self.length >= 1 << 14:
            raise ValueError("triggers must lie within the window, and the window below 16384 symbols")

    @property
    def seed(self) -> int:
        return self.length - self.reach + 1


def shape(length: int, gram: int, chunk: int) -> Shape:
    reach = max(1, min(length // 2, length - gram + 1))
    return Shape(length, reach, min(gram, length), chunk)


# ---------------------------------------------------------------- names


def tables(sym: np.ndarray, *lengths: int) -> list[np.ndarray | None]:
    """[j][i]: name of the 2^j symbols from i. Kept for the levels that the lengths need: each length alone, or if there are two negative ones all from -a to -b."""
    level = lambda n: abs(n).bit_length() - 1
    keep = set(range(level(lengths[0]), level(lengths[1]) + 1)) if min(lengths) < 0 else set(map(level, lengths))
    out, last = [sym if 0 in keep else None], sym
    while len(out) <= max(keep) and len(last) > (k := 1 << (len(out) - 1)):
        last = mix(last[:-k], last[k:], len(out))
        out.append(last if len(out) in keep else None)
    return out


def named(tabs: list[np.ndarray], at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Name of each stretch; lengths are at least 1 and the stretches lie within the symbols."""
    if np.isscalar(length):
        j = int(length).bit_length() - 1
        return mix(tabs[j][at], tabs[j][at + (length - (1 << j))], 1000 + length)
    out = np.zeros(len(at), U64)
    level = np.log2(np.maximum(length, 1)).astype(np.int64)
    for j in np.unique(level):
        m = level == j
        a, n = at[m], length[m]
        out[m] = mix(mix(tabs[j][a], tabs[j][a + n - (1 << int(j))]), n.astype(U64), 999)
    return out


def triggers(sym: np.ndarray, off: np.ndarray, s: Shape) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window start that chose it, and the name of what all its windows share."""
    n = len(sym)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    if n < s.length:
        return none
    if n > 1 << int(POS):
        raise ValueError(f"a text has over {(1 << int(POS)) - BLOCK} symbols, more than a trigger's key can place")
    tabs = tables(sym, s.gram, s.seed)
    key = named(tabs, np.arange(n - s.gram + 1), s.gram)
    key >>= POS
    key <<= POS
    key |= np.arange(len(key), dtype=U64)
    k = 1
    while k * 2 <= s.reach:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    if s.reach > k:
        key = np.minimum(key[: -(s.reach - k)], key[s.reach - k :])
    ok = np.zeros(n + 1, np.int32)
    last = off[1:] - s.length + 1
    full = last > off[:-1]
    np.add.at(ok, off[:-1][full], 1)
    np.add.at(ok, last[full], -1)
    p = np.flatnonzero(np.cumsum(ok)[:n])
    if not len(p):
        return none
    anchor = (key[p] & ((U64(1) << POS) - U64(1))).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(p) != 1)
    first = np.flatnonzero(new)
    at, lo, hi = anchor[first], p[first], p[np.append(first[1:], len(p)) - 1]
    return at, lo, hi, named(tabs, at, s.seed)


def cut(sym: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts that hold the places `at` alone: symbols, offsets, and for each place its shift and its text."""
    doc = np.searchsorted(off, at, "right") - 1
    used = np.unique(doc)
    noff = runs(off[used + 1] - off[used])
    keep = np.concatenate([sym[off[d] : off[d + 1]] for d in used]) if len(used) else sym[:0]
    k = np.searchsorted(used, doc)
    return keep, noff, noff[k] - off[doc], k


def extended(sym: np.ndarray, off: np.ndarray, meta: np.ndarray, s: Shape) -> tuple[np.ndarray, ...]:
    """For kept anchors, names of whole stretches with metas; names of chunks, their stretch's name and metas. meta: anchor, first and last window, packed."""
    at, lo, hi = (meta >> U64(28)).astype(np.int64), None, None
    lo = at - ((meta >> U64(14)) & U64(0x3FFF)).astype(np.int64)
    hi = at - (meta & U64(0x3FFF)).astype(np.int64)
    sub, noff, shift, doc = cut(sym, off, at)
    tabs = tables(sub, -(s.length - s.chunk), -(s.length + s.reach))
    p = at + shift
    start, end = np.maximum(p - (s.reach - 1), noff[doc]), np.minimum(p + s.length, noff[doc + 1])
    whole = mix(named(tabs, start, end - start), (p - start).astype(U64), 500)
    keys, tags, metas = [whole[:0]], [whole[:0]], [whole[:0]]
    for a0 in range(0, s.reach, s.chunk):
        a1 = min(a0 + s.chunk, s.reach) - 1
        x, y = np.maximum(lo, at - a1), np.minimum(hi, at - a0)
        m = x <= y
        keys.append(mix(named(tabs, p[m] - a1 + (a1 - a0), s.length - (a1 - a0)), np.full(int(m.sum()), a0, U64), 501))
        tags.append(whole[m])
        metas.append(pack(x[m], y[m], 0))
    return whole, pack(lo, hi, 1), np.concatenate(keys), np.concatenate(tags), np.concatenate(metas)


def pack(lo: np.ndarray, hi: np.ndarray, whole: int) -> np.ndarray:
    return (lo.astype(U64) << U64(15)) | ((hi - lo).astype(U64) << U64(1)) | U64(whole)


def unpack(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = (meta >> U64(15)).astype(np.int64)
    return lo, lo + ((meta >> U64(1)) & U64(0x3FFF)).astype(np.int64), (meta & U64(1)).astype(bool)


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the intervals, both ends included."""
    n = hi - lo + 1
    return np.repeat(lo - runs(n)[:-1], n) + np.arange(int(n.sum()))


def settled(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts known to repeat, and those to compare one by one (known ones that stand for their stretch among them)."""
    lo, hi, whole = unpack(meta)
    return spread(lo[whole], hi[whole]), np.unique(spread(lo[~whole], hi[~whole]))


# ---------------------------------------------------------------- blocks

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("text", pa.binary()), ("off", pa.binary())])


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Whole documents packed into compressed blocks, each a row; nothing is shuffled."""

    def make(batches):
        press, n = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for b in pieces(batches, "text", size):
            data, off = utf8(b.column(1))
            ids, null = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
            yield in_rows([{"block": n, "ids": ids.astype(np.int64).tobytes() + null.astype(np.uint8).tobytes(), "text": press.compress(data.tobytes()), "off": off.tobytes()}], BLOCKS)
            n += 1

    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(make, "block bigint, ids binary, text binary, off binary")


def unblock(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    off = np.frombuffer(row["off"], np.int64)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, int(off[-1]))), np.uint8), off, ids_of(row["ids"])


def ids_of(raw: bytes) -> list:
    n = len(raw) // 9
    ids, null = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n)
    return [None if z else i for i, z in zip(ids.tolist(), null.tolist())]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
    trim()


# ---------------------------------------------------------------- one round: names out, repeated ones back

SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("metas", pa.binary()), ("from", pa.binary()), ("many", pa.binary()), ("own", pa.binary()), ("pairs", pa.binary())])
SENT_DDL = "part int, block bigint, keys binary, metas binary, `from` binary, many binary, own binary, pairs binary"
BACK = pa.schema([("block", pa.int64()), ("metas", pa.binary())])


class Sender:
    """Gathers names of blocks; flush() gives a row for each partition, and what the task itself has found to repeat."""

    def __init__(self, keys: np.ndarray):
        self.slots, self.got, self.pairs, self.size = keys, [], [], 0

    def add(self, block: int, keys: np.ndarray, metas: np.ndarray, *pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """pairs: names, tags and metas; of those with a name and tag in common one is sent."""
        self.got.append((np.full(len(keys), block, np.int64), keys, metas))
        self.size += len(keys)
        if pairs:
            self.pairs.append(np.stack([*pairs, np.full(len(pairs[0]), block, np.int64).view(U64)]))
            self.size += len(pairs[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        block, key, meta = (np.concatenate(x) for x in zip(*self.got))
        self.got, self.size, n = [], 0, len(self.slots)
        order = np.argsort(key)
        block, key, meta = block[order], key[order], meta[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        many = np.repeat(count > 1, count)
        part = lambda k: (k % U64(n)).astype(np.int64)
        out = {}
        one = np.flatnonzero(~many)
        one = one[np.argsort(part(key[one]), kind="stable")]
        edges = np.searchsorted(part(key[one]), np.arange(n + 1))
        for i in range(n):
            if (m := one[edges[i] : edges[i + 1]]).size:
                out[i] = {"keys": key[m].tobytes(), "metas": meta[m].tobytes(), "from": block[m].tobytes()}
        twice = key[first[count > 1]]
        to = part(twice)
        for i in np.unique(to):
            out.setdefault(int(i), {})["many"] = twice[to == i].tobytes()
        if self.pairs:
            four = kinds(np.concatenate(self.pairs, axis=1))
            self.pairs = []
            to = part(four[0])
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(n + 1))
            for i in range(n):
                if (m := order[edges[i] : edges[i + 1]]).size:
                    out.setdefault(i, {})["pairs"] = four[:, m].tobytes()
        rows = [{"part": int(self.slots[i]), "block": -1} | r for i, r in out.items()]
        b, m = block[many], meta[many]
        order = np.argsort(b, kind="stable")
        b, m = b[order], m[order]
        ids, at = np.unique(b, return_index=True)
        for i, x in zip(ids.tolist(), np.split(m, at[1:])):
            rows.append({"part": int(self.slots[i % n]), "block": i, "own": x.tobytes()})
        for k in range(0, len(rows), 64):
            yield in_rows(rows[k : k + 64], SENT)


def kinds(four: np.ndarray) -> np.ndarray:
    """The first row for each name and tag, sorted by them."""
    four = four[:, np.lexsort((four[1], four[0]))]
    new = np.ones(four.shape[1], bool)
    new[1:] = (four[:2, 1:] != four[:2, :-1]).any(axis=0)
    return four[:, new]


def to_blocks(blk: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(blk):
        return
    order = np.argsort(blk, kind="stable")
    blk, meta = blk[order], meta[order]
    ids, start = np.unique(blk, return_index=True)
    rows = [{"block": i, "metas": m.tobytes()} for i, m in zip(ids.tolist(), np.split(meta, start[1:]))]
    for k in range(0, len(rows), 256):
        yield in_rows(rows[k : k + 256], BACK)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the names of a partition; sends the metas of those that are there more than once to their blocks."""
    keys, metas, block, many, pairs = [], [], [], [], []
    for r in rows_of(batches):
        if r["pairs"]:
            pairs.append(np.frombuffer(r["pairs"], U64).reshape(4, -1))
        if r["own"]:
            yield in_rows([{"block": r["block"], "metas": r["own"]}], BACK)
        if r["keys"]:
            keys.append(np.frombuffer(r["keys"], U64))
            metas.append(np.frombuffer(r["metas"], U64))
            block.append(np.frombuffer(r["from"], np.int64))
        if r["many"]:
            many.append(np.frombuffer(r["many"], U64))
    if pairs:
        four = kinds(np.concatenate(pairs, axis=1))
        del pairs
        same = four[0, 1:] == four[0, :-1]
        shared = np.append(False, same) | np.append(same, False) if four.shape[1] else same
        yield from to_blocks(four[3, shared].view(np.int64), four[2, shared])
        del four
    if not keys:
        return
    key, meta, blk = np.concatenate(keys), np.concatenate(metas), np.concatenate(block)
    del keys, metas, block
    every = np.sort(np.concatenate([key, *many, *many]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    hit = np.zeros(len(key), bool)
    if len(again):
        hit = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    yield from to_blocks(blk[hit], meta[hit])


def round_trip(frame: DataFrame, ask: Callable) -> DataFrame:
    """ask(rows, sender) -> batches, for the rows of frame; gives (block, metas) with the metas of repeated names."""
    n = n_shuffle(frame.sparkSession)
    keys = slots(n)

    def send(batches):
        sender = Sender(keys)
        for r in rows_of(batches):
            yield from ask(r, sender)
        yield from sender.flush()

    back = frame.mapInArrow(send, SENT_DDL).repartition(n, "part").mapInArrow(meet, "block bigint, metas binary")
    return back.groupBy("block").agg(F.collect_list("metas").alias("metas"))


def gathered(metas) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, U64) for x in metas]) if metas else np.zeros(0, U64)


def repeats(docs: DataFrame, s: Shape, symbols: Callable, finish: Callable, ddl: str, out: pa.Schema) -> DataFrame:
    """finish(ids, data, off, sym_off, extra, covered) -> column lists, for each block of whole documents.

    symbols(data, off) -> (names, offsets of the texts in names, extra). covered is
    True for each symbol within a repeated window. A row of docs gives a row; null
    texts are empty, null and repeated ids are kept as they are.
    """
    spark = prepare(docs.sparkSession)
    base = bucketed(blocks(docs), "block")

    def first(r, sender):
        data, off, _ = unblock(r)
        sym, soff, _ = symbols(data, off)
        at, lo, hi, key = triggers(sym, soff, s)
        meta = (at.astype(U64) << U64(28)) | ((at - lo).astype(U64) << U64(14)) | (at - hi).astype(U64)
        yield from sender.add(r["block"], key, meta)

    def second(r, sender):
        data, off, _ = unblock(r)
        sym, soff, _ = symbols(data, off)
        yield from sender.add(r["block"], *extended(sym, soff, gathered(r["metas"]), s))

    def third(r, sender):
        _, open_ = settled(gathered(r["metas"]))
        if len(open_):
            data, off, _ = unblock(r)
            sym, soff, _ = symbols(data, off)
            sub, _, shift, _ = cut(sym, soff, open_)
            yield from sender.add(r["block"], named(tables(sub, s.length), open_ + shift, s.length), open_.astype(U64))

    one = round_trip(base, first)
    two = stored(round_trip(base.join(one.hint("shuffle_hash"), "block"), second))
    three = round_trip(base.join(two.hint("shuffle_hash"), "block"), third).withColumnRenamed("metas", "singles")

    def last(batches):
        for r in rows_of(batches):
            data, off, ids = unblock(r)
            sym, soff, extra = symbols(data, off)
            known, _ = settled(gathered(r["metas"]))
            start = np.concatenate([known, gathered(r["singles"]).astype(np.int64)])
            edge = np.zeros(len(sym) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + s.length, -1)
            covered = np.cumsum(edge)[: len(sym)] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(finish(ids, data, off, soff, extra, covered), out.types)], schema=out)

    return base.join(two.hint("shuffle_hash"), "block", "left").join(three.hint("shuffle_hash"), "block", "left").mapInArrow(last, ddl)
