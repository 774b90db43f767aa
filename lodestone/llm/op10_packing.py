"""Packing of tokenized documents into sequences of a fixed length by bin completion."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import only, pieces, prepare, read_table, stored

LENGTH = 4096
SALTS = 1024
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# ---------------------------------------------------------------- tokens

#: The tokenizer's own split of a chunk without white space, for letters that lower() maps one to one.
PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+\Z")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
CACHED = 120_000


class WordTokens:
    """Ids of texts as the tokenizer gives them, 32 bits each, from a cache of chunks between ASCII white space.

    The tokenizer never joins characters across white space, so chunks are
    independent. A chunk of Latin letters, digits and signs is split as the
    tokenizer splits it and its parts go to the BPE model alone; any other chunk
    goes to the whole tokenizer. Both caches are bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.bytes = {b: chr(b if b in keep else next(spare)) for b in range(256)}
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.latin = {chr(i): "".join(self.bytes[b] for b in chr(i).encode()) for i in range(33, 256)}

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            units = p if p.isascii() else "".join(map(self.latin.__getitem__, p))
            got = np.array([t.id for t in self.model.tokenize(units)], "<u4").tobytes()
            if len(self.parts) < CACHED:
                self.parts[p] = got
        return got

    def chunk(self, raw: bytes) -> bytes:
        c = raw.decode()
        if PLAIN.match(c):
            return b"".join(map(self.part, SPLIT.findall(c.lower())))
        return np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        chunks = text.split()
        known = self.chunks
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            out = []
            for c in chunks:
                got = known.get(c)
                if got is None:
                    got = self.chunk(c)
                    if len(known) < CACHED and len(c) < 64:
                        known[c] = got
                out.append(got)
            return b"".join(out)


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32()), ("row", pa.int64())])
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int, row bigint"


def token_pieces(docs: DataFrame, length: int, path: str, end_id: int) -> DataFrame:
    """A row for each piece; row numbers the documents of a salt, in an order that a rerun of a task repeats."""

    def cut(batches):
        from pyspark import TaskContext

        encode, task, n = word_tokens(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in pieces(batches, "text", 4 << 20):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary()).to_pylist()):
                ids = encode(text or b"") + end
                salt = zlib.crc32(f"{task}.{n}".encode()) % SALTS
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), salt, (task << 32) + n))
                n += 1
            for at in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 8192]), PIECES.types)], schema=PIECES)

    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(cut, PIECES_DDL)


# ---------------------------------------------------------------- bin completion over lengths

NODES = 1000  # of each depth-first search
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how often), ...), number of bins


def completions(room: int, sizes: list[int], left: np.ndarray, width: int) -> tuple[list[list[int]], bool]:
    """Undominated fillings of `room` from the sizes (descending) still there, least waste first, `width` at most; and whether these are all.

    Taking at each step the largest that fits, then the next smaller alternatives
    (width + 2 of them), visits fillings without waste early. The search ends with
    `width` of those; beyond a budget of 64 * width steps, and past 24 items, what
    is left is filled with the largest that fit. Dominated fillings go at the end.
    """
    asc = sizes[::-1]
    found: list[tuple[int, list[int]]] = []
    budget, full, whole = 64 * width, 0, True

    def fits(most: int) -> int:
        return bisect_right(asc, most) - 1

    used: dict[int, int] = {}

    def greedy(rest: int, cap: int) -> tuple[int, list[int]]:
        at, more = fits(min(rest, cap)), []
        while at >= 0 and rest:
            size = asc[at]
            n = min(int(left[size]) - used.get(size, 0), rest // size)
            more += [size] * n
            rest -= n * size
            at = min(at - 1, fits(rest))
        return rest, more

    def search(rest: int, cap: int, chosen: list[int]) -> None:
        nonlocal budget, full, whole
        if budget <= 0 or len(chosen) >= 24:
            whole = False
            waste, more = greedy(rest, cap)
            found.append((waste, chosen + more))
            return
        at, tried = fits(min(rest, cap)), 0
        while at >= 0:
            size = asc[at]
            at -= 1
            if left[size] - used.get(size, 0) <= 0:
                continue
            if tried == width + 2:
                whole = False
                return
            tried += 1
            budget -= 1
            used[size] = used.get(size, 0) + 1
            chosen.append(size)
            if rest == size:
                found.append((0, list(chosen)))
                full += 1
            else:
                search(rest - size, size, chosen)
            chosen.pop()
            used[size] -= 1
            if budget <= 0 or full >= width:
                whole = False
                return
        if tried == 0:
            found.append((rest, list(chosen)))

    search(room, room, [])
    there, out = sum(1 << s for s in sizes), []
    for waste, fill in sorted(found, key=lambda x: (x[0], len(x[1]))):
        if len(out) == width:
            return out, False
        if not dominated(fill, waste, there, left):
            out.append(fill)
    return out or [min(found, default=(0, []), key=lambda x: (x[0], len(x[1])))[1]], whole


def dominated(fill: list[int], waste: int, there: int, left: np.ndarray) -> bool:
    """Whether one item outside could take the place of some of the filling's, which would then fit where it was.

    The item is larger than those that go by `waste` at most, or as large as two
    or more of them together. `there` has a bit for each size; sums of items of
    the filling are bits, too.
    """
    for s in set(fill):
        if left[s] <= fill.count(s):
            there &= ~(1 << s)
    some, several = 0, 0  # sums of at least one item, of at least two
    for s in fill:
        several |= some << s
        some |= (some | 1) << s
    larger, reach = (some | 1) << 1 if waste else 0, 1  # sums with 1 to `reach` added
    while reach < waste:
        more = min(reach, waste - reach)
        larger |= larger << more
        reach += more
    return bool((larger | several) & there)


def best_fit(counts: np.ndarray, length: int) -> list[Pattern]:
    """Best-fit decreasing on lengths: the incumbent. All bins with the same free room are one entry."""
    out: list[Pattern] = []
    free = np.zeros(length + 1, np.int64)
    bins: dict[int, list] = {}
    for size in range(length, 0, -1):
        need = int(counts[size])
        while need:
            fit = np.flatnonzero(free[size:])
            if not len(fit):
                per = length // size
                whole, rest = divmod(need, per)
                for items, n in (((size,) * per, whole), ((size,) * rest, 1 if rest else 0)):
                    if n:
                        r = length - size * len(items)
                        bins.setdefault(r, []).append([items, n])
                        free[r] += n
                break
            r = int(fit[0]) + size
            entry = bins[r][-1]
            n = min(entry[1], need)
            entry[1] -= n
            free[r] -= n
            if not entry[1]:
                bins[r].pop()
            bins.setdefault(r - size, []).append([(*entry[0], size), n])
            free[r - size] += n
            need -= n
    for group in bins.values():
        out += [(tally(items), n) for items, n in group if n]
    return out


def tally(items) -> tuple[tuple[int, int], ...]:
    count: dict[int, int] = {}
    for x in items:
        count[x] = count.get(x, 0) + 1
    return tuple(sorted(count.items(), reverse=True))


def bound(counts: np.ndarray, length: int) -> int:
    """Bins that any packing needs: the larger of total length and Martello and Toth's bound over all thresholds."""
    n, w = np.cumsum(counts), np.cumsum(counts * np.arange(length + 1))
    k, half = np.arange(length // 2 + 1), length // 2
    over = n[length] - n[half]  # items that share no bin with each other
    mid = n[length - k] - n[half]
    small = w[half] - np.where(k, w[k - 1], 0)
    more = small - (mid * length - (w[length - k] - w[half]))
    return max(-(-int(w[length]) // length), int(over + np.maximum(0, -(-more // length)).max()))


def complete(counts: np.ndarray, length: int, width: int, turn: int, waste: int) -> list[Pattern] | None:
    """Bin completion: fill up around the largest item left, as often as the counts allow.

    Takes the best filling at each node but the second best at node `turn`; gives
    up as soon as more than `waste` is lost, as the incumbent is no worse then.
    """
    left = counts.copy()
    out: list[Pattern] = []
    largest, node = length, 0
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return out
        left[largest] -= 1
        sizes = [int(x) for x in np.flatnonzero(left)[::-1] if x <= length - largest]
        some = completions(length - largest, sizes, left, width)[0] if sizes and largest < length else [[]]
        fill = some[min(len(some) - 1, int(node == turn))]
        left[largest] += 1
        pattern = tally([largest, *fill])
        n = min(int(left[s]) // c for s, c in pattern)
        for s, c in pattern:
            left[s] -= n * c
        out.append((pattern, n))
        node += 1
        if left.any():
            waste -= n * (length - largest - sum(fill))
            if waste < 0:
                return None


def choices(left: np.ndarray, length: int, width: int) -> tuple[list[Pattern], bool]:
    """Patterns around the largest item left, each as often as the counts allow and then once; and whether these are all."""
    largest = int(np.flatnonzero(left)[-1])
    left[largest] -= 1
    sizes = [int(x) for x in np.flatnonzero(left[: length - largest + 1])[::-1]]
    fills, whole = completions(length - largest, sizes, left, width) if sizes else ([[]], True)
    left[largest] += 1
    patterns = [tally([largest, *f]) for f in fills]
    often = [(p, min(int(left[s]) // c for s, c in p)) for p in patterns]
    return often + [(p, 1) for p, n in often if n > 1], whole


def branch(counts: np.ndarray, length: int, best: list[Pattern], width: int, nodes: int) -> tuple[list[Pattern], bool]:
    """Depth-first search over choices() with backtracking; the best packing found, and whether none can be better.

    A node is left if the bins so far and the bound of what is left come to the
    incumbent. The search ends at the lower bound or after `nodes` nodes.
    """
    left, out, bins = counts.copy(), [], 0
    n, least = sum(k for _, k in best), bound(counts, length)
    if n <= least:
        return best, True
    first, whole = choices(left, length, width)
    path = [iter(first)]
    while path:
        step = next(path[-1], None)
        if step is not None:
            if not nodes:
                return best, False
            nodes -= 1
            out.append(step)
            bins += step[1]
            for s, c in step[0]:
                left[s] -= step[1] * c
            if not left.any():
                if bins < n:
                    best, n = list(out), bins
                    if n <= least:
                        return best, True
            elif bins + bound(left, length) < n:
                some, all_of = choices(left, length, width)
                whole &= all_of
                path.append(iter(some))
                continue
        else:
            path.pop()
            if not path:
                break
        pattern, k = out.pop()
        bins -= k
        for s, c in pattern:
            left[s] += k * c
    return best, whole


def pack_lengths(counts: np.ndarray, length: int = LENGTH, width: int = 4, turns: int = 3, nodes: int = NODES) -> list[Pattern]:
    """Patterns with multiplicities that hold every item; counts[s] is the number of items of length s.

    Best-fit decreasing is the first incumbent. Bin completion then takes dives
    that differ from the best filling at one of the first nodes, and after these a
    depth-first search with backtracking, `nodes` nodes with `width` fillings each,
    then as many with 4 and 16 times as many fillings. All ends as soon as the
    incumbent meets the lower bound, or a search without limits of its own is
    through: then no packing is better. The work depends on the number of
    different lengths, `length` at most, and on `nodes`, not on that of documents.
    """
    counts = np.asarray(counts, np.int64)
    best, least = best_fit(counts, length), bound(counts, length)
    n, total = sum(k for _, k in best), int((counts * np.arange(length + 1)).sum())
    for turn in range(-1, turns):
        if n <= least:
            return best
        new = complete(counts, length, width, turn, (n - 1) * length - total)
        if new is not None and (m := sum(k for _, k in new)) < n:
            best, n = new, m
    for wide in (width, 4 * width, 16 * width):
        best, done = branch(counts, length, best, wide, nodes)
        if done:
            break
    return best


# ---------------------------------------------------------------- operator


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """Packs all documents into as few sequences of at most `length` tokens as the search finds.

    docs needs doc_id and text. A document is its tokens and `end_id`; one longer
    than `length` is cut into pieces of that length, the last may be shorter.
    Null and empty texts have the end alone. Repeated and null ids are packed
    row by row. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset; an empty table gives no rows.

    Documents of one length can be swapped, so the search runs on the histogram
    of lengths (at most `length` numbers), whatever the number of documents. Its
    patterns are dealt out to documents by their rank within a length; ranks come
    from counts by (length, salt), so that no length is one group.
    """
    spark = prepare(docs.sparkSession)
    items = stored(token_pieces(docs, length, tokenizer, end_id))
    by = items.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = deal(pack_lengths(counts, length))
    before = by.select("length", "salt", F.expr("coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    local = items.withColumn("local", F.expr("row_number() over (partition by length, salt order by row, piece) - 1"))
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    shared = spark.sparkContext.broadcast(table)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        first, rank0, per, seq0, off0 = shared.value
        for b in batches:
            size, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = find(first, rank0, size, rank)
            k = rank - rank0[at]
            seq, off = seq0[at] + k // per[at], off0[at] + (k % per[at]) * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=names)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def deal(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length the segments of its ranks: first segment, rank, items a bin, sequence and offset of the segment."""
    rows, seq = [], 0
    for pattern, n in patterns:
        off = 0
        for size, c in pattern:
            rows.append((size, c, n, seq, off))
            off += size * c
        seq += n
    rows.sort(key=lambda r: (r[0], r[3]))
    most = max([r[0] for r in rows], default=0)
    a = np.array(rows, np.int64).reshape(-1, 5)
    total = a[:, 1] * a[:, 2]
    run = np.concatenate(([0], np.cumsum(total)))[:-1] if len(a) else np.zeros(0, np.int64)
    first = np.searchsorted(a[:, 0], np.arange(most + 2))
    base = run[np.minimum(first[a[:, 0]], max(0, len(a) - 1))] if len(a) else run
    return first, run - base, a[:, 1], a[:, 3], a[:, 4]


def find(first: np.ndarray, rank0: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The segment of each (size, rank): binary search within the segments of the size."""
    lo, hi = first[size], first[size + 1]
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        up = (hi - lo > 1) & (rank0[np.minimum(mid, len(rank0) - 1)] <= rank)
        down = (hi - lo > 1) & ~up
        lo, hi = np.where(up, mid, lo), np.where(down, mid, hi)
    return lo


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
