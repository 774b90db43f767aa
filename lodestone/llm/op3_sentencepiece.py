"""SentencePiece encoding as a relational lattice, and decoding."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import C1, POSITION, bucketed, mix, n_shuffle, only, pieces, prepare, read_table, release, runs, utf8

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN = 10.0  # fixed value: how far below the least score an unknown character is
MARK = "▁"
BLOCK = 1 << 20  # bytes of text, or characters, that are worked on at once
SPLIT = 4  # tasks of the lattice for each of other shuffles
STEP = 1 << 15  # characters whose numbers stay in a processor's cache
COMMON_BYTES = 32 << 20  # of parts and their ids that are sent to all tasks
LONG = 256  # parts of more characters go through the lattice in stretches
STRETCH = 128  # edges of a long part that a step of the fold goes over
WIDE = 128 * LONG  # characters of a long part in a row, before they are cut into rows of LONG


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(piece, id, score, kind, hex): kind n(ormal), b(yte) or c(ontrol); hex: the bytes that the piece stands for. Its size is the vocabulary's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        kind = "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n"
        rows.append((p, i, float(sp.get_score(i)), kind, p[3:5] if kind == "b" else p.replace(MARK, " ").encode().hex().upper() if kind == "n" else ""))
    return spark.createDataFrame(rows, "piece string, id int, score double, kind string, hex string").coalesce(1)


class Cutter:
    """Cuts texts, in which blanks are marks and one more goes in front, between characters of different classes (letters, digits, others), or of one class, that no piece has side by side.

    Also before each run of marks, as no piece has a mark after another character,
    but never after a mark. Where any piece holds two classes in a row, they count
    as one; a character of a doubtful class is only cut off less often than it
    could be. Null and empty texts have no parts.
    """

    def __init__(self, pieces: list[str]):
        odd = re.escape("".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
        kinds = {"l": rf"[^\W\d_{odd}]", "d": "[0-9]", "o": rf"(?![0-9{MARK}])[\W\d_{odd}]"}
        kind = lambda c: "m" if c == MARK else next(k for k in kinds if re.match(kinds[k], c))
        met = {(kind(x), kind(y)) for x, y in {xy for p in pieces for xy in zip(p, p[1:])}} - {("m", k) for k in "mldo"}
        group = {k: {k} for k in kinds}
        for x, y in met:
            both = group[x] | group[y]
            group |= dict.fromkeys(both, both)
        self.kind, self.joint = np.zeros(0x110000, np.uint8), np.zeros((4, 4), bool)
        for i, x in enumerate(kinds, 1):
            for low, high in ((0, 0xD800), (0xE000, 0x110000)):
                for m in re.finditer(f"(?:{kinds[x]})+", "".join(map(chr, range(low, high)))):
                    self.kind[low + m.start() : low + m.end()] = i
            for j, y in enumerate(kinds, 1):
                self.joint[i, j] = y in group[x] and (len(group[x]) > 1 or (x, x) in met)
        self.kind[[0x20, ord(MARK)]] = 0
        self.joint[0] = True

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts, their code points, where parts start and the last ends, the first part of each text and one past the last)."""
        whole = "".join([MARK + t if t else "" for t in texts]).replace(" ", MARK)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        off = runs(np.array([len(t) + 1 if t else 0 for t in texts], np.int64))
        k = self.kind[points]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = ~self.joint.ravel()[k[:-1] * 4 + k[1:]]
        edge[off] = True
        start = np.flatnonzero(edge)
        return whole, points, start, np.searchsorted(start, off)

    def __call__(self, text: str) -> list[str]:
        """The parts of one text, as it stands: without a mark in front."""
        whole, _, start, _ = self.cut([text])
        parts = [whole[a:b] for a, b in zip(start.tolist(), start[1:].tolist())]
        return [p for p in [parts[0][1:], *parts[1:]] if p] if parts else []


def blocks(start: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """start in slices of about `size` characters, of whole parts, each slice with the end of its last."""
    at = 0
    while at < len(start) - 1:
        to = max(at + 1, int(np.searchsorted(start, start[at] + size, "right")) - 1)
        yield start[at : to + 1]
        at = to


def names_of(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit name for each part. Different parts may share one: who looks names up compares the parts as well."""
    out = [np.zeros(0, np.uint64)]
    for s in blocks(start, STEP):
        first, size = s[:-1], np.diff(s)
        with np.errstate(over="ignore"):
            v = points[s[0] : s[-1]] * C1
            v ^= v >> np.uint64(32)
            v *= POSITION[(np.arange(s[0], s[-1]) - np.repeat(first, size)) & (len(POSITION) - 1)]
            v ^= v >> np.uint64(29)
            out.append(mix(np.add.reduceat(v, first - s[0]), size.astype(np.uint64), 3))
    return np.concatenate(out)


def same(points: np.ndarray, start: np.ndarray, size: np.ndarray, others: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Whether each part, of `size` characters from `start`, is what `others` has from `where`. No part is empty."""
    if not len(size):
        return np.zeros(0, bool)
    first = runs(size)[:-1]
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.logical_and.reduceat(points[step + np.repeat(start, size)] == others[step + np.repeat(where, size)], first)


def parts_of(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(part, n, long): the different parts of texts, how often they come up, and whether they have over LONG characters; added up by block, then by task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cutter)

    def make(batches):
        for b in pieces(batches, "text", BLOCK):
            whole, points, start, _ = shared.value.cut(b.column(0).to_pylist())
            for s in blocks(start, BLOCK):
                _, first, which, n = np.unique(names_of(points, s), return_index=True, return_inverse=True, return_counts=True)
                size = np.diff(s)
                alike = size == size[first][which]
                alike[alike] = same(points, s[:-1][alike], size[alike], points, s[:-1][first][which][alike])
                lone = np.flatnonzero(~alike)
                n = np.concatenate((n - np.bincount(which[lone], minlength=len(n)), np.ones(len(lone), np.int64)))
                at = np.concatenate((first, lone))
                names = [whole[x:y] for x, y in zip(s[at].tolist(), s[at + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.int64)), pa.array(np.diff(s)[at] > LONG)], names=["part", "n", "long"])

    counted = only(docs, ("text", "string")).mapInArrow(make, "part string, n bigint, long boolean")
    return counted.groupBy("part").agg(F.sum("n").alias("n"), F.max("long").alias("long"))


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(part, n, ids) from (part, n, long): the segmentation with the largest sum of scores, ties to the longer last piece.

    Substrings up to the longest piece are exploded and joined to the piece
    table, which is broadcast (its size is the vocabulary's); edges are grouped
    by part, and the fold goes over them by their ends. A character that is no
    piece has an edge of the least score less UNKNOWN, and becomes bytes.

    Parts of up to LONG characters are grouped without a shuffle, as they are
    dealt by themselves already; their number in the task comes first in the
    key, so that the sort finds its rows in order. The fold keeps the best path
    to each of the last places that a piece can start from.

    A longer part (`long` says so) is exploded from stretches that overlap by the
    longest piece, so that no row holds all of it, and its edges meet by its MD5.
    The fold goes over stretches of edges and keeps a back-pointer for each
    place; a second fold follows them from the end. Time is linear in the length
    but for one reference a stretch, which is copied with each stretch.
    """
    usual = pieces.where("kind = 'n'").select("piece", "id", "score", F.length("piece").alias("m"))
    longest, least = usual.agg(F.max("m"), F.min("score")).first()
    byte_ids = [r.id for r in pieces.where("kind = 'b'").orderBy("hex").collect()]
    table = F.array(*[F.lit(i) for i in byte_ids])
    raw = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.get(table, F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def edges_of(texts: DataFrame, text: str, keep: list[str], first, to) -> DataFrame:
        """keep and edge, for the pieces in `text` that start at its characters 1 to `to`; `first` is added to their places."""
        cols = [*keep, *({text} - set(keep)), first.alias("first")]
        at = texts.select(*cols, F.explode(F.sequence(F.lit(1), to)).alias("s"))
        cut = at.select(*at.columns, F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(text) - F.col("s") + 1))).alias("m"))
        cut = cut.select(*keep, (F.col("first") + F.col("s")).alias("s"), "m", F.col(text).substr(F.col("s"), F.col("m")).alias("piece"))
        met = cut.join(F.broadcast(usual.drop("m")), "piece", "left").where("id is not null or m = 1")
        edge = F.struct((F.col("s") + F.col("m") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.coalesce("score", F.lit(least - UNKNOWN)).alias("w"), "id", F.when(F.col("id").isNull(), as_bytes).alias("raw"))
        return met.select(*keep, edge.alias("edge"))

    better = "a[size(a) - 1].w < a[x.s - a[0].e].w + x.w"
    step = "named_struct('e', x.e, 'w', a[x.s - a[0].e].w + x.w, 'ids', concat(a[x.s - a[0].e].ids, coalesce(x.raw, array(x.id))))"
    best = f"""aggregate(edges, array(named_struct('e', 0, 'w', 0.0D, 'ids', cast(array() as array<int>))),
        (a, x) -> CASE WHEN a[size(a) - 1].e < x.e THEN array_append(IF(size(a) > {longest}, slice(a, 2, {longest}), a), {step})
                       WHEN {better} THEN array_append(slice(a, 1, size(a) - 1), {step})
                       ELSE a END,
        a -> a[size(a) - 1].ids)"""
    few = words.where("not long").select(F.monotonically_increasing_id().alias("at"), "part", "n")
    grouped = edges_of(few, "part", ["at", "part", "n"], F.lit(0), F.length("part")).groupBy("at", "part").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    short = grouped.select("part", "n", F.expr(best).alias("ids"))

    point = "named_struct('e', x.e, 'w', a[x.s - a[0].e].w + x.w, 's', x.s, 'id', x.id, 'raw', x.raw)"
    start = "array(named_struct('e', 0, 'w', 0.0D, 's', -1, 'id', cast(null as int), 'raw', cast(null as array<int>)))"
    some = f"transform(sequence(k * {STRETCH}, least(size(edges), (k + 1) * {STRETCH}) - 1), i -> edges[i])"
    inner = f"""aggregate({some}, b.a, (a, x) -> CASE WHEN a[size(a) - 1].e < x.e THEN array_append(a, {point})
                       WHEN {better} THEN array_append(slice(a, 1, size(a) - 1), {point}) ELSE a END)"""
    # a step of a fold copies arrays and rows that it holds, but not binary values: so what is done leaves the fold as one
    text = "concat_ws(':', y.e, y.s, coalesce(array_join(transform(y.raw, i -> cast(i as string)), ' '), cast(y.id as string)))"
    packed = lambda rows: f"encode(array_join(transform(filter({rows}, y -> y.e > 0), y -> {text}), ','), 'UTF-8')"
    rows = packed(f"slice(a, 1, greatest(0, size(a) - {longest + 1}))")  # their place is passed: no edge that follows starts or ends there
    held = f"slice(a, greatest(1, size(a) - {longest}), {longest + 1})"
    forth = f"""aggregate(sequence(0, (size(edges) - 1) div {STRETCH}), named_struct('a', {start}, 'out', cast(array() as array<binary>)),
        (b, k) -> transform(array({inner}), a -> named_struct('a', {held}, 'out', array_append(b.out, {rows})))[0], b -> array_append(b.out, {packed("b.a")}))"""
    split = "transform(filter(split(decode(r, 'UTF-8'), ','), z -> z <> ''), z -> split(z, ':'))"
    back = f"""aggregate(reverse(best), named_struct('want', length(part), 'out', cast(array() as array<binary>)),
        (b, r) -> transform(array(aggregate(reverse({split}), named_struct('want', b.want, 'ids', cast(array() as array<string>)),
            (c, y) -> IF(cast(y[0] as int) = c.want, named_struct('want', cast(y[1] as int), 'ids', array_prepend(c.ids, y[2])), c))),
            c -> named_struct('want', c.want, 'out', array_append(b.out, encode(array_join(c.ids, ' '), 'UTF-8'))))[0],
        b -> flatten(transform(filter(reverse(b.out), z -> length(z) > 0), z -> transform(split(decode(z, 'UTF-8'), ' '), i -> cast(i as int)))))"""
    # n is in the hash so that all branches read the same columns, and thus the same exchange
    many = words.where("long").select(F.md5(F.concat_ws(" ", "part", F.col("n").cast("string"))).alias("at"), "part", "n")
    wide = many.select("at", "part", F.explode(F.sequence(F.lit(0), F.floor((F.length("part") - 1) / WIDE).cast("int"))).alias("b"))
    wide = wide.select("at", (F.col("b") * WIDE).alias("first"), F.col("part").substr(F.col("b") * WIDE + 1, F.lit(WIDE + longest)).alias("text")).repartition("at", "first")
    near = wide.select("at", "first", "text", F.explode(F.sequence(F.lit(0), F.least(F.lit(WIDE // LONG - 1), F.floor((F.length("text") - 1) / LONG).cast("int")))).alias("b"))
    near = near.select("at", (F.col("first") + F.col("b") * LONG).alias("first"), F.col("text").substr(F.col("b") * LONG + 1, F.lit(LONG + longest - 1)).alias("text"))
    edges = edges_of(near, "text", ["at"], F.col("first"), F.least(F.lit(LONG), F.length("text")))
    named = many.select("at", "part", "n", F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"))
    both = edges.select("at", F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("n"), "edge").unionByName(named)
    whole = both.groupBy("at").agg(F.max("part").alias("part"), F.max("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    long = whole.select("part", "n", F.expr(forth).alias("best")).select("part", "n", F.expr(back).alias("ids"))
    return short.unionByName(long)


def lexicon(docs: DataFrame, table: DataFrame, cutter: Cutter, kind: np.dtype) -> DataFrame:
    """(part, n, code): the lattice of all parts of docs, its ids as bytes, stored in buckets by part.

    Edges are grouped in order of their parts: a part's edges are in memory, not a
    task's. As edges take many times the room of parts, the tasks are SPLIT times
    as many as usual, and aren't joined up again by the size of their parts.
    """
    spark = docs.sparkSession
    n = n_shuffle(spark)
    wanted = {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(SPLIT * n)}
    before = {k: spark.conf.get(k, "true") for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        code = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2 * kind.itemsize, "0")), ""))
        return bucketed(lattice(parts_of(docs, cutter), table).select("part", "n", code.alias("code")), "part", "zstd", n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Table:
    """Parts and their codes, a few arrays in place of many objects: found by a name, then compared."""

    def __init__(self, parts: list[str], codes: list[bytes]):
        start = runs(np.array([len(p) for p in parts], np.int64))
        names = names_of(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), start)
        order = np.argsort(names, kind="stable").tolist()
        self.names, self.points = names[order], np.frombuffer("".join([parts[i] for i in order]).encode("utf-32-le"), np.uint32)
        self.start = runs(np.diff(start)[order]).astype(np.int32)
        self.code, self.code_off = np.frombuffer(b"".join([codes[i] for i in order]), np.uint8), runs(np.array([len(codes[i]) for i in order], np.int64)).astype(np.int32)

    def __getstate__(self) -> bytes:
        """Compressed: each executor keeps a broadcast on its disk."""
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(self.__dict__, protocol=5))

    def __setstate__(self, raw: bytes) -> None:
        self.__dict__.update(pickle.loads(zstandard.ZstdDecompressor().decompress(raw)))

    def at(self, points: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place of each part in the table; -1 for those that it has not."""
        out = [np.zeros(0, np.int64)]
        for s in blocks(start, STEP) if len(self.names) else []:
            names, size = names_of(points, s), np.diff(s)
            to = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            met = (self.names[to] == names) & (self.start[to + 1] - self.start[to] == size)
            met[met] = same(points, s[:-1][met], size[met], self.points, self.start[to][met])
            out.append(np.where(met, to, -1))
        return np.concatenate(out) if len(self.names) else np.full(len(start) - 1, -1)

    def find(self, parts: list[str]) -> dict[str, bytes]:
        """The codes of those parts that it has."""
        at = self.at(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), runs(np.array([len(p) for p in parts], np.int64)))
        return {p: self.code[self.code_off[i] : self.code_off[i + 1]].tobytes() for p, i in zip(parts, at.tolist()) if i >= 0}


def frequent(found: DataFrame, room: int = COMMON_BYTES) -> Table:
    """The most frequent parts, as many classes of like frequency as take `room` bytes together.

    Those left out come up no more often than the last class taken: together the
    classes down to theirs take over `room` bytes, so a part that is left out
    comes up in at most (bytes of the corpus) / room places, whatever its length.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    some = found.withColumn("level", level)
    sizes = some.groupBy("level").agg(F.sum(F.octet_length("part") + F.octet_length("code") * 2 + 16).alias("b")).orderBy(F.desc("level")).collect()
    least = None
    for r in sizes:
        room -= r.b
        if room < 0:
            break
        least = r.level
    rows = some.where(F.col("level") >= least if least is not None else F.lit(False)).select("part", "code").toArrow()
    return Table(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def encode(docs: DataFrame, model: str = MODEL, room: int = COMMON_BYTES) -> DataFrame:
    """(doc_id, ids) for each row of docs. Null and empty texts have no pieces; null and repeated ids are rows like others.

    Each different part of a word is encoded once, by the lattice. The most frequent
    parts, up to `room` bytes, are sent to all tasks and put into the texts at once;
    the others leave holes, and meet the lexicon in a join. As frequent parts take
    no part in that join, none of its keys is hot (see frequent()). Coded texts are stored
    once, bucketed by row, and aren't moved again; before that the shuffle files
    of the lattice are let go. An empty table gives no rows; a text without blanks
    is one long part (see lattice()). Other columns of docs, whatever their names, are ignored.
    """
    spark = prepare(docs.sparkSession)
    table = piece_table(spark, model)
    cutter = Cutter([r.piece for r in table.where("kind = 'n'").select("piece").collect()])
    kind = np.dtype(">u2" if table.count() < 0xFFFF else ">u4")
    hole = int(np.iinfo(kind).max)
    found = lexicon(docs, table, cutter, kind)
    common = spark.sparkContext.broadcast((frequent(found, room), cutter))
    release(spark)
    mark = hole.to_bytes(kind.itemsize, "big")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("code", pa.binary()), ("rare", pa.list_(pa.string()))])

    def code(batches):
        known, cutter = common.value
        codes, off = np.concatenate((known.code, np.frombuffer(mark, np.uint8))), np.append(known.code_off, known.code_off[-1] + len(mark))
        for b in pieces(batches, "text", BLOCK):
            whole, points, start, first = cutter.cut(b.column(2).to_pylist())
            at = known.at(points, start)
            rare = np.flatnonzero(at < 0)
            at[rare] = len(off) - 2
            size = off[at + 1] - off[at]
            to = runs(size)
            raw = codes[np.arange(to[-1]) + np.repeat(off[at] - to[:-1], size)]
            packed = [raw[x:y].tobytes() for x, y in zip(to[first].tolist(), to[first[1:]].tolist())]  # Parquet compresses many texts together
            names = [whole[x:y] for x, y in zip(start[rare].tolist(), start[rare + 1].tolist())]
            rares = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), pa.array(names, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), rares], schema=schema)

    def fill(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, data_off = utf8(b.column(1))
            off, ids = data_off // kind.itemsize, data.view(kind).astype(np.int32)
            gap, gap_off = utf8(b.column(2).flatten())
            size = np.ones(len(ids), np.int64)
            empty = ids == hole
            size[empty] = np.diff(gap_off) // kind.itemsize
            whole = np.repeat(ids, size)
            whole[np.repeat(empty, size)] = gap.view(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(runs(size)[off].astype(np.int32)), pa.array(whole))], names=["doc_id", "ids"])

    numbered = only(docs, ("doc_id", "bigint"), ("text", "string")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    coded = bucketed(numbered.mapInArrow(code, "row bigint, doc_id bigint, code binary, rare array<string>"), "row", "zstd")
    rare = coded.select("row", F.posexplode("rare").alias("pos", "part")).join(found.select("part", "code"), "part")
    gap = F.concat(F.unhex(F.lpad(F.hex("pos"), 8, "0")), "code")  # one value, less than a struct on its way: sorted by its place
    gaps = rare.select("row", gap.alias("gap")).groupBy("row").agg(F.transform(F.sort_array(F.collect_list("gap")), lambda x: F.substring(x, 5, 1 << 30)).alias("gaps"))
    whole = coded.select("row", "doc_id", "code").join(gaps, "row", "left").select("doc_id", "code", F.coalesce("gaps", F.array().cast("array<binary>")).alias("gaps"))
    return whole.mapInArrow(fill, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the exact inverse of encode() for valid text."""
    table = [r.hex for r in piece_table(encoded.sparkSession, model).orderBy("id").select("hex").collect()]
    names = encoded.sparkSession.createDataFrame([(table,)], "hexes array<string>")
    joined = encoded.join(F.broadcast(names))
    raw = F.array_join(F.transform("ids", lambda i: F.get(F.col("hexes"), i)), "")
    return joined.withColumn("r", raw).select("doc_id", F.expr("substring(decode(unhex(r), 'UTF-8'), 2)").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids")
