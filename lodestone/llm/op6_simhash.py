"""Near-duplicates by SimHash: candidates by the pigeonring principle, links by the Hamming distance, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import near_copies
from lodestone.llm.common import only, pieces, prepare, read_table, release, stored
from lodestone.llm.components import covering, smallest_label

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
DIRECT = 32  # larger groups of candidates go by neighbours in place of pairs
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


# ---------------------------------------------------------------- fingerprints


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles; no words: 0."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    lo, hi = start[: len(parts) - shingle + 1], (start + size)[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.bitwise_or.reduce(np.where(2 * count > len(h), np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, print): the 64 bits as a signed number. Null text has no words."""

    def make(batches):
        for b in pieces(batches, "text", 4 << 20):
            texts = pc.cast(b.column(1), pa.binary()).to_pylist()
            got = np.array([simhash(t or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], schema=PRINTS)

    return only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(make, "doc_id bigint, print bigint")


# ---------------------------------------------------------------- candidates and links


def ring(distance: int) -> tuple[list[tuple[int, int]], int]:
    """Segments (shift, width) of the ring, and how many in a row must be equal.

    With m segments and distance d, some chain of segments keeps its sum of
    differences within l * d / m for each of its lengths l. While l * d / m is
    under 1 the chain has no difference at all: the first ceil(m / d) - 1
    segments are equal, and these make the key of a candidate.
    """
    m = max(1, min(BITS, 4 * distance + 1))
    edge = [BITS * i // m for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(m)], (-(-m // distance) - 1 if distance else m)


def chain(diff: F.Column, start: F.Column, distance: int) -> F.Column:
    """Whether the chain from segment `start` keeps within its budget at every length."""
    segments, equal = ring(distance)
    m = len(segments)
    per = F.array(*[F.bit_count(diff.bitwiseAND(F.lit(signed(((1 << w) - 1) << s)))) for s, w in segments])
    ok, total = F.lit(True), F.lit(0)
    for k in range(m):
        total = total + F.element_at(per, (start + k) % m + 1)
        ok = ok & (total * m <= distance * (k + 1))
    return ok


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(distance: int) -> F.Column:
    segments, equal = ring(distance)
    m = len(segments)
    masks = []
    for i in range(m):
        bits = 0
        for k in range(equal):
            s, w = segments[(i + k) % m]
            bits |= ((1 << w) - 1) << s
        masks.append(F.struct(F.lit(i).alias("i"), F.col("print").bitwiseAND(F.lit(signed(bits))).alias("key")))
    return F.inline(F.array(*masks))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that join any two different prints within the distance, by a path of such links.

    Prints that share no chain key with another are out. Groups of up to DIRECT
    prints are compared by pairs: chain budgets first, then the Hamming check. In
    a larger group no pairs are made: each print names all prints within half the
    distance of it (rounded up and down in turn), and prints that name one and
    the same print are within the distance; each joins the smallest of them.
    That is for distances 1 and 2; for others, where a print would name too many,
    groups are compared with leaders and then across their parts (covering()).
    Keys have about 64 / distance bits, so large distances make large groups.
    """
    if not 0 <= distance <= BITS:
        raise ValueError(f"distance is 0 to {BITS}")
    if distance not in (1, 2):
        node = prints.select("print").distinct().select(F.col("print").alias("node"), "print")
        member, values = node.select("node", keys(distance)), node.select("node", F.col("print").alias("value"), F.lit(8).alias("size"))
        differ = lambda xs, ys: np.bitwise_count(xs.to_numpy()[:, None].view(np.uint64) ^ ys.to_numpy()[None, :].view(np.uint64))
        return covering(member, values, lambda pairs: pairs.withColumn("d", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))), differ, distance, ["i", "key"])
    keyed = prints.select("print", keys(distance))
    size = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = stored(keyed.join(size, ["i", "key"]))
    small = member.where(F.col("n") <= DIRECT)
    a = small.select("i", "key", F.col("print").alias("a"))
    b = small.select("i", "key", F.col("print").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["i", "key"]).where((F.col("a") > F.col("b")) & chain(diff, F.col("i"), distance) & (F.bit_count(diff) <= distance)).select("a", "b")
    flips = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(signed(1 << k))) for k in range(BITS)])
    if distance == 1:  # a flip of one is the other itself
        named = member.where(F.col("n") > DIRECT).select("print").distinct()
        flipped = named.select(F.col("print").alias("a"), F.explode(flips).alias("b"))
        stars = flipped.join(named.select(F.col("print").alias("b")), "b", "left_semi").select("a", "b").where("a > b")
    else:
        named = member.where(F.col("n") > DIRECT).select("print").distinct().select("print", F.explode(flips).alias("name"))
        least = named.groupBy("name").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1")
        stars = named.join(least, "name").select(F.col("print").alias("a"), "b").where("a > b").distinct()
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): each document's fingerprint and the smallest doc_id it reaches by links.

    Equal fingerprints are one class from the start, so copies make no pairs.
    Null and empty texts have fingerprint zero and are linked like others. A row
    of docs gives a row; rows with a null doc_id are in components too, and their
    component is null only if no member has an id. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, shingle))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    label = smallest_label(links(classes.select("print"), distance))
    joined = classes.join(label, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    component = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = joined.join(component, "label").select("print", "component_id")
    return prints.join(of, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- texts of a given similarity

WIDE = 64 * near_copies.PRINT
RING = 16  # segments of a wide print
CHAIN = 4  # segments in a row that are looked at before the whole print


def budget(similarity: float) -> int:
    """Differing bits of wide prints that texts of that Jaccard similarity hardly ever exceed.

    A bit differs with the angle of the two shingle sets over pi, a little more
    for sets of a few shingles (half the distance of the similarity at most); the
    rest is five standard deviations.
    """
    p = max(np.arccos(2 * similarity / (1 + similarity)) / np.pi, 0.94 * (1 - similarity))
    return int(np.ceil(WIDE * p + 5 * np.sqrt(WIDE * p * (1 - p))))


def chained(a: F.Column, b: F.Column, distance: int) -> tuple[F.Column, F.Column]:
    """Differences by segment, and whether these (in a column `per`) are within the distance, by pigeonring: from some segment
    of the ring on they keep to a proportional budget for CHAIN segments, and all of them to the whole budget."""
    size = WIDE // RING
    per = [F.bit_count(F.element_at(a, i * size // 64 + 1).bitwiseXOR(F.element_at(b, i * size // 64 + 1)).bitwiseAND(F.lit(signed(((1 << size) - 1) << (i * size % 64))))) for i in range(RING)]
    starts = []
    for start in range(RING):
        total, ok = F.lit(0), F.lit(True)
        for k in range(CHAIN):
            total = total + F.get(F.col("per"), F.lit((start + k) % RING))
            ok = ok & (total * RING <= distance * (k + 1))
        starts.append(ok)
    some = starts[0]
    for s in starts[1:]:
        some = some | s
    return F.array(*per), some & (F.aggregate("per", F.lit(0), lambda x, y: x + y) <= distance)


def kept(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row): one row of each component of the texts that are linked by a Jaccard similarity of at least `similarity` in word shingles.

    docs needs row (not null, the same only where doc_id and text are), doc_id and
    text. It is the row with the smallest doc_id, null ids last, then the smallest row. Texts of the same
    words are one node from the start; blank and null texts are one node. An
    empty table gives no rows; other columns of docs are ignored.

    SimHash prints of 256 bits are compared by pigeonring under a budget wide
    enough for the similarity, and exact shingle sets decide what is left. At a
    budget of 80 in 256 bits a chain without any difference is 3 bits long, so
    keys of equal segments, as links() has them, would make all texts candidates;
    MinHash bands propose the pairs instead. A link is missed where no band
    agrees (5 in 10^8 at 0.8) or the budget is exceeded (under 1 in 10^6).
    """
    spark = prepare(docs.sparkSession)
    marked = stored(near_copies.marks(docs, width))
    classes = stored(marked.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"), F.min("row").alias("row")))
    one = marked.select("row", F.col("class").alias("node"), "bands", "print").join(classes.select("row"), "row", "left_semi").dropDuplicates(["node"])
    member = one.select("node", F.posexplode("bands").alias("i", "key"))
    shared = stored(member.join(member.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1").select("i", "key"), ["i", "key"]))
    nodes = classes.join(shared.select(F.col("node").alias("class")).distinct(), "class", "left_semi").select(F.col("class").alias("node"), "row")
    texts = stored(docs.select("row", "text").join(nodes, "row").select("node", "text").dropDuplicates(["node"]))
    prints = stored(one.select("node", "print").join(nodes.select("node"), "node", "left_semi"))
    release(spark)

    def measure(pairs: DataFrame) -> DataFrame:
        a, b = prints.select(F.col("node").alias("a"), F.col("print").alias("p")), prints.select(F.col("node").alias("b"), F.col("print").alias("q"))
        per, ok = chained(F.col("p"), F.col("q"), budget(similarity))
        near = pairs.join(a, "a").join(b, "b").select("a", "b", per.alias("per")).where(ok).select("a", "b")
        return near_copies.measured(near, texts, width)

    values = texts.select("node", F.col("text").alias("value"), F.octet_length("text").alias("size"))
    label = smallest_label(covering(shared, values, measure, lambda xs, ys: near_copies.between(xs, ys, width), 1 - similarity + 1e-9, ["i", "key"]))
    found = classes.join(label, F.col("class") == F.col("node"), "left").select(F.coalesce("label", "class").alias("label"), "best")
    return found.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
