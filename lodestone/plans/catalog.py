"""Named queries over the tables of a folder, each with the SQL that gives the same rows.

Doubles are rounded on both sides. Queries without SQL are those that are random
or run as streams; their tests are in tests/.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import affine_family, seeded
from lodestone.operators import cluster, graph, itemsets, mapreduce, similarity, sketch
from lodestone.session import ensure_checkpoints
from lodestone.sources import tables
from lodestone.streaming import streams

N_HASH, BANDS, THRESHOLD, SEED = 120, 40, 0.6, 246
ITEM_SUPPORT, PAIR_SUPPORT, SPARSE_SUPPORT, CHUNKS = 200, 320, 2, 8
N_BITS, K = 1 << 14, 7
STEPS = 5
CENTROIDS, DIMS, WHOLE = 4, 8, 64

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def named(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def docs(spark, d):
    return tables.table(spark, d, "documents")


# ---------------------------------------------------------------- map/reduce

WORDS = "words AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t]+')) AS word FROM documents)"


@named(f"WITH {WORDS} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY word")
def word_count(spark, d):
    return mapreduce.word_count(mapreduce.words_of(docs(spark, d)))


@named(f"WITH {WORDS} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY word")
def word_count_combined(spark, d):
    words = mapreduce.words_of(docs(spark, d)).select("word", F.lit(1).cast("bigint").alias("one"))
    return mapreduce.map_reduce(words, lambda k, v: [(k, v)], lambda k, vs: [(k, sum(vs))], "word string, n bigint", combiner=lambda k, vs: [sum(vs)])


@named(f"WITH {WORDS} SELECT count(DISTINCT word) AS n FROM words WHERE word <> ''")
def distinct_words(spark, d):
    return mapreduce.distinct_count(mapreduce.words_of(docs(spark, d)))


@named("SELECT sum(n)::BIGINT AS pairs, count(*) AS combined FROM (SELECT l_orderkey % 8, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def shuffle_volume(spark, d):
    return mapreduce.shuffle_volume(tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("word")))


@named("SELECT event_type AS k, count(*) AS v FROM events GROUP BY 1")
def map_reduce_engine(spark, d):
    pairs = tables.table(spark, d, "events").select("event_id", "event_type")
    total = lambda k, vs: [(k, sum(vs))]
    return mapreduce.map_reduce(pairs, lambda k, v: [(v, 1)], total, "k string, v bigint", combiner=lambda k, vs: [sum(vs)])


@named("SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def matrix_vector(spark, d):
    m = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("m"))
    v = tables.table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("v"))
    return rounded(mapreduce.matrix_vector(m, v), "x", places=4)


@named(f"WITH b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS t FROM orders) SELECT (pos // greatest(1, ceil(t / {CHUNKS})::BIGINT))::INTEGER AS chunk, count(*) AS n FROM b GROUP BY 1")
def chunk_sizes(spark, d):
    pos = mapreduce.positions(tables.table(spark, d, "orders"), "o_orderkey")
    return mapreduce.chunked(pos, CHUNKS, "pos").groupBy("chunk").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- similarity: documents as sets of five-word shingles, one of each different set

SETS = (
    "w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t]+'), lambda x: x <> '') AS w FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM w WHERE len(w) > 0), "
    "h AS (SELECT doc_id, list_sort(list_distinct(list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % 2147483648))) AS items FROM s), "
    "sets AS (SELECT min(doc_id) AS doc, items FROM h GROUP BY items)"
)
PAIRS = f"long AS (SELECT doc, unnest(items) AS item, len(items) AS m FROM sets), truth AS (SELECT i, j, n / (m1 + m2 - n) AS sim FROM (SELECT a.doc AS i, b.doc AS j, any_value(a.m) AS m1, any_value(b.m) AS m2, count(*) AS n FROM long a JOIN long b ON a.item = b.item AND a.doc < b.doc GROUP BY 1, 2) WHERE n / (m1 + m2 - n) >= {THRESHOLD})"
FAMILY = affine_family(N_HASH, SEED)
SIGS = "sigs AS (SELECT doc, [" + ", ".join(f"list_min(list_transform(items, lambda x: ({a} * x + {b}) % 2147483647))" for a, b in FAMILY) + "] AS sig FROM sets)"
KEYS_OF = "[" + ", ".join(f"'{k}:' || array_to_string(sig[{s}:{s + n - 1}], '-')" for k, (s, n) in enumerate(similarity.bands_of(N_HASH, BANDS))) + "]"
CAND = f"keyed AS (SELECT doc, unnest({KEYS_OF}) AS key FROM sigs), cand AS (SELECT DISTINCT a.doc AS i, b.doc AS j FROM keyed a JOIN keyed b ON a.key = b.key AND a.doc < b.doc)"
JACC = "len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))"
FOUND = f"found AS (SELECT i, j, {JACC} AS sim FROM cand JOIN sets a ON a.doc = i JOIN sets b ON b.doc = j WHERE {JACC} >= {THRESHOLD})"


def document_sets(spark, d):
    return similarity.distinct_sets(similarity.shingles(docs(spark, d)))


def sigs(spark, d):
    return similarity.signatures(document_sets(spark, d), N_HASH, SEED)


@named(f"WITH {SETS} SELECT doc_id AS doc, min(doc_id) OVER (PARTITION BY items) AS representative FROM h")
def similar_classes(spark, d):
    return similarity.membership(similarity.shingles(docs(spark, d)))


@named(f"WITH {SETS}, {SIGS} SELECT doc, array_to_string(sig, ',') AS sig FROM sigs")
def minhash_signatures(spark, d):
    return sigs(spark, d).select("doc", F.array_join("sig", ",").alias("sig"))


@named(f"WITH {SETS}, {SIGS}, {CAND} SELECT i, j FROM cand")
def lsh_candidates(spark, d):
    return similarity.candidates(sigs(spark, d), N_HASH, BANDS)


@named(f"WITH {SETS}, {SIGS}, {CAND}, {FOUND} SELECT i, j, round(sim, 6) AS sim FROM found")
def lsh_similar_pairs(spark, d):
    return rounded(similarity.banded_pairs(document_sets(spark, d), THRESHOLD, N_HASH, BANDS, SEED), "sim")


@named(f"WITH {SETS}, {PAIRS} SELECT i, j, round(sim, 6) AS sim FROM truth")
def exact_similar_pairs(spark, d):
    return rounded(similarity.exact_pairs(document_sets(spark, d), THRESHOLD), "sim")


@named(f"WITH {SETS}, {SIGS}, {CAND}, {FOUND}, {PAIRS}, c AS (SELECT (SELECT count(*) FROM found) AS n_found, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM found JOIN truth USING (i, j)) AS n_both) SELECT *, coalesce(round(n_both / nullif(n_truth, 0), 6), 1.0) AS recall, coalesce(round(n_both / nullif(n_found, 0), 6), 1.0) AS precision FROM c")
def lsh_quality(spark, d):
    s = document_sets(spark, d)
    return rounded(similarity.quality(similarity.banded_pairs(s, THRESHOLD, N_HASH, BANDS, SEED), similarity.exact_pairs(s, THRESHOLD)), "recall", "precision")


@named(f"WITH {SETS}, {SIGS}, {CAND}, {FOUND}, {PAIRS} SELECT (SELECT count(*) FROM sets) AS n, (SELECT count(*) * (count(*) - 1) // 2 FROM sets) AS all_pairs, (SELECT count(*) FROM cand) AS lsh_comparisons, (SELECT count(*) FROM found) AS lsh_pairs, (SELECT count(*) FROM truth) AS exact_pairs")
def similarity_comparisons(spark, d):
    """How many pairs all pairs and the bands compare, and how many similar ones each finds."""
    s = document_sets(spark, d)
    cand = similarity.candidates(similarity.signatures(s, N_HASH, SEED), N_HASH, BANDS)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    n = count(s, "n").select("n", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("all_pairs"))
    parts = [count(cand, "lsh_comparisons"), count(similarity.verified(cand, s, THRESHOLD), "lsh_pairs"), count(similarity.exact_pairs(s, THRESHOLD), "exact_pairs")]
    for p in parts:
        n = n.join(F.broadcast(p))
    return n


DRAW = lambda x: f"('0x' || substr(md5('{SEED}:' || {x}), 1, 15))::BIGINT % 8"
SIZES = (1, 2, 4, 8)  # eighths


@named(
    f"WITH {SETS}, {SIGS}, {CAND}, {FOUND}, {PAIRS}, d AS (SELECT doc, {DRAW('doc')} AS draw FROM sets), l AS (SELECT unnest([1, 2, 4, 8]) AS size), "
    + ", ".join(f"{t}_d AS (SELECT greatest(x.draw, y.draw) AS draw FROM {t} JOIN d x ON x.doc = i JOIN d y ON y.doc = j)" for t in ("cand", "found", "truth"))
    + " SELECT size::INTEGER AS size, (SELECT count(*) FROM d WHERE draw < size) AS n, (SELECT count(*) * (count(*) - 1) // 2 FROM d WHERE draw < size) AS all_pairs, "
    + ", ".join(f"(SELECT count(*) FROM {t}_d WHERE draw < size) AS {c}" for t, c in (("cand", "lsh_comparisons"), ("found", "lsh_pairs"), ("truth", "exact_pairs")))
    + " FROM l"
)
def similarity_by_size(spark, d):
    """Comparisons of all pairs and of the bands, and similar pairs each finds, among growing random parts of the sets; the last is the whole."""
    s = document_sets(spark, d)
    cand = similarity.candidates(similarity.signatures(s, N_HASH, SEED), N_HASH, BANDS)
    draw = lambda c: F.pmod(seeded(SEED, F.col(c)), F.lit(8))
    level = F.broadcast(spark.createDataFrame([(x,) for x in SIZES], "size int"))
    among = lambda df, at, name: level.join(df.select(at.alias("draw")).groupBy("draw").count(), F.col("draw") < F.col("size"), "left").groupBy("size").agg(F.coalesce(F.sum("count"), F.lit(0)).alias(name))
    both = F.greatest(draw("i"), draw("j"))
    n = among(s, draw("doc"), "n").withColumn("all_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    for pairs, name in ((cand, "lsh_comparisons"), (similarity.verified(cand, s, THRESHOLD), "lsh_pairs"), (similarity.exact_pairs(s, THRESHOLD), "exact_pairs")):
        n = n.join(among(pairs, both, name), "size")
    return n


@named(f"WITH {SETS}, {SIGS}, {CAND}, {FOUND} SELECT i, j, round(sim, 6) AS sim, round(len(list_filter(range(1, {N_HASH + 1}), lambda k: a.sig[k] = b.sig[k])) / {N_HASH}, 6) AS estimate FROM found JOIN sigs a ON a.doc = i JOIN sigs b ON b.doc = j")
def signature_estimates(spark, d):
    s = document_sets(spark, d)
    g = similarity.signatures(s, N_HASH, SEED)
    found = similarity.verified(similarity.candidates(g, N_HASH, BANDS), s, THRESHOLD)
    a, b = g.select(F.col("doc").alias("i"), F.col("sig").alias("a")), g.select(F.col("doc").alias("j"), F.col("sig").alias("b"))
    return rounded(found.join(a, "i").join(b, "j").select("i", "j", "sim", similarity.estimate(F.col("a"), F.col("b")).alias("estimate")), "sim", "estimate")


@named(f"SELECT s / 10.0 AS similarity, round(1 - pow(1 - pow(s / 10.0, {N_HASH // BANDS}), {BANDS}), 6) AS chance FROM range(11) t(s)")
def s_curve(spark, d):
    s = spark.range(11).select((F.col("id") / 10.0).alias("similarity"))
    return s.select("similarity", F.round(similarity.s_curve(F.col("similarity"), N_HASH // BANDS, BANDS), 6).alias("chance"))


# ---------------------------------------------------------------- sketches


def h60(seed: str, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {expr}), 1, 15))::BIGINT"


BITS = "bits AS (SELECT DISTINCT bit FROM (" + " UNION ALL ".join(f"SELECT {h60(f'{SEED}-{i}', 'c_custkey')} % {N_BITS} AS bit FROM customer" for i in range(K)) + "))"
HIT = lambda item: " AND ".join(f"({h60(f'{SEED}-{i}', item)} % {N_BITS}) IN (SELECT bit FROM bits)" for i in range(K))


@named(f"WITH {BITS} SELECT bit FROM bits")
def bloom_bits(spark, d):
    return sketch.bloom_bits(tables.table(spark, d, "customer"), "c_custkey", N_BITS, K, SEED)


@named(f"WITH {BITS}, a AS (SELECT DISTINCT 'ghost' || o_orderkey AS item FROM orders), s AS (SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS n_in, (SELECT count(*) FROM a) AS n_absent, (SELECT count(*) FROM customer WHERE NOT ({HIT('c_custkey')})) AS false_negatives, (SELECT count(*) FROM a WHERE {HIT('item')}) AS false_positives, (SELECT count(*) FROM bits) AS b) SELECT n_in, n_absent, false_negatives, false_positives, round(false_positives / n_absent, 6) AS fp_rate, round(pow(1 - exp(-n_in * {K} / {N_BITS}.0), {K}), 6) AS expected, round(b / {N_BITS}, 6) AS fill, {N_BITS}::BIGINT AS memory_bits FROM s")
def bloom_false_positives(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    o = tables.table(spark, d, "orders").select(F.concat(F.lit("ghost"), F.col("o_orderkey").cast("string")).alias("key"))
    return rounded(sketch.bloom_quality(c, o, "key", N_BITS, K, SEED), "fp_rate", "expected", "fill")


GUESSES = (1, 2, 4, 7, 14)


def bloom_with(k: int) -> str:
    bits = "(SELECT DISTINCT bit FROM (" + " UNION ALL ".join(f"SELECT {h60(f'{SEED}-{i}', 'c_custkey')} % {N_BITS} AS bit FROM customer" for i in range(k)) + "))"
    hit = " AND ".join(f"({h60(f'{SEED}-{i}', 'item')} % {N_BITS}) IN {bits}" for i in range(k))
    return f"SELECT {k} AS k, round({N_BITS} * ln(2) / {k})::BIGINT AS guessed_n, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_in, (SELECT count(*) FROM a WHERE {hit}) AS false_positives, round((SELECT count(*) FROM {bits}) / {N_BITS}, 6) AS fill"


@named("WITH a AS (SELECT DISTINCT 'ghost' || o_orderkey AS item FROM orders) " + " UNION ALL ".join(bloom_with(k) for k in GUESSES))
def bloom_by_guess(spark, d):
    """False positives and fill of filters whose number of hashes suits a wrong guess of n, one hash among them."""
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    o = tables.table(spark, d, "orders").select(F.concat(F.lit("ghost"), F.col("o_orderkey").cast("string")).alias("key"))
    out = None
    for k in GUESSES:
        one = sketch.bloom_quality(c, o, "key", N_BITS, k, SEED).select(F.lit(k).alias("k"), F.lit(round(N_BITS * math.log(2) / k)).cast("bigint").alias("guessed_n"), "n_in", "false_positives", F.round("fill", 6).alias("fill"))
        out = one if out is None else out.unionByName(one)
    return out


@named("SELECT n, greatest(1, round_even(80000 / n * ln(2), 0))::INTEGER AS k FROM (VALUES (2000), (4000), (8000), (16000), (32000)) t(n)")
def bloom_optimal_k(spark, d):
    return spark.createDataFrame([(n, sketch.optimal_k(80_000, n)) for n in (2000, 4000, 8000, 16000, 32000)], "n int, k int")


KEYS = "keys AS (SELECT user_id || '|' || event_type AS key FROM events)"
REGS = f"h AS (SELECT {h60(str(SEED), 'key')} AS h FROM keys), regs AS (SELECT (h & 63)::INTEGER AS bucket, max(CASE WHEN (h >> 6) = 0 THEN 54 ELSE bit_count((h >> 6) & -(h >> 6) - 1) END) AS r FROM (SELECT h FROM h) GROUP BY 1)".replace("bit_count((h >> 6) & -(h >> 6) - 1)", "bit_count(((h >> 6) & (-(h >> 6))) - 1)")


def event_keys(spark, d):
    return tables.table(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))


@named(f"WITH {KEYS}, {REGS} SELECT bucket, r::INTEGER AS r FROM regs")
def fm_registers(spark, d):
    return sketch.registers(event_keys(spark, d), "key", 64, SEED)


VALS = "v AS (SELECT b, coalesce(pow(2, r), 0) AS v FROM range(64) t(b) LEFT JOIN regs ON bucket = b)"


@named(
    f"WITH {KEYS}, {REGS}, {VALS}, e AS (SELECT 'mean' AS rule, avg(v) AS v FROM v UNION ALL SELECT 'median', median(v) FROM v UNION ALL SELECT 'mean-then-median', median(x) FROM (SELECT avg(v) AS x FROM v GROUP BY b // 16) UNION ALL SELECT 'median-then-mean', avg(x) FROM (SELECT median(v) AS x FROM v GROUP BY b // 16)) SELECT rule, round(0.77351 * 64 * v, 4) AS estimate FROM e"
)
def fm_estimates(spark, d):
    regs = sketch.registers(event_keys(spark, d), "key", 64, SEED).cache()
    out = None
    for rule in sketch.RULES:
        one = sketch.combine(regs, 64, rule).select(F.lit(rule).alias("rule"), F.round("estimate", 4).alias("estimate"))
        out = one if out is None else out.unionByName(one)
    return out


@named(f"WITH {KEYS} SELECT count(DISTINCT key) AS n FROM keys")
def exact_distinct(spark, d):
    return mapreduce.distinct_count(event_keys(spark, d), "key")


@named(
    f"WITH k AS (SELECT user_id || '|' || event_type AS key, {DRAW('event_id')} AS draw FROM events), h AS (SELECT key, draw, {h60(str(SEED), 'key')} AS h FROM k), l AS (SELECT unnest([1, 2, 4, 8]) AS size), "
    "regs AS (SELECT size, h & 63 AS bucket, max(CASE WHEN (h >> 6) = 0 THEN 54 ELSE bit_count(((h >> 6) & (-(h >> 6))) - 1) END) AS r FROM h JOIN l ON draw < size GROUP BY 1, 2), "
    "v AS (SELECT s.size, b // 16 AS g, coalesce(pow(2, r), 0) AS v FROM l s CROSS JOIN range(64) t(b) LEFT JOIN regs ON bucket = b AND regs.size = s.size), "
    "e AS (SELECT size, 0.77351 * 64 * avg(x) AS estimate FROM (SELECT size, g, median(v) AS x FROM v GROUP BY 1, 2) GROUP BY 1), "
    "n AS (SELECT size, count(*) AS n, count(DISTINCT key) AS exact FROM k JOIN l ON draw < size GROUP BY 1) "
    "SELECT size::INTEGER AS size, n, exact, round(estimate, 4) AS estimate, round(estimate / exact, 6) AS ratio FROM n JOIN e USING (size)"
)
def distinct_by_size(spark, d):
    events = tables.table(spark, d, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    got = sketch.by_size(events, "key", F.pmod(seeded(SEED, F.col("event_id")), F.lit(8)), SIZES, 64, SEED)
    return got.withColumns({"estimate": F.round("estimate", 4), "ratio": F.round("ratio", 6)})


@named(f"SELECT event_id, user_id FROM events ORDER BY {h60(str(SEED), 'event_id')}, event_id LIMIT 100")
def reservoir_sample(spark, d):
    return sketch.reservoir(tables.table(spark, d, "events").select("event_id", "user_id"), 100, "event_id", SEED)


# ---------------------------------------------------------------- link analysis

EDGES = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), nodes AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)), deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes)"


def rank_steps(teleport: bool) -> str:
    out = ["r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for k in range(1, STEPS + 1):
        leak = f"(SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM deg))"
        base = f"(0.85::DOUBLE * {leak} + 0.15::DOUBLE) / n" if teleport else "0"
        push = "0.85::DOUBLE" if teleport else "1"
        out.append(f"f{k} AS (SELECT dst AS id, sum({push} * rank / deg) AS flow FROM r{k - 1} JOIN edges e ON e.src = id JOIN deg ON deg.src = id GROUP BY 1), r{k} AS (SELECT nodes.id, coalesce(flow, 0) + {base} AS rank FROM nodes LEFT JOIN f{k} ON f{k}.id = nodes.id, n)")
    return ", ".join(out)


@named(f"WITH {EDGES}, {rank_steps(True)} SELECT id, round(rank, 9) AS rank FROM r{STEPS}")
def pagerank(spark, d):
    return rounded(graph.pagerank(*tables.order_graph(spark, d), iterations=STEPS, tol=None).ranks, "rank", places=9)


@named(f"WITH {EDGES}, {rank_steps(False)} SELECT id, round(rank, 9) AS rank FROM r{STEPS}")
def pagerank_no_teleport(spark, d):
    return rounded(graph.pagerank(*tables.order_graph(spark, d), iterations=STEPS, tol=None, teleport=False).ranks, "rank", places=9)


@named(f"WITH {EDGES}, {rank_steps(True)} SELECT id, round(rank, 9) AS rank FROM r{STEPS} ORDER BY r{STEPS}.rank DESC, id LIMIT 10")
def pagerank_top10(spark, d):
    return rounded(graph.top_ranks(graph.pagerank(*tables.order_graph(spark, d), iterations=STEPS, tol=None).ranks), "rank", places=9)


@named(f"WITH {EDGES} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def dead_ends(spark, d):
    return graph.dead_ends(*tables.order_graph(spark, d))


@named()
def pagerank_converged(spark, d):
    got = graph.pagerank(*tables.user_graph(spark, d))
    return got.ranks.select(F.col("id"), "rank", F.lit(got.iterations).alias("iterations"))


@named()
def pagerank_convergence(spark, d):
    """Steps by damping and tolerance. Fewer and looser ones than convergence() takes by itself."""
    return graph.convergence(*tables.order_graph(spark, d), betas=(0.5, 0.7, 0.85), tols=(1e-2, 1e-3, 1e-4))


EVERY_EDGE = EDGES.replace("edges AS (SELECT DISTINCT", "edges AS (SELECT")


@named(f"WITH {EVERY_EDGE}, {rank_steps(True)} SELECT id, round(rank, 9) AS rank FROM r{STEPS}")
def pagerank_multigraph(spark, d):
    """Repeated edges count as often as they come."""
    lines, orders = tables.table(spark, d, "lineitem"), tables.table(spark, d, "orders")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    nodes, _ = tables.order_graph(spark, d)
    return rounded(graph.pagerank(nodes, edges, iterations=STEPS, tol=None, multigraph=True).ranks, "rank", places=9)


@named(f"WITH {EDGES} SELECT src, string_agg(dst, ',' ORDER BY dst) AS dsts FROM edges GROUP BY 1")
def adjacency(spark, d):
    return graph.adjacency(tables.order_graph(spark, d)[1]).select("src", F.array_join("dsts", ",").alias("dsts"))


@named(
    f"WITH a AS (WITH {EDGES}, {rank_steps(True)} SELECT * FROM r{STEPS}), b AS (WITH {EDGES}, {rank_steps(False)} SELECT * FROM r{STEPS}) "
    "SELECT round(sum(a.rank), 9) AS total_a, round(sum(b.rank), 9) AS total_b, round(sum(abs(a.rank - b.rank)), 9) AS l1, round(max(abs(a.rank - b.rank)), 9) AS worst FROM a JOIN b USING (id)"
)
def rank_differences(spark, d):
    """What ranks lose without teleport: both totals, the sum of differences and the largest."""
    g = tables.order_graph(spark, d)
    a, b = (graph.pagerank(*g, iterations=STEPS, tol=None, teleport=t).ranks for t in (True, False))
    return rounded(graph.differences(a, b), "total_a", "total_b", "l1", "worst", places=9)


@named()
def pagerank_settled(spark, d):
    return graph.pagerank(*tables.order_graph(spark, d)).ranks


@named()
def pagerank_no_teleport_settled(spark, d):
    return graph.pagerank(*tables.order_graph(spark, d), teleport=False).ranks


@named()
def pagerank_top10_settled(spark, d):
    return graph.top_ranks(graph.pagerank(*tables.order_graph(spark, d)).ranks)


# ---------------------------------------------------------------- itemsets

BASKETS = "b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), items AS (SELECT item, count(*) AS n FROM b GROUP BY 1)"
SPARSE = "b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), items AS (SELECT item, count(*) AS n FROM b GROUP BY 1)"
COUNTED = "p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)"


@named(f"WITH {BASKETS} SELECT item, n FROM items WHERE n >= {ITEM_SUPPORT}")
def frequent_items(spark, d):
    return itemsets.frequent_items(tables.brand_baskets(spark, d), ITEM_SUPPORT)


@named(f"WITH {BASKETS}, {COUNTED} SELECT a, b, n FROM p WHERE n >= {PAIR_SUPPORT}")
def frequent_pairs(spark, d):
    return itemsets.frequent_pairs(tables.brand_baskets(spark, d), PAIR_SUPPORT)


@named(f"WITH {BASKETS}, {COUNTED}, t AS (SELECT count(DISTINCT basket) AS t FROM b), r AS (SELECT a AS antecedent, b AS consequent, n FROM p WHERE n >= {PAIR_SUPPORT} UNION ALL SELECT b, a, n FROM p WHERE n >= {PAIR_SUPPORT}) SELECT antecedent, consequent, round(r.n / x.n, 6) AS confidence, round((r.n / x.n) / (y.n / t), 6) AS lift FROM r JOIN items x ON x.item = antecedent JOIN items y ON y.item = consequent, t WHERE r.n / x.n >= 0.14")
def association_rules(spark, d):
    return rounded(itemsets.association_rules(tables.brand_baskets(spark, d), PAIR_SUPPORT, 0.14), "confidence", "lift")


BUCKET = f"((a * {itemsets.MULTIPLIER} + b) % {itemsets.BUCKETS})"


@named(f"WITH {SPARSE}, {COUNTED} SELECT {BUCKET} AS bucket, sum(n)::BIGINT AS n FROM p GROUP BY 1 HAVING sum(n) >= {SPARSE_SUPPORT}")
def hash_buckets(spark, d):
    return itemsets.frequent_buckets(tables.part_baskets(spark, d), SPARSE_SUPPORT)


@named(f"WITH {SPARSE}, {COUNTED} SELECT a, b, n FROM p WHERE n >= {SPARSE_SUPPORT}")
def hash_bucket_pairs(spark, d):
    return itemsets.bucket_pairs(tables.part_baskets(spark, d), SPARSE_SUPPORT)


CHUNKED = f"{BASKETS}, sizes AS (SELECT basket % {CHUNKS} AS chunk, count(DISTINCT basket) AS size FROM b GROUP BY 1), local AS (SELECT x.basket % {CHUNKS} AS chunk, x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2, 3), cand AS (SELECT DISTINCT a, b FROM local JOIN sizes USING (chunk) WHERE n * (SELECT sum(size) FROM sizes) >= {PAIR_SUPPORT} * size)"


def in_chunks(spark, d):
    return tables.brand_baskets(spark, d).withColumn("chunk", F.col("basket") % CHUNKS)


@named(f"WITH {CHUNKED} SELECT a, b FROM cand")
def chunk_candidates(spark, d):
    return itemsets.chunk_candidates(in_chunks(spark, d), PAIR_SUPPORT)


@named(f"WITH {CHUNKED}, {COUNTED} SELECT a, b, n FROM p WHERE n >= {PAIR_SUPPORT}")
def chunk_pairs(spark, d):
    return itemsets.chunk_pairs(in_chunks(spark, d), PAIR_SUPPORT)


@named(f"WITH {BASKETS}, {COUNTED}, s AS (SELECT unnest([100, 200, 300, 400])::BIGINT AS support) SELECT support, count(*) FILTER (p.n >= support) AS frequent_pairs, count(*) FILTER (least(x.n, y.n) >= support) AS peak_counters FROM p JOIN items x ON x.item = a JOIN items y ON y.item = p.b, s GROUP BY 1")
def support_sweep(spark, d):
    return itemsets.support_sweep(tables.brand_baskets(spark, d), [100, 200, 300, 400])


# ---------------------------------------------------------------- clusters: centroids are the first rows by id

PTS = f"pts AS (SELECT vec_id AS id, list_transform(embedding[1:{DIMS}], lambda x: x::DOUBLE) AS p FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, p AS c FROM (SELECT * FROM pts ORDER BY id LIMIT {CENTROIDS}))"
NEAR = lambda c: f"(SELECT id, p, arg_min(cid, (round(list_distance(p, c), 12), cid)) AS label, min(list_distance(p, c)) AS dist FROM pts, {c} GROUP BY id, p)"


def first_points(spark, d, dims=DIMS):
    p = tables.points(spark, d, dims)
    return p, [tuple(r.p) for r in p.orderBy("id").limit(CENTROIDS).collect()]


@named(f"WITH {PTS} SELECT id, label::INTEGER AS label FROM {NEAR('c0')}")
def kmeans_assign(spark, d):
    return cluster.assign(*first_points(spark, d)).select("id", "label")


@named(f"WITH {PTS} SELECT round(sum(dist * dist), 6) AS sse FROM {NEAR('c0')}")
def kmeans_sse(spark, d):
    return rounded(cluster.sse(*first_points(spark, d)), "sse")


def lloyd() -> str:
    out = []
    for k in range(1, STEPS):
        out.append(f"l{k} AS {NEAR(f'c{k - 1}')}, m{k} AS (SELECT label, axis, avg(p[axis]) AS m FROM l{k}, range(1, {DIMS + 1}) t(axis) GROUP BY 1, 2), c{k} AS (SELECT cid, coalesce((SELECT list(m ORDER BY axis) FROM m{k} WHERE label = cid), c) AS c FROM c{k - 1})")
    return ", ".join(out)


@named(f"WITH {PTS}, {lloyd()} SELECT id, label::INTEGER AS label FROM {NEAR(f'c{STEPS - 1}')}")
def kmeans_steps(spark, d):
    p, c = first_points(spark, d)
    return cluster.kmeans(p, CENTROIDS, c, max_iter=STEPS).labelled.select("id", "label")


@named(f"WITH {PTS}, {lloyd()} SELECT id, label::INTEGER AS label FROM {NEAR(f'c{STEPS - 1}')}")
def kmeans_bounded(spark, d):
    return cluster.bounded_kmeans(*first_points(spark, d), max_iter=STEPS).labelled.select("id", "label")


@named()
def kmeans_plus_plus(spark, d):
    p = tables.points(spark, d)
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(cluster.spread_start(p, CENTROIDS))], "cid int, c array<double>")


@named()
def kmeans_assign_whole(spark, d):
    return cluster.assign(*first_points(spark, d, WHOLE)).select("id", "label")


@named()
def kmeans_sse_whole(spark, d):
    return cluster.sse(*first_points(spark, d, WHOLE))


@named()
def kmeans_settled(spark, d):
    p, c = first_points(spark, d, WHOLE)
    return cluster.kmeans(p, CENTROIDS, c).labelled.select("id", "label")


@named()
def kmeans_bounded_settled(spark, d):
    return cluster.bounded_kmeans(*first_points(spark, d, WHOLE), max_iter=100).labelled.select("id", "label")


DRAWS = f"n AS (SELECT count(*) AS n FROM embeddings), dr AS (SELECT {h60(f'{SEED}-a', 'k')} % n AS i, {h60(f'{SEED}-b', 'k')} % n AS j FROM range(2000) t(k), n), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings), dist AS (SELECT dim, list_distance(a.p[1:dim], b.p[1:dim]) AS d FROM dr JOIN e a ON a.vec_id = i JOIN e b ON b.vec_id = j, (SELECT unnest([2, 8, 32, 64]) AS dim) WHERE i <> j)"


@named(f"WITH {DRAWS} SELECT dim, count(*) AS pairs, round(min(d), 6) AS least, round(max(d), 6) AS most, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS stdev, round((max(d) - min(d)) / min(d), 4) AS contrast, round(stddev_pop(d) / avg(d), 6) AS relative_stdev FROM dist GROUP BY 1")
def distance_concentration(spark, d):
    got = cluster.concentration(tables.points(spark, d), [2, 8, 32, 64], 2000, SEED)
    return rounded(got, "least", "most", "mean", "stdev", "relative_stdev").withColumn("contrast", F.round("contrast", 4))


# ---------------------------------------------------------------- streams


def event_stream(spark, d):
    return streams.read_stream(spark, d, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))


@named("SELECT event_type AS word, count(*) AS n FROM events GROUP BY 1")
def stream_word_count(spark, d):
    return streams.drained(streams.word_count(event_stream(spark, d), "event_type"))


@named(SQL["fm_registers"])
def stream_registers(spark, d):
    return streams.drained(streams.distinct_registers(event_stream(spark, d), "key", 64, SEED))


@named("SELECT DISTINCT bit FROM (" + " UNION ALL ".join(f"SELECT {h60(f'{SEED}-{i}', 'user_id')} % {N_BITS} AS bit FROM events" for i in range(K)) + ")")
def stream_filter_bits(spark, d):
    return streams.drained(streams.filter_bits(event_stream(spark, d), "user_id", N_BITS, K, SEED), "append")


@named(SQL["reservoir_sample"])
def stream_reservoir(spark, d):
    path = f"{ensure_checkpoints(spark)}/{uuid.uuid4().hex}"
    keep = streams.Reservoir(f"{path}/sample", 100, "event_id", lambda c: seeded(SEED, c))
    q = event_stream(spark, d).select("event_id", "user_id").writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return keep.sample(spark)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
