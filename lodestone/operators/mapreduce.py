"""Map/reduce: the general engine with user functions, and the relational jobs that Catalyst plans alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAPPERS = 8


def map_reduce(pairs: DataFrame, mapper: Callable, reducer: Callable, out: str, mid: str = "k string, v bigint", combiner: Callable | None = None) -> DataFrame:
    """mapper(k, v) and reducer(k, values) yield pairs; combiner(k, values) yields values' partial results.

    mid and out are the schemas (k, v) after mapping and after reducing. The
    combiner runs on each batch of a map task, before the shuffle, and reducers
    stream over sorted rows, so that a task holds the values of one key at most.
    """
    names, last_names = StructType.fromDDL(mid).names, StructType.fromDDL(out).names

    def mapped(frames: Iterable[pd.DataFrame]):
        for f in frames:
            got = [kv for k, v in zip(f.iloc[:, 0], f.iloc[:, 1]) for kv in mapper(k, v)]
            if combiner:
                groups: dict = {}
                for k, v in got:
                    groups.setdefault(k, []).append(v)
                got = [(k, c) for k, vs in groups.items() for c in combiner(k, vs)]
            yield pd.DataFrame(got, columns=names)

    def reduced(frames: Iterable[pd.DataFrame]):
        last, held = None, []
        for f in frames:
            rows = []
            for k, v in zip(f.iloc[:, 0], f.iloc[:, 1]):
                if held and k != last:
                    rows += reducer(last, held)
                    held = []
                last = k
                held.append(v)
            if rows:
                yield pd.DataFrame(rows, columns=last_names)
        if held:
            yield pd.DataFrame(list(reducer(last, held)), columns=last_names)

    return pairs.mapInPandas(mapped, mid).repartition(names[0]).sortWithinPartitions(names[0]).mapInPandas(reduced, out)


def word_count(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, n): partial counts before the shuffle come from Catalyst."""
    return words.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each word between spaces, tabs and line ends."""
    return docs.select(F.explode(F.split(F.col(text), "[ \n\t]+")).alias("word")).where("word <> ''")


def shuffle_volume(words: DataFrame, mappers: int = MAPPERS, pos: str = "pos") -> DataFrame:
    """(pairs, combined): pairs that cross to reducers without and with a combiner in each of `mappers` map tasks."""
    tagged = words.select(F.pmod(F.col(pos), F.lit(mappers)).alias("mapper"), "word")
    each = tagged.groupBy("mapper", "word").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("combined"))


def positions(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """rows with their place from 0 by the key, without gaps whatever the key has: ranges are sorted apart, and the counts of
    the ranges before (a row each) are added."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.approxQuantile(key, [i / n for i in range(1, n)], 0.001) if n > 1 else []
    part = F.array_position(F.array_sort(F.array_append(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), F.col(key).cast("double"))), F.col(key).cast("double")).cast("int")
    dealt = rows.withColumn("part", part)
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    return local.join(F.broadcast(before), "part").withColumn(pos, F.col("before") + F.col("local")).drop("part", "before", "local")


def matrix_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, x): x_i = sum of m_ij * v_j. Rows without entries are absent. Spark broadcasts the vector if it is small, else both are shuffled by j."""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("m") * F.col("v")).alias("x"))


def distinct_count(words: DataFrame, word: str = "word") -> DataFrame:
    return words.agg(F.count_distinct(word).alias("n"))


def chunked(baskets: DataFrame, n_chunks: int, pos: str) -> DataFrame:
    """Adds `chunk`: rows in order of pos in stretches of max(1, ceil(rows / n_chunks)); pos counts from 0 without gaps."""
    total = baskets.agg(F.count("*").alias("total"))
    size = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(n_chunks)))
    return baskets.join(F.broadcast(total)).withColumn("chunk", F.floor(F.col(pos) / size).cast("int")).drop("total")
