"""Names like many needles at once, through an index of trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions import scalar, similarity
from photolake.session import stored

#: Distance of a column that a row lacks.
MISSING = 0.1


def gram_index(rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``(gram, n, key)``: the rows with a trigram in any of ``columns``, and how many those are; stored in order of trigrams."""
    grams = F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*(scalar.trigrams(similarity.folded(F.col(c))) for c in columns))))))
    pairs = rows.select(F.col(key).alias("key"), grams.alias("gram"))
    counts = pairs.groupBy("gram").agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(pairs.join(counts, "gram").repartitionByRange(parts, "gram", "key").sortWithinPartitions("gram", "key"), "grams")


def candidates(index: DataFrame, needles: DataFrame, least: float) -> DataFrame:
    """``(needle, key)``: rows that can be ``least`` similar to a needle, by word similarity.

    Such a row has ``least`` of the needle's u trigrams, so it has one of any u minus that
    many plus one of them: the rarest are looked up, and the common ones, which most rows
    share, are not. Needles without trigrams have no candidates.
    """
    own = needles.select("needle", F.explode(F.array_distinct(scalar.trigrams(similarity.folded(F.col("needle"))))).alias("gram")).distinct()
    counted = own.join(index.groupBy("gram").agg(F.max("n").alias("n")), "gram", "left")
    one = Window.partitionBy("needle")
    rare = counted.withColumn("at", F.row_number().over(one.orderBy(F.coalesce("n", F.lit(0)), "gram"))).withColumn("u", F.count("*").over(one))
    rare = rare.where(F.col("at") <= F.col("u") - F.ceil(F.col("u") * least - 1e-9) + 1).where("n IS NOT NULL")
    return rare.select("needle", "gram").join(index.select("gram", "key"), "gram").select("needle", "key").distinct()


def _found(rows: DataFrame, index: DataFrame, needles: DataFrame, columns: list[str], least: float, key: str) -> DataFrame:
    asked = candidates(index, needles.select("needle").distinct(), least)
    found = asked.join(rows.withColumnRenamed(key, "key"), "key").withColumnRenamed("key", key)
    for i, c in enumerate(columns):
        found = found.withColumn(f"_s{i}", similarity.similarities(F.col("needle"), F.col(c)))
    return found


def _distance(n: int) -> Column:
    """Distances of all columns together, to six places, so that order does not hang on the last bit."""
    return F.round(reduce(Column.__add__, (F.coalesce(1 - F.col(f"_s{i}.strict"), F.lit(MISSING)) for i in range(n))), 6)


def search_places(places: DataFrame, index: DataFrame, needles: DataFrame, columns: list[str], least: float = 0.5, limit: int = 20) -> DataFrame:
    """Of each needle the ``limit`` places of which a column is ``least`` similar to it by whole words, the nearest first.

    ``rank`` numbers them by ``distance``, the sum over the columns, ties by id.
    """
    found = _found(places, index, needles, columns, least, "id")
    hit = reduce(Column.__or__, (F.coalesce(F.col(f"_s{i}.strict") >= least, F.lit(False)) for i in range(len(columns))))
    found = found.where(hit).withColumn("distance", _distance(len(columns))).drop(*(f"_s{i}" for i in range(len(columns))))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("needle").orderBy("distance", "id"))).where(F.col("rank") <= limit)


def search_people(people: DataFrame, index: DataFrame, needles: DataFrame, least: float = 0.5, limit: int = 100, with_hidden: bool = False) -> DataFrame:
    """Of each owner and needle the ``limit`` people whose name is ``least`` similar to it by words, the nearest by whole words first."""
    found = _found(people if with_hidden else people.where("NOT is_hidden"), index, needles, ["name"], least, "id")
    found = found.join(needles.select("owner_id", "needle").distinct(), ["owner_id", "needle"], "left_semi")
    found = found.where(F.col("_s0.word") >= least).withColumn("distance", _distance(1)).drop("_s0")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("owner_id", "needle").orderBy("distance", "id"))).where(F.col("rank") <= limit)
