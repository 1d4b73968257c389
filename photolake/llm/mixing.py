"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.llm.common import WORD, fresh
from photolake.session import cut, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2


def size() -> Column:
    """Words of ``text``; null counts 0."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def order_key() -> Column:
    """The place of a row in its source's shuffle: a hash of its id and text."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``(source, sid, weight, source_size, source_rows, target)``, one row for each source.

    Sources rank by code point, nulls last, and take the weights in turn. A source's
    target is ``min(passes * size, level * weight)``, with the level at which the targets
    add up to ``share`` of all sizes: the excess of the capped is reshared by weight.
    The windows here see one row for each source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("cap", passes * F.col("source_size")).withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    levels = levels.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # levels fall once a source can take them, so the first that can is the largest
    levels = levels.withColumn("level", F.max(fits).over(whole))
    return levels.select("source", "sid", "weight", "source_size", "source_rows", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


@dataclass
class Mix:
    """``rows``: a row for each document with its finish time of each pass; ``last``: the latest finish time taken."""

    rows: DataFrame
    sources: DataFrame
    last: float
    passes: int

    def times(self) -> Column:
        """How often the mix takes a row."""
        return sum((F.col(f"finish{p}") <= F.lit(self.last)).cast("long") for p in range(self.passes))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> Mix:
    """Weighted fair queueing over the documents' shuffled sources.

    Each source is shuffled by a hash and gone through ``passes`` times. A document's
    virtual finish time is the source's words up to and with it, divided by the
    source's weight. All (document, pass) items are range-sorted by finish time and
    taken while their words fit ``share`` of all words; a document is taken whole or
    not at all in a pass. Rows equal in id, text and source tie and are taken together.
    Null texts have size 0; a null source is a source of its own, ranked last.

    A source's running sums come from sums of hash buckets, so a hot source is worked
    on in groups of about 100 rows. Only sizes and hashes are shuffled.
    """
    sized = stored(docs.select("doc_id", "source", size().alias("size"), order_key().alias("key")), "mix-sizes")
    sources = cut(targets(sized, weights, share, passes))
    rows, every, words = sources.agg(F.max("source_rows"), F.sum("source_rows"), F.sum("source_size")).first()
    buckets = min(1 << 20, 1 << max(0, math.ceil(math.log2(max(1, (rows or 0) / 100)))))
    bucket = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    placed = sized.withColumn("bucket", bucket).join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("run", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    finish = [((p * F.col("source_size") + F.col("ahead") + F.col("run")) / F.col("weight")).alias(f"finish{p}") for p in range(passes)]
    queued = stored(run.select("doc_id", "source", "key", "size", "source_size", "target", *finish), "mix-queue")

    items = queued.where("size > 0").select("size", F.explode(F.array(*(f"finish{p}" for p in range(passes)))).alias("finish"))
    # as many range parts as keep the one that the budget ends in to about a million items
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(passes * (every or 0) / 1_000_000))
    ranged = cut(items.repartitionByRange(parts, "finish").select("finish", "size", F.spark_partition_id().alias("part")))
    filled = ranged.groupBy("part").agg(F.sum("size").alias("words"), F.max("finish").alias("most"))
    upto = filled.withColumn("upto", F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    budget = share * (words or 0)
    full = upto.where(F.col("upto") <= budget).agg(F.max("upto"), F.max("most"), F.max("part")).first()
    used, last, part = full[0] or 0, -1.0 if full[1] is None else full[1], -1 if full[2] is None else full[2]
    # the budget ends within the next part that has rows; a range part holds all rows of a finish time
    edge = upto.where(F.col("part") > part).agg(F.min("part")).first()[0]
    if edge is not None:
        within = ranged.where(F.col("part") == edge).groupBy("finish").agg(F.sum("size").alias("words"))
        within = within.withColumn("upto", F.sum("words").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        more = within.where(F.col("upto") + used <= budget).agg(F.max("finish")).first()[0]
        last = last if more is None else more
    return Mix(queued, sources, last, passes)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.rows.select("doc_id", "size", "source_size", "target", (F.col("size") * found.times()).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents; one that is taken twice has two rows.

    A source's cut is the largest hash that each pass takes, so each row decides by its
    own hash and a row for each source is all that is joined; texts are not shuffled.
    Documents without words are never taken.
    """
    columns = docs.columns
    found = mix(docs)
    source, cut_at = fresh("_mix_source", columns), [fresh(f"_mix_cut{p}", columns) for p in range(found.passes)]
    cuts = found.rows.where("size > 0").groupBy(F.col("source").alias(source)).agg(*(F.max(F.when(F.col(f"finish{p}") <= F.lit(found.last), F.col("key"))).alias(cut_at[p]) for p in range(found.passes)))
    named = docs.withColumns({(key := fresh("_mix_key", columns)): order_key(), (words := fresh("_mix_size", columns)): size()})
    joined = named.where(F.col(words) > 0).join(cuts, named["source"].eqNullSafe(cuts[source]))
    times = sum((F.coalesce(F.col(key) <= F.col(cut_at[p]), F.lit(False))).cast("int") for p in range(found.passes))
    copy = fresh("_mix_copy", columns)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, 2 * source_size AS cap FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), picked AS (
  SELECT source, source_size, weight, least(cap::DOUBLE, coalesce((SELECT max(level) FROM levels WHERE level <= cap / weight), 0) * weight) AS target FROM levels
), queued AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.weight, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM sized s JOIN picked p ON s.source IS NOT DISTINCT FROM p.source
), items AS (
  SELECT size, run::DOUBLE / weight AS finish FROM queued WHERE size > 0
  UNION ALL SELECT size, (source_size + run)::DOUBLE / weight FROM queued WHERE size > 0
), upto AS (
  SELECT finish, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM items
), cut AS (
  SELECT coalesce(max(finish), -1) AS last FROM upto WHERE upto <= 1.5::DOUBLE * (SELECT sum(size) FROM sized)
)
SELECT doc_id, size, source_size, target,
  CAST(size * ((run::DOUBLE / weight <= last)::INTEGER + ((source_size + run)::DOUBLE / weight <= last)::INTEGER) AS BIGINT) AS taken
FROM queued, cut
"""
