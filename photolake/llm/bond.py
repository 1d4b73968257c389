"""Hard negatives by a vertical scan: dimension by dimension, candidates go as soon as their bounds leave every window."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.session import stored, table

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is this share (percent) of the positive's or more, and the positive's at most.
SHARE = 80
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Bytes of vectors of a block of rows, and of a block of anchors.
ROW_BYTES, ANCHOR_BYTES = 1 << 24, 1 << 22

Narrow = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Columns:
    """A block of vectors by dimension, rows in order of their ids, with each dimension's least and greatest component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.dims = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = (f(axis=1) if len(ids) else np.zeros(len(self.dims), dtype=np.int64) for f in (self.dims.min, self.dims.max))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, narrow: Narrow) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bitmap ``alive`` that ``narrow`` leaves, and their exact inner products with ``anchor``.

        Dimensions are read by descending magnitude in the anchor. What those not yet
        read can still add lies between sums of their least and greatest products, so
        each candidate has bounds; ``narrow(low, high)`` tells which candidates stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = a * self.least[order], a * self.most[order]
        rest = [np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum)]
        at = np.flatnonzero(alive)
        score = np.zeros(len(at), dtype=np.int64)
        for k in range(0, len(order), STEP):
            read = order[k : k + STEP]
            score += a[k : k + STEP] @ (self.dims[read] if len(at) == len(self.ids) else self.dims[np.ix_(read, at)])
            low, high = (r[min(k + STEP, len(order))] for r in rest)
            keep = narrow(score + low, score + high)
            at, score = at[keep], score[keep]
            if not len(at):
                break
        return at, score

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first ``k`` of rows ``at``: higher scores first, then smaller ids."""
        own = np.argsort(-score, kind="stable")[:k]
        return self.ids[at[own]], score[own]


def _kth(values: np.ndarray, k: int) -> int | None:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def highest(k: int) -> Narrow:
    """Leaves what can be among the ``k`` highest."""

    def narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = _kth(low, k)
        return np.ones(len(low), dtype=bool) if least is None else high >= least

    return narrow


def windows(ranges: list[tuple[int, int]], k: int) -> Narrow:
    """Leaves what can be among the ``k`` highest within one of ``ranges``."""

    def narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), dtype=bool)
        for a, b in ranges:
            least = _kth(low[(low >= a) & (high <= b)], k)
            keep |= (high >= (a if least is None else max(a, least))) & (low <= b)
        return keep

    return narrow


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows whose label and vector are whole, with components ``floor(256 * x)``.

    Rows with a null id, label or vector, or with a null or non-finite component, are
    left out. Of rows that share an id one stays, the least by label, then vector.
    Shorter vectors are filled up with zeros. Scores must fit in 64 bits.
    """
    whole = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(whole)
    ints = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    one = kept.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), ints.alias("v")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


def _pairs(rows: DataFrame, anchors: DataFrame, dims: int, schema: str, search: Callable[[Columns, dict], Iterator[tuple]]) -> DataFrame:
    """What ``search`` gives for each block of rows and each anchor.

    Rows and anchors are dealt by a hash of the id into blocks of bounded bytes; every
    block of rows meets every block of anchors in a task of its own, which holds those
    two blocks only. Rows are copied once for each block of anchors, anchors once for
    each block of rows.
    """
    n, m = rows.count(), anchors.count()
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(spread, math.ceil(n * 8 * max(1, dims) / ROW_BYTES))
    anchor_blocks = max(1, math.ceil(m * 8 * max(1, dims) / ANCHOR_BYTES))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = rows.select("*", block("vec_id", blocks).alias("block"), each(anchor_blocks).alias("asked"))
    right = anchors.select("*", block("anchor_id", anchor_blocks).alias("asked"), each(blocks).alias("block"))
    names = [part.split()[0] for part in schema.split(", ")]

    def task(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if own.num_rows and asked.num_rows:
            columns = Columns(own["vec_id"].to_numpy(), own["label"].to_numpy(), _matrix(own["v"], dims))
            vectors = _matrix(asked["anchor"], dims)
            for k, anchor in enumerate(asked.drop_columns(["anchor"]).to_pylist()):
                found += search(columns, anchor | {"anchor": vectors[k]})
        values = zip(*found) if found else [()] * len(names)
        return pa.table({name: pa.array(list(x), pa.int64()) for name, x in zip(names, values)})

    return left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInArrow(task, schema)


def _first(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key, numbered in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``anchors``, some of ``rows``.

    Both have ``vec_id, label, v`` as of ``usable``, ids once each, and should be stored.
    An anchor's positives are its first ``positives`` other rows of its label, by inner
    product, ties by smaller id. Negatives of a positive with score s are the first
    ``negatives`` rows of other labels that score from ``share`` % of s to s; a positive
    below zero has none, as that range is empty. Two scans: one for the positives, and
    one for all windows of an anchor together. Each row block gives an anchor at most
    the wanted number for each window, so equal vectors in any number are no burden. No
    anchors or rows: no row.
    """
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    filled = lambda df: df.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    rows = filled(rows)
    anchors = filled(anchors).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor"))

    def same(block: Columns, anchor: dict) -> Iterator[tuple]:
        alive = (block.labels == anchor["anchor_label"]) & (block.ids != anchor["anchor_id"])
        for other, score in zip(*block.first(*block.scan(anchor["anchor"], alive, highest(positives)), positives)):
            yield anchor["anchor_id"], other, score

    near = _pairs(rows, anchors, dims, "anchor_id long, positive_id long, positive_score long", same)
    near = stored(_first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "bond-positives")

    def between(block: Columns, anchor: dict) -> Iterator[tuple]:
        ranges = [(-(-share * top // 100), top) for top in anchor["tops"]]
        at, score = block.scan(anchor["anchor"], block.labels != anchor["anchor_label"], windows(ranges, negatives))
        for a, b in ranges:
            inside = (score >= a) & (score <= b)
            for other, got in zip(*block.first(at[inside], score[inside], negatives)):
                yield anchor["anchor_id"], b, other, got

    tops = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("tops"))
    far = _pairs(rows, anchors.join(tops, "anchor_id"), dims, "anchor_id long, positive_score long, negative_id long, negative_score long", between)
    far = _first(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(usable(table(spark, sf_dir, "embeddings").withColumn("label", moved)), "bond-rows")
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH whole AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows AS (
  SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), near AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT n.anchor_id, n.positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, s.other AS negative_id, n.positive_score, s.score AS negative_score
FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND NOT s.same AND 80 * n.positive_score <= 100 * s.score AND s.score <= n.positive_score
WINDOW o AS (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER o <= 5
"""
