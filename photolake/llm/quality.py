"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import WordHash, code_points, fold, slices, span_sums, texts, wider
from photolake.session import table

BITS = 17
#: The classifier is fitted on at most so many labelled documents, those of smallest hash.
SAMPLE = 3000


def features(strings: list[str], word_hash: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and character n-grams (3 and 4, within words and their edges), and where each text's begin.

    Each word has a second bucket by how far back the text has the same word (in powers
    of two, or not at all), so that repetition can be learned whatever is repeated.
    """
    points, starts = code_points(strings)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    solid = ~white
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    shift = np.uint32(32 - BITS)
    mix = np.uint32(0x9E3779B1)
    hashes = word_hash(points, first, last)
    words = (hashes >> np.uint64(64 - BITS)).astype(np.uint32)
    flat = np.concatenate([[32], np.where(white, np.uint32(32), points), [32, 32]]).astype(np.uint32)
    full = np.concatenate([solid, [False, False]])
    a, b, c, d = (flat[k : k + len(points)] * np.uint32(m) for k, m in enumerate((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)))
    abc = a + b + c
    three = ((abc + np.uint32(3)) * mix) >> shift
    four = ((abc + d + np.uint32(4)) * mix) >> shift
    keep = np.stack([solid, solid & full[1 : len(points) + 1]], axis=1)
    grams = np.stack([three, four], axis=1)[keep]
    per_char = keep.sum(axis=1)
    owner = np.searchsorted(starts, first, side="right") - 1
    n_words = np.bincount(owner, minlength=len(strings))[: len(strings)] if len(strings) else np.zeros(0, int)
    key = hashes + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    back = np.zeros(len(words), dtype=np.uint32)
    back[order[again]] = 1 + np.log2(order[again] - order[again - 1]).astype(np.uint32)
    words = np.stack([words, (back + np.uint32(7)) * mix >> shift], axis=1).ravel()
    n_words = 2 * n_words
    gram_starts = np.concatenate([[0], np.cumsum(span_sums(per_char, starts))])
    word_starts = np.concatenate([[0], np.cumsum(n_words)])
    # the words of a text stand before its n-grams
    out = np.empty(len(words) + len(grams), dtype=np.uint32)
    all_starts = gram_starts + word_starts
    at = np.arange(len(words)) - np.repeat(word_starts[:-1], n_words) + np.repeat(all_starts[:-1], n_words)
    rest = np.ones(len(out), dtype=bool)
    rest[at] = False
    out[at] = words
    out[rest] = grams
    return out, all_starts


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(y, ids, n)``: hashed feature counts of at most ``most`` labelled rows of ``docs`` (doc_id, text).

    Repeated labels of a document count once, by their maximum. The ids of the sample
    are at most ``most``, so they are broadcast and no text is shuffled.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = marked.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in slices(batches, "text", 1 << 20):
            ids, starts = features(batch.column("text").to_pylist(), word_hash)
            got = [np.unique(ids[a:b], return_counts=True) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.record_batch([batch.column("h"), batch.column("y"), pa.array([x.astype("<u4").tobytes() for x, _ in got], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in got], pa.binary())], names=["h", "y", "ids", "n"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("h", F.col("y").cast("int").alias("y"), "text")
    return rows.mapInArrow(count, "h long, y int, ids binary, n binary").orderBy("h", "ids", "n").limit(most)


def train(rows: list, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weight of every bucket toward label 1, and the bias last.

    Embeddings and a two-way softmax learn together by stochastic gradient descent. A
    score is linear in the averaged embeddings, so they fold into one weight a bucket.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, dim)) / dim
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    data = [(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.n, "<f4"), int(r.y == 1)) for r in rows]
    data = [(ids, n / n.sum(), y) for ids, n, y in data if len(ids)]
    steps = max(1, epochs * len(data))
    for step in range(epochs * len(data)):
        if step % len(data) == 0:
            order = rng.permutation(len(data))
        ids, share, y = data[order[step % len(data)]]
        now = rate * (1 - step / steps)
        mine = vectors[ids]
        mean = share @ mine
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = out @ p
        out -= now * np.outer(mean, p)
        bias -= now * p * 0.1
        # every feature of the average moves along one direction; the common factor is kept large enough to learn
        vectors[ids] -= (now * 20) * share[:, None] * back
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` (with a ``text`` that is not null) and the probability of label 1; an empty text has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, word_hash = shared.value, WordHash()
        for batch in slices(batches, "text", 1 << 20):
            ids, starts = features(batch.column("text").to_pylist(), word_hash)
            z = span_sums(w[ids], starts) / np.maximum(np.diff(starts), 1) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, column])

    return docs.mapInArrow(apply, wider(docs, **{column: "double"}))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of the folds other than 0 of 5.

    Each row is scored by itself, so repeated rows have equal scores. Null and empty texts
    have the model's bias; texts of any length are read whole. A document that is labelled
    several times counts once, by its largest label; null labels and labels without a
    document are left out. Without labels all scores are 0.5; an empty table gives an
    empty result. Other columns of both tables are not read.
    """
    docs = texts(table(spark, sf_dir, "documents"), (fold("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 5) != 0)
    weights = train(sample(docs.select("doc_id", "text"), labels, "quality", SAMPLE).collect())
    return score(docs, weights).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
