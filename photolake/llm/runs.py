"""Periodic runs of words, by a suffix automaton whose link tree is kept as a link-cut forest."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import raw, slices, texts, wider
from photolake.session import table

LEAST = 24
REPEATS = 3
#: Bytes of text that one step of the scan works on, one text at least.
SLICE = 1 << 22

Run = tuple[int, int, int]


def automaton_runs(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """``(start, length, period)`` of every run of ``words``, by start, then period.

    A run is a stretch with smallest period p and a length of ``max(least, repeats * p)``
    or more that no neighbouring word extends keeping period p. ``repeats`` is 2 or more.

    Words are appended one by one to a suffix automaton. A state's string lasts ended at
    the word that is its path's colour in a link-cut forest over the suffix links: after
    word i the path from its new state to the root is accessed, and all of it takes
    colour i. On the way each piece of an older path tells that its longest suffix, of L
    words, last ended at word j. If that is p = i - j back and p <= L, the two ends lie
    within the suffix's length: the last L + p words are a repetition whose smallest
    period is p. It is a run if the next word does not keep the period, and it begins
    where it must, as L is the longest such suffix. Recoloured pieces number O(n log n).

    States of strings that are too short to end a run, under ``least * (repeats - 1) /
    repeats`` words, are left out of the forest: they are all nearest the root.
    """
    n, low = len(words), -(-least * (repeats - 1) // repeats)
    # the automaton; state 0 is the empty string, which the forest uses as "none"
    following: list[dict] = [{}]
    link, length = [-1], [0]
    # the forest: splay trees by depth; `up` of a tree's root is the path's parent
    up, left, right, colour = [0], [0], [0], [-1]

    def rotate(v: int) -> None:
        u = up[v]
        w = up[u]
        if left[u] == v:
            b = left[u] = right[v]
            right[v] = u
        else:
            b = right[u] = left[v]
            left[v] = u
        if b:
            up[b] = u
        up[u], up[v] = v, w
        colour[v] = colour[u]  # means something where u was the root
        if w:
            if left[w] == u:
                left[w] = v
            elif right[w] == u:
                right[w] = v

    def splay(v: int) -> None:
        """Makes v the root of its path's tree."""
        while (u := up[v]) and (left[u] == v or right[u] == v):
            w = up[u]
            if w and (left[w] == u or right[w] == u):
                rotate(u if (left[u] == v) == (left[w] == u) else v)
            rotate(v)

    found: list[Run] = []
    last = 0
    for i, word in enumerate(words):
        cur = len(length)
        following.append({})
        length.append(i + 1)
        up.append(0), left.append(0), right.append(0), colour.append(i)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = cur
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = following[p][word]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                clone = cur + 1
                link.append(clone)
                link.append(link[q])
                following.append(following[q].copy())
                length.append(length[p] + 1)
                up.append(0), left.append(0), right.append(0), colour.append(-1)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[q] = clone
                if length[clone] >= low:
                    # the clone ends where q ended: it stands next above q, on the same path
                    splay(q)
                    if above := left[q]:
                        left[clone], up[above] = above, clone
                    left[q], up[clone] = clone, q
        last = cur
        v = link[cur]
        if length[v] < low:
            continue
        top, up[cur] = cur, v
        while v:
            splay(v)
            j, size = colour[v], length[v]
            period = i - j
            if size >= (repeats - 1) * period and size + period >= least and (i + 1 == n or words[i + 1] != words[i + 1 - period]):
                found.append((i - size - period + 1, size + period, period))
            if below := right[v]:
                colour[below] = j
            right[v] = top
            top, v = v, up[v]
        colour[top] = i
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: list[list], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int]]]:
    """For each list of words the parts ``[start, end)`` that runs can lie in; no run is in none or two.

    With k = 1 + least * (repeats - 2) // repeats, every k-gram of a run with period p
    is found again p words before or behind within the run, so at most length / repeats
    away. k-grams without an equal one of the same list that near, for the length of
    unbroken such k-grams around, are put aside. Grams are told apart by hashes; two that
    share one only make a part longer.
    """
    k = 1 + least * (repeats - 2) // repeats
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    total = int(ends[-1]) if len(ends) else 0
    if total < k:
        return out
    hashes = np.fromiter(map(hash, chain.from_iterable(words)), dtype=np.int64, count=total).view(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    grams = np.zeros(total - k + 1, dtype=np.uint64)
    for t in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[t : total - k + 1 + t]
    at = np.flatnonzero((of[: total - k + 1] == of[k - 1 :]) & (sizes[of[: total - k + 1]] >= least))
    keys = grams[at] ^ ((of[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    before, behind = order[:-1][same], order[1:][same]
    gap = at[behind] - at[before]
    near = np.full(len(at), total + 1, dtype=np.int64)
    near[behind] = gap
    near[before] = np.minimum(near[before], gap)
    at, near = at[near <= total], near[near <= total]
    while len(at):
        new = np.flatnonzero((np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])) + 1
        part = np.repeat(np.arange(len(new) + 1), np.diff([0, *new, len(at)]))
        long = np.bincount(part)[part] + k - 1
        keep = (long >= least) & (repeats * near <= long)
        if keep.all():
            for a, b in zip([0, *new], [*new, len(at)]):
                doc = int(of[at[a]])
                base = int(ends[doc] - sizes[doc])
                out[doc].append((int(at[a]) - base, int(at[b - 1]) - base + k))
            break
        at, near = at[keep], near[keep]
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that are in no run behind that run's first period."""
    out, done = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        out += words[done:a]
        done = max(done, b)
    return out + words[done:] if runs else words


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period of each, by start, then period) and ``collapsed``, the text without their repeats.

    Words are the runs of characters outside space and U+0009 to U+000D, numbered from 0.
    ``edit`` may change a text's words before. Texts are read whole, one by one; nothing
    is shuffled. Null and blank texts have no words, no run and an empty ``collapsed``;
    repeated rows and null ids are rows like any other, other columns are left out, and
    an empty table gives no row. A text of n words takes O(n log n) steps at most.
    """
    given = texts(docs)
    schema = wider(given.select("doc_id"), n_words="long", runs="array<struct<start: long, length: long, period: long>>", collapsed="string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids = batch.column("doc_id")
            words = [text.split() for text in raw(batch.column("text"))]
            if edit:
                words = [edit(doc, w) for doc, w in zip(ids.to_pylist(), words)]
            runs, kept = [], []
            for own, parts in zip(words, stretches(words, least, repeats)):
                found = [(start + a, size, period) for a, b in parts for start, size, period in automaton_runs(own[a:b], least, repeats)]
                found.sort(key=lambda r: (r[0], r[2]))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapsed(own, found)))
            columns = [ids, pa.array(list(map(len, words)), pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return given.mapInArrow(scan, schema)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    order = lambda a, b: F.coalesce(
        F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1)),
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)),
        F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0),
    )
    return F.get(F.array_sort(runs, order), F.lit(0))


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The query's planted repetitions: with h the crc32 of the id as text, if h % 10 is 0, words from a on repeat p of them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (-(-(n - a) // p)))[:n]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the planted repetitions, the strongest one, and digests of all of them and of the text without them."""
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail).withColumn("best", strongest())
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
