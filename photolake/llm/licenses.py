"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from photolake.llm.common import WordHash, code_points, slices, texts
from photolake.llm.license_texts import templates
from photolake.session import table

SHINGLE = 5
CONTAINED = 0.8
#: The chance that no band of a window retrieves a template which it contains at CONTAINED.
MISS = 1e-4

TEMPLATES = templates()

_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split(strings: list[str], word_hash: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (lower-case letters and digits, with ``.+-`` inside), their first and last places, and where texts begin.

    Digits alone with dots count as one word ``#``, so any version number fits a template.
    """
    points, starts = code_points([s.lower() if len(s.lower()) == len(s) else "".join(c.lower()[:1] for c in s) for s in strings])
    solid = ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
    joint = (points == 46) | (points == 43) | (points == 45)
    inner = joint.copy()
    inner[1:] &= solid[:-1]
    inner[:-1] &= solid[1:]
    inner[[0, -1] if len(inner) else []] = False
    edge = np.diff(np.concatenate([[0], (solid | inner).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = word_hash(points, first, last)
    alpha = np.concatenate([[0], np.cumsum((points >= 97) & (points <= 122))])
    hashes[alpha[last] == alpha[first]] = np.uint64(1)
    return hashes, first, last, np.searchsorted(first, starts)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; shingle i begins with word i."""
    n = max(0, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@dataclass
class Catalogue:
    """Templates by window size: the names, each one's shingles, and per size its bands and their keys."""

    names: list[str]
    sets: list[np.ndarray]
    lengths: list[int]
    #: window size in shingles -> (bands, sorted keys, template of each key)
    sizes: dict[int, tuple[int, np.ndarray, np.ndarray]]
    window_of: dict[int, int]
    #: how often each template has each of its shingles
    times: list[np.ndarray]


_RNG = np.random.default_rng(97)
MULTIPLY, ADD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)


def catalogue(templates: dict[str, str]) -> Catalogue:
    """Band keys of the templates.

    A template of n shingles is looked for in windows of the smallest power of two of at
    least 2 n, at steps of half of that, so some window holds all of it. What it keeps at
    ``CONTAINED`` then has a Jaccard similarity of at least j = 0.8 n / (window + 0.2 n),
    and of b bands of one hash none agrees with chance (1 - j) ** b at most; b is set to
    bring that below ``MISS``.
    """
    word_hash, names, sets, times, lengths = WordHash(), [], [], [], []
    by_size: dict[int, list[int]] = {}
    for name, text in templates.items():
        hashes = split([text], word_hash)[0]
        if len(hashes) < SHINGLE:
            raise ValueError(f"template {name} has under {SHINGLE} words")
        own, count = np.unique(shingles(hashes), return_counts=True)
        times.append(count)
        by_size.setdefault(1 << math.ceil(math.log2(2 * (len(hashes) - SHINGLE + 1))), []).append(len(names))
        names.append(name)
        sets.append(own)
        lengths.append(len(hashes))
    sizes = {}
    for window, members in sorted(by_size.items()):
        n = min(lengths[m] - SHINGLE + 1 for m in members)
        j = CONTAINED * n / (window + (1 - CONTAINED) * n)
        bands = min(len(MULTIPLY), math.ceil(math.log(MISS) / math.log(1 - j)))
        keys, owner = [], []
        for m in members:
            with np.errstate(over="ignore"):
                low = (sets[m][:, None] * MULTIPLY[:bands] + ADD[:bands]).min(axis=0)
            keys.append(low + np.arange(bands, dtype=np.uint64))
            owner += [m] * bands
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        sizes[window] = (bands, keys[order], np.array(owner)[order])
    return Catalogue(names, sets, lengths, sizes, {m: w for w, members in by_size.items() for m in members}, times)


def scan(strings: list[str], found_in: Catalogue, word_hash: WordHash) -> list[tuple[int, int, int, int, float]]:
    """``(text, template, start, end, containment)`` of each place of each template in each text, in code points."""
    hashes, first, last, starts = split(strings, word_hash)
    all_shingles = shingles(hashes)
    n = np.maximum(np.diff(starts) - SHINGLE + 1, 0)
    if not n.sum():
        return []
    # shingles of one text each, laid end to end
    begin = np.cumsum(n) - n
    s = all_shingles[np.repeat(starts[:-1] - begin, n) + np.arange(n.sum())]
    candidates: dict[tuple[int, int], set[int]] = {}
    for window, (bands, keys, owner) in found_in.sizes.items():
        half = window // 2
        blocks = -(-n // half)
        at = np.repeat(begin, blocks) + half * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        text = np.repeat(np.arange(len(n)), blocks)
        # a text's last block has no next one to share a window with
        ends = np.zeros(len(text), dtype=bool)
        ends[np.cumsum(blocks)[blocks > 0] - 1] = True
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(keys >> np.uint64(48)).astype(np.int64)] = True
        for band in range(bands):
            with np.errstate(over="ignore"):
                low = np.minimum.reduceat(s * MULTIPLY[band] + ADD[band], at)
                low[:-1] = np.where(ends[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
                low = low + np.uint64(band)
            maybe = np.flatnonzero(seen[(low >> np.uint64(48)).astype(np.int64)])
            a, b = np.searchsorted(keys, low[maybe], "left"), np.searchsorted(keys, low[maybe], "right")
            for w, x, y in zip(maybe[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist()):
                for k in range(x, y):
                    candidates.setdefault((int(text[w]), int(owner[k])), set()).add(int(at[w] - begin[text[w]]))
    out = []
    origins = np.cumsum([0, *(len(x) + 1 for x in strings)])
    for (t, m), places in sorted(candidates.items()):
        own, size = found_in.sets[m], found_in.window_of[m]
        # all shingles of the template in the windows that were retrieved
        near = np.zeros(int(n[t]), dtype=bool)
        for place in places:
            near[place : place + size] = True
        at = np.flatnonzero(near)
        part = s[begin[t] + at]
        which = np.minimum(np.searchsorted(own, part), len(own) - 1)
        hit = own[which] == part
        for a, b, share in _occurrences(at[hit], which[hit], found_in.times[m], size):
            base, origin = int(starts[t]), int(origins[t])
            out.append((t, m, int(first[base + a]) - origin, int(last[base + b + SHINGLE - 1]) - origin, share))
    return out


def _occurrences(at: np.ndarray, which: np.ndarray, times: np.ndarray, size: int) -> list[tuple[int, int, float]]:
    """``(first, last, share)`` of runs of hits that hold enough of a template's shingles within ``size``; none overlap.

    ``at`` are places in order, ``which`` the template's shingle at each and ``times`` how
    often the template has each. A run ends before a shingle that it has as often.
    """
    out, low, n = [], 0, len(times)
    while len(at) - low >= CONTAINED * n:
        counts: dict[int, int] = {}
        a, done = low, None
        for b in range(low, len(at)):
            counts[which[b]] = counts.get(which[b], 0) + 1
            while at[b] - at[a] >= size or (counts[which[a]] > times[which[a]] and a < b):
                counts[which[a]] -= 1
                if not counts[which[a]]:
                    del counts[which[a]]
                a += 1
            if len(counts) >= CONTAINED * n:
                while b + 1 < len(at) and counts.get(which[b + 1], 0) < times[which[b + 1]] and at[b + 1] - at[a] < size:
                    b += 1
                    counts[which[b]] = counts.get(which[b], 0) + 1
                done = (int(at[a]), int(at[b]), len(counts) / n)
                low = b + 1
                break
        if done is None:
            break
        out.append(done)
    return out


def scan_licenses(docs: DataFrame, known_texts: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, start, end, containment)``: the license texts and notices that a text contains.

    A template counts if at least 80 % of its five-word shingles stand in one window;
    each such place is a row. Version numbers are alike. Where places of one license
    overlap (its notices are many), the one with most text stays, of equals the first; where
    licenses of like wording have about the same place, the one contained most fully does.
    Texts of any length are scanned whole. Null and blank texts, texts under five words
    and an empty table contain none; repeated rows are scanned each. The templates are a
    fixed list that travels with each task; other columns are not read.
    """
    known = catalogue(known_texts or TEMPLATES)
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in slices(batches, "text", 1 << 20):
            got = _apart([(t, known.names[m].split(":")[0], *place) for t, m, *place in scan(batch.column("text").to_pylist(), known, word_hash)])
            if got:
                ids = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([g[1] for g in got]), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.float64())],
                    names=["doc_id", "license", "start", "end", "containment"],
                )

    return rows.mapInArrow(apply, f"doc_id {kind}, license string, start long, end long, containment double")


def _apart(places: list[tuple[int, str, int, int, float]]) -> list[tuple[int, str, int, int, float]]:
    """Places ``(text, license, start, end, containment)`` without those that another one of the text outdoes.

    That is one of the same license that overlaps and is longer, or one of another
    license (of like wording) at about the same place that is contained more fully.
    """

    def shared(p: tuple, q: tuple) -> int:
        return min(p[3], q[3]) - max(p[2], q[2])

    kept: list[tuple[int, str, int, int, float]] = []
    for _, group in groupby(sorted(places), key=lambda p: p[0]):
        mine: list[tuple[int, str, int, int, float]] = []
        for p in sorted(group, key=lambda p: (p[2] - p[3], p[2])):
            if all(p[1] != q[1] or shared(p, q) <= 0 for q in mine):
                mine.append(p)
        best: list[tuple[int, str, int, int, float]] = []
        for p in sorted(mine, key=lambda p: (-p[4], p[2] - p[3], p[2], p[1])):
            if all(5 * shared(p, q) < 4 * max(p[3] - p[2], q[3] - q[2]) for q in best):
                best.append(p)
        kept += sorted(best)
    return kept


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
