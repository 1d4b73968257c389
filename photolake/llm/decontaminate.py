"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from photolake.llm.common import code_points, letters, slices, texts
from photolake.session import stored, table

#: q-grams of most items, and the smaller ones of short items, so that the whole budget of edits leaves some.
Q, SHORT = 10, (8, 6)
#: A region is a match if an item, or this many characters of it, agree but for this share of edits.
REGION, EDITS = 80, 0.08
#: Characters of benchmark items that are indexed and broadcast at once; more are done in several passes.
INDEX_CHARS = 1 << 22


def _alnum() -> np.ndarray:
    return letters() | np.fromiter((chr(i).isalnum() for i in range(0x10000)), bool, 0x10000)


def normal(strings: list[str], alnum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and digits with one space between words: characters, their places, and where texts begin.

    The places are offsets in the joined originals, where each text has one space after it.
    """
    points, starts = code_points([s.lower() if len(s.lower()) == len(s) else "".join(c.lower()[:1] for c in s) for s in strings])
    good = alnum[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    keep = good.copy()
    keep[1:] |= good[:-1]
    place = np.flatnonzero(keep)
    return np.where(good, points, np.uint32(32))[place], place, np.searchsorted(place, starts)


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all runs of q = 6, 8 or 10 characters."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    b = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        one = chars.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * b + one[1:]
        grams = two[:-2] * (b * b) + two[2:]
        if q >= 8:
            grams = grams[:-4] * (b * b * b * b) + grams[4:]
        if q != 8:
            grams = grams[:-2] * (b * b) + two[q - 2 :]
        return (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    ids: list
    chars: np.ndarray
    starts: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    region: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    seen: np.ndarray
    q: int = Q


def size_of(n: int) -> int:
    """The q for an item of n normalised characters: the largest that leaves three q-grams after all edits, else the smallest."""
    region, budget = min(n, REGION), int(min(n, REGION) * EDITS)
    return next((q for q in (Q, *SHORT) if not budget or region + 1 - q * (budget + 1) >= 3), SHORT[-1])


def build_indexes(ids: list, items: list[str]) -> list[Index]:
    """One index for each q that the items need."""
    starts = normal(items, _alnum())[2]
    by_q: dict[int, list[int]] = {}
    for i, n in enumerate(np.maximum(np.diff(starts) - 1, 0).tolist()):
        by_q.setdefault(size_of(n), []).append(i)
    return [build_index([ids[i] for i in mine], [items[i] for i in mine], q) for q, mine in sorted(by_q.items())]


def build_index(ids: list, items: list[str], q: int = Q) -> Index:
    """Postings of all q-grams of the items and each item's region length, edit budget and least shared q-grams."""
    chars, _, starts = normal(items, _alnum())
    # without the space that ends each item
    ends = starts[1:] - (np.diff(starts) > 0)
    all_grams = qgrams(chars, q)
    n = np.maximum(ends - starts[:-1] - q + 1, 0)
    item = np.repeat(np.arange(len(items)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    grams = all_grams[np.repeat(starts[:-1], n) + offset] if n.sum() else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    unique, first = np.unique(grams[order], return_index=True)
    region = np.minimum(ends - starts[:-1], REGION)
    budget = np.floor(region * EDITS).astype(np.int64)
    # q-gram lemma: n characters with k edits keep n + 1 - q (k + 1) q-grams
    least = region + 1 - q * (budget + 1)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(unique >> np.uint64(42)).astype(np.int64)] = True
    return Index(ids, np.append(chars, np.uint32(32)), np.append(starts[:-1], ends[-1:] if len(items) else [0]), unique, np.append(first, len(grams)), item[order].astype(np.int32), offset[order].astype(np.int32), region, budget, np.maximum(least, 1), seen, q)


def edits(item: np.ndarray, text: np.ndarray, width: int, budget: int) -> tuple[int, int]:
    """Fewest edits that turn ``item`` into a part of ``text`` that begins within ``2 * width`` of its start, and that part's end.

    Only diagonals 0 to ``2 * width`` are worked out; past ``budget`` edits the count may be too low, but over it.
    """
    steps = np.arange(2 * width + 1)
    padded = np.concatenate([text.astype(np.int64), np.full(len(item) + 2 * width + 1, -1)])
    # the passage as it stands
    for d in np.flatnonzero(padded[: len(steps)] == item[0]).tolist():
        if np.array_equal(padded[d : d + len(item)], item):
            return 0, d + len(item)
    row = np.zeros(len(steps), dtype=np.int64)
    for i, c in enumerate(item.astype(np.int64)):
        new = row + (padded[i : i + len(steps)] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if i & 3 == 3 and row.min() > budget:
            break
    best = int(row.argmin())
    return int(row[best]), min(len(item) + best, len(text))


def matches(strings: list[str], index: Index, alnum: np.ndarray, most_hits: int = 1 << 21) -> list[tuple[int, int, int, int, int, int]]:
    """``(text, item, start, end, characters, edits)`` of every passage of the texts that holds an item's region.

    Passages of one item do not overlap in the text; of those that would, the longest stays.
    """
    return search(*normal(strings, alnum), index, most_hits)


def search(chars: np.ndarray, place: np.ndarray, starts: np.ndarray, index: Index, most_hits: int = 1 << 21) -> list[tuple[int, int, int, int, int, int]]:
    """As ``matches``, of normalised texts."""
    grams = qgrams(chars, index.q)
    if not len(grams) or not len(index.grams):
        return []
    maybe = np.flatnonzero(index.seen[(grams >> np.uint64(42)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(index.grams, grams[maybe]), len(index.grams) - 1)
    real = index.grams[slot] == grams[maybe]
    maybe, slot = maybe[real], slot[real]
    owner = np.searchsorted(starts, maybe, side="right") - 1
    whole = maybe + index.q <= starts[np.minimum(owner + 1, len(starts) - 1)]
    maybe, slot = maybe[whole], slot[whole]
    # a region with enough hits of one item on one band has as many places with any hit
    need, span = int(index.least[index.region >= index.q].min()) - 1, REGION + int(index.budget.max()) + 1
    if len(maybe) > need:
        dense = np.flatnonzero(maybe[need:] - maybe[: len(maybe) - need] <= span)
        edge = np.zeros(len(maybe) + 1, dtype=np.int64)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + need + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        maybe, slot = maybe[near], slot[near]
    else:
        maybe, slot = maybe[:0], slot[:0]
    per = index.first[slot + 1] - index.first[slot]
    found: dict[tuple[int, int], set[tuple[int, int, int, int]]] = {}
    width = int(index.budget.max()) + 1
    total, a = np.cumsum(per), 0
    while a < len(maybe):
        # texts with many hits are worked on in stretches that overlap by more than a region
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + most_hits, side="right")))
        part = slice(a, b)
        for cand in _candidates(maybe[part], slot[part], per[part], index, width):
            _verify(cand, chars, place, starts, index, width, found)
        if b >= len(maybe):
            break
        a = max(a + 1, int(np.searchsorted(maybe, maybe[b - 1] - 2 * (REGION + width))))
        if total[b - 1] - (total[a - 1] if a else 0) >= most_hits:
            a = b
    return [(t, i, *v) for (t, i), all_of in sorted(found.items()) for v in _apart(all_of)]


def _apart(passages: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The passages (start, end, characters, edits) in order without those that overlap a longer or closer one."""
    kept: list[tuple[int, int, int, int]] = []
    for p in sorted(passages, key=lambda p: (-p[2], p[3], p[0])):
        if all(p[1] <= k[0] or p[0] >= k[1] for k in kept):
            kept.append(p)
    return sorted(kept)


def _candidates(pos: np.ndarray, slot: np.ndarray, per: np.ndarray, index: Index, width: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Stretches of a diagonal band with enough hits: ``(item, first, lowest diagonal, first offset, offsets)``; a diagonal is place less offset."""
    n = int(per.sum())
    at = np.arange(n) - np.repeat(np.cumsum(per) - per, per) + np.repeat(index.first[slot], per)
    hit, item, offset = np.repeat(pos, per), index.items[at], index.offsets[at].astype(np.int64)
    diagonal = hit - offset + len(index.chars)
    for shift in (0, width):  # bands of twice the width overlap by half, so a drift of the width is inside one
        band = (diagonal + shift) // (2 * width)
        order = np.lexsort((hit, band, item))
        i, d, h, o = item[order], band[order], hit[order], offset[order]
        step = index.least[i] - 1
        other = np.arange(n) + step
        ok = other < n
        ends = np.where(ok, other, 0)
        ok &= (i[ends] == i) & (d[ends] == d) & (h[ends] - h <= index.region[i] + width - index.q)
        starts_at = np.flatnonzero(ok)
        if not len(starts_at):
            continue
        stops = starts_at + step[starts_at]
        # neighbouring stretches of the same item and band that touch are one
        new = np.concatenate([[True], (i[starts_at[1:]] != i[starts_at[:-1]]) | (d[starts_at[1:]] != d[starts_at[:-1]]) | (h[starts_at[1:]] > h[stops[:-1]] + REGION)])
        groups = np.flatnonzero(new)
        for x, y in zip(groups, [*(groups[1:] - 1), len(starts_at) - 1]):
            p, q = starts_at[x], stops[y]
            yield int(i[p]), int(h[p]), int(d[p]) * 2 * width - shift - len(index.chars), int(o[p : q + 1].min()), np.unique(o[p : q + 1])


def _windows(item: np.ndarray, at: np.ndarray, need: int, chars: np.ndarray, begin: int, end: int, lowest: int, width: int) -> np.ndarray:
    """Fewest edits of each ``item[x : x + need]``, x in ``at``, to a part of the text on the band above diagonal ``lowest``; all at once."""
    steps = np.arange(2 * width + 1)
    place = at[:, None] + lowest + steps
    rows = np.zeros(place.shape, dtype=np.int64)
    for i in range(need):
        here = place + i
        text = np.where((here >= begin) & (here < end), chars[np.clip(here, begin, end - 1)].astype(np.int64), -1)
        new = rows + (text != item[at + i, None])
        new[:, :-1] = np.minimum(new[:, :-1], rows[:, 1:] + 1)
        rows = np.minimum.accumulate(new - steps, axis=1) + steps
    return rows.min(axis=1)


def _verify(cand: tuple[int, int, int, int, np.ndarray], chars: np.ndarray, place: np.ndarray, starts: np.ndarray, index: Index, width: int, found: dict) -> None:
    item, first, lowest, low, offsets = cand
    high, q = int(offsets[-1]), index.q
    text = int(np.searchsorted(starts, first, side="right") - 1)
    origin = int(place[starts[text]])
    extent = int(place[first]) - origin, int(place[min(first + high - low + q, len(place)) - 1]) - origin + 1
    if any(x <= extent[0] and extent[1] <= y and not cost for x, y, _, cost in found.get((text, item), ())):
        return
    begin, end = int(starts[text]), int(starts[text + 1])
    whole = index.chars[index.starts[item] : index.starts[item + 1]]
    whole = whole[:-1] if len(whole) and whole[-1] == 32 else whole
    need = int(index.region[item])

    def holds(x: int, y: int, lead: int, wide: int) -> bool:
        """Whether the text has the item's x to y on the diagonals from ``lead``; notes the place."""
        left = max(begin, lead)
        budget = max(int((y - x) * EDITS), int(index.budget[item])) if y - x > need else int(index.budget[item])
        # before the text's start stand characters that match nothing, so the passage is in the band's middle
        region = np.concatenate([np.full(left - lead, -1), chars[left : min(end, lead + y - x + 3 * wide)].astype(np.int64)])
        cost, stop = edits(whole[x:y], region, wide, budget)
        if cost > budget:
            return False
        new = (int(place[left] - origin), int(place[max(left, min(lead + stop, end) - 1)] - origin + 1), y - x, cost)
        found.setdefault((text, item), set()).add(new)
        return True

    a, b = low, min(high + q, len(whole))
    if b - a < need:
        spare = need - (b - a)
        a = max(0, min(a - spare // 2, len(whole) - need))
        b = a + need
    # the hits' extent as one passage
    if holds(a, b, first - low + a - width, width):
        return
    # every region that keeps enough of its q-grams
    kept = np.zeros(len(whole) + 1, dtype=np.int64)
    kept[offsets + 1] = 1
    kept = np.cumsum(kept)
    at = np.arange(max(0, low + q - need), min(high, len(whole) - need) + 1)
    at = at[kept[at + need - q + 1] - kept[at] >= index.least[item]]
    for part in np.split(at, range(4096, len(at), 4096)):
        good = part[_windows(whole, part, need, chars, begin, end, lowest, width) <= index.budget[item]] if len(part) else part
        # regions next to each other are one passage, if that holds as a whole
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
            if len(run) and not holds(int(run[0]), int(run[-1]) + need, int(run[0]) + lowest, width):
                after = 0
                for x in run.tolist():
                    if x >= after and holds(x, x + need, x + lowest, width):
                        after = x + need


def indexes(benchmark: DataFrame) -> Iterator[tuple[list[Index], bool]]:
    """The benchmark's indexes by q, for each ``INDEX_CHARS`` characters (rounded up) of its items, and whether more come.

    Each has a proven size: items are dealt out by a hash into as many groups as their
    characters need, and a group is brought to the driver by itself when it is asked for.
    Items under ten normalised characters are too short to tell and match nothing.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-chars // INDEX_CHARS)
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, groups))))
    for g in range(groups):
        rows = dealt.where(F.col("group") == g).orderBy("item_id").collect()
        yield build_indexes([r.item_id for r in rows], [r.text for r in rows]), g + 1 < groups


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, end, n_chars, edits)``: benchmark passages in the documents.

    A row for each row of ``docs``, item and passage: a part of the text that holds the
    whole item, or at least 80 characters of it, with edits of at most 8 % (letters and
    digits in lower case, words one space apart). Passages of one item do not overlap.
    Offsets are code points of the text, within ten or so of the passage's ends. Texts of
    any length are searched whole; null and blank ones, an empty table and an empty
    benchmark match nothing; repeated rows each have their own matches, repeated items
    too. Ids are of any type, and other columns are not read. A benchmark of several
    groups is searched one group after the other, each result written before the next.
    """
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    kinds, item_arrow = f"doc_id {kind}, item_id {item_type.simpleString()}, start long, end long, n_chars long, edits long", to_arrow_type(item_type)
    out = None
    for index, more in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            alnum = _alnum()
            for batch in slices(batches, "text", 1 << 20):
                text = normal(batch.column("text").to_pylist(), alnum)
                for index in shared.value:
                    got = search(*text, index)
                    if not got:
                        continue
                    at = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), pa.array([index.ids[g[1]] for g in got], item_arrow), *(pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4, 5))],
                        names=["doc_id", "item_id", "start", "end", "n_chars", "edits"],
                    )

        part = rows.mapInArrow(apply, kinds)
        if more or out is not None:
            part = stored(part, "benchmark-found")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("doc_id", F.lit(None).cast(item_type).alias("item_id"), *(F.lit(None).cast("long").alias(c) for c in ("start", "end", "n_chars", "edits"))).where("false")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark (see ``find``), with all their columns.

    Null and blank texts stay, as do all rows if the benchmark is empty; repeated rows
    stay or go together. With a benchmark of several groups the rows that are left are
    written after each but the last.
    """
    for index, more in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            alnum = _alnum()
            for batch in slices(batches, "text", 1 << 20):
                text = normal([x or "" for x in batch.column("text").to_pylist()], alnum)
                hit = {g[0] for index in shared.value for g in search(*text, index)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)])) if hit else batch

        docs = docs.mapInArrow(apply, docs.schema)
        if more:
            docs = stored(docs, "benchmark-left")
            shared.unpersist()
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, null and blank texts among them; see ``clean``."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
