"""SimHash near-duplicates through a vantage-point tree; for the pipeline, near copies from it and from MinHash bands, by exact shingle overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import fresh, raw, slices, texts
from photolake.operators.graph import connected_components
from photolake.session import stored, table

SEED = 42
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(text: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the spans of ``text``: those under 32 bytes together, the others one by one."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    padded = np.frombuffer(text + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray(len(text) + 1, dtype="<u4", buffer=padded, strides=(1,))
    lengths = np.minimum(ends - starts, 32).astype(np.uint8)
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            at = order[edges[n] : edges[n + 1]]
            if not len(at):
                continue
            p = starts[at]
            h = np.full(len(at), np.uint64(seed) + P5 + np.uint64(n), dtype=np.uint64)
            done = 0
            while done + 8 <= n:
                k = _rotl(eight[p + done] * P2, 31) * P1
                h = _rotl(h ^ k, 27) * P1 + P4
                done += 8
            if done + 4 <= n:
                h = _rotl(h ^ (four[p + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            for i in range(done, n):
                h = _rotl(h ^ (padded[p + i].astype(np.uint64) * P5), 11) * P1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            out[at] = h ^ (h >> np.uint64(32))
    for i in order[edges[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]], seed)
    return out


_LANES = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], dtype=np.uint64)


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each span of ``hashes`` the bits set in over half of them; an empty span gives 0."""
    n = np.diff(starts)
    counts = np.zeros((len(n), 64), dtype=np.int64)
    full = np.flatnonzero(n > 0)
    if len(full):
        # byte lanes hold sums of up to 255 hashes, so spans are cut into blocks of that size
        blocks = (n[full] + 254) // 255
        first = np.concatenate([[0], np.cumsum(blocks)])
        at = np.repeat(starts[full], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums = np.add.reduceat(_LANES[octets[:, k]], at).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts[full, 8 * k : 8 * k + 8] = np.add.reduceat(sums, first[:-1], axis=0)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingles(documents: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of UTF-8 texts, repeats included, and where each text's begin.

    A text of fewer words has one shingle of them all, a blank one none.
    """
    split = [d.lower().split() for d in documents]
    words = [w for ws in split for w in ws]
    n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    word = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(np.cumsum(n) - n, counts)
    last = word + np.repeat(np.minimum(n, size), counts) - 1
    return xxh64(b" ".join(words), starts[word], ends[last]), first


def simhash(documents: list[bytes], size: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts from their ``size``-word shingles, repeats included."""
    return majority(*shingles(documents, size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, fp)`` for each row of ``docs``; ``tie`` is a hash of the text. Null texts are empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            fp = simhash(raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fp.view(np.int64))], names=["doc_id", "tie", "fp"])

    rows = texts(docs, F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


# --- vantage-point tree -----------------------------------------------------------------


def split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[int, int] | None:
    """A vantage point and ball radius that part ``points`` well, or None if no ball does.

    Pairs within ``radius`` of each other across the sphere have their outer point at
    most ``radius`` outside (triangle inequality), so only those are in both sides. The
    choice lowers the work, the sum of both sides' squares.
    """
    best, found = 0.85 * float(len(points)) ** 2, None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        per = np.bincount(np.bitwise_count(points ^ v), minlength=65).cumsum()
        wide = per[np.minimum(np.arange(65) + radius, 64)].astype(float)
        work = wide**2 + (len(points) - per.astype(float)) ** 2
        mu = int(work.argmin())
        if work[mu] < best:
            best, found = work[mu], (int(v), mu)
    return found


def build(sample: np.ndarray, leaf: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage point, ball radius, inside, outside)``; a child below zero is the leaf ``-child - 1``."""
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal leaves
        cut = split(points, radius) if len(points) > leaf and depth < 40 else None
        if cut is None:
            leaves += 1
            return -leaves
        me = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(points ^ np.uint64(cut[0]))
        nodes[me] = (*cut, grow(points[d <= cut[1] + radius], depth + 1), grow(points[d > cut[1]], depth + 1))
        return me

    grow(sample, 0)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of each point: positions in ``points`` and leaf numbers."""
    at, leaf = [], []
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        node, mine = todo.pop()
        if not len(mine):
            continue
        if node < 0:
            at.append(mine)
            leaf.append(np.full(len(mine), -node - 1))
            continue
        v, mu, inside, outside = nodes[node]
        d = np.bitwise_count(points[mine] ^ np.uint64(v))
        todo += [(inside, mine[d <= mu + radius]), (outside, mine[d > mu])]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *leaf])


def stars(points: np.ndarray, radius: int, brute: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each group linked within ``radius`` among ``points``, not all its pairs.

    Large inputs are parted by vantage points again. A small one is searched by
    growing each group from one point; a point found leaves the rest at once.
    """
    if len(points) > brute and (cut := split(points, radius)):
        d = np.bitwise_count(points ^ np.uint64(cut[0]))
        sides = [stars(points[d <= cut[1] + radius], radius, brute), stars(points[d > cut[1]], radius, brute)]
        return np.concatenate([a for a, _ in sides]), np.concatenate([b for _, b in sides])
    rest, src, dst = np.sort(points), [], []
    while len(rest) > 1:
        center, rest = rest[:1], rest[1:]
        front = center
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for p in front:
                near |= np.bitwise_count(rest ^ p) <= radius
            front, rest = rest[near], rest[~near]
            src.append(front)
            dst.append(np.repeat(center, len(front)))
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def links(fps: DataFrame, n: int, radius: int = 2, leaf_rows: int = 1000, most_leaves: int = 1 << 17) -> DataFrame:
    """``(src, dst)`` fingerprints whose components are those of all pairs within ``radius`` bits.

    ``fps`` has distinct ``fp``, ``n`` of them. A tree built from a sample (at most 16
    rows for each of ``most_leaves`` leaves, 17 MB in all) deals the fingerprints out;
    those near a sphere go to both sides, so each pair meets in some leaf. Leaves part
    further where they are worked on, so past ``most_leaves`` (some 130 million distinct
    fingerprints) they only become deeper: 8 bytes a fingerprint and copy. No pair is lost.
    """
    leaves = int(min(most_leaves, max(1, n // leaf_rows)))
    per = 16
    chosen = fps.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(per * leaves).toPandas() if leaves > 1 else pd.DataFrame({"fp": []})
    nodes = build(chosen["fp"].to_numpy(np.int64).view(np.uint64), per, radius)
    shared = fps.sparkSession.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            at, leaf = route(points, shared.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(points[at].view(np.int64))], names=["leaf", "fp"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        src, dst = stars(group["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    # a task has few leaves however many there are
    dealt = fps.mapInArrow(deal, "leaf long, fp long").repartition(max(1, leaves // 4), "leaf")
    return dealt.groupBy("leaf").applyInPandas(search, "src long, dst long")


def fingerprint_groups(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, group_fp)``: the smallest fingerprint reachable from each of the distinct ``fp`` that has another within ``radius`` bits."""
    linked = connected_components(links(fps.select("fp"), fps.count(), radius))
    return linked.select(F.col("node").alias("fp"), F.col("component").alias("group_fp"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``(doc_id, tie, fp, group_fp, component_id)`` for each row of ``docs``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer. ``component_id``
    is the smallest ``doc_id`` that can be reached, null if all of them are null;
    ``group_fp`` is the smallest fingerprint. Null and blank texts have fingerprint 0 and
    link like any other. Equal fingerprints collapse to one before the search; repeated
    rows stay in the result. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-fp")
    groups = fingerprint_groups(fps, radius)
    linked = fps.join(groups, "fp").select("fp", "group_fp", "low")
    lowest = linked.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    of_linked = linked.join(lowest, "group_fp").select("fp", "group_fp", "component_id")
    alone = fps.where("n > 1").join(groups, "fp", "left_anti").select("fp", F.col("fp").alias("group_fp"), F.col("low").alias("component_id"))
    return rows.join(of_linked.unionByName(alone), "fp", "left").select(
        "doc_id", "tie", "fp", F.coalesce("group_fp", "fp").alias("group_fp"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by fingerprints and shingle overlap, for the pipeline -------------------

#: Texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 4/5 or more.
WORDS, ALIKE, OF = 5, 4, 5
#: MinHash bands and hashes in each. At 4/5 the chance that no band agrees is (1 - 0.8 ** 4) ** 25, under 2e-6.
BANDS, DEPTH = 25, 4
_RNG = np.random.default_rng(SEED)
MULTIPLY, ADD = _RNG.integers(1, 1 << 63, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)


def shingle_sets(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct ``WORDS``-word shingles in order, where each text's begin, and how many each has with repeats."""
    hashes, first = shingles(documents, WORDS)
    owner = np.repeat(np.arange(len(documents)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(documents) + 1)), np.diff(first)


def band_keys(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each set that is not empty."""
    at = starts[:-1][np.diff(starts) > 0]
    keys = np.zeros((len(at), BANDS), dtype=np.uint64)
    if len(at):
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                key = np.full(len(at), np.uint64(band + 1))
                for k in range(band * DEPTH, (band + 1) * DEPTH):
                    key = (key ^ np.minimum.reduceat(sets * MULTIPLY[k] + ADD[k], at)) * P1
                    key ^= key >> np.uint64(29)
                keys[:, band] = key
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, n, fp, sig, keys)`` for each row: a hash of the text, its shingles with repeats, its fingerprint, a hash of the shingles' set, and its bands."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            documents = raw(batch.column("text"))
            fp = simhash(documents)
            sets, starts, n = shingle_sets(documents)
            sig = np.fromiter((xxhash.xxh64_intdigest(sets[a:b].tobytes(), SEED) for a, b in zip(starts[:-1], starts[1:])), np.uint64, batch.num_rows)
            ends = np.concatenate([[0], np.cumsum((np.diff(starts) > 0) * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(sets, starts).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(fp.view(np.int64)), pa.array(sig.view(np.int64)), keys], names=["doc_id", "tie", "n", "fp", "sig", "keys"])

    rows = texts(docs, _text_hash().alias("tie"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie long, n long, fp long, sig long, keys array<long>")


def _named(doc_id: Column, tie: Column) -> Column:
    """A row's id and text hash in one text, which no null hides."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), tie.cast("string"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(sig, set)`` for the rows of ``docs`` whose id and text hash are a ``name`` of ``wanted`` ``(sig, name)``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets, starts, _ = shingle_sets(raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["sig", "set"])

    rows = docs.select(_named(F.col("doc_id"), _text_hash()).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows have one name
    once = rows.join(wanted, "name").dropDuplicates(["sig"])
    return once.select("sig", "text").mapInArrow(apply, "sig long, set array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those ``(src, dst)`` whose sets have the similarity, counted exactly."""
    both = pairs.join(sets.select(F.col("sig").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("sig").alias("dst"), F.col("set").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * OF >= ALIKE * (F.size("a") + F.size("b") - shared)).select("src", "dst")


#: A band of more open texts than ``SMALL`` is not paired but worked on in tiles of twice ``TILE`` texts at most.
SMALL, TILE = 32, 2048


def tile_edges(sig: np.ndarray, label: np.ndarray, sets: list[np.ndarray], side: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges between similar texts of different labels that join all labels which such texts join.

    In an ``own`` tile all texts are compared, else those of side 0 with those of side 1.
    Texts of the commonest label are not compared with each other; overlaps are counted
    through an index of the shingles, a text at a time, so no pairs are kept.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, code, count = np.unique(label, return_inverse=True, return_counts=True)
    up = np.arange(len(names))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    src, dst = [], []
    for i in np.flatnonzero(code != count.argmax()).tolist():
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = b - a
        hits = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[hits], minlength=len(sets))
        found = (shared * OF >= ALIKE * (size[i] + size - shared)) & (code != code[i])
        if not own:
            found &= side != side[i]
        for j in np.flatnonzero(found).tolist():
            x, y = top(int(code[i])), top(int(code[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                src.append(i)
                dst.append(j)
    return sig[src], sig[dst]


def tiled(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``(src, dst)``: edges of the large bands of ``rest`` ``(key, sig, label, open)``, found tile by tile (see ``tile_edges``)."""
    blocks = F.ceil(F.col("open") / TILE).cast("int")
    mine = rest.withColumn("block", F.pmod(F.xxhash64("sig", "key"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = mine.withColumn("other", other).select("key", "sig", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = group["i"].iat[0] == group["j"].iat[0]
        found = tile_edges(group["sig"].to_numpy(np.int64), group["label"].to_numpy(np.int64), [np.asarray(x) for x in group["set"]], group["side"].to_numpy(), own)
        return pd.DataFrame({"src": found[0], "dst": found[1]})

    return dealt.join(sets, "sig").groupBy("key", "i", "j").applyInPandas(search, "src long, dst long")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """``(key, sig, texts)``: the rows of ``keyed`` ``(sig, key)`` whose key has more than one text, and how many it has."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    return keyed.join(shared, "key").select("key", "sig", "texts")


def exact_links(members: DataFrame, sets: DataFrame, edges: DataFrame | None = None, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges`` ``(src, dst)`` with more of them, and their components: all that pairs which share a key and have the exact similarity join.

    ``members`` are ``(key, sig, texts)`` of ``shared_keys``; texts that ``edges`` join already
    (``groups`` are their components) are not compared. First each text of a key is compared
    with the one that shares most keys with others (a group's origin rather than a much edited
    copy of it). What a key's texts then lack to be joined is found from the pairs of small
    keys and, in tiles, from the overlaps of large ones, so a large group of copies costs no
    pairs of its members, and no pair of a key is left out.
    """

    def labelled(groups: DataFrame | None) -> DataFrame:
        if groups is None:
            return members.select("key", "sig", F.col("sig").alias("label"))
        return members.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("label"))

    crowd = members.groupBy("sig").agg(F.sum("texts").alias("crowd"))
    before = labelled(groups)
    centre = before.join(crowd, "sig").groupBy("key").agg(F.max_by(F.struct("sig", "label"), F.struct("crowd", "sig")).alias("c")).select("key", F.col("c.sig").alias("centre"), F.col("c.label").alias("of_centre"))
    pairs = before.join(centre, "key").where("label <> of_centre").select(F.least("sig", "centre").alias("src"), F.greatest("sig", "centre").alias("dst")).distinct()
    pairs = stored(pairs, "near-stars")
    found = stored(alike(pairs, sets), "near-pairs")
    edges = found if edges is None else edges.unionByName(found)
    groups = connected_components(edges)
    size = sets.select(F.col("sig"), F.size("set").alias("n"))
    after = labelled(groups)
    apart = after.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("open")).where("x <> y").select("key", "open")
    rest = stored(after.join(apart, "key").join(size, "sig"), "near-rest")
    few = rest.where(f"open <= {SMALL}")
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("sig", "label", "n"))) for side in "ab")
    open_pairs = a.join(b, "key").where(f"sig_a < sig_b AND label_a <> label_b AND n_a * {OF} >= n_b * {ALIKE} AND n_b * {OF} >= n_a * {ALIKE}")
    # those with a centre have been compared
    open_pairs = open_pairs.select(F.col("sig_a").alias("src"), F.col("sig_b").alias("dst")).distinct().join(pairs, ["src", "dst"], "left_anti")
    more = stored(alike(open_pairs, sets).unionByName(tiled(rest.where(f"open > {SMALL}"), sets)), "near-pairs")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        groups = connected_components(edges)
    return edges, groups


def near_copies(docs: DataFrame) -> DataFrame:
    """``(group, more, last, doc_id, tie)``: for each group of near copies the fullest one: most shingles, then smallest ``doc_id`` (nulls last), then text hash.

    Groups are the components of all pairs of texts that share a fingerprint group or a band
    and have the exact similarity. Equal shingle sets are one. First come the groups of
    SimHash fingerprints within two bits, through the vantage-point tree. Near copies that
    are further apart than a tree can search for share a MinHash band, and are compared
    where the first step has not joined them.
    """
    kinds = sketches(docs).groupBy("sig").agg(F.min(F.struct((-F.col("n")).alias("more"), F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "fp")).alias("least"), F.first("keys").alias("keys"))
    kinds = stored(kinds, "near")
    prints = kinds.select("sig", F.col("least.fp").alias("fp"))
    grouped = fingerprint_groups(stored(prints.select("fp").distinct(), "near-fp"))
    close = stored(shared_keys(prints.join(grouped, "fp", "left").select("sig", F.coalesce("group_fp", "fp").alias("key"))), "near-close")
    bands = stored(shared_keys(kinds.select("sig", F.explode("keys").alias("key"))), "near-bands")
    compared = close.select("sig").unionByName(bands.select("sig")).distinct()
    wanted = kinds.join(compared, "sig", "left_semi").select("sig", _named(F.col("least.doc_id"), F.col("least.tie")).alias("name"))
    sets = stored(sets_of(docs, wanted), "near-sets")
    _, groups = exact_links(bands, sets, *exact_links(close, sets))
    found = kinds.select("sig", "least").join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    return found.groupBy(F.coalesce("component", "sig").alias("group")).agg(F.min("least").alias("least")).select("group", "least.more", "least.last", "least.doc_id", "least.tie")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the fullest text's, of equals that of the smallest ``doc_id`` (nulls last), then text hash.

    Groups come from SimHash through the vantage-point tree, then MinHash bands, each pair
    counted exactly. Null, empty and blank texts are copies of each other; repeated rows are one. Texts of
    any length are compared whole. The columns are those of ``docs``, whatever their names.
    """
    columns = docs.columns
    key = fresh("near_key", columns)

    keep = near_copies(docs).select(_named(F.col("doc_id"), F.col("tie")).alias(key))
    rows = docs.withColumn(key, _named(F.col("doc_id"), _text_hash()))
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).select(*columns)
