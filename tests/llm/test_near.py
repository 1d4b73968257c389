"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np

from photolake.llm import simhash
from photolake.llm.simhash import near_copies, stage_near_dedup


def brute_groups(rows):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := text.lower().split()) else frozenset() for i, text in rows}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    return {top(i) for i in sets}


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(3000)]
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice((20, 80, 300)))]
        # chains of small edits: the ends of a chain are far from each other
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.choice((0, 1, 1, 2))):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(len(rows), ""), (len(rows) + 1, "  "), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_groups(rows)
    assert 25 <= len(expected) < 100
    assert {r.doc_id for r in near_copies(docs).collect()} == expected
    assert sorted(r.doc_id for r in stage_near_dedup(spark, docs, "").collect()) == sorted(expected)


def test_large_groups_equal_all_pairs(spark, monkeypatch):
    """More texts in a band than are paired, most of them too far from the origin: tiles find what joins them."""
    monkeypatch.setattr(simhash, "SMALL", 6)
    monkeypatch.setattr(simhash, "TILE", 20)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(150)]
        for i in range(110):
            text = list(base)
            for _ in range(i % 11):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies(docs).collect()} == brute_groups(rows)


def test_tiles_join_what_all_pairs_join():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 60)
    sets = []
    for i in range(70):
        x = base.copy()
        at = rng.choice(60, i % 14, replace=False)
        x[at] = rng.integers(0, 1 << 60, len(at))
        sets.append(np.unique(x))
    sig, label = np.arange(70) + 100, np.where(np.arange(70) % 3, np.arange(70), 0)
    similar = [(i, j) for i in range(70) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]

    def joined(edges):
        low = list(range(70))
        for _ in range(70):
            for i, j in [*edges, *((i, int(label[i])) for i in range(70))]:
                low[i] = low[j] = min(low[i], low[j])
        return low

    src, dst = simhash.tile_edges(sig, label, sets, np.zeros(70, int), True)
    assert len(src) < 70 and joined(list(zip(src - 100, dst - 100))) == joined(similar)
    half = np.arange(70) // 35
    src, dst = simhash.tile_edges(sig, label, sets, half, False)
    assert joined(list(zip(src - 100, dst - 100))) == joined([(i, j) for i, j in similar if half[i] != half[j]])


def test_fingerprints_link_near_copies_without_bands(spark, monkeypatch):
    """The vantage-point tree gives the stage near copies, and their overlap is counted: there are no bands here."""
    monkeypatch.setattr(simhash, "BANDS", 0)
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(5000)], []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(3000)]
        for _ in range(3):
            text[0] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    # one phrase over and over rules the fingerprint, yet most shingles differ
    phrase = ["all", "rights", "reserved"] * 300
    far = [" ".join(phrase + [rng.choice(words) for _ in range(60)]) for _ in range(2)]
    rows += [(len(rows) + i, t) for i, t in enumerate(far)]
    prints = simhash.simhash([t.encode() for _, t in rows])
    assert np.bitwise_count(prints[-1] ^ prints[-2]) <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_groups(rows)
    assert len(expected) == 14
    assert {r.doc_id for r in near_copies(docs).collect()} == expected
