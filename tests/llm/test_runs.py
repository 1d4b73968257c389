"""Periodic runs against a brute-force search, and the query on the given documents."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photolake.llm import runs

FOLDER = "/root/testdata/sf0.001"


def brute(w, least=24, repeats=3):
    """Every stretch that keeps a period and cannot be longer, if no smaller period fits it."""
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, repeats * q) and not any(all(w[s + t] == w[s + t + r] for t in range(size - r)) for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_parts(w, least=24, repeats=3):
    """As the operator does it, with other texts beside."""
    parts = runs.stretches([[b"x"] * 3, w, w[::-1], []], least, repeats)[1]
    return sorted(((a + s, size, p) for a, b in parts for s, size, p in runs.automaton_runs(w[a:b], least, repeats)), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.sampled_from([(24, 3), (6, 2), (9, 3), (4, 2), (12, 4)]))
def test_runs_are_those_of_brute_force(pieces, rule):
    w = [x for piece, times in pieces for x in piece * times]
    want = brute(w, *rule)
    assert runs.automaton_runs(w, *rule) == want
    assert by_parts(w, *rule) == want


def test_runs_of_random_words():
    rng = random.Random(7)
    seen = 0
    for _ in range(300):
        w = [b"%d" % rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(120))]
        for _ in range(3):
            p, s = rng.randint(1, 25), rng.randint(0, len(w))
            w[s:s] = w[s : s + p] * rng.randint(2, 5)
        want = brute(w)
        seen += len(want)
        assert runs.automaton_runs(w) == want == by_parts(w)
    assert seen > 200


@pytest.mark.parametrize("w", [[b"w"] * 60_000, [b"%d" % (i % 7) for i in range(60_000)], [b"%d" % (i * i % 9973) for i in range(9973)] * 4], ids=["one", "seven", "long"])
def test_long_texts(w):
    (found,) = runs.automaton_runs(w)
    assert found[:2] == (0, len(w))
    assert by_parts(w) == [found]


def test_repeated_lines_far_apart_go_to_no_automaton():
    line = [b"l%d" % i for i in range(40)]
    text = line + [b"x%d" % i for i in range(500)] + line + [b"y%d" % i for i in range(500)]
    assert runs.stretches([text]) == [[]]


def test_collapsed_leaves_the_first_period():
    w = [b"a", b"b"] * 14 + [b"z"]
    assert runs.automaton_runs(w) == [(0, 28, 2)]
    assert runs.collapsed(w, [(0, 28, 2)]) == [b"a", b"b", b"z"]


def expected(doc_id, text):
    """The contract, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n > 0:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_query_on_given_documents(spark):
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 8000]
    found = {r.doc_id: tuple(r) for r in runs.op12_runs(spark, FOLDER).collect()}
    assert len(found) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in docs:
        assert found[r.doc_id] == expected(*r), r.doc_id


def test_query_on_odd_texts(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 40_000), (4, "ü ß " * 30), (5, "a b c " * 30), (None, "x y z " * 12), (None, None), (6, "q\x1cr\x85 " * 25), (7, "a b c d\x0be\x0cf\r" * 9), (7, "a b c d\x0be\x0cf\r" * 9), (-1, "one two")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in runs.op12_runs(spark, str(tmp_path)).collect()), key=str)
    small = [r for r in rows if len(r[1] or "") < 8000]
    assert [r for r in found if r[0] != 3] == sorted((expected(*r) for r in small), key=str)
    assert [r[1:6] for r in found if r[0] == 3] == [(1, 0, 40_000, 1, 40_000_000)]


def test_ties_of_the_strongest(spark):
    odd = spark.createDataFrame([([(9, 30, 10), (3, 60, 20), (3, 30, 10), (0, 29, 10)],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r.best and tuple(r.best) for r in odd.select(runs.strongest().alias("best")).collect()] == [(3, 30, 10), None]
