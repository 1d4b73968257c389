"""Benchmark passages that only a part of a stretch, or a small q, shows."""

import random

import pytest

from photolake.llm import decontaminate

ALNUM = decontaminate._alnum()


def prose(rng, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) + " "
    return out[: n - 1] + "z"


def plain_regions(text, item, region=80, share=0.08):
    """Whether some ``region`` characters of the item (all, if it has fewer) are in the text but for the share of edits, by plain alignment."""
    n = min(region, len(item))
    for a in range(len(item) - n + 1):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item[a : a + n]):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= int(n * share):
            return True
    return False


def found(text, items):
    indexes = decontaminate.build_indexes(list(range(len(items))), items)
    return {index.ids[f[1]]: f for index in indexes for f in decontaminate.matches([text], index, ALNUM)}


@pytest.mark.parametrize("a,b", [(110, 170), (85, 150), (100, 215), (60, 219)])
def test_item_with_its_middle_replaced(a, b):
    rng = random.Random(a)
    item = prose(rng, 300)
    copy = item[:a] + prose(rng, b - a) + item[b:]
    text = f"{prose(rng, 400)} {copy} {prose(rng, 400)}"
    got = found(text, [prose(rng, 200), item])
    assert set(got) == {1}
    _, _, start, end, n, edits = got[1]
    assert n >= 80 and edits <= 0.08 * n and 390 < start < end < 715


@pytest.mark.parametrize("n", [13, 19, 25, 29, 38, 39, 50, 63, 75, 79, 80])
def test_short_items_have_their_whole_budget(n):
    for seed in range(8):
        rng = random.Random(seed)
        item, budget = prose(rng, n), int(n * 0.08)
        copy = list(item)
        # edits as far from each other as they can be leave the shortest runs
        for k in range(budget):
            copy[(k + 1) * n // (budget + 1)] = "7"
        text = f"{prose(rng, 300)} {''.join(copy)} {prose(rng, 300)}"
        assert set(found(text, [item])) == {0}
        copy[0] = copy[-1] = copy[n // (2 * budget + 2)] = copy[1] = "8"
        assert not found(f"{prose(rng, 300)} {''.join(copy)} {prose(rng, 300)}", [item])


@pytest.mark.parametrize("k", [82, 90, 110, 140])
@pytest.mark.parametrize("share", [0.1, 0.12, 0.15, 0.3])
@pytest.mark.parametrize("front", [True, False])
def test_an_exact_end_is_found_whatever_follows(k, share, front):
    for seed in range(10):
        rng = random.Random(seed)
        item = prose(rng, 420)
        copy = list(item)
        other = range(k, 420) if front else range(420 - k)
        for i in rng.sample(other, int(len(other) * share)):
            copy[i] = rng.choice("0123456789")
        assert set(found(f"{prose(rng, 300)} {''.join(copy)} {prose(rng, 300)}", [item])) == {0}


def test_matches_equal_plain_alignment_of_all_regions():
    seen = set()
    for seed in range(36):
        rng = random.Random(seed)
        item = prose(rng, rng.choice((40, 79, 95, 120)))
        copy = list(item)
        for i in rng.sample(range(len(item)), int(len(item) * rng.choice((0.04, 0.07, 0.09, 0.13)))):
            copy[i] = rng.choice(("", "7", copy[i] + "8"))
        copy = " ".join("".join(copy).split())
        text = f"{prose(rng, 60)} {copy} {prose(rng, 60)}"
        want = plain_regions(text, item)
        assert (set(found(text, [item])) == {0}) == want, seed
        seen.add(want)
    assert seen == {True, False}


def test_every_passage_is_given():
    rng = random.Random(9)
    item, other = prose(rng, 300), prose(rng, 90)
    text = f"{item[:120]} {prose(rng, 200)} {item[150:290]} {prose(rng, 150)} {other} {prose(rng, 150)} {other.upper()}"
    indexes = decontaminate.build_indexes(["a", "b"], [item, other])
    got = sorted((index.ids[f[1]], f[2], f[3]) for index in indexes for f in decontaminate.matches([text], index, ALNUM))
    want = [("a", 0, 120), ("a", 321, 461), ("b", 613, 703), ("b", 855, 945)]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(x - y) <= 12 for g, w in zip(got, want) for x, y in zip(g[1:], w[1:]))


def test_text_ids_and_several_groups(spark, monkeypatch):
    rng = random.Random(11)
    items = [prose(rng, 120) for _ in range(6)]
    docs = spark.createDataFrame([(f"d{i}", prose(rng, 200) + " " + items[i % 6]) for i in range(12)] + [("clean", prose(rng, 400)), (None, None)], "doc_id string, text string")
    benchmark = spark.createDataFrame([(f"i{i}", x, "more") for i, x in enumerate(items)] + [(None, None, None)], "item_id string, text string, start string")
    for chars in (1 << 22, 200):
        monkeypatch.setattr(decontaminate, "INDEX_CHARS", chars)
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, benchmark).collect()) == sorted((f"d{i}", f"i{i % 6}") for i in range(12))
        assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == {"clean", None}
