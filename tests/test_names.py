"""Word similarity: published values, brute force over all runs, and searches through the index against all rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photolake.functions import similarity
from photolake.operators import names


def brute(needle, text):
    wanted = set(similarity.ordered_trigrams(needle)[0])
    grams, starts, ends = similarity.ordered_trigrams(text)
    share = lambda run: len(wanted & set(run)) / len(wanted | set(run)) if wanted | set(run) else 0.0
    plain = max((share(grams[i : j + 1]) for i in range(len(grams)) for j in range(i, len(grams))), default=0.0)
    strict = max((share(grams[i : j + 1]) for i in starts for j in ends if j >= i), default=0.0)
    return plain, strict


@pytest.mark.parametrize(
    "needle,text,plain,strict",
    [("word", "two words", 0.8, 4 / 7), ("words", "words", 1.0, 1.0), ("berlin", "east berlin", 1.0, 1.0), ("berlin", "east berliner", 6 / 7, 6 / 10), ("abc", "", 0.0, 0.0), ("abc", "xyz", 0.0, 0.0), ("!!", "abc", 0.0, 0.0)],
)
def test_published_values(needle, text, plain, strict):
    assert similarity.word_similarities(needle, text) == pytest.approx((plain, strict))


@settings(max_examples=300, deadline=None)
@given(st.text("ab .", max_size=12), st.text("abc .", max_size=24))
def test_equals_all_runs(needle, text):
    assert similarity.word_similarities(needle, text) == pytest.approx(brute(needle, text))


def test_long_texts_are_quick():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(20_000))
    plain, strict = similarity.word_similarities("abcdea dabcde", text)
    assert 0.4 < strict <= plain < 1


def rows_of(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["old", "town", "tówn", "Münster", "district", "berg", "bergen", "upper"]) + rng.choice(["", "s", "er"])
    name = lambda: None if rng.random() < 0.2 else " ".join(word() for _ in range(rng.randrange(4)))
    return [(i, rng.randrange(3), name(), name(), name(), rng.random() < 0.2) for i in range(n)]


SCHEMA = "id long, owner_id long, name string, admin string, more string, is_hidden boolean"
NEEDLES = ["old town", "TOWNS", "munster distrikt", "berg", "zzz", "", "Upper Bergen", "old town"]


def fold(text):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def test_places_through_the_index(spark):
    rows = rows_of(400, 3)
    places = spark.createDataFrame(rows, SCHEMA)
    columns = ["name", "admin", "more"]
    index = names.gram_index(places, columns)
    found = names.search_places(places, index, spark.createDataFrame([(n,) for n in NEEDLES], "needle string"), columns, limit=15).select("needle", "rank", "id", "distance").collect()
    want = []
    for needle in set(NEEDLES):
        near = []
        for r in rows:
            s = [None if t is None else brute(fold(needle), fold(t))[1] for t in r[2:5]]
            if any(x is not None and x >= 0.5 for x in s):
                near.append((round(sum(0.1 if x is None else 1 - x for x in s), 6), r[0]))
        want += [(needle, k + 1, i, pytest.approx(d)) for k, (d, i) in enumerate(sorted(near)[:15])]
    assert sorted(tuple(r) for r in found) == sorted(want, key=lambda r: r[:2]) and len(want) > 50


def test_people_of_their_owner(spark):
    rows = rows_of(300, 4)
    people = spark.createDataFrame(rows, SCHEMA)
    asked = [(o, n) for o in (0, 1) for n in ("old town", "berg")]
    index = names.gram_index(people, ["name"])
    found = names.search_people(people, index, spark.createDataFrame(asked, "owner_id long, needle string"), limit=8).select("owner_id", "needle", "rank", "id").collect()
    want = []
    for owner, needle in asked:
        near = [(round(1 - brute(needle, fold(r[2]))[1], 6), r[0]) for r in rows if r[1] == owner and not r[5] and r[2] is not None and brute(needle, fold(r[2]))[0] >= 0.5]
        want += [(owner, needle, k + 1, i) for k, (_, i) in enumerate(sorted(near)[:8])]
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 15


def test_common_trigrams_are_not_looked_up(spark):
    rows = [(i, f"town {i:04d} zq" if i == 7 else f"town {i:04d}") for i in range(500)]
    places = spark.createDataFrame(rows, "id long, name string")
    index = names.gram_index(places, ["name"])
    asked = names.candidates(index, spark.createDataFrame([("town zq",)], "needle string"), 0.9)
    assert [r.key for r in asked.collect()] == [7]
