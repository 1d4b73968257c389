"""License texts in other wordings, several times over, and in unseen notices."""

import random

from photolake.llm import licenses
from photolake.llm.license_texts import TEXTS

WORDS = [f"w{i}" for i in range(3000)]


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    out = {i: [] for i in range(len(texts))}
    for r in licenses.scan_licenses(docs).orderBy("doc_id", "start").collect():
        out[r.doc_id].append((r.license, r.start, r.end))
    return out


def filler(rng, n=60):
    return " ".join(rng.choices(WORDS, k=n))


def test_whole_texts_are_told_apart(spark):
    names = list(TEXTS)
    rng = random.Random(1)
    found = scanned(spark, [f"{filler(rng)} {TEXTS[n]} {filler(rng)}" for n in names])
    for i, name in enumerate(names):
        assert name in {x[0] for x in found[i]}, name
    # the GNU notices differ by few words: the right one is found
    for i, name in enumerate(names):
        if name in ("gpl", "lgpl", "agpl", "mit", "apache-2.0", "zlib", "unlicense"):
            best = max(found[i], key=lambda x: x[2] - x[1])
            assert best[0] == name


def test_edited_wordings_are_found(spark):
    rng = random.Random(2)
    texts, names = [], []
    for name, text in TEXTS.items():
        words = text.split()
        if len(words) < 60:
            continue
        for at in rng.sample(range(len(words)), len(words) // 50):
            words[at] = "someone"
        names.append(name)
        texts.append(f"{filler(rng)}\n # {' '.join(words).lower()} {filler(rng)}")
    found = scanned(spark, texts)
    assert all(name in {x[0] for x in found[i]} for i, name in enumerate(names))


def test_unseen_notices(spark):
    lines = {
        "This package is distributed under the MIT License (see LICENSE).": "mit-notice",
        "All of it is released under the Apache License, Version 2.0, by its authors.": "apache-notice",
        "The code may be used under the terms of the GNU General Public License version 2.": "gpl-notice",
        "Photos are published under a Creative Commons Attribution-ShareAlike 3.0 International License.": "cc-by-sa-notice",
        "Text is available under CC BY-SA 3.0 unless noted.": "cc-by-sa-notice",
        "This file is licensed under the Mozilla Public License 2.0.": "mpl-notice",
        "It is licensed under the BSD 3-Clause License.": "bsd-notice",
    }
    found = scanned(spark, [*lines, "He was licensed under the old law to sell fish.", "", None, "under the terms of the deal"])
    assert [{x[0] for x in found[i]} for i in range(len(lines))] == [{v} for v in lines.values()]
    assert not any(found[i] for i in range(len(lines), len(found)))


def test_every_place_is_given(spark):
    rng = random.Random(3)
    notice = "Licensed under the MIT License"
    parts = [filler(rng, 30), notice, filler(rng, 3), notice, filler(rng, 200), notice, TEXTS["mit"], TEXTS["mit"], filler(rng, 20), TEXTS["mit"]]
    text = " ".join(parts)
    found = scanned(spark, [text])[0]
    places, at = {"mit": [], "mit-notice": []}, 0
    for p in parts:
        if p in (notice, TEXTS["mit"]):
            places["mit" if p != notice else "mit-notice"].append((at, at + len(p)))
        at += len(p) + 1
    assert [(a, b) for n, a, b in found if n == "mit-notice"] == places["mit-notice"]
    mit = [(a, b) for n, a, b in found if n == "mit"]
    assert len(mit) == 3 and all(abs(a - x) <= 40 and abs(b - y) <= 40 for (a, b), (x, y) in zip(mit, places["mit"]))
