"""Whole queries, and the pipeline's stages, against brute-force versions on the smallest tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from photolake.llm import decontaminate, html, langid, sstable
from photolake.llm.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def placed(rows, tokenizer):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) in order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def test_media(spark, documents):
    for r in queries()["op4_media"](spark, FOLDER).collect():
        data = (documents[r.doc_id].text or "").encode()
        whole = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))


def test_clips_cover_every_file(spark, documents):
    ends = {}
    for r in queries()["media_clips"](spark, FOLDER).orderBy("doc_id", "clip").collect():
        frame, second = ends.get(r.doc_id, (-1, 0.0))
        assert r.first_frame == frame + 1 and abs(r.start_s - second) < 1e-9 and abs(r.end_s - (r.last_frame + 1) / 25) < 1e-9
        ends[r.doc_id] = r.last_frame, r.end_s
    assert {i: n + 1 for i, (n, _) in ends.items()} == {i: max(1, -(-len((d.text or "").encode()) // 576)) for i, d in documents.items()}


def test_token_ids(spark, documents, tokenizer):
    found = queries()["op7_token_ids"](spark, FOLDER).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == placed([(i, documents[i].text) for i in sorted(documents)], tokenizer)


def test_lookup_in_shards(spark, documents, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    manifest = sstable.write_shards(docs, str(tmp_path), public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=1 << 15)
    assert manifest.count() > 5
    asked = [*sorted(documents)[::17], 10**9, -4, sorted(documents)[0]]
    found = {r.doc_id: r.ids for r in sstable.lookup(manifest, asked).collect()}
    assert found == {i: [*tokenizer.encode(documents[i].text or "", add_special_tokens=False).ids, 2] for i in asked if i in documents}


def test_fingerprints_and_components(spark, documents):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(d.text) for i, d in documents.items()}
    low = {i: i for i in fp}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                low[b] = a
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op10_simhash"](spark, FOLDER).collect()} == {i: (f"{fp[i]:016x}", top(i)) for i in fp}


def test_language_equals_plain_bayes(spark, documents):
    """Posteriors from counts of hashed n-grams, a text at a time."""
    import numpy as np

    is_letter = langid.letters()
    grams = {i: langid.ngrams([d.text or ""], is_letter)[0] for i, d in documents.items()}
    learn = [d for i, d in documents.items() if zlib.crc32(str(i).encode()) % 4 != 2 and d.lang is not None]
    langs = sorted({d.lang for d in learn})
    counts = np.full((len(langs), langid.BUCKETS), 0.5)
    prior = np.zeros(len(langs))
    for d in learn:
        np.add.at(counts[langs.index(d.lang)], grams[d.doc_id], 1)
        prior[langs.index(d.lang)] += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    for r in queries()["op5_language_id"](spark, FOLDER).collect():
        g = grams[r.doc_id]
        s = logs[:, g].sum(axis=1) * min(1, 60 / max(1, len(g))) + np.log(prior / prior.sum())
        if not any(c.isalpha() for c in documents[r.doc_id].text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert r.lang_pred == langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-3


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in queries()["op8_html"](spark, FOLDER).collect()}
    assert found == {p.page_id: (p.url, html.main_text(p.html), len(html.main_text(p.html))) for p in pages}
    # no tag or character reference is left, and blocks are clean lines
    assert all(line == " ".join(line.split()) and line for _, t, _ in found.values() if t for line in t.split("\n"))


def test_pipeline_stages(spark, documents, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")

    known = step("language_id", docs)
    kept = {r.doc_id for r in known.collect()}
    assert kept <= set(documents) and not any(any(c.isalpha() for c in documents[i].text or "") is False for i in kept)
    single = step("near_dedup", known)
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i in kept for w in [documents[i].text.lower().split()]}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    ids = [r.doc_id for r in single.collect()]
    assert sorted(top(i) for i in ids) == sorted({top(i) for i in sets})
    clean = step("decontaminate", single)
    hit = {r.doc_id for r in decontaminate.find(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(ids) - hit)
    mixed = step("mix_sources", clean)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/decontaminate/documents.parquet/*.parquet'")
    taken = con.sql(f"SELECT doc_id, taken // size FROM ({oracle_sql()['op2_mixing']}) WHERE size > 0 AND taken > 0").fetchall()
    rows = mixed.collect()
    assert Counter(r.doc_id for r in rows) == dict(taken)
    out = stages["token_output"](spark, mixed, FOLDER).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == placed([(r.doc_id, r.text) for r in sorted(rows, key=lambda r: r.doc_id)], tokenizer)
    assert [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).orderBy("start").collect()] == [tuple(r) for r in out]
