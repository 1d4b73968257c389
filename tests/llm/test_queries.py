"""Every query on odd and on empty tables, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from photolake.llm import mixing
from photolake.llm.registry import oracle_sql, queries

CLASH = ("score", "size", "target", "fingerprint", "lang_pred", "near_key", "tie", "media", "ids", "key", "taken", "held_out", "start", "uid", "worker", "n_tokens", "runs", "collapsed", "n_words", "best")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
EN = "the house of the river and a long road to the town with many people in it was quiet that day, and the light was low."
DE = "der weg zu dem haus und die lange straße in der stadt mit vielen menschen war ruhig an diesem tag, und das licht war schwach."


def rows():
    texts = [EN, DE, EN, None, "", " \t\n", "!!! ??? 123", EN + " " + DE, "word " * 30_000, EN.upper(), "zażółć gęślą jaźń 日本語 テキスト 😀", "a b"]
    texts += [f"{EN} number {i} {'xyz' * (i % 5)} {i * 7919}" for i in range(12)] + [f"{DE} nummer {i} {i * 104729}" for i in range(12)]
    out = [(i, t, "de" if t and "der" in t else "en" if i % 7 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), *("x",) * len(CLASH)) for i, t in enumerate(texts)]
    return [*out, out[0], out[3], (None, EN, None, None, None, *(None,) * len(CLASH)), (None, None, None, None, None, *(None,) * len(CLASH)), (-5, EN, "en", "s0", 1, *("y",) * len(CLASH))]


def write(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(24)] * bool(docs) + ([(3, None, None), (None, 1, 0), (0, 1, 1)] if docs else []), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, EN), (2, None), (3, ""), (4, "short")] if docs else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "u", f"<html><body><nav>menu</nav><article><p>{EN}</p></article></body></html>", "x"), (2, None, None, "x"), (3, "u", "", None), (None, "u", "<p>a", None)]
    spark.createDataFrame(pages if docs else [], "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [0.1 * (i % 5), 0.2, -0.1], i % 3, "x") for i in range(30)] + [(100, [0.4, 0.2, 0.0], 1, None), (None, [0.1], 1, "x"), (5, None, 1, "x"), (6, [None], 1, "x"), (7, [0.1], None, "x")]
    spark.createDataFrame(vectors if docs else [], "vec_id long, embedding array<float>, label int, v string").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


PER_DOCUMENT = [n for n in queries() if n not in ("op6_licenses", "op8_html", "op9_decontaminate", "media_clips", "op13_hard_negatives")]


@pytest.mark.parametrize("name", queries())
def test_odd_rows(spark, odd, name):
    found = queries()[name](spark, odd).collect()
    if name in PER_DOCUMENT:
        assert len(found) == len(rows())
    elif name == "media_clips":
        # each row's file has a clip at least, and its clips begin with the first frame
        assert len([r for r in found if r.clip == 0 and r.first_frame == 0]) == len(rows())
    elif name == "op8_html":
        assert {r.page_id: r.text for r in found} == {1: EN, 2: "", 3: "", None: "a"}
    elif name == "op9_decontaminate":
        assert {r.item_id for r in found} == {1}
        assert {r.doc_id for r in found} >= {0, 2, 7, 9, -5, None}
    elif name == "op13_hard_negatives":
        assert {r.anchor_id for r in found} == {0, 100}
    else:
        assert found == []


@pytest.mark.parametrize("name", queries())
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


def test_repeated_rows_agree(spark, odd):
    for name in ("op1_lm_score", "op3_quality", "op4_media", "op5_language_id", "op10_simhash"):
        found = queries()[name](spark, odd).where("doc_id IN (0, 3)")
        found = found.select(*(F.round(c, 4) if k == "double" else F.col(c) for c, k in found.dtypes))
        assert found.distinct().count() == 2, name


def test_language_of_odd_texts(spark, odd):
    found = {r.doc_id: r for r in queries()["op5_language_id"](spark, odd).collect()}
    assert [found[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4
    assert found[1].lang_pred == "de" and found[9].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in found.values())


def test_mixing_equals_sql(spark, odd, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = sorted(con.sql(oracle_sql()["op2_mixing"]).fetchall(), key=str)
    got = [tuple(r) for r in mixing.op2_mixing(spark, odd).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=str) == want
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_mixing_meets_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9).cast("int")), " ").alias("text"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 8).cast("string"))).alias("source"))
    found = mixing.mix(docs)
    sums = found.rows.groupBy("source").agg(F.sum(F.col("size") * found.times()).alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 5
    assert all(abs(r.taken - r.target) <= 16 for r in sums)


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(docs.count())
    ids = {r.doc_id for r in docs.collect()}
    # the benchmark passage, texts without letters and copies are gone
    assert not ids & {0, 1_000, 2, 3, 4, 5, 6, 7, 9, -5}
    assert ids & set(range(24, 36))
    assert counts[0] < len(rows()) and counts[1] < counts[0] and counts[2] < counts[1]


def test_pipeline_runs_whole(spark, odd, empty):
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
