"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import code_points, fold, fresh, letters, slices, span_sums, texts, wider
from photolake.session import stored, table

BUCKETS = 1 << 15
MOST_LANGUAGES = 1000
UNKNOWN = "und"


def ngrams(strings: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams (1 to 3 letters, with the spaces at word ends), where each text's begin, and its letters."""
    points, starts = code_points([s.lower() for s in strings])
    low = np.minimum(points, 0xFFFF).astype(np.uint16)
    keep = is_letter[low]
    if (points > 0xFFFF).any():
        high = np.flatnonzero(points > 0xFFFF)
        keep = keep.copy()
        keep[high] = [chr(int(c)).isalpha() for c in points[high]]
    clean = np.where(keep, points, np.uint32(32))
    here = np.concatenate([[False], keep, [False]])
    before = here[:-2]
    a = np.concatenate([np.array([32], np.uint32), clean[:-1]]) * np.uint32(0x85EBCA6B)
    b = clean * np.uint32(0xC2B2AE35)
    c = np.concatenate([clean[1:], np.array([32], np.uint32)]) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 15)
    mix = np.uint32(0x9E3779B1)
    one = ((b + np.uint32(1)) * mix) >> shift
    two = ((a + b + np.uint32(2)) * mix) >> shift
    three = ((a + b + c + np.uint32(3)) * mix) >> shift
    grams = np.stack([one, two, three], axis=1)
    real = np.stack([keep, keep | before, keep], axis=1)
    per_char = real.sum(axis=1)
    return grams[real], np.concatenate([[0], np.cumsum(span_sums(per_char, starts))]), span_sums(keep, starts)


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)``: n-gram counts of the rows that have a ``lang``; bucket -1 counts rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, sums, rows = letters(), {}, {}
        for batch in slices(batches, "text", 1 << 20):
            langs = batch.column("lang").to_pylist()
            grams, starts, _ = ngrams(batch.column("text").to_pylist(), is_letter)
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(starts))
                got = np.bincount(grams[mine], minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
                rows[lang] = rows.get(lang, 0) + langs.count(lang)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.record_batch(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(got[at], rows[lang]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    learn = docs.where("lang IS NOT NULL")
    return learn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (buckets and one last row of priors, by languages).

    ``docs`` has text and lang; all its rows are counted. The matrix has 32,769 rows and
    a column for each language, of which there may be 1,000; more is an error.
    """
    found = stored(counts(docs), "lang-counts")
    if found.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    got = found.toPandas()
    langs = sorted(got["lang"].unique())
    matrix = np.zeros((BUCKETS + 1, len(langs)))
    matrix[got["bucket"].to_numpy(), [langs.index(x) for x in got["lang"]]] = got["n"].to_numpy()
    if langs:
        grams = matrix[:BUCKETS] + smoothing
        matrix[:BUCKETS] = np.log(grams / grams.sum(axis=0))
        matrix[BUCKETS] = np.log(matrix[BUCKETS] / matrix[BUCKETS].sum())
    return langs, matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], lang_column: str = "lang_pred", score_column: str = "score", evidence: int = 60) -> DataFrame:
    """``docs`` with the language and score of each row's whole ``text`` in two new columns.

    The language is one of the learned ones; ``und`` with score 0 if the text is null or
    has no letter, or if nothing was learned. Equal posteriors go to the first language
    by code point. The score is the posterior after scaling the log likelihood to at
    most ``evidence`` n-grams, so that long texts are not all 1. Repeated rows stay;
    an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, lang_column, score_column]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        is_letter = letters()
        for batch in slices(batches, "text", 1 << 20):
            grams, starts, n_letters = ngrams([x or "" for x in batch.column("text").to_pylist()], is_letter)
            if langs:
                sums = np.stack([span_sums(matrix[:BUCKETS, k][grams], starts) for k in range(len(langs))], axis=1)
                n = np.maximum(np.diff(starts), 1)
                sums = sums * np.minimum(1, evidence / n)[:, None] + matrix[BUCKETS]
                best = sums.argmax(axis=1)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                share = odds.max(axis=1) / odds.sum(axis=1)
            else:
                best, share = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            known = (n_letters > 0) & bool(langs)
            label = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(np.where(known, share, 0.0))], names=names)

    return docs.mapInArrow(score, wider(docs, **{lang_column: "string", score_column: "double"}))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held = (fold("doc_id", 4) == 2).alias("held_out")
    model = fit(texts(docs, "lang", held).where("NOT held_out").select("text", "lang"))
    return predict(texts(docs, held), model).select("doc_id", "held_out", "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is known: ``und`` and scores below ``least`` go.

    Null, empty and blank texts and those without letters are ``und``. All rows that have
    a ``lang`` are learned from; without any, all documents go. Repeated rows go or stay
    together. The columns are those of ``docs``, whatever their names.
    """
    columns = docs.columns
    lang, score = fresh("lang_pred", columns), fresh("lang_score", columns)
    model = fit(docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang"))
    return predict(docs, model, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*columns)
