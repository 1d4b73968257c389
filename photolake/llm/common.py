"""Pieces that several text operators share: splitting, folds and array kernels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are the runs of characters outside these (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def wider(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` with more columns of the named types."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in types.items())])


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no taken name equals it in any case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``more``; other columns are left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def byte_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text. ``bytes.split`` splits at just WORD's white space."""
    return text.lower().split()


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, each followed by one space, and where each begins (one more at the end)."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
    joined = " ".join(strings) + " " if strings else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def span_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]] along the first axis; empty spans give zero."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out


class WordHash:
    """64-bit polynomial hashes of spans of an array, by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        while len(self.powers) < n + 1:
            m = len(self.powers)
            step, back = pow(self.BASE, m, 1 << 64), pow(self.BASE, -m, 1 << 64)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(step)])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(back)])

    def __call__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(points))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.powers[: len(points)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
