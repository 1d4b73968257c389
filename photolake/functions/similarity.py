"""Word similarity of texts: the best run of a text's trigrams for a needle."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake.functions import scalar

_WORD = re.compile(r"[^\W_]+")


def ordered_trigrams(text: str) -> tuple[list[str], list[int], list[int]]:
    """Trigrams of the words in order (two spaces in front, one behind each), and where each word's begin and end."""
    grams: list[str] = []
    starts, ends = [], []
    for word in _WORD.findall(text):
        padded = f"  {word} "
        starts.append(len(grams))
        grams += [padded[i : i + 3] for i in range(len(word) + 1)]
        ends.append(len(grams) - 1)
    return grams, starts, ends


def _best(wanted: set[str], grams: list[str], firsts: list[int], lasts: list[int]) -> float:
    """The greatest share of common trigrams among those of both, over runs that begin at one of ``firsts`` and end at one of ``lasts``."""
    best, may_end = 0.0, set(lasts)
    for i in firsts:
        seen: set[str] = set()
        common = 0
        for j in range(i, len(grams)):
            if grams[j] not in seen:
                seen.add(grams[j])
                common += grams[j] in wanted
                # more trigrams than this cannot be made up for by any that are left
                if len(seen) * best > len(wanted):
                    break
            if j in may_end:
                best = max(best, common / (len(wanted) + len(seen) - common))
    return best


def word_similarities(needle: str, text: str) -> tuple[float, float]:
    """Similarity of ``needle`` to the best run of the text's trigrams, and to the best run of whole words.

    The similarity of two sets of trigrams is the share of common ones among all of both.
    Both texts are folded already. A best run begins and ends with a trigram, or a word
    with one, that the needle has; a text without any has 0.
    """
    wanted = set(ordered_trigrams(needle)[0])
    grams, starts, ends = ordered_trigrams(text)
    hits = [i for i, g in enumerate(grams) if g in wanted]
    if not hits:
        return 0.0, 0.0
    plain = _best(wanted, grams, hits, hits)
    held = [(a, b) for a, b in zip(starts, ends) if any(g in wanted for g in grams[a : b + 1])]
    return plain, _best(wanted, grams, [a for a, _ in held], [b for _, b in held])


_BOTH = T.StructType([T.StructField("word", T.DoubleType()), T.StructField("strict", T.DoubleType())])


@F.pandas_udf(_BOTH)
def _similarities(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
    pairs = [(None, None) if n is None or t is None else word_similarities(n, t) for n, t in zip(needle, text)]
    return pd.DataFrame(pairs, columns=["word", "strict"], dtype=float)


def folded(text: Column) -> Column:
    """Without accents, in lower case."""
    return F.lower(scalar.unaccent(text))


def similarities(needle: Column, text: Column) -> Column:
    """``word`` and ``strict`` similarity of a needle to a text; null if either is."""
    return _similarities(folded(needle), folded(text))
