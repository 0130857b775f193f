"""Similarities of vectors (in the JVM) and of labels (Arrow batches, for which Spark has no function)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def comparable(a: Column, b: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Nought for missing, unequally long and null vectors."""
    return F.when(comparable(a, b), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def semantic_similarity(a: Column, b: Column, fallback: Column) -> Column:
    """Cosine within [0, 1], or ``fallback`` where there is none."""
    value = F.when(comparable(a, b), F.try_divide(dot(a, b), norm(a) * norm(b)))
    return F.when(value.isNull(), fallback).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def sorted_ratio(left: str, right: str) -> float:
    """Ratcliff-Obershelp ratio of the sorted words; not symmetric, so callers keep an order."""
    a, b = " ".join(sorted(left.split())), " ".join(sorted(right.split()))
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def best_ratio(left: list[str], right: list[str]) -> float:
    """The largest ratio of two lists' members."""
    return max((sorted_ratio(a, b) for a in left for b in right), default=0.0)


def lexical_similarity(left: Column | str, right: Column | str) -> Column:
    """Largest ratio over two lists of label variants."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([best_ratio(a, b) for a, b in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratios, "double")(left, right)


def sorted_words(text: Column) -> Column:
    """The text's words in order, as ``sorted_ratio`` compares them."""
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def ratio_of_sorted(left: Column | str, right: Column | str) -> Column:
    """Ratio of texts whose words are sorted already."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratios, "double")(left, right)


def counted_characters(text: Column) -> Column:
    """The text's characters, each with how often it has occurred so far, as one number: the overlap of two such arrays is that of the
    characters' counts."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.transform(chars, lambda c, i: F.shiftleft(c, 32) + F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)))


def lexical_floor(threshold: float, alpha: float, *, vectors: bool) -> float:
    """No pair whose lexical similarity is under this reaches the threshold, whatever its vectors."""
    if not vectors:
        return threshold
    return max(0.0, (threshold - alpha) / (1 - alpha)) if alpha < 1 else 0.0


def hybrid_similarity(lexical: Column, semantic: Column, left_type: Column, right_type: Column, alpha: float) -> Column:
    compatible = (left_type == right_type) | (left_type == "Other") | (right_type == "Other")
    mixed = F.lit(alpha) * semantic + F.lit(1 - alpha) * lexical
    return F.when(compatible, mixed).when(lexical >= 0.98, lexical).otherwise(F.least(lexical, semantic) * 0.75)
