"""Similarities of vectors, sets and words, as built-in column expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """The sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is missing or zero."""
    lengths = norm(a) * norm(b)
    return F.coalesce(F.when(lengths > 0, dot(a, b) / lengths), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """Minus the squared distance."""
    return -squared_distance(a, b)


def hamming_tanh(a: Column, b: Column) -> Column:
    """The mean of tanh(x) tanh(y): a smooth agreement of signs."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.tanh(x) * F.tanh(y))) / F.size(a)


def hamming_sign(a: Column, b: Column) -> Column:
    """The share of places where both are positive or both are not."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when((x > 0) == (y > 0), 1.0).otherwise(0.0))) / F.size(a)


def unit(a: Column) -> Column:
    """The vector of length 1 in the same direction; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(doubles(a), lambda x: x / norm(a)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values of two arrays taken as sets; null if both are empty or one is null."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def same_places(a: Column, b: Column) -> Column:
    """The share of equal values place by place, the estimate that minwise signatures of equal length give."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))) / F.size(a)


def hamming_words(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1 minus the share of differing bits of two pairs of 64-bit words."""
    return 1 - (F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))) / 128


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scores between 0 and 1, with a guard against equal ends."""
    return (score - low + 1e-8) / (high - low + 1e-8)


def zero_one(label: Column) -> Column:
    """+1 and -1 as 1 and 0."""
    return (label + 1) / 2


def both_orders(a: Column, b: Column) -> Column:
    """Two vectors behind each other, in both orders."""
    return F.array(F.concat(a, b), F.concat(b, a))
