"""Vector functions and the default embedder, which hashes words into dimensions; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

DIMENSIONS = 64


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_of(a: Column, b: Column, dimensions: int) -> Column:
    """The same for a known number of components, written out, so that it is compiled instead of interpreted per component."""
    total = F.lit(0.0)
    for i in range(dimensions):
        total = total + F.get(a, F.lit(i)) * F.get(b, F.lit(i))
    return total


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column | str) -> Column:
    return bind(_double(v), lambda v: bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


#: Components up to which products are written out.
WRITTEN_OUT = 128


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None, dimensions: int | None = None) -> Column:
    """0 where either vector is zero; norms may be given, computed once, and the ``dimensions`` that nearly all have."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    product = dot(a, b)
    if dimensions is not None and 0 < dimensions <= WRITTEN_OUT:
        product = F.when((F.size(a) == dimensions) & (F.size(b) == dimensions), dot_of(a, b, dimensions)).otherwise(product)
    return F.when(size == 0, F.lit(0.0)).otherwise(product / size)


def word_dimensions(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """The dimension of each word, in order."""
    return F.transform(words(F.lower(text)), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int"))


def hashed_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """Words per dimension (not scaled)."""
    every = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return bind(word_dimensions(text, dimensions), lambda dims: F.transform(every, lambda d: (F.size(dims) - F.size(F.array_remove(dims, d))).cast("double")))


def sparse_cosine(dims: Column, dense: Column, dense_norm: Column) -> Column:
    """Cosine of a short text, given by its words' dimensions, with a dense count vector: work in proportion to the short one."""
    product = F.aggregate(dims, F.lit(0.0), lambda s, d: s + F.element_at(dense, d + 1))
    own = F.sqrt(F.aggregate(dims, F.lit(0.0), lambda s, d: s + F.size(F.filter(dims, lambda x: x == d)).cast("double")))
    size = own * dense_norm
    return F.when(size == 0, F.lit(0.0)).otherwise(product / size)
