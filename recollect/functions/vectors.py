"""Vector expressions over array<float|double> columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Null unless both are there and of one size."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def dot_or_zero(a: Column, b: Column) -> Column:
    """The variant in which vectors of two sizes have likeness 0."""
    return F.coalesce(dot(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Length 1; an all-zero vector stays as it is."""
    n = norm(a)
    by = F.array_repeat(n, F.size(a))  # the norm inside a lambda would be worked out again for every component
    return F.when(n > 0, F.zip_with(doubles(a), by, lambda x, m: x / m)).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean_pool(vectors: Column, dim: int) -> Column:
    """The mean of an array of vectors, component by component; null for an empty array."""

    def part(i: int) -> Column:
        return F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[i].cast("double")) / F.size(vectors)

    parts = [part(i) for i in range(dim)]
    return F.when(F.size(vectors) > 0, F.array(*parts))


def softmax(scores: Column, scale: float = 100.0) -> Column:
    """Shares that sum to 1, shifted by the largest so that nothing overflows."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) * scale))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def best_prompt(shares: Column, names: Column, least: float = 0.30) -> Column:
    """The name of the first largest share, or null below `least`."""
    top = F.array_max(shares)
    return F.when(top >= least, F.element_at(names, F.array_position(shares, top).cast("int")))


def any_alike(v: Column, phrases: list[Column], least: float = 0.15) -> Column:
    """Whether some phrase is alike enough; no vector means yes."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | (dot(v, p) >= least)
    return v.isNull() | hit


def sign_hash(v: Column, bits: int = 64) -> Column:
    """A 64-bit hash from the signs of the first components, most significant first."""
    h = F.lit(0).cast("long")
    for i in range(bits):
        h = F.shiftleft(h, 1).bitwiseOR(F.when(v[i] > 0, 1).otherwise(0).cast("long"))
    return h


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_text(h: Column) -> Column:
    """16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hash_bits(text: Column) -> Column:
    """The number that 16 hexadecimal digits stand for; null for anything else."""
    high, low = F.substring(text, 1, 8), F.substring(text, 9, 8)
    ok = text.rlike("^[0-9a-fA-F]{16}$")
    n = F.shiftleft(F.conv(high, 16, 10).cast("long"), 32).bitwiseOR(F.conv(low, 16, 10).cast("long"))
    return F.when(ok, n)
