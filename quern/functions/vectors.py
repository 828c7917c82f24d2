"""Column expressions over vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(vectors: Column, width: Column) -> Column:
    """Sum of an array of vectors of the given width."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), add)


def concat(*vectors: Column) -> Column:
    return F.concat(*vectors)


def cut(v: Column, start: int, stop: int) -> Column:
    """Entries start..stop-1, counted from 0."""
    return F.slice(v, start + 1, stop - start)


def constant(value: float, width: int) -> Column:
    return F.array_repeat(F.lit(float(value)), width)


def width(v: Column) -> Column:
    return F.size(v)


def argmax(v: Column) -> Column:
    """Index of the largest entry, the first of equals, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def topk(v: Column, k: int) -> Column:
    """Indices of the k largest entries, larger first, lower index first among equals."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def to_sparse(v: Column) -> Column:
    """struct(size, indices, values) of the entries that aren't zero."""
    kept = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
    return F.struct(F.size(v).alias("size"), F.transform(kept, lambda s: s["i"]).alias("indices"), F.transform(kept, lambda s: s["x"]).alias("values"))


def to_dense(size: Column, indices: Column, values: Column) -> Column:
    """Entries without an index are 0. The inputs are bound to a variable first, so they are computed once and not once an entry."""
    bound = F.array(F.struct(size.alias("n"), F.map_from_arrays(indices, values).alias("known")))

    def one(s: Column) -> Column:
        filled = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.coalesce(F.try_element_at(s["known"], i), F.lit(0.0)))
        return F.when(s["n"] <= 0, F.array().cast("array<double>")).otherwise(filled)

    return F.transform(bound, one)[0]


def pairs_to_map(pairs: Column, key: str, value: str) -> Column:
    """Array of structs to a map; of equal keys the last stays. One sort, so n log n for a hub's list."""
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p[key].alias("k"), i.alias("i"), p[value].alias("v"))))

    def last_of_key(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["k"] != x["k"]))

    # Bound to a variable, so that the sort runs once.
    kept = F.transform(F.array(ranked), last_of_key)[0]
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def at_key(m: Column, key: Column) -> Column:
    """A map's value, null where it lacks the key."""
    return F.try_element_at(m, key)


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    norm = F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return F.transform(v, lambda x: x - norm)


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def tokens(text: Column) -> Column:
    """Pieces of a command line, split at white space."""
    return F.split(F.trim(text), r"\s+")


def clean(x: Column, default: float = 0.0) -> Column:
    """NaN and null become the default."""
    return F.coalesce(F.nanvl(x, F.lit(default)), F.lit(default))
