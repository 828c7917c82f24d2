"""Text and JSON codecs for vectors. Ids stay LONG all the way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from quern.functions.vectors import to_dense

#: Numbers, or bytes of text, that a worker writes or reads at a time. A longer row is a piece of its own.
PIECE_NUMBERS, PIECE_BYTES = 1 << 17, 2 << 20


def _text(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("string"))


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: x.cast("double"))


@F.arrow_udf(ArrayType(StringType()))
def _six_places(v: pa.Array) -> pa.Array:
    """C's %e, which rounds the number itself, ties to even; Java's rounds its decimal digits, ties up."""
    return pa.array([None if one is None else [None if x is None else "%e" % x for x in one] for one in v.to_pylist()], pa.list_(pa.string()))


def encode_dense(id_: Column, v: Column, exact: bool = True) -> Column:
    """id,x0,x1,... in full digits, or as C's %e with six places: nulls in the vector are left out, a null vector gives null, an empty one id and a comma."""
    if not exact:
        return F.concat(id_.cast("string"), F.lit(","), F.array_join(_six_places(v.cast("array<double>")), ","))
    return F.concat_ws(",", F.concat(F.array(id_.cast("string")), _text(v)))


def decode_dense(line: Column) -> Column:
    """struct(id, vec)"""
    parts = F.split(line, ",")
    written = F.filter(F.slice(parts, 2, F.size(parts) - 1), lambda x: x != "")
    return F.struct(parts[0].cast("long").alias("id"), _numbers(written).alias("vec"))


def encode_gather(id_: Column, nbrs: Column) -> Column:
    """id,n,(u,x0,x1,...)*n for an array of struct(u, vec)."""
    flat = F.flatten(F.transform(nbrs, lambda p: F.concat(F.array(p["u"].cast("string")), _text(p["vec"]))))
    return F.concat_ws(",", F.concat(F.array(id_.cast("string"), F.size(nbrs).cast("string")), flat))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, not once for each element that a lambda inside touches."""
    return F.transform(F.array(value), use)[0]


def decode_gather(line: Column) -> Column:
    """struct(id, nbrs); the width follows from the number of fields."""

    def read(parts: Column) -> Column:
        n = parts[1].cast("int")
        step = F.when(n > 0, ((F.size(parts) - 2) / n).cast("int")).otherwise(1)
        one = lambda i: F.struct(
            F.get(parts, 2 + i * step).cast("long").alias("u"), _numbers(F.slice(parts, 4 + i * step, step - 1)).alias("vec")
        )
        some = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)
        return F.struct(parts[0].cast("long").alias("id"), F.slice(some, 1, n).alias("nbrs"))

    return _bound(F.split(line, ","), read)


def encode_sparse(id_: Column, size: Column, indices: Column, values: Column) -> Column:
    """id;length;i,i,...;v,v,... where an empty vector leaves the last two empty."""
    return F.concat_ws(";", id_.cast("string"), size.cast("string"), F.array_join(F.transform(indices, lambda i: i.cast("string")), ","), F.array_join(_text(values), ","))


def decode_sparse(line: Column) -> Column:
    """struct(id, size, indices, values)"""
    parts = F.split(line, ";")
    listed = lambda p: F.filter(F.split(p, ","), lambda x: x != "")
    return F.struct(
        parts[0].cast("long").alias("id"),
        parts[1].cast("int").alias("size"),
        F.transform(listed(parts[2]), lambda x: x.cast("int")).alias("indices"),
        _numbers(listed(parts[3])).alias("values"),
    )


def sparse_to_vector(s: Column) -> Column:
    return to_dense(s["size"], s["indices"], s["values"])


def encode_json_vector(id_: Column, v: Column) -> Column:
    """[id,[x,...]]"""
    return F.concat(F.lit("["), id_.cast("string"), F.lit(","), F.to_json(v), F.lit("]"))


def decode_json_vector(line: Column) -> Column:
    """struct(id, vec)"""
    parts = F.from_json(line, "array<string>")
    return F.struct(parts[0].cast("long").alias("id"), F.from_json(parts[1], "array<double>").alias("vec"))


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit at most."""
    bins = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(sizes)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(lengths)), pa.int32())


def _joined(pieces: list[pa.Array]) -> pa.Array:
    """One array of the pieces, with what they took given back: a task has several workers at once."""
    whole = pa.concat_arrays(pieces)
    pieces.clear()
    pa.default_memory_pool().release_unused()
    return whole


def _chosen(values: pa.Array, where: np.ndarray) -> pa.Array:
    return values if where.all() else values.filter(pa.array(where))


def _placed(chosen: pa.Array, where: np.ndarray) -> pa.Array:
    """The chosen rows back in their places, null elsewhere."""
    return chosen if where.all() else chosen.take(pa.array(np.cumsum(where) - 1, mask=~where))


def _json_numbers(values: pa.Array) -> pa.Array:
    """Texts of numbers in the digits that tell them from all others; what JSON has no number for as to_json writes it."""
    text = values.cast(pa.string())
    if values.null_count:
        text = pc.fill_null(text, "null")
    if pa.types.is_floating(values.type) and not pc.all(pc.is_finite(values), min_count=0).as_py():
        for number, name in (("nan", '"NaN"'), ("inf", '"Infinity"'), ("-inf", '"-Infinity"')):
            text = pc.if_else(pc.equal(text, number), name, text)
    if pc.any(pc.equal(values, 0)).as_py():
        text = pc.if_else(pc.equal(text, "-0"), "-0.0", text)
    return text


def _write_gather(ids: pa.Array, nbrs: pa.Array) -> pa.Array:
    pairs, counts = nbrs.flatten(), _lengths(nbrs)
    u, vec = pc.struct_field(pairs, "u"), pc.struct_field(pairs, "vec")
    whole = pc.and_(pc.is_valid(u), pc.is_valid(vec)).to_numpy(zero_copy_only=False)
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[whole], minlength=len(counts))
    u, vec = _chosen(u, whole), _chosen(vec, whole)
    numbers = pc.binary_join(pa.ListArray.from_arrays(_offsets(_lengths(vec)), _json_numbers(vec.flatten())), ",")
    inner = pc.binary_join_element_wise("[", u.cast(pa.string()), ",[", numbers, "]]", "")
    lines = pc.binary_join_element_wise("[", ids, ",[", pc.binary_join(pa.ListArray.from_arrays(_offsets(counts), inner), ","), "]]", "")
    valid = nbrs.is_valid().to_numpy(zero_copy_only=False)
    return _placed(_chosen(lines, valid), valid)


@F.arrow_udf(StringType())
def _gather_lines(ids: pa.Array, nbrs: pa.Array) -> pa.Array:
    ends = np.append(0, np.cumsum(_lengths(nbrs), dtype=np.int64))
    numbers = np.append(0, np.cumsum(_lengths(pc.struct_field(nbrs.flatten(), "vec")), dtype=np.int64))[ends]
    cuts = _pieces(np.diff(numbers), PIECE_NUMBERS)
    return _joined([_write_gather(ids.slice(i, j - i), nbrs.slice(i, j - i)) for i, j in cuts])


def encode_json_gather(id_: Column, nbrs: Column) -> Column:
    """[id,[[u,[x,...]],...]] for an array of struct(u, vec). A neighbour with a null u or vec is left out, a null id or array gives null."""
    return _gather_lines(id_.cast("string"), nbrs)


_WHOLE, _NUMBER = r"(?:0|-?[1-9][0-9]{0,17})", r"(?:0(?:\.[0-9]+)?|-0\.[0-9]+|-?[1-9][0-9]*(?:\.[0-9]+)?)(?:[eE][-+]?[0-9]+)?"
_PAIR = rf"\[{_WHOLE},\[(?:{_NUMBER}(?:,{_NUMBER})*)?\]\]"
#: Lines without spaces, nulls, names, a -0 (which JSON readers take for 0) or ids of more than 18 digits, which are read in columns; Spark's JSON reader has the others.
_PLAIN = rf"^\[{_WHOLE},\[(?:{_PAIR}(?:,{_PAIR})*)?\]\]$"
_NBRS = ArrayType(StructType().add("u", LongType()).add("vec", ArrayType(DoubleType())))
_GATHERED = pa.struct([("id", pa.int64()), ("nbrs", pa.list_(pa.struct([("u", pa.int64()), ("vec", pa.list_(pa.float64()))])))])


def _read_gather(lines: pa.Array) -> pa.Array:
    """struct(id, nbrs) of plain lines. Between ,[ a line has its id and, in turn, a neighbour and its numbers, or nothing if it has no neighbours."""
    lists = pc.split_pattern(lines, ",[")
    parts, n = pc.ascii_trim(lists.flatten(), "[]"), _lengths(lists)
    place = np.arange(len(parts)) - np.repeat(np.cumsum(n) - n, n)
    of_pair = (place > 0) & (np.repeat(n, n) > 2)
    at = lambda where: parts.take(pa.array(np.flatnonzero(where)))
    numbers = pc.split_pattern(at(of_pair & (place % 2 == 0)), ",")
    # An empty text is split into one empty text.
    width, texts = _lengths(numbers), numbers.flatten()
    empty = (width == 1) & pc.equal(texts.take(pa.array(np.cumsum(width) - width)), "").to_numpy(zero_copy_only=False)
    if empty.any():
        texts, width = texts.filter(pc.not_equal(texts, "")), np.where(empty, 0, width)
    vec = pa.ListArray.from_arrays(_offsets(width), texts.cast(pa.float64()))
    pairs = pa.StructArray.from_arrays([at(of_pair & (place % 2 == 1)).cast(pa.int64()), vec], ["u", "vec"])
    return pa.StructArray.from_arrays([at(place == 0).cast(pa.int64()), pa.ListArray.from_arrays(_offsets((n - 1) // 2), pairs)], ["id", "nbrs"])


@F.arrow_udf(StructType().add("read", StructType().add("id", LongType()).add("nbrs", _NBRS)).add("left", StringType()))
def _plain_gather(lines: pa.Array) -> pa.Array:
    """read: what _read_gather reads of plain lines; left: the lines that aren't plain."""
    found = []
    for i, j in _pieces(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False), PIECE_BYTES):
        piece = lines.slice(i, j - i)
        plain = pc.fill_null(pc.match_substring_regex(piece, _PLAIN), False).to_numpy(zero_copy_only=False)
        read = _placed(_read_gather(_chosen(piece, plain)).cast(_GATHERED), plain)
        found.append(pa.StructArray.from_arrays([read, _placed(_chosen(piece, ~plain), ~plain)], ["read", "left"]))
    return _joined(found)


def decode_json_gather(line: Column) -> Column:
    """struct(id, nbrs)"""

    def read(parts: Column) -> Column:
        pairs = F.transform(F.from_json(parts[1], "array<string>"), lambda p: F.from_json(p, "array<string>"))
        nbrs = F.transform(pairs, lambda p: F.struct(p[0].cast("long").alias("u"), F.from_json(p[1], "array<double>").alias("vec")))
        return F.struct(parts[0].cast("long").alias("id"), nbrs.alias("nbrs"))

    found = _plain_gather(line)
    return F.coalesce(found["read"], _bound(F.from_json(found["left"], "array<string>"), read))
