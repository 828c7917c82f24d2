"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits, links join fingerprints that differ in RADIUS = 2 bits at most. Bits are
dealt to the non-zero vectors of {0,1}^3; table v keeps the bits whose vector has odd overlap with
v. Two differing bits leave some v orthogonal to both, so every pair within the radius agrees on
all kept bits of some table: seven tables, no misses. Within a bucket nobody is paired with
everybody: each fingerprint emits itself and its one-bit changes among the table's free bits, and
two fingerprints are within the radius exactly if they emit a common point. A point is emitted by
65 fingerprints at most, which bounds the groups.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; texts of
one or two words hash their whole sequence; rows that repeat a doc_id share a component if their
fingerprints link; a null doc_id is never the smallest, a component of null ids only has
component_id null; an empty table gives an empty result. Other columns are not read, whatever their
names. Texts are hashed in blocks of about BLOCK bytes, cut at blanks, and only 64 counts are carried
from block to block, so memory doesn't follow the longest text (but does the longest word). Crowded
buckets and fingerprints that very many documents share, zero among them, are dealt to many places
(common.spread_join).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import Workspace, spread_join, table
from quern.llm.components import components

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of text in lower case, about block bytes at a time; each list but the first begins with the size - 1 words before it."""
    at, held = 0, []
    while at < len(text):
        end = len(text)
        if end - at > block:
            blank = _BLANK.search(text, at + block)
            end = blank.start() if blank else end
        own = text[at:end].lower().split()
        if own:
            words = held + own
            yield words
            held = words[1 - size :] if size > 1 else []
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the runs of size words, or of the whole list if it has fewer."""
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def text_hashes(text: bytes, size: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, block by block; one hash of the whole sequence if it has under size words."""
    held: list[bytes] = []
    for words in word_blocks(text, size, block):
        if len(words) >= size:
            held = []
            yield shingle_hashes(words, size)
        else:
            held = words
    if held:
        yield shingle_hashes(held, size)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, block: int = BLOCK) -> np.ndarray:
    """A bit is set if it is set in over half of the text's hashes."""
    counts, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def add() -> None:
        lengths = np.array([len(p) for p in parts])
        sums = np.add.reduceat(_bits(np.concatenate(parts)), np.cumsum(lengths) - lengths, axis=0, dtype=np.int32)
        np.add.at(counts, rows, sums)
        np.add.at(sizes, rows, lengths)
        rows.clear()
        parts.clear()

    held = 0
    for row, text in enumerate(texts):
        for hashes in text_hashes(text, size, block):
            rows.append(row)
            parts.append(hashes)
            held += len(hashes)
            if held >= block // 4:
                add()
                held = 0
    if parts:
        add()
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint_of_hashes(hashes: np.ndarray) -> np.uint64:
    """The same of given hashes; zero of none."""
    return np.packbits(2 * _bits(hashes).sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=BLOCK):
            found = fingerprints_of(texts_of(chunk)).view(np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(found)], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Kept bits of each table. Any radius bits are free together in at least one."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, workspace: Workspace) -> DataFrame:
    """a, b: enough links between prints (print, no repeats) to connect all within the radius."""
    masks = covering_masks()
    fp = F.col("print")
    keys = [F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    dealt = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("print", "k.table", "k.key")
    shared = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = workspace.materialise(shared, "shared-buckets")
    free = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks]
    changes = F.element_at(F.array(*free), F.col("table") + 1)
    points = spread_join(dealt, shared, ["table", "key"], ["print"]).select("print", F.explode(F.transform(changes, lambda c: c.bitwiseXOR(fp))).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("print").alias("prints")).where(F.size("prints") > 1)
    low = F.array_min("prints")
    return met.select(low.alias("a"), F.explode("prints").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """doc_id, print, component_id: one row per row of docs."""
    printed = workspace.materialise(fingerprints(docs), "printed")
    prints = workspace.materialise(printed.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "prints")
    roots = workspace.materialise(components(links(prints, workspace), workspace), "roots")
    linked = prints.join(roots.withColumnRenamed("node", "print"), "print", "left")
    linked = workspace.materialise(linked.select("print", "low", "n", "root"), "linked")
    lowest = linked.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest"))
    lowest = workspace.materialise(lowest, "lowest")
    owner = linked.join(lowest, "root", "left").select("print", "n", F.coalesce("lowest", "low").alias("component_id"))
    owner = workspace.materialise(owner, "owner")
    return spread_join(printed, owner, ["print"], ["doc_id"]).select("doc_id", "print", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "simhash"))
    return found.select("doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id")
