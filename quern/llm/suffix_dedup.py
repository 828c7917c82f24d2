"""Suffix-array dedup: remove every byte covered by a SPAN-byte string that starts anywhere else.

The suffix array is sparse and range-partitioned. Of each window of SPAN bytes the GRAM-byte piece
with the lowest hash (leftmost of equals) is its anchor, so equal windows have anchors at equal
offsets, and only the suffixes at anchors, about one in 185, are sorted. An anchor's block is all
that its windows cover. Three steps find all repeated windows:

1. Blocks that occur twice (128-bit digest) are repeated as a whole.
2. Other windows can be equal only if their anchors agree in the HALF bytes to the right or to the
   left, so anchors alone with both are done. Of the rest one block of each kind goes on.
3. Sampled splitters range-partition these by the leading bytes of the anchor's suffix, ties by
   digest, so that one hot suffix spreads over several partitions. There are as many as the session
   has shuffle partitions, so the sample on the driver doesn't follow the data. A task takes its
   sorted rows in buckets of BUCKET_ROWS; a bucket sorts its suffixes by multikey quicksort,
   neighbours' common prefixes say which windows can repeat, and windows are compared by 128-bit
   digests. The first and the last group of a bucket may go on next door: their windows are compared
   across the boundaries, by aggregations over all buckets. STRIPE windows with neighbouring offsets
   have a core in common, so cores are compared first, and windows only where another bucket has the
   core.

Spans go back to the documents by id. Nothing is capped, and strings are judged on the input.

Edge cases: null text counts as empty; texts under SPAN bytes keep all; rows that repeat a doc_id
are told apart by their text, rows that repeat both count as two places of the same text; null ids
pass through; an empty table gives an empty result. Other columns are not read, whatever their names.
The places of a digest that very many have are dealt out (common.spread_join).
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import Workspace, spread_join, table

SPAN, GRAM, HALF = 400, 32, 200
BUCKET_ROWS = 2_000
STRIPE = 16
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def piece_hashes(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of the 1, 2, 4, ... upto bytes from each position on; past the end they are cut short."""
    hashes, size = {1: _BYTE_VALUES[data]}, 1
    while size < upto:
        longer = hashes[size] * _power(size)
        longer[:-size] += hashes[size][size:]
        size *= 2
        hashes[size] = longer
    return hashes


def anchors_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end, all at least SPAN long: first window, last window, anchor position, right key, left key.

    A key is 0 where no window of the anchor reaches HALF bytes to that side.
    """
    n, width = len(data), SPAN - GRAM + 1
    hashes = piece_hashes(data, 128)
    order = (_mixed(hashes[GRAM]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, _MASK, np.uint64)
    padded[:n] = order
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = sizes - SPAN + 1
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    windows = np.arange(int(counts.sum())) + shift
    at = (np.minimum(behind[windows], ahead[windows + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    low, high = windows[cuts], windows[np.append(cuts[1:], len(windows)) - 1]
    anchor = at[cuts]

    def half(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 0, n - HALF)
        return _mixed(hashes[128][p] * _power(72) + hashes[64][p + 128] * _power(8) + hashes[8][p + 192])

    right = np.where(anchor - high <= HALF, half(anchor) | np.uint64(1), np.uint64(0))
    left = np.where(anchor - low > HALF, (half(anchor - HALF) | np.uint64(1)) - np.uint64(1) | np.uint64(2), np.uint64(0))
    return low, high, anchor, right, left


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row, base and bytes of the pieces of texts, about SEGMENT bytes at a time.

    Each window starts in one piece. An anchor whose windows are parted between two pieces gives two
    blocks, which the comparison of windows treats like any others.
    """
    rows, bases, pieces, held = [], [], [], 0
    for row, text in enumerate(texts):
        for base in range(0, len(text) - SPAN + 1, SEGMENT):
            piece = text[base : base + SEGMENT + SPAN - 1]
            rows.append(row)
            bases.append(base)
            pieces.append(piece)
            held += len(piece)
            if held >= SEGMENT:
                yield rows, bases, pieces
                rows, bases, pieces, held = [], [], [], 0
    if rows:
        yield rows, bases, pieces


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: a hash of the text tells rows of one doc_id apart."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), low, off, span (first window, anchor and last window from there), right, left, digest."""
    names = ["doc_id", "key", "low", "off", "span", "right", "left", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=SEGMENT):
            for rows, bases, pieces in _segments(texts_of(chunk)):
                whole = b"".join(pieces)
                sizes = np.array([len(x) for x in pieces], np.int64)
                starts = np.cumsum(sizes) - sizes
                low, high, anchor, right, left = anchors_of(np.frombuffer(whole, np.uint8), starts, sizes)
                piece_no = np.searchsorted(starts, low, side="right") - 1
                digest, view = xxhash.xxh3_128_digest, memoryview(whole)
                digests = [digest(view[a:b]) for a, b in zip(low.tolist(), (high + SPAN).tolist(), strict=True)]
                row = pa.array(np.array(rows, np.int64)[piece_no])
                columns = [
                    chunk.column("doc_id").take(row),
                    chunk.column("key").take(row),
                    pa.array(low - starts[piece_no] + np.array(bases, np.int64)[piece_no]),
                    pa.array((anchor - low).astype(np.int32)),
                    pa.array((high - low).astype(np.int32)),
                    pa.array(right.view(np.int64)),
                    pa.array(left.view(np.int64)),
                    pa.array(digests, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(run, f"doc_id {kind}, key long, low long, off int, span int, right long, left long, digest binary")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of words: three-way partition by one word, then the next within equals. Equal rows keep their order."""
    out, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= 1 or depth == words.shape[1]:
            out.append(rows)
            continue
        column = words[rows, depth]
        pivot = np.sort(column[[0, len(column) // 2, -1]])[1]
        for part, deeper in ((column > pivot, 0), (column == pivot, 1), (column < pivot, 0)):
            if part.any():
                stack.append((rows[part], depth + deeper))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(suffixes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    out = np.zeros(len(suffixes), np.int64)
    for start in range(1, len(suffixes), 4096):
        rows = slice(start, min(start + 4096, len(suffixes)))
        before = slice(rows.start - 1, rows.stop - 1)
        differ = suffixes[rows] != suffixes[before]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
        out[rows] = np.minimum(same, np.minimum(sizes[rows], sizes[before]))
    return out


def bucket_repeats(blocks: list[bytes], offs: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, bytes, list[int], list[bytes]]]]:
    """Repeated windows inside a bucket, and the windows to compare with other buckets.

    The former as (row, first window, last window), the latter by stripe as (row, digest of the
    core, windows, their digests), where each digest of a window comes once. Rows have distinct blocks.
    """
    suffixes = [b[o : o + SPAN] for b, o in zip(blocks, offs, strict=True)]
    sizes = np.array([len(s) for s in suffixes], np.int64)
    matrix = np.frombuffer(b"".join(s.ljust(SPAN, b"\0") for s in suffixes), np.uint8).reshape(-1, SPAN)
    # Shorter ones first, and the sort keeps that among equals: padding may equal NULs of the text.
    order = np.argsort(sizes, kind="stable")
    order = order[multikey_quicksort(matrix[order].view(">u8").astype(np.uint64))]
    prefix = common_prefixes(matrix[order], sizes[order])
    cuts = np.append(np.flatnonzero(prefix < GRAM), len(order))
    digest, runs, outside = xxhash.xxh3_128_digest, [], []
    for group, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        edge = group == 0 or b == len(order)
        if b - a == 1 and not edge:
            continue
        near = np.append(prefix[a + 1 : b], 0)
        near[1:] = np.maximum(near[1:], prefix[a + 1 : b])
        holder: dict[bytes, tuple[int, int]] = {}
        hits: dict[int, set[int]] = {}
        for row, reach in zip(order[a:b].tolist(), near.tolist(), strict=True):
            block, off = blocks[row], offs[row]
            view = memoryview(block)
            last = len(block) - SPAN
            if not edge:  # what lies right of the anchor has to be in the prefix shared with a neighbour
                last = min(last, off - (SPAN - reach))
            for s in range(last + 1):
                found = digest(view[s : s + SPAN])
                first = holder.setdefault(found, (row, s))
                if first[0] != row:
                    hits.setdefault(row, set()).add(s)
                    hits.setdefault(first[0], set()).add(first[1])
        for row, places in hits.items():
            own = np.array(sorted(places))
            ends = np.append(np.flatnonzero(np.diff(own) > 1), len(own) - 1)
            begins = np.append(0, ends[:-1] + 1)
            runs += [(row, int(own[i]), int(own[j])) for i, j in zip(begins, ends, strict=True)]
        if edge:
            stripes: dict[tuple[int, int], tuple[list[int], list[bytes]]] = {}
            for found, (row, s) in holder.items():
                places, windows = stripes.setdefault((row, (offs[row] - s) // STRIPE), ([], []))
                places.append(s)
                windows.append(found)
            for (row, stripe), held in stripes.items():
                core = offs[row] - stripe * STRIPE
                outside.append((row, digest(blocks[row][core : core + SPAN - STRIPE + 1]), *held))
    return runs, outside


def _settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, workspace: Workspace, span_bucket: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, key, spans (start and end in bytes, unmerged) of the texts that have any."""
    spark = docs.sparkSession
    anchors = workspace.materialise(anchor_table(docs), "anchors")
    place = F.struct("doc_id", "key", "low").alias("place")
    kinds = anchors.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(place).alias("place"), *[F.min(c).alias(c) for c in ("off", "span", "right", "left")]
    )
    kinds = workspace.materialise(kinds, "kinds")
    twice = workspace.materialise(kinds.where("n > 1").select("digest", "n"), "twice")
    whole = spread_join(anchors, twice, ["digest"], ["doc_id", "low"]).select("doc_id", "key", F.col("low").alias("start"), (F.col("low") + F.col("span") + SPAN).alias("end"))
    whole = workspace.materialise(whole, "whole")
    workspace.drop("anchors")
    _settle(spark)
    sides = kinds.select("digest", F.explode(F.array("right", "left")).alias("side")).where("side != 0")
    shared = workspace.materialise(sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    chosen = workspace.materialise(spread_join(sides, shared, ["side"], ["digest"]).select("digest").distinct(), "chosen")
    picked = kinds.join(chosen.hint("merge"), "digest").select("place.*", "off", "span", "digest")
    wanted = picked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("low", "off", "span", "digest")).alias("wanted"))
    blocks = workspace.materialise(cut_blocks(docs, workspace.materialise(wanted, "wanted")), "blocks")
    for name in ("kinds", "twice", "shared", "chosen", "wanted"):
        workspace.drop(name)
    _settle(spark)
    found = workspace.materialise(sort_buckets(blocks, span_bucket), "found")
    local = found.where("core is null").select("doc_id", "key", "start", "end")
    edge = found.where("core is not null")
    cores = workspace.materialise(_in_several_buckets(edge, "core"), "cores")
    held = spread_join(edge, cores, ["core"], ["doc_id", "start"]).select("doc_id", "key", "start", "bucket", F.explode(F.arrays_zip("places", "windows")).alias("w"))
    held = held.select("doc_id", "key", (F.col("start") + F.col("w.places")).alias("start"), F.col("w.windows").alias("window"), "bucket")
    held = workspace.materialise(held, "held")
    both = workspace.materialise(_in_several_buckets(held, "window"), "both")
    across = spread_join(held, both, ["window"], ["doc_id", "start"]).select("doc_id", "key", "start", (F.col("start") + SPAN).alias("end"))
    spans = whole.unionByName(local).unionByName(across).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = workspace.materialise(spans, "spans")
    for name in ("blocks", "whole", "found", "cores", "held", "both"):
        workspace.drop(name)
    _settle(spark)
    return spans


def _in_several_buckets(rows: DataFrame, digest: str) -> DataFrame:
    met = rows.groupBy(digest).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count("*").alias("n"))
    return met.where("low != high").select(digest, "n")


def _beside(docs: DataFrame, other: DataFrame, keep: str) -> DataFrame:
    """doc_id, key, text and a column of other, joined by id and text; a merge join at every size."""
    right = other.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col(keep))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    return keyed(docs).join(right.hint("merge"), same, "left").select("doc_id", "key", "text", keep)


def cut_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted blocks: doc_id, key, low, off, digest, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "low", "off", "digest", "block"]
        for chunk in text_chunks(batches):
            rows = []
            for doc_id, key, wants, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("key").to_pylist(), chunk.column("wanted").to_pylist(), texts_of(chunk), strict=True):
                rows += [(doc_id, key, w["low"], w["off"], w["digest"], text[w["low"] : w["low"] + w["span"] + SPAN]) for w in wants]
            if rows:
                kinds = (chunk.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _beside(docs, wanted, "wanted").where("wanted is not null")
    return joined.mapInArrow(run, f"doc_id {kind}, key long, low long, off int, digest binary, block binary")


def sort_buckets(blocks: DataFrame, bucket_rows: int) -> DataFrame:
    """doc_id, key, start, end of repeated windows; where core is set, windows from start on to compare across buckets.

    Any cut of the sorted rows into buckets is right: what the cut parts is compared across. So a
    partition is read as a stream of buckets, and no more than one is held.
    """
    lead = blocks.withColumn("lead", F.expr(f"substring(block, off + 1, {GRAM})"))
    dealt = lead.repartitionByRange("lead", "digest").sortWithinPartitions("lead", "digest").drop("lead")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(start, bucket_rows)
                if size and size + part.num_rows > bucket_rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(buckets(batches), TaskContext.get().partitionId() << 32):
            low = rows.column("low").to_numpy()
            runs, outside = bucket_repeats(rows.column("block").to_pylist(), rows.column("off").to_pylist())
            found = [(r, a, b + SPAN, None, None, None) for r, a, b in runs] + [(r, 0, 0, *rest) for r, *rest in outside]
            for start in range(0, len(found), 10_000):
                at, first, last, core, places, windows = zip(*found[start : start + 10_000], strict=True)
                base = low[list(at)]
                index = pa.array(at, pa.int64())
                columns = [rows.column(c).take(index).combine_chunks() for c in ("doc_id", "key")]
                columns += [pa.array(base + np.array(first)), pa.array(base + np.array(last)), pa.array([number] * len(at), pa.int64())]
                columns += [pa.array(core, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(windows, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "start", "end", "bucket", "core", "places", "windows"])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key long, start long, end long, bucket long, core binary, places array<int>, windows array<binary>"
    return dealt.mapInArrow(run, schema)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: one row per row of docs; kept is what remains of the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts = texts_of(chunk)
            spans = [merged(x or []) for x in chunk.column("spans").to_pylist()]
            kept = [kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    spans = repeated_spans(docs, workspace)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _beside(docs, spans, "spans").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "suffix-dedup"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
