"""Near-dedup by SimHash and an exact similarity join on word shingles, the pipeline's stage after line dedup.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, and one
document of each connected component stays. Equal sets are one node, so exact copies never meet in
pairs.

SimHash comes first: every set has a fingerprint of 64 bits, covering tables find the ones within
two bits (simhash.links), and what they pair is compared by whole sets. Edited copies often differ in
more bits, so an exact join follows that finds the rest; its pairs across parts leave out what is
linked by then. Shingles have one order for all texts, those known to be frequent last. Two sets of n
and m shingles that are similar enough share 0.8 n and 0.8 m at least, so the first n - ceil(0.8 n) + 1
of the one and the same part of the other have a shingle in common: joining on these prefixes misses
no pair, whatever the order. Pairs are compared by their whole sets unless a bound on what they can
share rules them out before.

Where many nodes meet in a shingle, not all pairs are made: each is first compared with a leader, the
smallest set there, and what that links counts as one part. Then only nodes of different parts are
paired, so a template with thousands of edited copies costs about their number. Components are those
of all pairs.

The order's frequent shingles come from a sixteenth of the texts. They decide how many pairs are
compared, never which are found.

Edge cases: null, empty and wordless texts have the empty set and link to each other; texts of up to
five words are one shingle; case and blanks don't matter; rows that repeat a doc_id go together; a
null doc_id is never the smallest, a component of null ids only keeps them; an empty table gives an
empty result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.arrow import text_chunks, texts_of
from quern.llm.bitmap import build_filter, probe_filter
from quern.llm.common import Workspace, spread_join, text_or_empty
from quern.llm.components import components
from quern.llm.simhash import BLOCK, fingerprint_of_hashes, text_hashes

SHINGLE = 5
#: Similarity of 4/5, kept as whole numbers so that the boundary is exact.
PART, WHOLE = 4, 5
#: One text in SAMPLE is counted, a shingle in FREQUENT of these is frequent, MOST are kept.
SAMPLE, FREQUENT, MOST = 16, 4, 50_000
#: Groups of more nodes than CROWD are first linked by leaders, in so many rounds.
CROWD, ROUNDS = 16, 1
#: Bits of a set's parities. Two sets differ in as many shingles as their parities in bits, or more.
PARITY_BITS = 1024


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted, without repeats."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *text_hashes(text, SHINGLE)]))


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1 if n else 0


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of shingles falls to it."""
    counts = np.bincount((shingles % PARITY_BITS).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts % 2).astype(np.uint8)).view(np.int64)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The frequent shingles, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=BLOCK):
            found = [shingle_set(t) for t in texts_of(chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    text = text_or_empty()
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(MOST).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, key (a digest of the set), n (its size), prefix (its first shingles in the common order), parity, print (its SimHash fingerprint)."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def first(shingles: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(shingles), np.int64)
        if len(values):
            at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
            rank = np.where(values[at] == shingles, by_value[at] + 1, 0)
        return shingles[np.argsort(rank, kind="stable")[: prefix_length(len(shingles))]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=BLOCK):
            sets = [shingle_set(t) for t in texts_of(chunk)]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            columns = [chunk.column("doc_id"), keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([first(s) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array([parities(s) for s in sets], pa.list_(pa.int64())))
            columns.append(pa.array(np.array([fingerprint_of_hashes(s) for s in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "prefix", "parity", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, n long, prefix array<long>, parity array<long>, print long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """key, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=BLOCK):
            sets = [shingle_set(t) for t in texts_of(chunk)]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>")


def meetings(sets: DataFrame, workspace: Workspace) -> DataFrame:
    """shingle, node, n, at, n_nodes: the prefix entries whose shingle several nodes have there."""
    dealt = sets.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    met = dealt.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    met = workspace.materialise(met.where("low != high").select("shingle", F.col("n").alias("n_nodes"), "n"), "met")
    # Most shingles are one node's: a filter keeps their entries out of the second shuffle.
    bitmap = workspace.materialise(build_filter(met, "shingle"), "met-filter")
    return workspace.materialise(spread_join(probe_filter(dealt, bitmap, "shingle"), met, ["shingle"], ["node"]), "through")


def fitting(a: str, b: str) -> str:
    """Sizes that allow the similarity."""
    return f"{WHOLE} * least({a}, {b}) >= {PART} * greatest({a}, {b})"


def mixed_groups(through: DataFrame, roots: DataFrame | None, workspace: Workspace) -> DataFrame:
    """through with part (what a node is linked to so far) and body (the largest part of the shingle's group), of groups with several parts."""
    if roots is None:
        parts = through.withColumn("part", F.col("node"))
    else:
        parts = through.join(roots.hint("merge"), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    parts = workspace.materialise(parts.withColumnRenamed("n", "size"), "parts")
    sizes = parts.groupBy("shingle", "part").agg(F.count("*").alias("n")).groupBy("shingle")
    body = sizes.agg(F.max(F.struct("n", "part")).alias("body"), F.sum("n").alias("all")).where("all > body.n")
    body = workspace.materialise(body.select("shingle", F.col("body.part").alias("body"), F.col("body.n").alias("n_body"), F.col("all").alias("n")), "bodies")
    return workspace.materialise(spread_join(parts, body, ["shingle"], ["node"]), "mixed")


def pairs_with_leaders(mixed: DataFrame, workspace: Workspace) -> DataFrame:
    """a, b: in each crowd, the nodes that fit the leader, the smallest set outside of the body. As many rows as the crowds have entries."""
    crowd = mixed.where(F.col("n_nodes") > CROWD)
    outside = F.when((F.col("part") != F.col("body")) | (F.col("n_body") == 1), F.struct("size", "node", "part"))
    leaders = crowd.groupBy("shingle").agg(F.min(outside).alias("leader"), F.count("*").alias("n"))
    leaders = workspace.materialise(leaders, "leaders")
    led = spread_join(crowd, leaders, ["shingle"], ["node"]).where("part != leader.part and " + fitting("size", "leader.size"))
    return led.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def pairs_across(mixed: DataFrame) -> DataFrame:
    """a, b: the other pairs that meet. Nodes that are linked already aren't paired, so a crowd of near-copies costs its outsiders times its size.

    Every pair of different parts has a node outside of the group's body.
    """
    row = F.struct("node", F.col("size").alias("n"), (F.col("size") - F.col("at") - 1).alias("rest"), "part")
    outside = mixed.where("part != body").select("shingle", row.alias("x"))
    other = mixed.select("shingle", row.alias("y"), (F.col("part") == F.col("body")).alias("inner"))
    # Up to their first meeting two sets share nothing, so what follows has to be enough; a later meeting of a pair that fits has an earlier one.
    enough = f"{PART + WHOLE} * (1 + least(x.rest, y.rest)) >= {PART} * (x.n + y.n)"
    apart = f"x.part != y.part and (inner or x.node < y.node) and {fitting('x.n', 'y.n')} and {enough}"
    met = outside.join(other.hint("merge"), "shingle").where(apart)
    low, high = F.least("x", "y"), F.greatest("x", "y")  # by node
    pairs = met.select(low.alias("l"), high.alias("h")).groupBy(F.col("l.node").alias("a"), F.col("h.node").alias("b"), F.col("l.n").alias("na"), F.col("h.n").alias("nb"))
    # The order is common, so all that two sets share up to their last meeting is counted, and no more can follow than the shorter rest.
    pairs = pairs.agg(F.count("*").alias("shared"), F.min("l.rest").alias("ra"), F.min("h.rest").alias("rb"))
    return pairs.where(f"{PART + WHOLE} * (shared + least(ra, rb)) >= {PART} * (na + nb)").select("a", "b")


def similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, workspace: Workspace) -> DataFrame:
    """a, b: the pairs that are similar enough, first by parities, then by their whole sets."""
    pairs = workspace.materialise(pairs, "met-pairs")
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where((PART + WHOLE) * apart <= (WHOLE - PART) * (F.col("na") + F.col("nb")))
    pairs = workspace.materialise(near.select("a", "b"), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = workspace.materialise(sets.select("node", "key", "low").join(nodes, "node"), "wanted")
    ids = workspace.materialise(wanted.select("low").distinct(), "ids")
    bitmap = workspace.materialise(build_filter(ids, "low"), "ids-filter")
    texts = probe_filter(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), bitmap, "doc_id")
    texts = texts.join(ids.hint("merge"), texts["doc_id"].eqNullSafe(ids["low"]), "left_semi")
    found = whole_sets(texts).join(wanted.select("node", "key").hint("merge"), "key")
    found = workspace.materialise(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "whole")
    counts = pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    first = workspace.materialise(found.join(counts, "node").select(F.col("node").alias("a"), F.col("shingles").alias("sa"), "n"), "firsts")
    second = found.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = spread_join(pairs.join(second.hint("merge"), "b"), first, ["a"], ["b"])
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = workspace.materialise(both.where((PART + WHOLE) * shared >= PART * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")
    for name in ("met-pairs", "pairs", "wanted", "whole", "firsts"):
        workspace.drop(name)
    return linked


def fingerprint_links(docs: DataFrame, sets: DataFrame, workspace: Workspace) -> DataFrame:
    """a, b: similar sets that SimHash pairs. A fingerprint's lowest node stands for it and is paired with its other nodes."""
    own = Workspace(workspace.spark, path=f"{workspace.path}/simhash")
    prints = own.materialise(sets.groupBy("print").agg(F.min("node").alias("head"), F.count("*").alias("n")), "prints")
    close = own.materialise(simhash.links(prints.select("print"), own), "close")
    a, b = (prints.select(F.col("print").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    across = close.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("ha", "hb")
    within = spread_join(sets.select("node", "print"), prints.where("n > 1"), ["print"], ["node"]).where("node != head").select("head", "node")
    pairs = across.union(within).select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    found = similar(docs, sets, pairs, own)
    for name in ("prints", "close", "shared-buckets"):
        own.drop(name)
    return found


def links(docs: DataFrame, sets: DataFrame, workspace: Workspace, rounds: int = ROUNDS, found: DataFrame | None = None) -> DataFrame:
    """a, b: links that connect all nodes which pairs of similar sets connect; those in found are known already."""
    through, roots = meetings(sets, workspace), None
    for number in range(rounds + 1):
        own = Workspace(workspace.spark, path=f"{workspace.path}/round-{number}")
        mixed = mixed_groups(through, roots, own)
        pairs = pairs_with_leaders(mixed, own) if number < rounds else pairs_across(mixed)
        more = similar(docs, sets, pairs, own)
        found = more if found is None else found.unionByName(more)
        if number < rounds:
            roots = own.materialise(components(found, own), "roots")
        for name in ("parts", "bodies", "mixed", "leaders"):
            own.drop(name)
    return found


def near_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """doc_id, component_id (the smallest id of the component): one row per row of docs."""
    described = workspace.materialise(prefixes(docs, frequent_shingles(docs)), "described")
    same = [F.first(x).alias(x) for x in ("n", "prefix", "parity", "print")]
    sets = described.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_rows"), *same)
    sets = workspace.materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    found = links(docs, sets, workspace, found=fingerprint_links(docs, sets, workspace))
    roots = workspace.materialise(components(found, workspace), "roots")
    linked = workspace.materialise(sets.select("node", "key", "low", "n_rows").join(roots, "node", "left"), "linked")
    lowest = workspace.materialise(linked.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    owner = linked.join(lowest, "root", "left").select("key", F.col("n_rows").alias("n"), F.coalesce("lowest", "low").alias("component_id"))
    owner = workspace.materialise(owner, "owner")
    return spread_join(described.select("doc_id", "key"), owner, ["key"], ["doc_id"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, or null with no other; columns as they were."""
    found = near_duplicates(docs, workspace)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # A merge join at every size, so that the plan doesn't turn over as the table grows.
    return rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["gone"]), "left_anti").select("row.*")
