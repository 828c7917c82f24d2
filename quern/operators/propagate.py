"""Message passing: weighted neighbour sums, gathers, and their backward forms.

The sum has three plans with one answer. summarizer (the default) ships one array for each edge
group and returns (id, vec); wide sums one column for each entry and suits short vectors; long keeps
rows (id, pos, val), for vectors that are mostly zero or too wide for one row. A source without a
vector sends no message, and a vertex without a message has no row.

A hub's edges and vector would meet in one task. So the edges of hubs, found by counting, are dealt
to COPIES places by their other end, and the hub's vector goes to each (join_sent); all other
vertices are joined as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quern.functions.vectors import add, scale, to_sparse
from quern.graph import reverse_edges

PLANS = ("summarizer", "wide", "long")
#: Vertices with HUB_EDGES edges or more at the joined end are hubs, the MOST_HUBS largest if there are more; their edges go to COPIES places.
HUB_EDGES, MOST_HUBS, COPIES = 100_000, 1_000, 64


def _weighted(edges: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", weight.alias("weight"))


def hubs(edges: DataFrame, end: str, least: int = HUB_EDGES, most: int = MOST_HUBS) -> DataFrame:
    """id of the hubs at an end of the edges: at most most rows, so they can be broadcast."""
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "id").limit(most).select("id")


def join_sent(edges: DataFrame, vertices: DataFrame, at: str, to: str, of_hubs: DataFrame | bool | None = None) -> DataFrame:
    """edges beside the rows of vertices (id renamed to the end at). of_hubs: ids whose edges are spread, counted here if not given.

    False joins plainly, as a bucketed store without hubs asks for.
    """
    if of_hubs is False:
        return edges.join(vertices.withColumnRenamed("id", at), at)
    marked = (hubs(edges, at) if of_hubs is None else of_hubs).select(F.col("id").alias(at), F.lit(True).alias("__hub"))
    place = F.when(F.col("__hub"), F.pmod(F.xxhash64(to), F.lit(COPIES)).cast("int")).otherwise(0)
    dealt = edges.join(F.broadcast(marked), at, "left").withColumn("__place", place).drop("__hub")
    side = vertices.withColumnRenamed("id", at).join(F.broadcast(marked), at, "left")
    places = F.when(F.col("__hub"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(side.withColumn("__place", F.explode(places)).drop("__hub"), [at, "__place"]).drop("__place")


def triplets(edges: DataFrame, vertices: DataFrame, fields: str = "src") -> DataFrame:
    """Edges beside the vertex columns they need: src_* and dst_*; only the named ends are joined."""
    if fields not in ("none", "src", "dst", "both"):
        raise ValueError("fields has to be none, src, dst or both")
    out = edges
    for end, other in (("src", "dst"), ("dst", "src")):
        if fields in (end, "both"):
            side = vertices.select("id", *[F.col(c).alias(f"{end}_{c}") for c in vertices.columns if c != "id"])
            out = join_sent(out, side, end, other)
    return out


def aggregate_messages(edges: DataFrame, vertices: DataFrame, message: Column, reduce: Column | list[Column], to: str = "dst", fields: str = "src") -> DataFrame:
    """id and the reduced columns: message over triplets is named msg, reduce aggregates msg at the end named by to."""
    sent = triplets(edges, vertices, fields).select(F.col(to).alias("id"), message.alias("msg")).where(F.col("msg").isNotNull())
    return sent.groupBy("id").agg(*(reduce if isinstance(reduce, list) else [reduce]))


@dataclass(frozen=True)
class LayerProtocol:
    """A layer by a user's three functions: the message of a triplet, its reduction at the target, and the vertex's new value.

    message and reduce are column expressions as in aggregate_messages; update takes a frame of the
    vertices beside their reduced columns (null where no message came) and returns the new vertices.
    """

    message: Column
    reduce: list[Column]
    update: Callable[[DataFrame], DataFrame]
    fields: str = "src"

    def run(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        return self.update(vertices.join(aggregate_messages(edges, vertices, self.message, self.reduce, "dst", self.fields), "id", "left"))


def _entries(vertices: DataFrame, column: str) -> DataFrame:
    return vertices.where(F.col(column).isNotNull()).select("id", F.col(column).alias("__vec"))


def _array_sum(rows: DataFrame, vector: Column) -> DataFrame:
    """id, vec: the sum of vectors by id."""
    return rows.select("id", array_to_vector(vector).alias("m")).groupBy("id").agg(vector_to_array(Summarizer.sum(F.col("m"))).alias("vec"))


def _sum(edges: DataFrame, vertices: DataFrame, column: str, at: str, to: str, plan: str, width: int | None, of_hubs: DataFrame | bool | None) -> DataFrame:
    if plan not in PLANS:
        raise ValueError(f"plan has to be one of {PLANS}")
    sent = join_sent(_weighted(edges), _entries(vertices, column), at, to, of_hubs).select(F.col(to).alias("id"), "weight", "__vec")
    if plan == "long":
        rows = sent.select("id", "weight", F.posexplode("__vec").alias("pos", "x"))
        return rows.groupBy("id", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("val"))
    if plan == "wide":
        if width is None:
            raise ValueError("the wide plan needs the width of the vectors")
        parts = [F.sum(F.col("weight") * F.get("__vec", F.lit(i))).alias(f"x{i}") for i in range(width)]
        return sent.groupBy("id").agg(*parts).select("id", F.array(*[f"x{i}" for i in range(width)]).alias("vec"))
    return _array_sum(sent, scale(F.col("__vec").cast("array<double>"), F.col("weight")))


def weighted_sum(edges: DataFrame, vertices: DataFrame, column: str = "feat", plan: str = "summarizer", width: int | None = None, of_hubs: DataFrame | bool | None = None) -> DataFrame:
    """Sum over in-edges of weight times the source's vector: (id, vec), or (id, pos, val) for the long plan."""
    return _sum(edges, vertices, column, "src", "dst", plan, width, of_hubs)


def sparse_sum(edges: DataFrame, sparse: DataFrame, at: str = "src", to: str = "dst") -> DataFrame:
    """The same from (id, size, indices, values): (id, pos, val) of entries that some message has."""
    sent = join_sent(_weighted(edges), sparse.select("id", F.arrays_zip(F.col("indices").alias("pos"), F.col("values").alias("x")).alias("__pairs")), at, to)
    rows = sent.select(F.col(to).alias("id"), "weight", F.explode("__pairs").alias("e"))
    return rows.groupBy("id", F.col("e.pos").alias("pos")).agg(F.sum(F.col("weight") * F.col("e.x")).alias("val"))


def backward_reverse(edges: DataFrame, grads: DataFrame, column: str = "grad", plan: str = "summarizer", width: int | None = None, of_hubs: DataFrame | bool | None = None) -> DataFrame:
    """Gradients flow back along reversed edges with the same weights."""
    return weighted_sum(reverse_edges(_weighted(edges)), grads, column, plan, width, of_hubs)


def backward_forward(edges: DataFrame, grads: DataFrame, column: str = "grad", plan: str = "summarizer", width: int | None = None, of_hubs: DataFrame | bool | None = None) -> DataFrame:
    """The same without a reversed table: messages go from dst to src."""
    return _sum(edges, grads, column, "dst", "src", plan, width, of_hubs)


def backward_sparse(edges: DataFrame, sparse: DataFrame, orientation: str = "reverse") -> DataFrame:
    """Sparse gradients (id, size, indices, values) back along reversed edges, or from dst to src of the given ones: (id, pos, val)."""
    if orientation not in ("reverse", "forward"):
        raise ValueError("orientation has to be reverse or forward")
    return sparse_sum(reverse_edges(_weighted(edges)), sparse) if orientation == "reverse" else sparse_sum(edges, sparse, "dst", "src")


def gather(edges: DataFrame, vertices: DataFrame, column: str = "feat", weighted: bool = True, parts: int | None = None) -> DataFrame:
    """id, nbrs: every in-neighbour's message, in order of the neighbour.

    A hub's list is as long as its in-degree; sums and other reductions belong in weighted_sum or
    gather_rows, which never hold a list, and lists of a bounded length in gather_blocks.

    Without parts each edge's message is shuffled. With a number of parts, which suits graphs with
    more in-edges a vertex than that, edges go to parts by target without their messages, all vectors
    go to every part once, and messages are made there as the lists are; a part's vectors have to
    fit a worker's memory.
    """
    if parts is None:
        rows = gather_rows(edges, vertices, column, weighted).groupBy("id").agg(F.collect_list(F.struct("u", "vec")).alias("nbrs"))
    else:
        rows = _gather_in_parts(_weighted(edges), _entries(vertices, column), parts, weighted)
    return rows.select("id", F.array_sort("nbrs").alias("nbrs"))


def _gather_in_parts(edges: DataFrame, entries: DataFrame, parts: int, weighted: bool) -> DataFrame:
    """id, nbrs, unsorted by message. A part's rows come sorted, its vectors first, then its edges by target."""
    # Vectors of floats that were cast go as floats, which is half of the bytes. No list is null: Spark measures a batch
    # after each row, and goes through all the null lists at its end each time.
    vec, short = F.col("__vec").cast("array<double>"), F.col("__vec").cast("array<float>")
    same = F.coalesce(short.cast("array<double>") == vec, F.lit(False))
    none = {name: F.array().cast(kind) for name, kind in (("short", "array<float>"), ("vec", "array<double>"))}
    pair = [same.alias("same"), F.when(same, short).otherwise(none["short"]).alias("short"), F.when(same, none["vec"]).otherwise(vec).alias("vec")]
    places = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    given = entries.where("id is not null").select(F.lit(None).cast("long").alias("dst"), F.col("id").cast("long").alias("src"), F.lit(None).cast("double").alias("weight"), *pair)
    given = given.select(places, F.lit(False).alias("edge"), "*")
    place = F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int").alias("part")
    empty = [F.lit(True).alias("same"), *[column.alias(name) for name, column in none.items()]]
    sent = edges.select(place, F.lit(True).alias("edge"), F.col("dst").cast("long"), F.col("src").cast("long"), F.col("weight").cast("double"), *empty)
    dealt = given.unionByName(sent).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "edge", "dst", "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, fresh, held = None, None, [], None
        for batch in batches:
            of, is_edge = batch.column("part").to_numpy(), batch.column("edge").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(is_edge.astype(np.int8)) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                rows = batch.slice(start, end - start)
                if of[start] != part:
                    if held is not None:
                        yield from _lists(held, known, weighted)
                    part, known, fresh, held = of[start], None, [], None
                if not is_edge[start]:
                    same = rows.column("same").to_numpy(zero_copy_only=False)
                    both = pa.concat_arrays([rows.column("short").cast(pa.list_(pa.float64())), rows.column("vec").cast(pa.list_(pa.float64()))])
                    fresh.append((rows.column("src").to_numpy(), both.take(pa.array(np.where(same, 0, len(same)) + np.arange(len(same))))))
                    continue
                if known is None:
                    ids = [i for i, _ in fresh] or [np.zeros(0, np.int64)]
                    known = np.concatenate(ids), pa.concat_arrays([v for _, v in fresh] or [pa.array([], pa.list_(pa.float64()))])
                    fresh = []
                # Here and not by a filter, which would go below the edges and make them anew beside those that degrees are counted of.
                rows = rows.filter(rows.column("src").is_valid())
                mine = pa.table([rows.column(c) for c in ("dst", "src", "weight")], ["dst", "src", "weight"])
                mine = mine if held is None else pa.concat_tables([held, mine]).combine_chunks()
                # The last target's edges may go on in the next batch.
                ends = _group_starts(mine.column("dst"))[-1]
                if ends:
                    yield from _lists(mine.slice(0, ends), known, weighted)
                held = mine.slice(ends)
        if held is not None:
            yield from _lists(held, known, weighted)

    return dealt.mapInArrow(run, "id long, nbrs array<struct<u: long, vec: array<double>>>")


def _group_starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal ids start, nulls one of them."""
    values, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()
    return np.append(0, np.flatnonzero((np.diff(values) != 0) | (null[1:] != null[:-1])) + 1)


def _lists(edges: pa.Table, known: tuple[np.ndarray, pa.Array], weighted: bool) -> Iterator[pa.RecordBatch]:
    """id, nbrs of edges that are sorted by target; a source with several vectors sends each, one without any sends none."""
    ids, vectors = known
    src = edges.column("src").to_numpy()
    low, high = np.searchsorted(ids, src, "left"), np.searchsorted(ids, src, "right")
    n = high - low
    edge = np.repeat(np.arange(len(src)), n)
    if not len(edge):
        return
    sent = vectors.take(pa.array(low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)))
    values, widths = sent.flatten(), pc.list_value_length(sent).to_numpy()
    if weighted:
        weights = edges.column("weight").combine_chunks().take(pa.array(np.repeat(edge, widths)))
        values = pc.multiply(values, weights)
    messages = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(widths)), pa.int32()), values)
    pairs = pa.StructArray.from_arrays([pa.array(src[edge]), messages], ["u", "vec"])
    targets = edges.column("dst").combine_chunks().take(pa.array(edge))
    starts = _group_starts(pa.chunked_array([targets]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(edge)), pa.int32()), pairs)
    yield pa.RecordBatch.from_arrays([targets.take(pa.array(starts)), lists], ["id", "nbrs"])


def gather_blocks(edges: DataFrame, vertices: DataFrame, column: str = "feat", weighted: bool = True, size: int = 10_000) -> DataFrame:
    """id, block, nbrs: the messages in lists of about size; a vertex has as many blocks as its in-degree asks for."""
    n_blocks = edges.groupBy(F.col("dst").alias("id")).agg(F.ceil(F.count("*") / size).cast("int").alias("n_blocks")).where("n_blocks > 1")
    rows = gather_rows(edges, vertices, column, weighted).join(n_blocks, "id", "left")
    block = F.pmod(F.xxhash64("u"), F.coalesce("n_blocks", F.lit(1))).cast("int")
    return rows.groupBy("id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("u", "vec"))).alias("nbrs"))


def gather_rows(edges: DataFrame, vertices: DataFrame, column: str = "feat", weighted: bool = True) -> DataFrame:
    """id, u, vec: one row for each message."""
    sent = join_sent(_weighted(edges), _entries(vertices, column), "src", "dst")
    vec = F.col("__vec").cast("array<double>")
    return sent.select(F.col("dst").alias("id"), F.col("src").alias("u"), (scale(vec, F.col("weight")) if weighted else vec).alias("vec"))


def collect_neighbours(edges: DataFrame, vertices: DataFrame, direction: str = "in") -> DataFrame:
    """id, nbrs: the neighbours' whole rows, along in- or out-edges. A list is as long as the degree; neighbour_rows has none."""
    return neighbour_rows(edges, vertices, direction).groupBy("id").agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))


def neighbour_rows(edges: DataFrame, vertices: DataFrame, direction: str = "in") -> DataFrame:
    """id, nbr: one row for each neighbour along in- or out-edges, with its whole row as a struct."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    side = vertices.select("id", F.struct(*[vertices[c] for c in vertices.columns]).alias("nbr"))
    return join_sent(edges.select("src", "dst"), side, far, near).select(F.col(near).alias("id"), "nbr")


def sum_gathered(gathered: DataFrame) -> DataFrame:
    """(id, vec) from gathered messages, in whole lists or in blocks; equals weighted_sum."""
    return _array_sum(gathered.select("id", F.explode("nbrs").alias("n")), F.col("n.vec"))


@F.arrow_udf(ArrayType(DoubleType()))
def _listed_sums(vectors: pa.Array) -> pa.Array:
    """Sums of whole vectors of one width, in the list's order; null for other lists."""
    lists = vectors.flatten()
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    null = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else np.zeros(0, np.int64)
    values = values.to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(np.maximum(widths, 0), dtype=np.int64))
    out, i = [], 0
    for n in pc.list_value_length(vectors).to_pylist():
        first, last = ends[i], ends[i + (n or 0)]
        if n is None or n and (widths[i] < 0 or (widths[i : i + n] != widths[i]).any() or np.searchsorted(null, first) < np.searchsorted(null, last)):
            out.append(None)
        else:
            out.append(values[first:last].reshape(n, widths[i]).sum(axis=0) + 0.0 if n else np.zeros(0))
        i += n or 0
    return pa.array(out, pa.list_(pa.float64()))


def sum_listed(vectors: Column) -> Column:
    """Sum of an array of vectors of one width, such as a gathered list that came as JSON; the empty array for none."""
    width = F.size(F.get(vectors, F.lit(0)))
    folded = F.when(F.size(vectors) > 0, F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), add)).otherwise(F.array().cast("array<double>"))
    return F.coalesce(_listed_sums(vectors.cast("array<array<double>>")), folded)


def edge_gradients(edges: DataFrame, edge_grads: DataFrame, weighted: bool = True) -> DataFrame:
    """u, v, vec: gradients per edge (v, u, vec) of messages u to v, times the edge's weight or 1; multi-edges keep a row each."""
    pairs = _weighted(edges).select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
    return pairs.join(edge_grads, ["u", "v"]).select("u", "v", (scale(F.col("vec"), F.col("weight")) if weighted else F.col("vec")).alias("vec"))


def backward_edge_grads(edges: DataFrame, edge_grads: DataFrame, weighted: bool = True, to: str = "u") -> DataFrame:
    """(id, vec): per-edge gradients summed at the vertex that sent the message (to u), or at the one that got it (to v)."""
    return _array_sum(edge_gradients(edges, edge_grads, weighted).withColumnRenamed(to, "id"), F.col("vec"))


def gather_edge_grads(edges: DataFrame, edge_grads: DataFrame, to: str = "u") -> DataFrame:
    """id, other, vec: the unweighted gradients per edge as rows of the vertex that sent the message (to u) or got it (to v)."""
    rows = edge_gradients(edges, edge_grads, weighted=False)
    return rows.select(F.col(to).alias("id"), F.col("v" if to == "u" else "u").alias("other"), "vec")


def assemble(rows: DataFrame, name: str = "vec", width: int | None = None) -> DataFrame:
    """(id, pos, val) to (id, vec). With a width, entries without a row are 0."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "val")))
    out = rows.groupBy("id").agg(pairs.alias("p"))
    values = F.transform("p", lambda s: s["val"])
    if width is not None:
        known = F.map_from_arrays(F.transform("p", lambda s: s["pos"]), values)
        values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0)))
    return out.select("id", values.alias(name))


def choose_sum(reduction: str) -> Callable[..., DataFrame]:
    """Planner rule: a linear sum is pushed below the layer, anything else has to see the messages."""
    return weighted_sum if reduction == "sum" else gather


def reduce_messages(edges: DataFrame, vertices: DataFrame, column: str = "feat", reduction: str = "sum") -> DataFrame:
    """id, vec: sum, or the greatest or least message (max, min) entry by entry. choose_sum decides whether messages are listed.

    A gathered list of a hub is taken in blocks, whose results are reduced again.
    """
    if choose_sum(reduction) is weighted_sum:
        return weighted_sum(edges, vertices, column)
    if reduction not in ("max", "min"):
        raise ValueError("reduction has to be sum, max or min")
    pick = F.greatest if reduction == "max" else F.least

    def fold(lists: Column) -> Column:
        return F.aggregate(F.slice(lists, 2, F.size(lists)), F.get(lists, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y)))

    blocks = gather_blocks(edges, vertices, column).select("id", fold(F.transform("nbrs", lambda n: n["vec"])).alias("vec"))
    return blocks.groupBy("id").agg(fold(F.collect_list("vec")).alias("vec"))


def update_vertices(vertices: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    """Left outer update: vertices with a row in updates (id, columns) take its values, even null; the others keep theirs, or null where there is no such column."""
    new = updates.select(F.col("id").alias("__id"), F.struct(*columns).alias("__new"))
    joined = vertices.join(new, F.col("id") == F.col("__id"), "left")
    for column in columns:
        old = F.col(column) if column in vertices.columns else F.lit(None)
        joined = joined.withColumn(column, F.when(F.col("__new").isNotNull(), F.col("__new").getField(column)).otherwise(old))
    return joined.drop("__id", "__new")


#: The columns that a graph's state has in each form, see update_state.
STATE_FORMS = {"dense": ("grad",), "gathered": ("nbrs",), "map": ("messages",), "sparse": ("size", "indices", "values")}


def update_state(vertices: DataFrame, updates: DataFrame, form: str) -> DataFrame:
    """update_vertices by the form of what came back: one vector, a list of messages, a map from neighbour to vector, or a sparse vector."""
    if form not in STATE_FORMS:
        raise ValueError(f"form has to be one of {sorted(STATE_FORMS)}")
    return update_vertices(vertices, updates, *STATE_FORMS[form])


def as_sparse(rows: DataFrame, column: str = "vec") -> DataFrame:
    """id, size, indices, values of dense vectors."""
    return rows.select("id", to_sparse(F.col(column)).alias("s")).select("id", "s.*")


def attach_features(vertices: DataFrame, features: DataFrame, column: str = "feat", strict: bool = False) -> DataFrame:
    """Outer join of features onto structure; strict raises for a vertex without any."""
    joined = vertices.join(features.select("id", column), "id", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no features for vertex "), F.col("id").cast("string")))
        joined = joined.withColumn(column, F.when(F.col(column).isNull(), missing).otherwise(F.col(column)))
    return joined
