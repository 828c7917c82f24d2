"""Registered graph queries, each beside the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import codecs, vectors
from quern.functions.draws import gaussian_sql, uniform_sql
from quern.graph import reverse_edges
from quern.operators import generate, metrics, neural, structure, train
from quern.operators.propagate import (
    LayerProtocol,
    aggregate_messages,
    as_sparse,
    backward_edge_grads,
    backward_forward,
    backward_reverse,
    backward_sparse,
    collect_neighbours,
    gather,
    gather_blocks,
    gather_edge_grads,
    gather_rows,
    neighbour_rows,
    reduce_messages,
    sparse_sum,
    sum_gathered,
    sum_listed,
    update_state,
    update_vertices,
    weighted_sum,
)
from quern.plans import fixture as fx
from quern.session import shared_folder
from quern.sources import readers, writers

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """(id, pos, val) with steady numbers: no minus zero, no noise in the last digits."""
    return rows.select("id", F.col("pos").cast("int").alias("pos"), (F.round("val", digits) + 0.0).alias("val"))


def spread(rows: DataFrame, column: str = "vec") -> DataFrame:
    return rows.select("id", F.posexplode(column).alias("pos", "val"))


def sql_sum(w: str = "w", x: str = "x", at: str = "src", to: str = "dst") -> str:
    return f"SELECT {w}.{to} AS id, {x}.pos AS pos, round(sum({w}.weight * {x}.val), 6) + 0.0 AS val FROM {w} JOIN {x} ON {x}.id = {w}.{at} GROUP BY 1, 2"


# Structure -------------------------------------------------------------------------------------


@register("degrees", f"WITH {fx.V}, {fx.E0}, {fx.E}, {fx.DEG} SELECT v.id, greatest(coalesce(ind.d, 0), 1) AS in_deg, greatest(coalesce(od.d, 0), 1) AS out_deg FROM v LEFT JOIN ind USING (id) LEFT JOIN od ON od.id = v.id")
def degrees(spark, d):
    v = fx.vertices(spark, d)
    return structure.degrees(v, structure.add_self_loops(fx.edges(spark, d), v))


@register("degrees_multigraph", "WITH s AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), v AS (SELECT src AS id FROM s UNION SELECT dst FROM s) SELECT v.id, coalesce(i.n, 0) AS in_deg, coalesce(o.n, 0) AS out_deg FROM v LEFT JOIN (SELECT dst AS id, count(*) AS n FROM s GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM s GROUP BY 1) o USING (id)")
def degrees_multigraph(spark, d):
    e = fx.supply(spark, d)
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return structure.degrees(v, e, clamp=False)


@register("labelled_degrees", f"WITH {fx.V}, {fx.E0} SELECT e0.dst AS id, sum(CASE WHEN v.label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS labelled_deg FROM e0 JOIN v ON v.id = e0.src GROUP BY 1")
def labelled_degrees(spark, d):
    v = fx.vertices(spark, d).withColumn("labeled", F.when(F.col("label") < 5, 1.0).otherwise(0.0))
    return structure.labelled_degrees(v, fx.edges(spark, d))


@register("edges_reverse", f"WITH {fx.E0} SELECT dst AS src, src AS dst FROM e0")
def edges_reverse(spark, d):
    return reverse_edges(fx.edges(spark, d))


@register("edges_undirected", f"WITH {fx.E0} SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0")
def edges_undirected(spark, d):
    return structure.undirected(fx.edges(spark, d))


@register("edges_self_loop", f"WITH {fx.V}, {fx.E0}, {fx.E} SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2")
def edges_self_loop(spark, d):
    return structure.add_self_loops(fx.edges(spark, d), fx.vertices(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _norm(norm: str, convention: str = "forward"):
    sql = f"{fx.weighted(norm, convention == 'reverse')} SELECT src, dst, round(weight, 10) AS weight FROM w"

    @register(f"norm_{norm}" + "_reverse" * (convention == "reverse"), sql)
    def run(spark, d):
        return fx.graph(spark, d, norm, convention).edges.select("src", "dst", F.round("weight", 10).alias("weight"))


for _n in structure.NORMS:
    _norm(_n)
_norm("symmetric", "reverse")


@register("khop_in", f"WITH {fx.E0}, h0 AS (SELECT vec_id AS id FROM embeddings WHERE label = 0), h1 AS (SELECT src AS id FROM e0 JOIN h0 ON e0.dst = h0.id), h2 AS (SELECT src AS id FROM e0 JOIN (SELECT DISTINCT id FROM h1) h ON e0.dst = h.id), a AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) SELECT id, min(hop)::INT AS hop FROM a GROUP BY 1")
def khop_in(spark, d):
    return structure.khop_in(fx.edges(spark, d), fx.vertices(spark, d).where("label = 0"), 2)


@register("khop_subgraph", f"WITH {fx.E0}, h0 AS (SELECT vec_id AS id FROM embeddings WHERE label = 0), h1 AS (SELECT src AS id FROM e0 JOIN h0 ON e0.dst = h0.id), h AS (SELECT id FROM h0 UNION SELECT id FROM h1) SELECT src, dst FROM e0 WHERE dst IN (SELECT id FROM h)")
def khop_subgraph(spark, d):
    return structure.khop_subgraph(fx.edges(spark, d), fx.vertices(spark, d).where("label = 0"), 2).select("src", "dst")


_SPLIT_SQL = "CASE WHEN id % 10 < 8 THEN 0 WHEN id % 10 = 8 THEN 1 ELSE 2 END"


@register("split_masks", f"WITH {fx.V}, s AS (SELECT id, {_SPLIT_SQL} AS s FROM v) SELECT id, s::INT AS all_mask, (s = 0)::INT AS train_mask, (s = 1)::INT AS valid_mask, (s = 2)::INT AS test_mask, 1.0::DOUBLE AS labeled FROM s")
def split_masks(spark, d):
    return structure.split_masks(fx.vertices(spark, d), fx.split_number())


@register("random_split_hash", f"WITH {fx.V} SELECT id, CASE WHEN ((id % 1000003) * 7919) % 10 < 9 THEN 0 ELSE 2 END::INT AS split FROM v")
def random_split_hash(spark, d):
    return fx.vertices(spark, d).select("id", structure.hash_split(F.col("id")).alias("split"))


@register("random_split_seeded", f"WITH {fx.V} SELECT id, CASE WHEN {uniform_sql(2021, 'id')} < 0.9 THEN 0 ELSE 2 END::INT AS split FROM v")
def random_split_seeded(spark, d):
    return fx.vertices(spark, d).select("id", structure.seeded_split(0.9, 2021).alias("split"))


_PID_SQL = {
    "1d": "((src % 1000003) * 7919) % 16",
    "2d": "(((src % 1000003) * 7919) % 4) * 4 + ((dst % 1000003) * 7919) % 4",
    "random": "((src % 1000003) * 7919 + (dst % 1000003) * 104729) % 16",
    "canonical": "((least(src, dst) % 1000003) * 7919 + (greatest(src, dst) % 1000003) * 104729) % 16",
}


def _replication(strategy: str):
    sql = f"WITH s AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), p AS (SELECT {_PID_SQL[strategy]} AS pid, src, dst FROM s), b AS (SELECT pid, src AS vid, 's' AS e FROM p UNION ALL SELECT pid, dst, 'd' FROM p), g AS (SELECT vid, count(DISTINCT pid) AS n, count(DISTINCT CASE WHEN e = 's' THEN pid END) AS ns, count(DISTINCT CASE WHEN e = 'd' THEN pid END) AS nd FROM b GROUP BY vid) SELECT round(avg(n), 9) AS rf_all, round(avg(CASE WHEN ns > 0 THEN ns END), 9) AS rf_src, round(avg(CASE WHEN nd > 0 THEN nd END), 9) AS rf_dst FROM g"

    @register(f"replication_{strategy}", sql)
    def run(spark, d):
        found = structure.replication_factor(fx.supply(spark, d), structure.partition_id(strategy, 16))
        return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


for _s in structure.STRATEGIES:
    _replication(_s)


@register("replication_physical")
def replication_physical(spark, d):
    placed = structure.place_edges(fx.supply(spark, d), 16).withColumn("pid", F.spark_partition_id())
    return structure.replication_factor(placed, F.col("pid"))


# Messages --------------------------------------------------------------------------------------


@register("propagate_dense", f"{fx.weighted()} {sql_sum()}")
def propagate_dense(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(weighted_sum(g.edges, g.vertices)))


@register("propagate_wide", f"{fx.weighted()} {sql_sum()}")
def propagate_wide(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(weighted_sum(g.edges, g.vertices, plan="wide", width=64)))


@register("propagate_long", f"{fx.weighted()} {sql_sum()}")
def propagate_long(spark, d):
    g = fx.graph(spark, d)
    return rounded(weighted_sum(g.edges, g.vertices, plan="long"))


@register("propagate_layer2", f"{fx.weighted()}, y AS (SELECT w.dst AS id, x.pos, sum(w.weight * x.val) AS val FROM w JOIN x ON x.id = w.src GROUP BY 1, 2) {sql_sum(x='y')}")
def propagate_layer2(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(weighted_sum(g.edges, weighted_sum(g.edges, g.vertices), "vec")))


def _sparse(g):
    """Entries over 0.05 of each vertex's vector."""
    cut = F.transform("feat", lambda x: F.when(x > 0.05, x).otherwise(0.0))
    return as_sparse(g.vertices.select("id", cut.alias("vec")))


_SPARSE = f"{fx.weighted()}, y AS (SELECT id, pos, val FROM x WHERE val > 0.05)"


@register("propagate_sparse", f"{_SPARSE} {sql_sum(x='y')}")
def propagate_sparse(spark, d):
    g = fx.graph(spark, d)
    return rounded(sparse_sum(g.edges, _sparse(g)))


def _backward_sparse(orientation: str):
    @register(f"backward_sparse_{orientation}", f"{_SPARSE} {sql_sum(x='y', at='dst', to='src')}")
    def run(spark, d):
        g = fx.graph(spark, d)
        return rounded(backward_sparse(g.edges, _sparse(g), orientation))


_backward_sparse("reverse")
_backward_sparse("forward")


def _marks(v):
    """A vector's sum and its sum by place, which tells an order from another."""
    add = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6) + 0.0
    return [add(v).alias("total"), add(F.transform(v, lambda x, i: x * (i + 1))).alias("placed")]


def _marks_sql(v: str) -> str:
    return f"round(list_sum({v}), 6) + 0.0 AS total, round(list_sum(list_transform({v}, lambda x, i: x * i)), 6) + 0.0 AS placed"


_GATHERED = f"{fx.weighted()}, n AS (SELECT w.dst AS id, w.src AS u, list_transform(v.feat, lambda x: x * w.weight) AS vec FROM w JOIN v ON v.id = w.src) SELECT id, u, {_marks_sql('vec')}, len(vec) AS n FROM n"


def _gather_parts(spark) -> int:
    """Twice the cores: the fixture graph has far more edges than vertices, so vectors go to parts and not along with edges."""
    return 2 * spark.sparkContext.defaultParallelism


@register("gather_neighbors", _GATHERED)
def gather_neighbors(spark, d):
    g = fx.graph(spark, d)
    rows = gather(g.edges, g.vertices, parts=_gather_parts(spark)).select("id", F.explode("nbrs").alias("n"))
    return rows.select("id", "n.u", *_marks(F.col("n.vec")), F.size("n.vec").cast("long").alias("n"))


@register("gather_blocks", _GATHERED)
def gather_in_blocks(spark, d):
    g = fx.graph(spark, d)
    rows = gather_blocks(g.edges, g.vertices, size=50).select("id", F.explode("nbrs").alias("n"))
    return rows.select("id", "n.u", *_marks(F.col("n.vec")), F.size("n.vec").cast("long").alias("n"))


@register("gather_unweighted", f"WITH {fx.V}, {fx.E0} SELECT e0.dst AS id, e0.src AS u, {_marks_sql('v.feat')}, len(v.feat) AS n FROM e0 JOIN v ON v.id = e0.src")
def gather_unweighted(spark, d):
    rows = gather_rows(fx.edges(spark, d), fx.vertices(spark, d), weighted=False)
    return rows.select("id", "u", *_marks(F.col("vec")), F.size("vec").cast("long").alias("n"))


@register("gather_then_sum", f"{fx.weighted()} {sql_sum()}")
def gather_then_sum(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(sum_gathered(gather_blocks(g.edges, g.vertices))))


@register("sum_listed", f"{fx.weighted()} {sql_sum()}")
def sum_listed_json(spark, d):
    """Gathered lists written as JSON, read back and summed."""
    g = fx.graph(spark, d)
    line = gather(g.edges, g.vertices, parts=_gather_parts(spark)).select(codecs.encode_json_gather(F.col("id"), F.col("nbrs")).alias("line"))
    back = line.select(codecs.decode_json_gather(F.col("line")).alias("r"))
    # An inner explode infers a filter on its array, which is pushed below the codecs and decodes each line again.
    sums = back.select("r.id", sum_listed(F.col("r.nbrs.vec")).alias("vec"))
    return rounded(sums.select("id", F.posexplode_outer("vec").alias("pos", "val")).where("pos is not null"))


def _reduced(reduction: str):
    @register(f"reduce_{reduction}", f"{fx.weighted()} SELECT w.dst AS id, x.pos, round({reduction}(w.weight * x.val), 6) + 0.0 AS val FROM w JOIN x ON x.id = w.src GROUP BY 1, 2")
    def run(spark, d):
        g = fx.graph(spark, d)
        return rounded(spread(reduce_messages(g.edges, g.vertices, reduction=reduction)))


for _r in ("sum", "max", "min"):
    _reduced(_r)


@register("layer_protocol", f"{fx.weighted()}, m AS (SELECT w.dst AS id, round(sum(w.weight * v.label), 8) AS total, count(*) AS n FROM w JOIN v ON v.id = w.src GROUP BY 1) SELECT v.id, round(coalesce(m.total, 0.0) / coalesce(m.n, 1) + v.label, 6) AS state FROM v LEFT JOIN m USING (id)")
def layer_protocol(spark, d):
    g = fx.graph(spark, d)
    message = F.struct((F.col("weight") * F.col("src_label")).alias("x"))
    state = F.round(F.coalesce(F.col("total"), F.lit(0.0)) / F.coalesce(F.col("n"), F.lit(1)) + F.col("label"), 6)
    layer = LayerProtocol(message, [F.round(F.sum("msg.x"), 8).alias("total"), F.count("*").alias("n")], lambda rows: rows.select("id", state.alias("state")))
    return layer.run(g.edges, g.vertices.select("id", "label"))


def _collect(direction: str):
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")

    @register(f"collect_neighbors_{direction}", f"WITH {fx.V}, {fx.E0} SELECT e0.{near} AS id, v.id AS u, v.label FROM e0 JOIN v ON v.id = e0.{far}")
    def run(spark, d):
        found = collect_neighbours(fx.edges(spark, d), fx.vertices(spark, d).select("id", "label"), direction)
        return found.select("id", F.explode("nbrs").alias("n")).select("id", F.col("n.id").alias("u"), "n.label")


_collect("in")
_collect("out")


@register("neighbor_rows", f"WITH {fx.V}, {fx.E0} SELECT e0.dst AS id, v.id AS u, v.label FROM e0 JOIN v ON v.id = e0.src")
def neighbor_rows(spark, d):
    return neighbour_rows(fx.edges(spark, d), fx.vertices(spark, d).select("id", "label")).select("id", F.col("nbr.id").alias("u"), "nbr.label")


@register("aggregate_messages", f"{fx.weighted()} SELECT w.dst AS id, max(v.label) AS top, round(sum(w.weight), 8) AS total FROM w JOIN v ON v.id = w.src GROUP BY 1")
def aggregate(spark, d):
    g = fx.graph(spark, d)
    msg = F.struct(F.col("src_label").alias("label"), "weight")
    return aggregate_messages(g.edges, g.vertices.select("id", "label"), msg, [F.max("msg.label").alias("top"), F.round(F.sum("msg.weight"), 8).alias("total")])


_BACK = f"{fx.weighted()} {sql_sum(at='dst', to='src')}"


@register("backward_reverse", _BACK)
def back_reverse(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(backward_reverse(g.edges, g.vertices, "feat")))


@register("backward_forward", _BACK)
def back_forward(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(backward_forward(g.edges, g.vertices, "feat")))


_EDGE_GRADS = f"{fx.weighted()}, y AS (SELECT DISTINCT w.dst AS v, w.src AS u, x.pos, x.val * (w.src % 3 + 1) AS val FROM w JOIN x ON x.id = w.dst)"


def _edge_grads(g):
    """v, u, vec for each pair of the graph."""
    pairs = g.edges.select(F.col("dst").alias("v"), F.col("src").alias("u")).distinct().join(g.vertices.select(F.col("id").alias("v"), "feat"), "v")
    return pairs.select("v", "u", vectors.scale(F.col("feat"), (F.col("u") % 3 + 1).cast("double")).alias("vec"))


@register("backward_edge_grads", f"{_EDGE_GRADS} SELECT w.src AS id, y.pos, round(sum(w.weight * y.val), 6) + 0.0 AS val FROM w JOIN y ON y.v = w.dst AND y.u = w.src GROUP BY 1, 2")
def back_edges(spark, d):
    g = fx.graph(spark, d)
    return rounded(spread(backward_edge_grads(g.edges, _edge_grads(g))))


def _unweighted_edge_grads(to: str, end: str):
    @register(f"backward_edge_grads_sum_{end}", f"{_EDGE_GRADS} SELECT w.{end} AS id, y.pos, round(sum(y.val), 6) + 0.0 AS val FROM w JOIN y ON y.v = w.dst AND y.u = w.src GROUP BY 1, 2")
    def run(spark, d):
        g = fx.graph(spark, d)
        return rounded(spread(backward_edge_grads(g.edges, _edge_grads(g), False, to)))

    other = "dst" if end == "src" else "src"

    @register(f"gather_edge_grads_{end}", f"{_EDGE_GRADS}, r AS (SELECT *, row_number() OVER () AS rn FROM w) SELECT id, other, total, placed FROM (SELECT r.rn, r.{end} AS id, r.{other} AS other, round(sum(y.val), 6) + 0.0 AS total, round(sum(y.val * (y.pos + 1)), 6) + 0.0 AS placed FROM r JOIN y ON y.v = r.dst AND y.u = r.src GROUP BY 1, 2, 3)")
    def rows(spark, d):
        g = fx.graph(spark, d)
        return gather_edge_grads(g.edges, _edge_grads(g), to).select("id", "other", *_marks(F.col("vec")))


_unweighted_edge_grads("u", "src")
_unweighted_edge_grads("v", "dst")


@register("update_join", "SELECT vec_id AS id, CASE WHEN label < 3 THEN -label ELSE label END AS label FROM embeddings")
def update_join(spark, d):
    v = fx.vertices(spark, d).select("id", "label")
    return update_vertices(v, v.where("label < 3").select("id", (-F.col("label")).alias("label")), "label")


def _updates(spark, d):
    """Vertices with a state of each form, and for those of label 0 to 2 a new one: the vector times two."""
    v = fx.vertices(spark, d)

    def state(vec):
        pairs = F.array(F.struct(F.col("id").alias("u"), vec.alias("vec")))
        sparse = vectors.to_sparse(vec)
        return v.select("id", "label", vec.alias("grad"), pairs.alias("nbrs"), F.create_map("id", vec).alias("messages"), sparse["size"].alias("size"), sparse["indices"].alias("indices"), sparse["values"].alias("values"))

    return state(F.col("feat")).drop("label"), state(vectors.scale(F.col("feat"), F.lit(2.0))).where("label < 3").drop("label")


def _update_state(form: str, vec):
    @register(f"update_{form}", f"WITH {fx.V}, {fx.X} SELECT x.id, x.pos, CASE WHEN v.label < 3 THEN 2 * x.val ELSE x.val END AS val FROM x JOIN v USING (id)")
    def run(spark, d):
        old, new = _updates(spark, d)
        return spread(update_state(old, new, form).select("id", vec().alias("vec")))


_update_state("dense", lambda: F.col("grad"))
_update_state("gathered", lambda: F.col("nbrs")[0]["vec"])
_update_state("map", lambda: vectors.at_key(F.col("messages"), F.col("id")))
_update_state("sparse", lambda: vectors.to_dense(F.col("size"), F.col("indices"), F.col("values")))


# Vectors and codecs ----------------------------------------------------------------------------


@register("vec_arithmetic", f"WITH {fx.V}, {fx.X} SELECT id, pos, round(val * 2.5, 9) + 0.0 AS scaled, round(val + val, 9) + 0.0 AS added FROM x")
def vec_arithmetic(spark, d):
    v = F.col("feat")
    both = F.arrays_zip(vectors.scale(v, F.lit(2.5)).alias("s"), vectors.add(v, v).alias("a"))
    rows = fx.vertices(spark, d).select("id", F.posexplode(both).alias("pos", "x"))
    return rows.select("id", "pos", (F.round("x.s", 9) + 0.0).alias("scaled"), (F.round("x.a", 9) + 0.0).alias("added"))


@register("vec_parts", f"WITH {fx.V}, {fx.X}, j AS (SELECT id, pos, val FROM x WHERE pos BETWEEN 2 AND 9 UNION ALL SELECT id, pos + 64, 0.5::DOUBLE FROM x WHERE pos < 3) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS pos, val FROM j")
def vec_parts(spark, d):
    """Entries 2 to 9 of a vector with a constant one of three behind."""
    return spread(fx.vertices(spark, d).select("id", vectors.concat(vectors.cut(F.col("feat"), 2, 10), vectors.constant(0.5, 3)).alias("vec")))


@register("vec_dot_width_total", "SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot, len(embedding)::INT AS width, round(3 * list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def vec_dot_width_total(spark, d):
    v = F.col("feat")
    added = vectors.total(F.array(v, v, v), vectors.width(v))
    total = F.round(F.aggregate(added, F.lit(0.0), lambda s, x: s + x), 6) + 0.0
    return fx.vertices(spark, d).select("id", F.round(vectors.dot(v, v), 6).alias("dot"), vectors.width(v).alias("width"), total.alias("total"))


@register("vec_argmax", f"WITH {fx.V}, {fx.X} SELECT id, arg_max(pos, val)::INT AS best FROM x GROUP BY 1")
def vec_argmax(spark, d):
    return fx.vertices(spark, d).select("id", vectors.argmax(F.col("feat")).alias("best"))


@register("vec_topk", f"WITH {fx.V}, {fx.X}, r AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY val DESC, pos) AS rank FROM x) SELECT id, rank::INT AS rank, pos FROM r WHERE rank <= 3")
def vec_topk(spark, d):
    return fx.vertices(spark, d).select("id", F.posexplode(vectors.topk(F.col("feat"), 3)).alias("r", "pos")).select("id", (F.col("r") + 1).alias("rank"), "pos")


@register("dense_to_sparse", f"WITH {fx.V}, {fx.X} SELECT id, pos, val FROM x WHERE val > 0.1")
def dense_to_sparse(spark, d):
    some = F.transform("feat", lambda x: F.when(x > 0.1, x).otherwise(0.0))
    rows = fx.vertices(spark, d).select("id", vectors.to_sparse(some).alias("s"))
    return rows.select("id", F.explode(F.arrays_zip("s.indices", "s.values")).alias("e")).select("id", F.col("e.indices").alias("pos"), F.col("e.values").alias("val"))


@register("sparse_to_dense", f"WITH {fx.V}, {fx.X} SELECT id, pos, CASE WHEN val > 0.1 THEN val ELSE 0.0::DOUBLE END AS val FROM x")
def sparse_to_dense(spark, d):
    some = F.transform("feat", lambda x: F.when(x > 0.1, x).otherwise(0.0))
    rows = fx.vertices(spark, d).select("id", vectors.to_sparse(some).alias("s"))
    return spread(rows.select("id", vectors.to_dense(F.col("s.size"), F.col("s.indices"), F.col("s.values")).alias("vec")))


_PLAIN = f"WITH {fx.V}, {fx.X} SELECT id, pos, val FROM x"


@register("codec_dense_roundtrip", _PLAIN)
def codec_dense(spark, d):
    line = codecs.encode_dense(F.col("id"), F.col("feat"))
    return spread(fx.vertices(spark, d).select(codecs.decode_dense(line).alias("r")).select("r.id", "r.vec"))


@register("codec_dense_lines", f"WITH {fx.V} SELECT id || ',' || array_to_string(list_transform(feat, lambda x: printf('%e', x * 1.1::DOUBLE)), ',') AS line FROM v")
def codec_dense_lines(spark, d):
    """The factor spreads the digits; products that still are exact ties in the seventh (0.12890625) round to even, as in C."""
    return fx.vertices(spark, d).select(codecs.encode_dense(F.col("id"), vectors.scale(F.col("feat"), F.lit(1.1)), exact=False).alias("line"))


@register("codec_layouts", "SELECT i AS id, i || ',' || (i % 3) || CASE WHEN i % 3 > 0 THEN ',' || array_to_string(list_transform(range(0, i % 3), lambda k: (k + 7) || ',1.5,-2.0'), ',') ELSE '' END AS gathered, i || ';4;1,3;1.5,-2.0' AS sparse, '[' || i || ',[1.5,-2.0]]' AS json FROM range(20) t(i)")
def codec_layouts(spark, d):
    """The written lines themselves, on values that every engine prints alike."""
    vec = F.array(F.lit(1.5), F.lit(-2.0))
    nbrs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < F.col("id") % 3), lambda k: F.struct((k + 7).cast("long").alias("u"), vec.alias("vec")))
    sparse = codecs.encode_sparse(F.col("id"), F.lit(4), F.array(F.lit(1), F.lit(3)), vec)
    return spark.range(20).select("id", codecs.encode_gather(F.col("id"), nbrs).alias("gathered"), sparse.alias("sparse"), codecs.encode_json_vector(F.col("id"), vec).alias("json"))


@register("codec_sparse_roundtrip", _PLAIN)
def codec_sparse(spark, d):
    rows = fx.vertices(spark, d).select("id", vectors.to_sparse(F.col("feat")).alias("s"))
    line = rows.select(codecs.encode_sparse(F.col("id"), F.col("s.size"), F.col("s.indices"), F.col("s.values")).alias("line"))
    return spread(line.select(codecs.decode_sparse(F.col("line")).alias("r")).select("r.id", codecs.sparse_to_vector(F.col("r")).alias("vec")))


_NBRS = f"WITH {fx.V}, {fx.E0} SELECT e0.dst AS id, e0.src AS u, v.feat = v.feat AS same FROM e0 JOIN v ON v.id = e0.src"


def _nbrs(spark, d, encode, decode):
    """Every message after the round trip, and whether its whole vector is the neighbour's."""
    v = fx.vertices(spark, d)
    rows = gather(fx.edges(spark, d), v, weighted=False).select(encode(F.col("id"), F.col("nbrs")).alias("line"))
    back = rows.select(decode(F.col("line")).alias("r")).select("r.id", F.explode("r.nbrs").alias("n")).select("id", "n.u", "n.vec")
    return back.join(v.select(F.col("id").alias("u"), "feat"), "u").select("id", "u", (F.col("vec") == F.col("feat")).alias("same"))


@register("codec_gather_roundtrip", _NBRS)
def codec_gather(spark, d):
    return _nbrs(spark, d, codecs.encode_gather, codecs.decode_gather)


@register("codec_json_gather", _NBRS)
def codec_json_gather(spark, d):
    return _nbrs(spark, d, codecs.encode_json_gather, codecs.decode_json_gather)


@register("codec_json_vector", _PLAIN)
def codec_json(spark, d):
    line = codecs.encode_json_vector(F.col("id"), F.col("feat"))
    return spread(fx.vertices(spark, d).select(codecs.decode_json_vector(line).alias("r")).select("r.id", "r.vec"))


@register("vec_concat_map", f"WITH {fx.V}, {fx.E0}, m AS (SELECT dst AS id, count(DISTINCT src) AS n, max(src) AS top FROM e0 GROUP BY 1) SELECT m.id, n, top, round(v.feat[1], 9) + 0.0 AS first FROM m LEFT JOIN v ON v.id = m.top")
def vec_concat_map(spark, d):
    pairs = gather(fx.edges(spark, d), fx.vertices(spark, d), weighted=False)
    mapped = pairs.select("id", vectors.pairs_to_map(F.col("nbrs"), "u", "vec").alias("m")).withColumn("top", F.array_max(F.map_keys("m")))
    first = F.round(vectors.at_key(F.col("m"), F.col("top"))[0], 9) + 0.0
    return mapped.select("id", F.size("m").cast("long").alias("n"), "top", first.alias("first"))


@register("tokens_and_clean", "SELECT n_nationkey AS id, len(string_split_regex(trim(n_name), '\\s+'))::BIGINT AS n, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_nationkey::DOUBLE END, 0.0::DOUBLE) AS x FROM nation")
def tokens_and_clean(spark, d):
    rows = fx.table(spark, d, "nation")
    x = F.when(F.col("n_nationkey") % 4 == 0, F.lit(float("nan"))).when(F.col("n_nationkey") % 2 == 0, F.lit(None)).otherwise(F.col("n_nationkey").cast("double"))
    return rows.select(F.col("n_nationkey").alias("id"), F.size(vectors.tokens(F.col("n_name"))).cast("long").alias("n"), vectors.clean(x).alias("x"))


# Sources and sinks -----------------------------------------------------------------------------


def _written(spark, d, name: str, write):
    folder = shared_folder(spark, name)
    write(fx.graph(spark, d).with_vertices(fx.vertices(spark, d)), folder)
    return folder


def _meta(spark, d):
    return structure.split_masks(fx.vertices(spark, d), fx.split_number()).select("id", F.lit(0).alias("label"), "all_mask", "train_mask", "valid_mask", "test_mask")


@register("csv_features", f"WITH {fx.V}, {fx.X} SELECT id, pos, printf('%.4e', val)::DOUBLE + 0.0 AS val FROM x")
def csv_features(spark, d):
    folder = _written(spark, d, "csv", lambda g, to: writers.save_csv(g, _meta(spark, d), to))
    return rounded(spread(readers.read_features(spark, f"{folder}/features.csv", labelled=True), "feat"), 12)


@register("csv_sparse_features", f"WITH {fx.V}, {fx.X} SELECT id, pos, printf('%.4e', val)::DOUBLE + 0.0 AS val FROM x WHERE printf('%.4e', val)::DOUBLE <> 0")
def csv_sparse_features(spark, d):
    folder = _written(spark, d, "csv", lambda g, to: writers.save_csv(g, _meta(spark, d), to))
    rows = readers.read_sparse_features(spark, f"{folder}/features.csv", labelled=True)
    pairs = rows.select("id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return rounded(pairs.select("id", F.col("e.indices").alias("pos"), F.col("e.values").alias("val")), 12)


@register("csv_features_partitioned", f"WITH {fx.V} SELECT id, 1 AS places FROM v")
def csv_features_partitioned(spark, d):
    """Rows read into a number of partitions by id: none is in two of them."""
    folder = _written(spark, d, "csv", lambda g, to: writers.save_csv(g, _meta(spark, d), to))
    rows = readers.read_features(spark, f"{folder}/features.csv", labelled=True, partitions=5).withColumn("place", F.spark_partition_id())
    return rows.groupBy("id").agg(F.countDistinct("place").cast("int").alias("places"))


@register("csv_graph", f"{fx.weighted('right')} SELECT src, dst, round(weight, 10) AS weight FROM w")
def csv_graph(spark, d):
    folder = shared_folder(spark, "csv")
    v = fx.vertices(spark, d)
    writers.save_csv(fx.graph(spark, d).with_vertices(v).with_edges(fx.edges(spark, d)), _meta(spark, d), folder)
    loaded = readers.load_graph(spark, folder, "csv", labelled=True, loops=True, norm="right")
    return loaded.edges.select("src", "dst", F.round("weight", 10).alias("weight"))


@register("csv_meta", f"WITH {fx.V}, s AS (SELECT id, {_SPLIT_SQL} AS s FROM v) SELECT id, 0 AS label, s::INT AS all_mask, (s = 0)::INT AS train_mask, (s = 1)::INT AS valid_mask, (s = 2)::INT AS test_mask FROM s")
def csv_meta(spark, d):
    folder = _written(spark, d, "csv", lambda g, to: writers.save_csv(g, _meta(spark, d), to))
    return readers.read_meta(spark, f"{folder}/meta.csv")


@register("plain_graph", f"WITH {fx.V}, {fx.E0}, {fx.E} SELECT src, dst FROM e")
def plain_graph(spark, d):
    folder = _written(spark, d, "plain", lambda g, to: writers.save_plain(g, f"{to}/edges", f"{to}/vertices"))
    return readers.read_plain_graph(spark, f"{folder}/edges", f"{folder}/vertices").edges


@register("partitioned_graph", f"{fx.weighted()} SELECT dst AS src, src AS dst, round(weight, 10) AS weight FROM w")
def partitioned_graph(spark, d):
    folder = _written(spark, d, "parts", lambda g, to: writers.save_partitioned(g, to, 8))
    return readers.load_partitioned(spark, folder)[1].select("src", "dst", F.round("weight", 10).alias("weight"))


def _bucketed(spark, d):
    name = "quern_" + uuid.uuid4().hex
    writers.save_bucketed(fx.graph(spark, d), name, 8)
    return readers.load_bucketed(spark, name)


@register("bucketed_graph", f"{fx.weighted()} {sql_sum()}")
def bucketed_graph(spark, d):
    """The sum over a bucketed store, whose join needs no shuffle."""
    g, _ = _bucketed(spark, d)
    return rounded(spread(weighted_sum(g.edges, g.vertices, of_hubs=False)))


@register("bucketed_reverse", f"{fx.weighted()} SELECT dst AS src, src AS dst, round(weight, 10) AS weight FROM w")
def bucketed_reverse(spark, d):
    return _bucketed(spark, d)[1].select("src", "dst", F.round("weight", 10).alias("weight"))


@register("graph_sample", f"WITH {fx.V}, {fx.E0}, {fx.E} SELECT 'vertex' AS kind, id AS a, id AS b FROM (SELECT id FROM v ORDER BY id LIMIT 3) UNION ALL SELECT 'edge', src, dst FROM (SELECT src, dst FROM e ORDER BY src, dst LIMIT 3)")
def graph_sample(spark, d):
    v, e = fx.graph(spark, d).sample(3)
    return v.select(F.lit("vertex").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@register("metrics_log", "SELECT e::INT AS epoch, 'm' || (e % 2) AS model, 'accuracy' AS name, e / 8.0::DOUBLE AS value FROM range(6) t(e)")
def metrics_log(spark, d):
    folder = shared_folder(spark, "metrics")
    for low in (0, 3):
        writers.append_metrics(spark, [(e, f"m{e % 2}", "accuracy", e / 8.0) for e in range(low, low + 3)], folder)
    return spark.read.parquet(folder)


@register("dataset_registry", "SELECT * FROM (VALUES (0, 'log-normal', 100, 2, false), (1, 'products', 100, 47, false), (2, 'arxiv', 128, 40, false), (3, 'papers100M', 128, 172, false), (4, 'yelp', 300, 100, true), (5, 'reddit', 602, 41, false), (6, 'amazon', 300, 22, false)) t(id, name, n_features, n_classes, multilabel)")
def dataset_registry(spark, d):
    rows = [(i, s.name, s.n_features, s.n_classes, s.multilabel) for i, s in readers.DATASETS.items()]
    return spark.createDataFrame(rows, "id int, name string, n_features int, n_classes int, multilabel boolean")


@register("typed_edge_lines", f"WITH {fx.E0} SELECT src AS src_id, dst AS dst_id, 0.0::DOUBLE AS weight FROM e0")
def typed_edge_lines(spark, d):
    return writers.edge_lines(fx.edges(spark, d))


@register("typed_split_lines", "SELECT vec_id AS id, 1.0::DOUBLE AS weight FROM embeddings WHERE vec_id % 10 = 8")
def typed_split_lines(spark, d):
    return writers.split_lines(structure.split_masks(fx.vertices(spark, d), fx.split_number()), "valid")


@register("typed_node_lines", f"WITH {fx.V}, {fx.X} SELECT x.id, v.label::BIGINT AS label, x.pos, round(x.val, 12) + 0.0 AS val FROM x JOIN v USING (id)")
def typed_node_lines(spark, d):
    rows = writers.node_lines(fx.vertices(spark, d)).select("id", "label", F.posexplode(F.split("feature", ":")).alias("pos", "x"))
    return rows.select("id", "label", "pos", (F.round(F.col("x").cast("double"), 12) + 0.0).alias("val"))


# Generators ------------------------------------------------------------------------------------


@register("grid_graph", "WITH g AS (SELECT r, c, r * 7 + c AS id FROM range(5) a(r), range(7) b(c)) SELECT id AS src, id + 7 AS dst, 1.0::DOUBLE AS weight FROM g WHERE r < 4 UNION ALL SELECT id, id + 1, 1.0::DOUBLE FROM g WHERE c < 6")
def grid_graph(spark, d):
    return generate.grid_graph(spark, 5, 7).edges


@register("star_graph", "SELECT i AS src, 0::BIGINT AS dst, 1.0::DOUBLE AS weight FROM range(1, 50) t(i)")
def star_graph(spark, d):
    return generate.star_graph(spark, 50).edges


def _lognormal_sql(n: int, mu: float, sigma: float, seed: int) -> str:
    """CTE g (src, dst)."""
    draw = f"floor(exp({mu}::DOUBLE + {sigma}::DOUBLE * {gaussian_sql(seed, 'i', 'k')}))"
    drawn = f"list_filter(list_transform(range(0, {generate.tries_needed(mu, sigma, n)}), lambda k: {draw}), lambda t: t < {n})[1]"
    return f"d AS (SELECT i, coalesce({drawn}, 0)::BIGINT AS deg FROM range({n}) t(i)), k AS (SELECT i, unnest(range(1, deg + 1)) AS j FROM d), g AS (SELECT i AS src, floor({uniform_sql(seed + 1, 'i', 'j')} * {n})::BIGINT AS dst FROM k)"


@register("lognormal_graph", f"WITH {_lognormal_sql(500, 2.0, 1.0, 1)} SELECT src, dst FROM g")
def lognormal_graph(spark, d):
    return generate.lognormal_graph(spark, 500, 2.0, 1.0)


def _rmat_sql(n_edges: int, levels: int, seed: int, drawn: int) -> str:
    a, b, c, _ = generate.RMAT
    u = uniform_sql(seed, "id", "l")
    quadrants = f"list_transform(range(1, {levels + 1}), lambda l: CASE WHEN {u} < {a} THEN 0 WHEN {u} < {a + b} THEN 1 WHEN {u} < {a + b + c} THEN 2 ELSE 3 END)"
    fold = lambda take: f"list_sum(list_transform(q, lambda x, i: ({take})::BIGINT * (1 << ({levels} - i))))::BIGINT"
    return f"WITH d AS (SELECT id, {quadrants} AS q FROM range({drawn}) t(id)), p AS (SELECT {fold('x // 2')} AS src, {fold('x % 2')} AS dst, min(id) AS id FROM d GROUP BY 1, 2) SELECT src, dst FROM p ORDER BY id LIMIT {n_edges}"


@register("rmat_graph", _rmat_sql(1000, 8, 1, 2000))
def rmat_graph(spark, d):
    return generate.rmat_graph(spark, 256, 1000)


@register("random_graph", f"WITH {_lognormal_sql(200, 1.5, 0.8, 1)}, e AS (SELECT src, dst FROM g UNION ALL SELECT i, i FROM range(200) t(i)) SELECT dst AS id, p.pos::INT AS pos, 1.0::DOUBLE AS val FROM (SELECT DISTINCT dst FROM e), range(8) p(pos)")
def random_graph(spark, d):
    """Features of ones under right weights: every sum is one."""
    g = generate.random_graph(spark, 200, width=8, mu=1.5, sigma=0.8, norm="right")
    return rounded(spread(weighted_sum(g.edges, g.vertices)))


@register("random_features", f"SELECT id, floor({uniform_sql(2, 'id')} * 4)::INT AS label, CASE WHEN id < 20 THEN 2 ELSE 0 END::INT AS split, pos::INT AS pos, round({gaussian_sql(1, 'id', 'pos')}, 8) + 0.0 AS val FROM range(400) t(id), range(8) p(pos)")
def random_features(spark, d):
    g = readers.with_random_features(generate.grid_graph(spark, 20, 20), 8, 4)
    rows = g.vertices.select("id", "label", "split", F.posexplode("feat").alias("pos", "x"))
    return rows.select("id", "label", "split", "pos", (F.round("x", 8) + 0.0).alias("val"))


# Layers and metrics ----------------------------------------------------------------------------


def _linear(src: str, name: str, fan_in: int, fan_out: int, step: int, act: bool, leaky: float = 0.01) -> str:
    w = f"((i.k * 31 + j.k * 17 + {step * 7}) % 13 - 6) / 13.0::DOUBLE / sqrt({fan_in}::DOUBLE)"
    total = f"sum({src}.val * ww.w)"
    out = f"CASE WHEN {total} > 0 THEN {total} ELSE {leaky} * {total} END" if act else total
    return (f"w{name} AS (SELECT i.k AS i, j.k AS j, {w} AS w FROM range({fan_in}) i(k), range({fan_out}) j(k)), "
            f"{name} AS (SELECT {src}.id, ww.j AS pos, {out} AS val FROM {src} JOIN w{name} ww ON ww.i = {src}.pos GROUP BY 1, 2)")


def _gamma(src: str, name: str) -> str:
    return f"{name} AS (SELECT w.dst AS id, {src}.pos, sum(w.weight * {src}.val) AS val FROM w JOIN {src} ON {src}.id = w.src GROUP BY 1, 2)"


_OUT = "SELECT id, pos::INT AS pos, round(val, 6) + 0.0 AS val FROM "
_GCN = neural.ModelSpec((64, 16, 10))
_GCN_SQL = f"{fx.weighted()}, {_gamma('x', 'g0')}, {_linear('g0', 'h0', 64, 16, 0, True)}, {_gamma('h0', 'g1')}, {_linear('g1', 'h1', 16, 10, 1, False)}"


def _forward(spark, d, specs):
    g = fx.graph(spark, d)
    return train.forward(g, specs, [neural.formula_weights(s) for s in specs])


@register("gcn_forward", f"{_GCN_SQL} {_OUT} h1")
def gcn_forward(spark, d):
    return rounded(spread(_forward(spark, d, [_GCN]), "logits"))


_GIN = neural.ModelSpec((64, 16, 10), "gin", mlp_hidden=12)
_GIN_SQL = f"{fx.weighted()}, {_gamma('x', 'g0')}, {_linear('g0', 'a0', 64, 12, 0, True)}, {_linear('a0', 'h0', 12, 16, 1, True)}, {_gamma('h0', 'g1')}, {_linear('g1', 'a1', 16, 12, 2, True)}, {_linear('a1', 'h1', 12, 10, 3, False)}"


@register("gin_forward", f"{_GIN_SQL} {_OUT} h1")
def gin_forward(spark, d):
    return rounded(spread(_forward(spark, d, [_GIN]), "logits"))


def _batched(name: str, kind: str, sql: str):
    """Two models of different widths side by side, the second with the activation's slope at 0.5."""

    @register(name, f"{sql} SELECT id, pos::INT AS pos, round(val, 6) + 0.0 AS val FROM h1 UNION ALL SELECT id, (pos + 10)::INT, round(val, 6) + 0.0 FROM k1")
    def run(spark, d):
        specs = [neural.ModelSpec((64, 16, 10), kind, mlp_hidden=12), neural.ModelSpec((64, 12, 7), kind, mlp_hidden=9, leaky=0.5)]
        return rounded(spread(_forward(spark, d, specs), "logits"))


_batched("gcn_batched_forward", "gcn", f"{_GCN_SQL}, {_linear('g0', 'k0', 64, 12, 0, True, 0.5)}, {_gamma('k0', 'm1')}, {_linear('m1', 'k1', 12, 7, 1, False)}")
_batched("gin_batched_forward", "gin", f"{_GIN_SQL}, {_linear('g0', 'b0', 64, 9, 0, True, 0.5)}, {_linear('b0', 'k0', 9, 12, 1, True, 0.5)}, {_gamma('k0', 'm1')}, {_linear('m1', 'b1', 12, 9, 2, True, 0.5)}, {_linear('b1', 'k1', 9, 7, 3, False)}")


@register("apply_vertices", f"WITH {fx.V}, {fx.X} SELECT id, pos, 2 * val + 1 AS val FROM x")
def user_layer(spark, d):
    """A layer that isn't built in, as a function on Arrow batches."""

    def double(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        column = batch.column("feat")
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(column.offsets, pc.add(pc.multiply(column.values, 2.0), 1.0))], ["id", "vec"])

    return spread(neural.apply_vertices(fx.vertices(spark, d).select("id", "feat"), double, "id long, vec array<double>"))


_GRADS_SQL = (
    f"{_GCN_SQL}, p AS (SELECT h1.id, h1.pos, h1.val, v.label, sum(exp(h1.val)) OVER (PARTITION BY h1.id) AS total FROM h1 JOIN v USING (id)), "
    "t AS (SELECT count(*) AS n FROM v WHERE id % 10 < 8), "
    "dz AS (SELECT id, pos, (exp(val) / total - (pos = label)::INT) / t.n AS val FROM p, t WHERE id % 10 < 8), "
    "back AS (SELECT dz.id, ww.i AS pos, sum(dz.val * ww.w) AS val FROM dz JOIN wh1 ww ON ww.j = dz.pos GROUP BY 1, 2), "
    "dh AS (SELECT w.src AS id, back.pos, sum(w.weight * back.val) AS val FROM w JOIN back ON back.id = w.dst GROUP BY 1, 2), "
    "ds AS (SELECT dh.id, dh.pos, dh.val * CASE WHEN h0.val > 0 THEN 1 ELSE 0.01 END AS val FROM dh JOIN h0 ON h0.id = dh.id AND h0.pos = dh.pos) "
    "SELECT 1 AS layer, g1.pos::INT AS i, dz.pos::INT AS j, round(sum(g1.val * dz.val), 8) + 0.0 AS val FROM g1 JOIN dz USING (id) GROUP BY 1, 2, 3 "
    "UNION ALL SELECT 0, g0.pos::INT, ds.pos::INT, round(sum(g0.val * ds.val), 8) + 0.0 FROM g0 JOIN ds USING (id) GROUP BY 1, 2, 3 "
    "UNION ALL SELECT 1, -1, pos::INT, round(sum(val), 8) + 0.0 FROM dz GROUP BY 3 UNION ALL SELECT 0, -1, pos::INT, round(sum(val), 8) + 0.0 FROM ds GROUP BY 3"
)


def _trainer(spark, d, specs, **options):
    g = fx.graph(spark, d)
    targets = g.vertices.select("id", "label").join(structure.split_masks(g.vertices, fx.split_number()), "id")
    return train.Trainer(g, targets, specs, **options)


@register("gcn_gradients", _GRADS_SQL)
def gcn_gradients(spark, d):
    """Gradients of every weight and bias (i = -1) of a two-layer model by its loss, through the whole training path."""
    grads, _ = _trainer(spark, d, [_GCN], weights=[neural.formula_weights(_GCN)]).gradients(0)
    rows = [(layer, i, j, round(float(x), 8) + 0.0) for layer, steps in enumerate(grads[0]) for w, b in steps for i, row in [*enumerate(w), (-1, b)] for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "layer int, i int, j int, val double")


@register("train_first_epoch", f"{_GCN_SQL}, r AS (SELECT h1.id, h1.pos, h1.val, v.label, {_SPLIT_SQL.replace('id', 'h1.id')} AS s, row_number() OVER (PARTITION BY h1.id ORDER BY h1.val DESC, h1.pos) AS rank FROM h1 JOIN v USING (id)), z AS (SELECT id, s, ln(sum(exp(val))) - max(CASE WHEN pos = label THEN val END) AS ce, max(CASE WHEN rank = 1 AND pos = label THEN 1 ELSE 0 END) AS hit FROM r GROUP BY 1, 2) SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END || '_accuracy' AS name, round(avg(hit), 8) AS value FROM z GROUP BY s UNION ALL SELECT 'loss', round(sum(CASE WHEN s = 0 THEN ce END) / count(*) FILTER (WHERE s = 0), 8) FROM z")
def train_first_epoch(spark, d):
    """What the first epoch reports, from weights that SQL can compute."""
    trainer = _trainer(spark, d, [_GCN], weights=[neural.formula_weights(_GCN)])
    trainer.fit(1)
    return train.history_frame(spark, trainer.history).select("name", F.round("value", 8).alias("value"))


def _logits(spark, d):
    """Ten numbers for each vertex: the first entries of its vector, the label's raised for even ids."""
    raised = F.transform(F.slice("feat", 1, 10), lambda x, i: x + F.when((i == F.col("label")) & (F.col("id") % 2 == 0), 1.0).otherwise(0.0))
    masks = structure.split_masks(fx.vertices(spark, d), fx.split_number())
    return fx.vertices(spark, d).select("id", "label", raised.alias("logits")).join(masks, "id")


_LOGITS = f"WITH {fx.V}, {fx.X}, l AS (SELECT x.id, x.pos, v.label, x.val + CASE WHEN x.pos = v.label AND x.id % 2 = 0 THEN 1.0 ELSE 0.0 END AS val FROM x JOIN v USING (id) WHERE x.pos < 10), r AS (SELECT id, label, pos, val, {_SPLIT_SQL} AS s, row_number() OVER (PARTITION BY id ORDER BY val DESC, pos) AS rank FROM l)"


@register("masked_ce_loss", f"{_LOGITS}, z AS (SELECT id, s, ln(sum(exp(val))) - max(CASE WHEN pos = label THEN val END) AS ce FROM r GROUP BY 1, 2) SELECT round(sum(CASE WHEN s = 0 THEN ce END) / count(*) FILTER (WHERE s = 0), 8) AS loss FROM z")
def masked_ce_loss(spark, d):
    return metrics.masked_cross_entropy(_logits(spark, d), mask="train_mask").select(F.round("loss", 8).alias("loss"))


@register("log_softmax", f"{_LOGITS}, z AS (SELECT id, ln(sum(exp(val))) AS n FROM r GROUP BY 1) SELECT r.id, r.pos, round(r.val - z.n, 8) AS val FROM r JOIN z USING (id)")
def log_softmax(spark, d):
    rows = _logits(spark, d).select("id", vectors.log_softmax(F.col("logits")).alias("vec"))
    return rounded(spread(rows), 8)


@register("sigmoid", f"{_LOGITS} SELECT id, pos, round(1 / (1 + exp(-val)), 8) AS val FROM r")
def sigmoid(spark, d):
    return rounded(spread(_logits(spark, d).select("id", vectors.sigmoid(F.col("logits")).alias("vec"))), 8)


def _accuracy(name: str, k: int):
    @register(name, f"{_LOGITS}, h AS (SELECT s, id, max(CASE WHEN rank <= {k} AND pos = label THEN 1 ELSE 0 END) AS hit FROM r GROUP BY 1, 2) SELECT CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, sum(hit)::BIGINT AS n_correct, count(*) AS n, round(sum(hit) / count(*), 9) AS accuracy FROM h GROUP BY s")
    def run(spark, d):
        rows = _logits(spark, d)
        if k == 1:
            found = metrics.split_accuracy(rows)
        else:
            split = F.when(F.col("train_mask") == 1, "train").when(F.col("valid_mask") == 1, "valid").otherwise("test")
            found = metrics.accuracy(rows.withColumn("split", split), ["split"], k)
        return found.select("split", "n_correct", "n", F.round("accuracy", 9).alias("accuracy"))


_accuracy("accuracy", 1)
_accuracy("topk_accuracy", 3)

_PRED = f"{_LOGITS}, p AS (SELECT id, pos AS pred, label AS truth FROM r WHERE rank = 1), c AS (SELECT unnest(range(10))::INT AS cls), cm AS (SELECT cls, count(*) FILTER (WHERE pred = cls AND truth = cls) AS tp, count(*) FILTER (WHERE pred = cls AND truth <> cls) AS fp, count(*) FILTER (WHERE pred <> cls AND truth = cls) AS fn, count(*) FILTER (WHERE pred <> cls AND truth <> cls) AS tn FROM c, p GROUP BY cls HAVING tp + fp + fn > 0)"


def _predicted(spark, d):
    return _logits(spark, d).select("id", vectors.argmax(F.col("logits")).alias("pred"), F.col("label").alias("truth"))


@register("confusion", f"{_PRED} SELECT cls, tp, fp, fn, tn FROM cm")
def confusion(spark, d):
    return metrics.confusion(_predicted(spark, d))


@register("f1_scores", f"{_PRED} SELECT round(sum(tp) / (sum(tp) + 0.5 * (sum(fp) + sum(fn))), 9) AS f1_micro, round(avg(tp / (tp + 0.5 * (fp + fn))), 9) AS f1_macro FROM cm")
def f1_scores(spark, d):
    found = metrics.f1_scores(metrics.confusion(_predicted(spark, d)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


_MULTI = f"WITH {fx.V}, {fx.X}, b AS (SELECT x.id, x.pos AS cls, (x.val > 0)::INT AS p, ((x.id + x.pos) % 3 = 0)::INT AS t FROM x WHERE x.pos < 10), cm AS (SELECT cls, count(*) FILTER (WHERE p = 1 AND t = 1) AS tp, count(*) FILTER (WHERE p = 1 AND t = 0) AS fp, count(*) FILTER (WHERE p = 0 AND t = 1) AS fn, count(*) FILTER (WHERE p = 0 AND t = 0) AS tn FROM b GROUP BY 1)"


def _multilabel(spark, d):
    pred = F.transform(F.slice("feat", 1, 10), lambda x: (x > 0).cast("int"))
    truth = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("id") + i) % 3 == 0).cast("int"))
    return metrics.multilabel_confusion(fx.vertices(spark, d).select(pred.alias("pred"), truth.alias("truth")))


@register("multilabel_confusion", f"{_MULTI} SELECT cls, tp, fp, fn, tn FROM cm")
def multilabel_confusion(spark, d):
    return _multilabel(spark, d)


@register("multilabel_f1", f"{_MULTI} SELECT round(sum(tp) / (sum(tp) + 0.5 * (sum(fp) + sum(fn))), 9) AS f1_micro, round(avg(tp / (tp + 0.5 * (fp + fn))), 9) AS f1_macro FROM cm")
def multilabel_f1(spark, d):
    found = metrics.f1_scores(_multilabel(spark, d))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@register("binary_accuracy", f"WITH {fx.V} SELECT sum((feat[1] > 0.0) = (label % 2 = 1))::BIGINT AS n_correct, count(*) AS n, round(avg(((feat[1] > 0.0) = (label % 2 = 1))::INT), 9) AS accuracy FROM v")
def binary_accuracy(spark, d):
    rows = fx.vertices(spark, d).select(F.col("feat")[0].alias("score"), (F.col("label") % 2).alias("label"))
    return metrics.binary_accuracy(rows, threshold=0.0).select("n_correct", "n", F.round("accuracy", 9).alias("accuracy"))


@register("num_classes", "SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def num_classes(spark, d):
    return metrics.n_classes(fx.vertices(spark, d))


@register("train_count", "SELECT count(*) FILTER (WHERE vec_id % 10 < 8) AS n_train FROM embeddings")
def train_count(spark, d):
    return metrics.train_count(structure.split_masks(fx.vertices(spark, d), fx.split_number()))


@register("graph_counts", f"WITH {fx.V}, {fx.E0}, {fx.E} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges")
def graph_counts(spark, d):
    return fx.graph(spark, d).counts()


@register("hparam_grid", "SELECT (row_number() OVER (ORDER BY o.i, l.i, p.i) - 1)::INT AS model, o.v AS optimizer, l.v AS lr, p.v AS dropout FROM (VALUES (0, 'adamw'), (1, 'adagrad')) o(i, v), (VALUES (0, 0.01::DOUBLE), (1, 0.001::DOUBLE)) l(i, v), (VALUES (0, 0.3::DOUBLE), (1, 0.5::DOUBLE)) p(i, v)")
def hparam_grid(spark, d):
    specs = neural.grid(_GCN, optimizer=["adamw", "adagrad"], lr=[0.01, 0.001], dropout=[0.3, 0.5])
    return spark.createDataFrame([(i, s.optimizer, s.lr, s.dropout) for i, s in enumerate(specs)], "model int, optimizer string, lr double, dropout double")


def _accuracy_by_model_sql() -> str:
    first = "SELECT 0 AS model, id, label, s, pos, val FROM (SELECT DISTINCT id, label, s, pos, val FROM r)"
    second = "SELECT 1 AS model, id, label, s, pos, -val FROM (SELECT DISTINCT id, label, s, pos, val FROM r)"
    ranked = f"b AS (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY val DESC, pos) AS k FROM ({first} UNION ALL {second}))"
    return f"{_LOGITS}, {ranked} SELECT model, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, sum((pos = label)::INT)::BIGINT AS n_correct, count(*) AS n, round(avg((pos = label)::INT), 9) AS accuracy FROM b WHERE k = 1 GROUP BY 1, 2"


@register("accuracy_by_model", _accuracy_by_model_sql())
def accuracy_by_model(spark, d):
    """Two models, the second with the first's logits negated, over each split."""
    rows = _logits(spark, d)
    both = rows.withColumn("model", F.lit(0)).unionByName(rows.withColumn("logits", F.transform("logits", lambda x: -x)).withColumn("model", F.lit(1)))
    return metrics.split_accuracy(both, ["model"]).select("model", "split", "n_correct", "n", F.round("accuracy", 9).alias("accuracy"))


@register("train_count_by_partition", "SELECT (((vec_id % 1000003) * 7919) % 4)::INT AS place, count(*) FILTER (WHERE vec_id % 10 < 8) AS n_train FROM embeddings GROUP BY 1")
def train_count_by_partition(spark, d):
    masks = structure.split_masks(fx.vertices(spark, d), fx.split_number())
    return metrics.train_count(masks.withColumn("place", structure.partition_id("1d", 4, src=F.col("id"), dst=F.col("id")).cast("int")), ["place"])


@register("train_gcn")
def train_gcn(spark, d):
    return train.history_frame(spark, _trainer(spark, d, [_GCN]).fit(2))


@register("train_batched")
def train_batched(spark, d):
    specs = neural.grid(neural.ModelSpec((64, 8, 10), normalise=True), optimizer=["adamw", "adagrad"], dropout=[0.0, 0.3])
    return train.history_frame(spark, _trainer(spark, d, specs).fit(1))
