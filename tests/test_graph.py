"""Toy graphs with answers by hand, and laws that hold on random ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import codecs, vectors
from quern.graph import PropertyGraph, reverse_edges
from quern.operators import generate, metrics, neural, structure, train
from quern.operators import propagate as pr
from quern.operators.optimizers import optimizer
from quern.session import Scope, Timers, shared_folder
from quern.sources import readers, writers


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def feats_of(spark, rows):
    return spark.createDataFrame(rows, "id long, feat array<double>")


def as_dict(rows, column="vec"):
    return {r["id"]: [round(x, 9) + 0.0 for x in r[column]] for r in rows.collect()}


@pytest.fixture(scope="module")
def toy(spark):
    return feats_of(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]), edges_of(spark, [(0, 1, 0.5), (2, 1, 1.0), (1, 0, 2.0)])


@pytest.mark.parametrize("plan", pr.PLANS)
def test_triangle(toy, plan):
    v, e = toy
    out = pr.weighted_sum(e, v, plan=plan, width=2)
    assert as_dict(pr.assemble(out) if plan == "long" else out) == {0: [6.0, 8.0], 1: [5.5, 7.0]}


def test_null_vectors_send_nothing(spark, toy):
    v, e = toy
    with_null = v.union(feats_of(spark, [(7, None)]))
    assert as_dict(pr.weighted_sum(e.union(edges_of(spark, [(7, 1, 1.0), (9, 0, 1.0)])), with_null)) == {0: [6.0, 8.0], 1: [5.5, 7.0]}


def test_gather_sums_to_the_same(toy):
    v, e = toy
    assert as_dict(pr.sum_gathered(pr.gather(e, v))) == as_dict(pr.sum_gathered(pr.gather_blocks(e, v, size=1))) == as_dict(pr.weighted_sum(e, v))


@pytest.mark.parametrize("weighted", [True, False])
def test_gather_in_parts_equals_gather(spark, weighted):
    """Repeated edges and vertices, null ends, weights, vectors and entries, sources without a vector; lists longer than a batch."""
    rows = [(i, [i / 3, -1.0 * i]) for i in range(200)] + [(3, [0.1, 0.2, 0.3]), (4, []), (5, [None, 1.0]), (7, None), (None, [9.0])]
    v = feats_of(spark, rows).union(feats_of(spark, [(1000 + i, [0.5 * i]) for i in range(20)]))
    ends = [(i * 7 % 230, i * i % 40, 0.1 * (i % 5) - 0.2) for i in range(1500)] + [(1, None, 1.0), (2, None, 2.0), (None, 1, 1.0), (5, 3, None), (1003, 3, 2.0), (9999, 77, 1.0)]
    e = edges_of(spark, ends).repartition(5)
    want = sorted(((r["id"], r["nbrs"]) for r in pr.gather(e, v, weighted=weighted).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        for parts in (1, 3, 50):
            assert sorted(((r["id"], r["nbrs"]) for r in pr.gather(e, v, weighted=weighted, parts=parts).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pr.gather(e.limit(0), v, parts=3).collect() == [] == pr.gather(e, v.limit(0), parts=3).collect()


def test_gathered_messages_arent_shuffled(spark):
    """Neither a join of edges with vectors nor lists that are collected through a shuffle."""
    from quern.plans import catalogue

    assert "Join" not in pr.gather(edges_of(spark, [(1, 2, 1.0)]), feats_of(spark, [(1, [1.0])]), parts=4)._jdf.queryExecution().executedPlan().toString()
    for name in ("gather_neighbors", "sum_listed"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "collect_list" not in plan


def test_distinct_edges_are_made_once(spark):
    """The degrees at both ends and the messages read one exchange; ends that are null count as vertices of degree one."""
    from quern.plans import catalogue

    found = catalogue.queries()["sum_listed"](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1 and plan.count("ReusedExchange") == 2
    e = edges_of(spark, [(None, 1, 0.0), (None, 2, 0.0), (1, None, 0.0), (0, 1, 0.0)])
    got = {(r["src"], r["dst"]): round(r["weight"], 9) for r in structure.normalise(e).collect()}
    assert got == {(None, 1): round(0.5**0.5, 9), (None, 2): 1.0, (1, None): 1.0, (0, 1): round(0.5**0.5, 9)}


def test_no_null_lists_are_sent_to_gather(spark):
    """Spark goes through the null lists at a batch's end after each row."""
    plan = pr.gather(edges_of(spark, [(1, 2, 1.0)]), feats_of(spark, [(1, [1.0])]), parts=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS short" in plan and "null AS short" not in plan and "null AS vec" not in plan


@pytest.mark.parametrize("plan", pr.PLANS)
def test_hubs_are_dealt_out(spark, monkeypatch, plan):
    monkeypatch.setattr(pr, "COPIES", 4)
    v = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("feat"))
    e = spark.createDataFrame([(0, i, 1.0) for i in range(60)] + [(i, i + 1, 2.0) for i in range(59)], "src long, dst long, weight double")
    assert [r["id"] for r in pr.hubs(e, "src", 10).collect()] == [0] and pr.hubs(e, "src", 10, 0).count() == 0
    flat = lambda x: as_dict(pr.assemble(x) if plan == "long" else x)
    want = flat(pr.weighted_sum(e, v, plan=plan, width=2, of_hubs=False))
    assert flat(pr.weighted_sum(e, v, plan=plan, width=2, of_hubs=pr.hubs(e, "src", 10))) == want == flat(pr.weighted_sum(e, v, plan=plan, width=2))
    back = pr.backward_forward(e, v, "feat", plan, 2, pr.hubs(e, "dst", 2))
    assert flat(back) == flat(pr.backward_reverse(e, v, "feat", plan, 2, False))


def test_a_bucketed_store_joins_without_a_shuffle(spark):
    v = spark.range(500).select("id", F.array(F.col("id").cast("double")).alias("feat"))
    e = spark.range(3000).select((F.col("id") % 500).alias("src"), (F.col("id") * 7 % 500).alias("dst"), F.lit(1.0).alias("weight"))
    writers.save_bucketed(PropertyGraph(v, e), "stored", 4)
    graph, rev = readers.load_bucketed(spark, "stored")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = pr.join_sent(graph.edges, graph.vertices, "src", "dst", of_hubs=False)
        assert joined.count() == 3000 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in pr.join_sent(e, v, "src", "dst", of_hubs=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert as_dict(pr.weighted_sum(graph.edges, graph.vertices, of_hubs=False)) == as_dict(pr.weighted_sum(e, v))
    assert sorted(map(tuple, rev.collect())) == sorted(map(tuple, reverse_edges(e).collect()))


def test_messages_that_arent_summed(toy):
    v, e = toy
    assert as_dict(pr.reduce_messages(e, v, reduction="max")) == {0: [6.0, 8.0], 1: [5.0, 6.0]}
    assert as_dict(pr.reduce_messages(e, v, reduction="min")) == {0: [6.0, 8.0], 1: [0.5, 1.0]}
    with pytest.raises(ValueError):
        pr.reduce_messages(e, v, reduction="median")


def test_a_layer_by_three_functions(spark, toy):
    v, e = toy
    layer = pr.LayerProtocol(F.struct((F.col("weight") * F.col("src_feat")[0]).alias("x")), [F.sum("msg.x").alias("total")], lambda rows: rows.select("id", F.coalesce("total", F.lit(-1.0)).alias("x")))
    assert {r["id"]: r["x"] for r in layer.run(e, v).collect()} == {0: 6.0, 1: 5.5, 2: -1.0}


def test_sparse_sum_equals_dense(spark):
    v = feats_of(spark, [(0, [0.0, 2.0]), (1, [0.0, 0.0]), (2, [5.0, 6.0])])
    e = edges_of(spark, [(0, 1, 0.5), (2, 1, 1.0), (1, 0, 2.0)])
    sparse = v.select("id", vectors.to_sparse(F.col("feat")).alias("s")).select("id", "s.*")
    assert as_dict(pr.assemble(pr.sparse_sum(e, sparse), width=2)) == {1: [5.0, 7.0]}


def test_backward_both_ways_and_adjoint(spark, toy):
    v, e = toy
    g = v.select("id", F.transform("feat", lambda x: x * 2 - 3).alias("grad"))
    a, b = pr.backward_reverse(e, g), pr.backward_forward(e, g)
    assert as_dict(a) == as_dict(b)
    forward, back = as_dict(pr.weighted_sum(e, v)), as_dict(a)
    sparse = pr.as_sparse(g, "grad")
    for orientation in ("reverse", "forward"):
        assert as_dict(pr.assemble(pr.backward_sparse(e, sparse, orientation), width=2)) == back
    x, y = as_dict(v, "feat"), as_dict(g, "grad")
    assert sum(np.dot(forward[i], y[i]) for i in forward) == pytest.approx(sum(np.dot(x[i], back[i]) for i in back))


def test_edge_gradients_keep_multi_edges(spark):
    e = edges_of(spark, [(0, 1, 1.0), (0, 1, 1.0)])
    grads = spark.createDataFrame([(1, 0, [1.0, 2.0])], "v long, u long, vec array<double>")
    assert as_dict(pr.backward_edge_grads(e, grads)) == {0: [2.0, 4.0]} and as_dict(pr.backward_edge_grads(e, grads, to="v")) == {1: [2.0, 4.0]}
    assert [tuple(r) for r in pr.gather_edge_grads(e, grads, "v").collect()] == [(1, 0, [1.0, 2.0])] * 2


def test_star_degrees_and_clamp(spark):
    g = generate.star_graph(spark, 5)
    assert {r["id"]: (r["in_deg"], r["out_deg"]) for r in structure.degrees(g.vertices, g.edges).collect()} == {0: (4, 1), **{i: (1, 1) for i in range(1, 5)}}


def test_four_cycle_weights_and_conventions(spark):
    e = spark.createDataFrame([(i, (i + 1) % 4) for i in range(4)], "src long, dst long")
    v = spark.range(4)
    looped = structure.add_self_loops(structure.undirected(e), v)
    for convention in ("forward", "reverse"):
        assert {round(r["weight"], 9) for r in structure.normalise(looped, "symmetric", convention).collect()} == {round(1 / 3, 9)}


def test_right_norm_rows_sum_to_one(spark):
    e = generate.lognormal_graph(spark, 60, 1.0, 0.7)
    sums = structure.normalise(e, "right").groupBy("dst").agg(F.sum("weight").alias("s")).collect()
    assert sums and all(r["s"] == pytest.approx(1) for r in sums)


def test_grid(spark):
    g = generate.grid_graph(spark, 2, 3)
    assert g.vertices.count() == 6 and sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [(0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (4, 5)]


def test_enough_draws_for_a_bound(spark):
    assert generate.tries_needed(4.0, 1.3, 1 << 40) == 1 and generate.tries_needed(4.0, 1.3, 2) > 4000
    degrees = structure.out_degrees(generate.lognormal_graph(spark, 3, 4.0, 1.3)).collect()
    assert {r["out_deg"] for r in degrees} <= {1, 2}


def test_lowest_of_many(spark):
    rows = spark.range(0, 9000, 7)
    for n in (1, 2, 100, 1200, rows.count()):
        assert generate._lowest(rows, n, 9000, fan=5).count() == n
        assert generate._lowest(rows, n, 9000).agg(F.max("id")).first()[0] == 7 * (n - 1)


def test_a_seeded_split_doesnt_depend_on_partitions(spark):
    split = lambda rows: {r["id"]: r["s"] for r in rows.select("id", structure.seeded_split(0.7, 5).alias("s")).collect()}
    found = split(spark.range(3000).repartition(7))
    assert found == split(spark.range(3000)) and 0.66 < sum(s == 0 for s in found.values()) / 3000 < 0.74


def test_random_generators(spark):
    e = generate.rmat_graph(spark, 64, 200)
    assert e.count() == 200 == e.distinct().count() and e.agg(F.max(F.greatest("src", "dst"))).first()[0] < 64
    a, b = generate.lognormal_graph(spark, 80, 2.0, 1.0), generate.lognormal_graph(spark, 80, 2.0, 1.0).repartition(3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert structure.out_degrees(a).agg(F.max("out_deg")).first()[0] < 80


def test_khop(spark):
    e = edges_of(spark, [(3, 2, 1.0), (2, 1, 1.0), (1, 0, 1.0), (5, 0, 1.0)])
    found = {r["id"]: r["hop"] for r in structure.khop_in(e, spark.createDataFrame([(0,)], "id long"), 2).collect()}
    assert found == {0: 0, 1: 1, 5: 1, 2: 2}
    chain = edges_of(spark, [(i + 1, i, 1.0) for i in range(9)])
    assert {r["id"]: r["hop"] for r in structure.khop_in(chain, spark.range(1), 7).collect()} == {i: i for i in range(8)}


def test_masks_of_unsplit_vertices(spark):
    v = spark.range(3).withColumn("s", F.when(F.col("id") < 2, F.col("id").cast("int")))
    rows = {r["id"]: (r["all_mask"], r["train_mask"], r["valid_mask"], r["labeled"]) for r in structure.split_masks(v, F.col("s")).collect()}
    assert rows == {0: (0, 1, 0, 1.0), 1: (1, 0, 1, 1.0), 2: (-1, 0, 0, 0.0)}


def test_update_keeps_the_unmatched(spark):
    v = spark.createDataFrame([(0, 1), (1, 2)], "id long, x int")
    out = pr.update_vertices(v, spark.createDataFrame([(1, 9), (5, 5)], "id long, x int"), "x")
    assert sorted(map(tuple, out.select("id", "x").collect())) == [(0, 1), (1, 9)]


def test_attach_features_raises_when_strict(spark):
    out = pr.attach_features(spark.range(2), feats_of(spark, [(0, [1.0])]), strict=True)
    with pytest.raises(Exception, match="no features for vertex 1"):
        out.collect()


@pytest.mark.parametrize("v", [[0.0, 0.0], [0.0, 2.5, 0.0], [1.0, -2.0], []])
def test_codecs(spark, v):
    ids = [(1 << 60) + 1]
    rows = spark.createDataFrame([(ids[0], v)], "id long, vec array<double>")
    back = rows.select(codecs.decode_sparse(codecs.encode_sparse(F.col("id"), F.size("vec"), vectors.to_sparse(F.col("vec"))["indices"], vectors.to_sparse(F.col("vec"))["values"])).alias("s"))
    assert back.select("s.id", codecs.sparse_to_vector(F.col("s")).alias("v")).first()[:] == (ids[0], v)
    assert tuple(rows.select(codecs.decode_json_vector(codecs.encode_json_vector(F.col("id"), F.col("vec"))).alias("s")).select("s.*").first()) == (ids[0], v)
    if v:
        assert tuple(rows.select(codecs.decode_dense(codecs.encode_dense(F.col("id"), F.col("vec"))).alias("s")).select("s.*").first()) == (ids[0], v)


def test_six_places_as_sql_writes_them(spark, tmp_path):
    """Exact ties go to even, ties of the decimal digits alone by the number itself."""
    from quern.plans import catalogue

    ties = [k / 2**n for n in (7, 8, 9) for k in range(1, 400)]
    products = [x for t in ties for x in (t / 1.1, float(np.nextafter(t / 1.1, 1)), -t / 1.1)]
    rows = [(1, products), (2, [0.0, -0.0, 1e-320, 2.5e-7, 0.00012345675, 1e300]), (3, [float("nan"), float("inf"), -float("inf")]), (4, []), (5, [1.5, None]), (6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["line"] for r in catalogue.queries()["codec_dense_lines"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == {line for (line,) in db.execute(catalogue.oracle_sql()["codec_dense_lines"]).fetchall()}
    line = codecs.encode_dense(F.lit(4), F.array(F.lit(0.12890625), F.lit(0.5)), exact=False)
    assert spark.range(1).select(line.alias("s")).first()["s"] == "4,1.289062e-01,5.000000e-01"


def test_gather_codec_without_neighbours(spark):
    rows = spark.createDataFrame([(4, [])], "id long, nbrs array<struct<u:long,vec:array<double>>>")
    assert rows.select(codecs.decode_gather(codecs.encode_gather(F.col("id"), F.col("nbrs"))).alias("s")).first()["s"].asDict()["nbrs"] == []


def test_pairs_to_map_keeps_the_last(spark):
    rows = spark.createDataFrame([([(1, 2.0), (1, 3.0)],)], "p array<struct<u:long,x:double>>")
    assert rows.select(vectors.pairs_to_map(F.col("p"), "u", "x").alias("m")).first()["m"] == {1: 3.0}
    rows = spark.createDataFrame([([(i % 4000, float(i)) for i in range(9000)],), ([],)], "p array<struct<u:long,x:double>>")
    many, none = (r["m"] for r in rows.select(vectors.pairs_to_map(F.col("p"), "u", "x").alias("m")).collect())
    assert none == {} and len(many) == 4000 and many[0] == 8000.0 and many[3999] == 7999.0


def test_sum_of_a_list_of_vectors(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "n array<array<double>>")
    assert [r["s"] for r in rows.select(pr.sum_listed(F.col("n")).alias("s")).collect()] == [[4.0, 6.0], []]


def test_sums_of_odd_lists(spark):
    """Lists of one width are summed in Python, others by Spark: null where a vector is short or an entry null, null for null vectors."""
    lists = [[[1.0, None], [2.0, 3.0]], [[1.0], [2.0, 3.0]], [None, [1.0]], [[1.0], None], [[], []], None, [[-0.0]], [[0.1, 1.0]] * 3]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, n array<array<double>>").coalesce(1)
    got = [r["s"] for r in rows.select("i", pr.sum_listed(F.col("n")).alias("s")).orderBy("i").collect()]
    assert got == [[3.0, None], [3.0, None], None, None, [], [], [0.0], [0.1 + 0.1 + 0.1, 3.0]] and str(got[6]) == "[0.0]"


def test_json_gather_codec(spark, monkeypatch):
    """What is written is read back whole, in one piece or several; plain lines in columns, others by Spark's JSON reader."""
    nan, inf, most = float("nan"), float("inf"), (1 << 63) - 1
    nbrs = [[(2, [0.1, -0.0, 1e-320, 1e300]), (3, [])], [], None, [(4, [])], [(i, [i / 7, i * 1e9, 1e16 + i]) for i in range(500)], [(None, [1.0]), (5, None), None, (6, [2.0])]]
    others = [[(7, [None, nan, inf, -inf])], [(most, [1.0])]]
    rows = spark.createDataFrame(list(enumerate(nbrs + others)), "id long, nbrs array<struct<u:long,vec:array<double>>>").coalesce(1)
    lines = rows.select("id", codecs.encode_json_gather(F.col("id"), F.col("nbrs")).alias("line"))
    found = lines.select("*", codecs.decode_json_gather(F.col("line")).alias("r"), codecs._plain_gather(F.col("line"))["left"].alias("left")).orderBy("id").collect()
    want = [*nbrs[:2], None, *nbrs[3:5], [(6, [2.0])], *others]
    assert str([None if r["r"]["nbrs"] is None else [tuple(n) for n in r["r"]["nbrs"]] for r in found]) == str(want)
    assert [r["id"] for r in found if r["left"]] == [6, 7] and found[2]["line"] is None
    assert found[0]["line"].startswith("[0,[[2,[0.1,-0.0,") and found[6]["line"] == '[6,[[7,[null,"NaN","Infinity","-Infinity"]]]]'
    texts = [" [1, [[2, [1.5, 2]]]] ", "[1,[[2,[1.5,2]]]]", "[1,[[2,[-0,01]]]]", "[1,[[2,null]]]", "[1,[[2,[1E5,-0]]]]", "x"]
    read = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "line string").select(codecs.decode_json_gather(F.col("line")).alias("r")).collect()]
    assert str([(r["id"], r["nbrs"] and [tuple(n) for n in r["nbrs"]]) for r in read]) == str([(1, [(2, [1.5, 2.0])])] * 2 + [(None, None), (1, [(2, None)]), (1, [(2, [1e5, 0.0])]), (None, None)])
    # In several pieces, here in this process.
    batch = rows.toArrow()
    monkeypatch.setattr(codecs, "PIECE_NUMBERS", 40)
    monkeypatch.setattr(codecs, "PIECE_BYTES", 300)
    again = codecs._gather_lines.func(batch.column("id").cast("string").combine_chunks(), batch.column("nbrs").combine_chunks())
    assert again.to_pylist() == [r["line"] for r in found]
    assert [x and x["id"] for x in codecs._plain_gather.func(again).field("read").to_pylist()] == [0, 1, None, 3, 4, 5, None, None]


def test_empty_accuracy_is_zero(spark):
    rows = spark.createDataFrame([], "logits array<double>, label int")
    assert tuple(metrics.accuracy(rows).first()) == (0, 0, 0.0)


def test_replication(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    assert tuple(structure.replication_factor(e, F.col("src") % 2).first()) == (pytest.approx(5 / 3), 1.0, 1.5)


def test_files(spark, tmp_path, toy):
    v, e = toy
    g = PropertyGraph(v.withColumn("label", F.lit(1)), e)
    masks = structure.split_masks(v, F.lit(0))
    writers.save_csv(g, masks.select("id", F.lit(1).alias("label"), "all_mask", "train_mask", "valid_mask", "test_mask"), str(tmp_path / "csv"))
    assert as_dict(readers.read_features(spark, str(tmp_path / "csv/features.csv"), labelled=True), "feat") == as_dict(v, "feat")
    loaded = readers.load_graph(spark, str(tmp_path / "csv"), "csv", labelled=True, norm="none")
    assert loaded.edges.count() == 3 and readers.read_meta(spark, str(tmp_path / "csv/meta.csv")).count() == 3
    writers.save_partitioned(g, str(tmp_path / "parts"), 2)
    again, rev = readers.load_partitioned(spark, str(tmp_path / "parts"))
    assert sorted(map(tuple, rev.collect())) == sorted(map(tuple, reverse_edges(again.edges).collect()))
    writers.save_plain(g, str(tmp_path / "e"), str(tmp_path / "v"))
    assert readers.read_plain_graph(spark, str(tmp_path / "e"), str(tmp_path / "v")).edges.count() == 3
    writers.save_typed_tsv(g, masks, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv/nodes.tsv")).columns == ["id:int64", "label:int64", "feature:string"]
    weights = {"w0": [[1.0, 2.0], [3.0, 4.0]]}
    writers.save_weights(spark, weights, str(tmp_path / "w"))
    assert writers.load_weights(spark, str(tmp_path / "w")) == weights


def small_problem(spark):
    rng = np.random.default_rng(5)
    v = feats_of(spark, [(i, rng.normal(size=3).tolist()) for i in range(8)])
    e = structure.normalise(structure.add_self_loops(spark.createDataFrame([(i, (i * 3 + 1) % 8) for i in range(8)], "src long, dst long"), v), "symmetric")
    targets = v.select("id", (F.col("id") % 2).cast("int").alias("label")).join(structure.split_masks(v, F.when(F.col("id") < 6, 0).otherwise(2)), "id")
    return PropertyGraph(v, e), targets


def numpy_loss(spark, graph, targets, spec, weights, loss="ce"):
    x = np.array([r["feat"] for r in graph.vertices.orderBy("id").collect()])
    a = np.zeros((8, 8))
    for r in graph.edges.collect():
        a[r["dst"], r["src"]] += r["weight"]
    for layer in range(spec.n_layers):
        x = neural.LayerPass(spec, weights, layer).forward(a @ x, np.arange(8))
    rows = targets.orderBy("id").collect()
    mask = np.array([r["train_mask"] for r in rows], float)
    return train.loss_and_gradient(x, np.array([r["label"] for r in rows]), mask, loss)[0] / mask.sum()


@pytest.mark.parametrize("kind", neural.KINDS)
def test_gradient_by_finite_differences(spark, kind):
    graph, targets = small_problem(spark)
    spec = neural.ModelSpec((3, 4, 2), kind, mlp_hidden=3)
    trainer = train.Trainer(graph, targets, [spec])
    grads, _ = trainer.gradients(0)
    for layer, number, i, j in ((0, 0, 1, 2), (1, 0, 0, 1)):
        def moved(by):
            shifted = [[(w.copy(), b.copy()) for w, b in steps] for steps in trainer.weights[0]]
            shifted[layer][number][0][i, j] += by
            return numpy_loss(spark, graph, targets, spec, shifted)
        slope = (moved(1e-5) - moved(-1e-5)) / 2e-5
        assert grads[0][layer][number][0][i, j] == pytest.approx(slope, abs=1e-7)


def test_batched_models_equal_single_runs(spark):
    graph, targets = small_problem(spark)
    specs = neural.grid(neural.ModelSpec((3, 4, 2), dropout=0.3), lr=[0.05, 0.01])
    both = train.Trainer(graph, targets, specs)
    both.fit(2)
    for k, spec in enumerate(specs):
        one = train.Trainer(graph, targets, [spec])
        one.fit(2)
        for name in ("loss", "train_accuracy"):
            assert both.history.value(1, k, name) == pytest.approx(one.history.value(1, 0, name))


def numpy_history(spark, graph, targets, spec, epochs):
    """Losses of a run in plain numpy: dense matrices, the same start."""
    x = np.array([r["feat"] for r in graph.vertices.orderBy("id").collect()])
    a = np.zeros((8, 8))
    for r in graph.edges.collect():
        a[r["dst"], r["src"]] += r["weight"]
    rows = targets.orderBy("id").collect()
    y, mask = np.array([r["label"] for r in rows]), np.array([r["train_mask"] for r in rows], float)
    (w0, b0), (w1, b1) = (layer[0] for layer in neural.init_weights(spec))
    parts, step, losses = [w0, b0, w1, b1], optimizer(spec.optimizer, spec.lr, spec.weight_decay), []
    for _ in range(epochs):
        w0, b0, w1, b1 = parts
        g0 = a @ x
        z0 = g0 @ w0 + b0
        g1 = a @ np.where(z0 > 0, z0, 0.01 * z0)
        z1 = g1 @ w1 + b1
        p = np.exp(z1) / np.exp(z1).sum(axis=1, keepdims=True)
        losses.append(-(np.log(p[np.arange(8), y]) * mask).sum() / mask.sum())
        d1 = (p - np.eye(2)[y]) * mask[:, None] / mask.sum()
        d0 = (a.T @ (d1 @ w1.T)) * np.where(z0 > 0, 1, 0.01)
        grads = [g0.T @ d0, d0.sum(axis=0), g1.T @ d1, d1.sum(axis=0)]
        flat = step.step(np.concatenate([q.ravel() for q in parts]), np.concatenate([q.ravel() for q in grads]))
        cuts = np.cumsum([q.size for q in parts])[:-1]
        parts = [part.reshape(q.shape) for part, q in zip(np.split(flat, cuts), parts, strict=True)]
    return losses


@pytest.mark.parametrize("name", ["adamw", "adagrad", "lbfgs"])
def test_training_equals_numpy_and_resumes(spark, name):
    graph, targets = small_problem(spark)
    spec = neural.ModelSpec((3, 5, 2), optimizer=name, lr=0.05)
    whole = train.Trainer(graph, targets, [spec], storage="MEMORY_ONLY")
    losses = [whole.fit(3).value(e, 0, "loss") for e in range(3)]
    assert losses == pytest.approx(numpy_history(spark, graph, targets, spec, 3))
    first = train.Trainer(graph, targets, [spec])
    first.fit(1)
    folder = shared_folder(spark, "state")
    first.save(folder)
    second = train.Trainer(graph, targets, [neural.ModelSpec((3, 5, 2), optimizer=name, lr=0.05, seed=9)])
    second.load(folder)
    assert [second.fit(3).value(e, 0, "loss") for e in range(3)] == pytest.approx(losses, rel=1e-12) and second.done == 3


def test_gradients_in_several_blocks(spark, monkeypatch):
    graph, targets = small_problem(spark)
    spec = neural.ModelSpec((3, 4, 2), "gin", mlp_hidden=3, normalise=True)
    want, _ = train.Trainer(graph, targets, [spec]).gradients(0)
    monkeypatch.setattr(train, "BLOCK", 5)
    got, _ = train.Trainer(graph, targets, [spec]).gradients(0)
    for a, b in zip(want[0], got[0], strict=True):
        assert np.allclose(train.flatten(a), train.flatten(b))


def test_a_closure_lets_the_loss_fall(spark):
    graph, targets = small_problem(spark)
    trainer = train.Trainer(graph, targets, [neural.ModelSpec((3, 4, 2), optimizer="lbfgs", lr=1.0)])
    losses = trainer.fit_closure(steps=3)
    assert losses[0] >= losses[1] >= losses[2] and losses[2] < 0.7
    with pytest.raises(ValueError):
        train.Trainer(graph, targets, [neural.ModelSpec((3, 4, 2))]).fit_closure()


def test_normalised_layers_have_no_mean(spark):
    graph, targets = small_problem(spark)
    spec = neural.ModelSpec((3, 4, 2), normalise=True)
    raw = neural.layer_forward(train.Trainer(graph, targets, [spec]).first, [spec], [neural.init_weights(spec)], 0, 0, True)
    mean, var = neural.output_moments(raw)
    out = neural.standardised(raw, [(mean, var)], [4])
    again = neural.output_moments(out)
    assert np.allclose(again[0], 0) and np.allclose(again[1], var / (var + 1e-5))
    same = neural.layer_forward(train.Trainer(graph, targets, [spec]).first, [spec], [neural.init_weights(spec)], 0, 0, True, [(mean, var)])
    assert as_dict(same, "emb") == as_dict(out, "emb")


def test_loss_falls(spark):
    graph, targets = small_problem(spark)
    trainer = train.Trainer(graph, targets, [neural.ModelSpec((3, 8, 2), lr=0.1)])
    history = trainer.fit(4)
    assert history.value(3, 0, "loss") < history.value(0, 0, "loss")
    before = as_dict(trainer.predict(), "logits")
    folder = shared_folder(spark, "weights")
    trainer.save(folder)
    other = train.Trainer(graph, targets, [neural.ModelSpec((3, 8, 2), seed=1)])
    other.load(folder)
    assert as_dict(other.predict(), "logits") == before and len(before) == 8


@pytest.mark.parametrize("name", ["adamw", "adagrad", "lbfgs"])
def test_optimizers_descend(name):
    x, step = np.array([3.0, -2.0]), optimizer(name, 0.3, 0.0)
    for _ in range(60):
        x = step.step(x, 2 * x * np.array([1.0, 4.0]))
    assert np.abs(x).max() < 1


def test_bad_options(spark, toy):
    v, e = toy
    for call in (lambda: structure.normalise(e, "up"), lambda: pr.weighted_sum(e, v, plan="x"), lambda: neural.ModelSpec((3, 2), "sage"), lambda: optimizer("sgd", 1, 0)):
        with pytest.raises(ValueError):
            call()


def test_scope_lets_go(spark):
    with Scope() as scope:
        a, b = scope.persist(spark.range(3)), scope.persist(spark.range(4).withColumn("x", F.lit(1)))
        a.count(), b.count()
        scope.keep(b)
    assert not a.is_cached and b.is_cached
    b.unpersist()


def test_timers_add_up():
    timers = Timers()
    for _ in range(2):
        with timers.timed("x"):
            pass
    assert list(timers.seconds) == ["x"]


def test_multilabel_loss_and_training(spark):
    graph, targets = small_problem(spark)
    many = targets.drop("label").withColumn("label", F.array((F.col("id") % 2).cast("double"), (F.col("id") % 3 == 0).cast("double")))
    trainer = train.Trainer(graph, many, [neural.ModelSpec((3, 6, 2), lr=0.1)], loss="bce")
    history = trainer.fit(3)
    assert history.value(2, 0, "loss") < history.value(0, 0, "loss")
