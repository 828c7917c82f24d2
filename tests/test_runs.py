"""Datasets, settings and the command line."""

import gzip
import json

import numpy as np
import pytest

from quern import cli
from quern.session import Settings, ensure_checkpoint_dir
from quern.sources import datasets, readers


@pytest.fixture
def ogb(tmp_path):
    (tmp_path / "split").mkdir()
    rows = [f"{i}.5,{-i}" for i in range(30)]
    with gzip.open(tmp_path / "node-feat.csv.gz", "wt") as file:
        file.write("\n".join(rows) + "\n")
    (tmp_path / "node-label.csv").write_text("\n".join("nan" if i == 7 else str(i % 2) for i in range(30)))
    (tmp_path / "edge.csv").write_text("\n".join(f"{i},{(i * 3) % 30}" for i in range(30)))
    for name, ids in (("train", range(20)), ("valid", range(20, 25)), ("test", range(25, 29))):
        (tmp_path / "split" / f"{name}.csv").write_text("\n".join(map(str, ids)))
    return str(tmp_path)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(f"v{i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = datasets._numbered(spark, str(tmp_path / "x.csv"))
        assert rows.rdd.getNumPartitions() > 2
        assert {r["id"]: r["value"] for r in rows.collect()} == {i: f"v{i}" for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ogb_layout(spark, ogb):
    graph, meta = datasets.read_ogb(spark, ogb)
    assert {r["id"]: list(r["feat"]) for r in graph.vertices.collect()} == {i: [i + 0.5, -float(i)] for i in range(30)}
    found = {r["id"]: (r["label"], r["all_mask"], r["train_mask"]) for r in meta.collect()}
    assert found[3] == (1, 0, 1) and found[22] == (0, 1, 0) and found[29] == (1, -1, 0) and found[7][0] is None
    assert graph.edges.count() == 30


@pytest.mark.parametrize("many", [False, True])
def test_saint_layout(spark, tmp_path, many):
    np.save(tmp_path / "feats.npy", np.arange(20.0).reshape(10, 2))
    np.savez(tmp_path / "adj_full.npz", indptr=np.arange(0, 22, 2), indices=np.arange(20) % 10, data=np.ones(20), shape=(10, 10), format=b"csr")
    (tmp_path / "class_map.json").write_text(json.dumps({str(i): [i % 2, 1] if many else i % 3 for i in range(10)}))
    (tmp_path / "role.json").write_text(json.dumps({"tr": [0, 1, 2], "va": [3], "te": [4]}))
    graph, meta = datasets.read_saint(spark, str(tmp_path), block=4)
    assert sorted((r["src"], r["dst"]) for r in graph.edges.collect()) == sorted((i // 2, i % 10) for i in range(20))
    rows = {r["id"]: r for r in meta.collect()}
    assert rows[3]["valid_mask"] == 1 and rows[9]["all_mask"] == -1 and rows[5]["label"] == ([1, 1] if many else 2)


def test_landing_is_done_once(spark, tmp_path):
    target = str(tmp_path / "g")
    graph, meta = datasets.land(spark, 0, target, n=40)
    assert graph.vertices.count() == 40 == meta.count() and len(graph.vertices.first()["feat"]) == 100
    assert datasets.land(spark, 0, target, n=7)[0].vertices.count() == 40
    assert datasets.land(spark, 0, target, n=7, force=True)[0].vertices.count() == 7
    with pytest.raises(ValueError):
        datasets.land(spark, 1, str(tmp_path / "none"))
    assert set(readers.DATASETS) == set(range(7))


def test_settings_come_from_defaults_file_and_line(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"epochs": 3, "hidden": 8, "lrs": [0.1, 0.2]}))
    args = cli.parser().parse_args(["train", "--config", str(tmp_path / "c.json"), "--hidden", "16", "--optimizers", "adamw,adagrad", "--undirected", "false"])
    found = cli.settings_of(args)
    assert (found.epochs, found.hidden, found.lrs, found.optimizers, found.undirected, found.seed) == (3, 16, (0.1, 0.2), ("adamw", "adagrad"), False, Settings().seed)
    assert len(cli.specs_of(found)) == 4
    (tmp_path / "c.json").write_text(json.dumps({"epoch": 3}))
    with pytest.raises(ValueError, match="unknown"):
        cli.settings_of(args)


def test_land_train_resume_and_predict(spark, tmp_path, capsys):
    graph, state, out = (str(tmp_path / x) for x in ("graph", "state", "out"))
    shape = ["--dataset", "0", "--n", "40", "--hidden", "4", "--dropouts", "0"]
    assert cli.main(["land", "--graph", graph, *shape], spark) == 0
    assert cli.main(["train", "--graph", graph, "--state", state, "--epochs", "1", *shape], spark) == 0
    assert "epoch 0 model 0 loss" in capsys.readouterr().out
    assert cli.main(["train", "--graph", graph, "--state", state, "--epochs", "2", *shape], spark) == 0
    assert "epoch 1 model 0 loss" in capsys.readouterr().out
    assert cli.main(["predict", "--graph", graph, "--state", state, "--out", out, *shape], spark) == 0
    assert spark.read.parquet(out).count() == 40
    assert cli.main(["list"]) == 0 and "propagate_dense" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["train", "--graph", graph], spark)


def test_a_query_from_the_command_line(spark, tmp_path):
    from tests.test_entry import DATA

    assert cli.main(["query", "--name", "star_graph", "--tables", DATA, "--out", str(tmp_path / "q")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() == 49


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda key, default=None: default)})})
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(session)
