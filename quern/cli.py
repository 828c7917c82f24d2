"""Command line: python -m quern COMMAND --option value ...

Every field of Settings is an option of every command; a file of options (--config, JSON) sets them
first, the command line afterwards. Commands:

land     write a dataset (--dataset, --source, --n) under --graph
train    train models on the graph under --graph, resume from --state if it is there and save to it
predict  write the logits of the models saved in --state to --out
query    run a registered query (--name) over the tables of --tables and write it to --out
list     print the names of the registered queries
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators.neural import ModelSpec, grid
from quern.operators.structure import add_self_loops, normalise, undirected
from quern.operators.train import Trainer
from quern.plans import catalogue
from quern.session import Settings, session
from quern.sources.datasets import land
from quern.sources.readers import DATASETS

COMMANDS = ("land", "train", "predict", "query", "list")


def _many(kind):
    return lambda text: tuple(kind(x) for x in text.split(",") if x)


_KINDS = {"int": int, "int | None": int, "float": float, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes"), "tuple[int, ...]": _many(int), "tuple[float, ...]": _many(float), "tuple[str, ...]": _many(str)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("--config", help="a JSON file of options")
    for name in ("graph", "source", "state", "out", "tables", "name"):
        out.add_argument(f"--{name}")
    for field in fields(Settings):
        out.add_argument("--" + field.name.replace("_", "-"), type=_KINDS[field.type], default=None, help=f"default {field.default!r}")
    return out


def settings_of(args: argparse.Namespace) -> Settings:
    """Defaults, then the file, then the command line."""
    found = Settings()
    if args.config:
        with open(args.config) as file:
            given = json.load(file)
        if unknown := set(given) - {f.name for f in fields(Settings)}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        found = replace(found, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    own = {f.name: getattr(args, f.name) for f in fields(Settings) if getattr(args, f.name) is not None}
    return replace(found, **own)


def specs_of(settings: Settings) -> list[ModelSpec]:
    """One model for each combination of optimizers, lrs and dropouts."""
    data = DATASETS[settings.dataset]
    width = settings.features or data.n_features
    base = ModelSpec((width, *[settings.hidden] * (settings.layers - 1), settings.classes or data.n_classes), settings.kind, settings.mlp_hidden, normalise=settings.normalise, seed=settings.seed)
    return grid(base, settings.models or None, optimizer=list(settings.optimizers), lr=list(settings.lrs), dropout=list(settings.dropouts))


def trainer_of(spark: SparkSession, settings: Settings, folder: str) -> Trainer:
    graph, meta = land(spark, settings.dataset, folder)
    edges = undirected(graph.edges) if settings.undirected else graph.edges
    if settings.loops:
        edges = add_self_loops(edges, graph.vertices)
    several = DATASETS[settings.dataset].multilabel
    targets = meta.withColumn("label", F.col("label").cast("array<double>")) if several else meta
    return Trainer(graph.with_edges(normalise(edges, settings.norm)), targets, specs_of(settings), "bce" if several else "ce", storage=settings.storage)


def _saved(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/history/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    settings = settings_of(args)
    needs = {"land": ["graph"], "train": ["graph", "state"], "predict": ["graph", "state", "out"], "query": ["name", "tables", "out"]}[args.command]
    if missing := [name for name in needs if not getattr(args, name)]:
        parser().error(f"{args.command} needs " + ", ".join(f"--{name}" for name in missing))
    spark = spark or session(settings)
    if args.command == "land":
        land(spark, settings.dataset, args.graph, args.source, settings.partitions, settings.n)
    elif args.command == "query":
        catalogue.queries()[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    else:
        trainer = trainer_of(spark, settings, args.graph)
        if _saved(spark, args.state):
            trainer.load(args.state)
        if args.command == "train":
            trainer.fit(settings.epochs)
            trainer.save(args.state)
            for epoch, model, name, value in trainer.history.rows[-4 * len(trainer.specs) :]:
                print(f"epoch {epoch} model {model} {name} {value:.6f}")
        else:
            trainer.predict().write.mode("overwrite").parquet(args.out)
    return 0
