"""Session, settings and materialised steps."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Options of a run. Partition counts of None leave the session's; a number of 0 is the dataset's own."""

    app_name: str = "quern"
    shuffle_partitions: int | None = None
    storage: str = "MEMORY_AND_DISK"  # of the first layer's sums, which every epoch reads
    dataset: int = 2
    n: int = 10_000_000  # vertices of the generated graph
    partitions: int = 8
    epochs: int = 200
    seed: int = 2021
    kind: str = "gcn"
    layers: int = 2
    hidden: int = 256
    mlp_hidden: int = 128
    features: int = 0
    classes: int = 0
    norm: str = "symmetric"
    loops: bool = True
    undirected: bool = True
    normalise: bool = False
    models: int = 0
    optimizers: tuple[str, ...] = ("adamw",)
    lrs: tuple[float, ...] = (0.01,)
    dropouts: tuple[float, ...] = (0.5,)


def session(settings: Settings = Settings(), **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(settings.app_name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if settings.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(settings.shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that spark.checkpoint.dir or the application set. Only a local session gets one of its own where there is none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quern-checkpoints-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/quern-{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder and forget the lineage; lost executors don't lose it."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


class Scope:
    """Frames persisted inside the block are let go at its end, those kept stay."""

    def __init__(self, storage: str = "MEMORY_AND_DISK"):
        self.level, self.held = getattr(StorageLevel, storage), []

    def persist(self, frame: DataFrame) -> DataFrame:
        self.held.append(frame.persist(self.level))
        return frame

    def keep(self, frame: DataFrame) -> DataFrame:
        self.held = [f for f in self.held if f is not frame]
        return frame

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        for frame in self.held:
            frame.unpersist()


class Timers:
    """Seconds by name, added up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
