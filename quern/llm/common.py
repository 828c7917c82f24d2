"""What the corpus operators share: word rules, shared folder, materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks; fixed by the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, else the context's checkpoint folder.

    Only a local session, where everything runs on one machine, gets a folder of its own if both
    are unset; on a cluster that would be each machine's own disk, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


class Workspace:
    """A fresh folder under the shared root for the written tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str = "work", path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"

    def materialise(self, frame: DataFrame, name: str) -> DataFrame:
        """Write frame as a table and reread it: cuts the lineage, survives lost executors."""
        frame.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.reread(name, frame)

    def reread(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        self._delete(f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete the whole folder, once nothing reads the results any more."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def digest(text: Column) -> Column:
    """SHA-256 in hex of a text that isn't null, as a column that can't be null: joins on it then add no null check, which Spark would push below and hash for again."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


#: A group is hot with LEAST_HOT rows at least and more than one in HOT_SHARE of all rows; so fewer than HOT_SHARE groups are.
HOT_SHARE, LEAST_HOT, COPIES = 1_000, 1_000, 64


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of groups by keys; the rows of a hot group are dealt to COPIES places.

    groups is a written table with one row for each key and the number n of its rows. Names of hot
    groups (fewer than HOT_SHARE short keys) are broadcast, rows of such a group go by a hash of the
    columns in spread, and the group's row goes to each place. The rest is a merge join at every
    size, so that the plan doesn't turn over as tables grow.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = (F.col("n") >= LEAST_HOT) & (F.col("n") * HOT_SHARE > total)
    hot = groups.where(is_hot).select(*keys, F.lit(True).alias("__hot"))
    place = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(COPIES)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__place", place).drop("__hot")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    copied = groups.withColumn("__place", F.explode(every)).drop("n")
    return dealt.join(copied.hint("merge"), [*keys, "__place"], how).drop("__place")
