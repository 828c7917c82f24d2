"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Every task's rows are a memtable: sorted by digest and flushed as one Parquet run. A batch of runs
waits until compaction merges all that wait and the level before into a new sorted level, one row
for each digest with the smallest identifier and the number of rows. Beside a level lies its
filter, a bitmap of fixed size (bitmap.py). A look-up probes the filter first and joins only what
passes; the filter never misses, and what it passes wrongly the join drops.

The groups of a table come from the level. Rows whose digest several rows hold are hits: probing the
filter of these digests keeps the other rows' texts out of the join. The normalised bytes of a hit
are compared with those of the row that is kept, and rows that differ (a digest collision) are
grouped by their bytes instead. Hot digests are dealt to many places (common.spread_join), also for
the comparison.

Edge cases: null text counts as empty; rows that repeat a doc_id with equal texts stay together
(every row that carries keep_id is kept); a null doc_id is larger than any other, and a group of
null ids only has keep_id null and is kept; an empty table gives an empty result. Extra columns pass
through drop_duplicates, whatever their names; dedup_groups doesn't read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bitmap import build_filter, probe_filter
from quern.llm.common import BLANKS, Workspace, digest, spread_join, table

def normalised(text: Column | None = None) -> Column:
    return F.regexp_replace(F.coalesce(F.col("text") if text is None else text, F.lit("")), BLANKS, " ")


class DigestIndex:
    """Runs that wait and the levels, under one folder that all executors share. The newest level holds all that was compacted."""

    RUN = "digest string, doc_id long"
    LEVEL = "digest string, keep_id long, n long"
    FILTER = "piece long, bits binary"

    def __init__(self, spark: SparkSession, path: str):
        self.workspace = Workspace(spark, path=path)
        self.spark, self.waiting, self.batches, self.newest = spark, [], 0, 0

    def flush(self, docs: DataFrame) -> None:
        """Write the digests of docs (doc_id, text) as sorted runs, one per task."""
        name = f"runs-{self.batches}"
        rows = docs.select(digest(normalised(docs["text"])).alias("digest"), docs["doc_id"].cast("long").alias("doc_id"))
        self.workspace.materialise(rows.sortWithinPartitions("digest", "doc_id"), name)
        self.waiting, self.batches = [*self.waiting, name], self.batches + 1

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.workspace.path}/{name}")

    def compact(self) -> None:
        """Merge the waiting runs and the newest level into the next level and write its filter; the merged ones go."""
        parts = [self._read(name, self.RUN).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")) for name in self.waiting]
        if self.newest:
            parts.append(self.level())
        if not parts:
            return
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        merged = rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        old = [*self.waiting, *([f"level-{self.newest}", f"filter-{self.newest}"] if self.newest else [])]
        level = self.workspace.materialise(merged.sortWithinPartitions("digest"), f"level-{self.newest + 1}")
        self.workspace.materialise(build_filter(level), f"filter-{self.newest + 1}")
        self.newest, self.waiting = self.newest + 1, []
        for name in old:
            self.workspace.drop(name)

    def level(self) -> DataFrame:
        """digest, keep_id, n."""
        return self._read(f"level-{self.newest}", self.LEVEL)

    def look_up(self, rows: DataFrame) -> DataFrame:
        """The rows (with a column digest) that the newest level holds, with its keep_id: the filter first, then the join."""
        passed = probe_filter(rows, self._read(f"filter-{self.newest}", self.FILTER))
        own = [passed["digest"], *[passed[c] for c in passed.columns if c != "digest"]]
        held = self.level().select(F.col("digest").alias("__digest"), "keep_id")
        return passed.join(held, passed["digest"] == held["__digest"]).select(*own, "keep_id")


def dedup_groups(docs: DataFrame, index: DigestIndex, workspace: Workspace) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, among which equal texts are sought. index is a new one."""
    index.flush(docs)
    index.compact()
    level = index.level()
    shared = workspace.materialise(level.where("n > 1"), "shared")
    bitmap = workspace.materialise(build_filter(shared), "shared-filter")
    rows = docs.select(docs["doc_id"].alias("doc_id"), normalised(docs["text"]).alias("body")).withColumn("digest", digest(F.col("body")))
    sizes = shared.select("digest", "keep_id", "n", F.col("n").alias("size"))
    hits = spread_join(probe_filter(rows, bitmap), sizes, ["digest"], ["doc_id"])
    hits = workspace.materialise(hits, "hits")
    held = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("held_body"), F.min("size").alias("n"))
    held = workspace.materialise(held, "held")
    other = F.when(F.col("body") != F.col("held_body"), F.col("body"))
    checked = spread_join(hits, held, ["digest"], ["doc_id"]).select("digest", "doc_id", other.alias("other"))
    checked = workspace.materialise(checked, "checked")
    for name in ("hits", "held", "shared-filter"):
        workspace.drop(name)
    verified = checked.where(F.col("other").isNull()).select("digest", "doc_id")
    groups = verified.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"), F.count("*").alias("group_size"))
    groups = workspace.materialise(groups, "groups")
    collided = checked.where(F.col("other").isNotNull())
    collided_groups = collided.groupBy("digest", "other").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["digest", "doc_id", "keep_id", "group_size"]
    out = level.where("n = 1").select("digest", F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"))
    out = out.unionByName(spread_join(verified, groups, ["digest"], ["doc_id"]).select(*columns))
    out = out.unionByName(collided.join(collided_groups, ["digest", "other"]).select(*columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """The rows of docs that stay; columns as they were."""
    groups = dedup_groups(docs, DigestIndex(docs.sparkSession, f"{workspace.path}/index"), workspace)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("text_sha256").alias("held")).distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(docs["doc_id"].alias("doc_id"), digest(normalised(docs["text"])).alias("digest"), row)
    same = rows["doc_id"].eqNullSafe(gone["gone"]) & (rows["digest"] == gone["held"])
    return rows.join(gone.hint("merge"), same, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "exact-dedup")
    index = DigestIndex(spark, f"{workspace.path}/index")
    return dedup_groups(table(spark, sf_dir, "documents"), index, workspace)


ORACLE_SQL = r"""
WITH bodies AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
  SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM bodies
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""
