"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines are split at \\n; lines without a word are left alone and don't count. What repeats is a run of
RUN consecutive counted lines, or a single line of LONG words or more. Of equal runs anywhere in the
table the first in the order (doc_id, position) stays, and every line of the others is deleted.

1. Winnowing: of each window of RUN counted lines the line with the smallest hash is selected (the
   rightmost of equals), and so is each long line. Equal runs select equal lines at equal offsets.
   Only selected positions are written, each with the hashes of the up to RUN - 1 lines on either side.
2. Positions are joined by fingerprint; those whose fingerprint occurs once are done.
3. The others extend their match both ways over the lines beside them: each run of RUN lines through
   the position that agrees in 128 hash bits with an earlier one is deleted. Selected positions are
   at most RUN lines apart, so the extensions of neighbours meet and a longer repeated passage goes
   as a whole, whatever its length.

A line that opens no match before stays, so the first copy of everything is kept. The rows of a
fingerprint or run that holds a large share of all are dealt to many places (common.spread_join).

Edge cases: null text counts as empty and comes back as an empty text; null ids come last in the
order; rows that repeat both doc_id and text are one document and keep what it keeps; rows that
share a doc_id only are ordered by a hash of their text; a text may become empty, its row stays;
an empty table gives an empty result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WORD, Workspace, spread_join, table

RUN, LONG = 2, 50
HAS_WORD = r"[^\x20\x09-\x0D]"
PLACE = ["no_id", "doc_id", "key"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    """no_id, doc_id, key (a hash of the text), text (null: empty) and the other columns of docs as one struct."""
    text = F.coalesce(docs["text"], F.lit(""))
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    return docs.select(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"), row)


def selected_positions(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """no_id, doc_id, key, pos, fp, at (index of pos in near), near (at, h1, h2 of the lines around), long: one row for each selected position."""
    numbered = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    counted = F.filter(numbered, lambda x: F.regexp_like(x["line"], F.lit(HAS_WORD)))

    def hashed(x: Column) -> Column:
        # A line of long words has 2 * long - 1 characters at least, which spares most lines the count.
        many = (F.length(x["line"]) >= 2 * long - 1) & (F.regexp_count(x["line"], F.lit(WORD)) >= long)
        return F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(7), x["line"]).alias("h2"), many.alias("long"))

    worded = _identified(docs).where(F.regexp_like("text", F.lit(HAS_WORD)))
    lines = worded.select(*PLACE, F.transform(counted, hashed).alias("h"))

    def window_minimum(i: Column) -> Column:
        part = F.transform(F.slice("h", i + 1, run), lambda x, k: F.struct(x["h1"].alias("h"), (-(i + k)).alias("minus")))
        return -F.array_min(part)["minus"]

    none = F.array().cast("array<int>")
    minima = F.when(F.size("h") >= run, F.transform(F.sequence(F.lit(0), F.size("h") - run), window_minimum)).otherwise(none)
    longs = F.filter(F.transform("h", lambda x, i: F.when(x["long"], i)), lambda i: i.isNotNull())
    chosen = lines.select(*PLACE, "h", F.explode(F.array_distinct(F.concat(minima, longs))).alias("pos"))
    first = F.greatest(F.col("pos") - (run - 1), F.lit(0))
    own = F.get("h", F.col("pos"))
    near = F.transform(F.slice("h", first + 1, F.col("pos") - first + run), lambda x: F.struct(x["at"], x["h1"], x["h2"]))
    return chosen.select(*PLACE, "pos", own["h1"].alias("fp"), (F.col("pos") - first).alias("at"), near.alias("near"), own["long"].alias("long"))


def extended_runs(positions: DataFrame, run: int = RUN) -> DataFrame:
    """no_id, doc_id, key, start, lines, k1, k2: the runs of run lines through each position, and the position alone if its line is long."""

    def one(start: Column, size: int) -> Column:
        part = F.slice("near", start + 1, size)
        return F.struct(
            F.get("near", start)["at"].alias("start"),
            F.transform(part, lambda x: x["at"]).alias("lines"),
            F.aggregate(part, F.lit(41 + size).cast("long"), lambda a, x: F.xxhash64(a, x["h1"])).alias("k1"),
            F.aggregate(part, F.lit(-41 - size).cast("long"), lambda a, x: F.xxhash64(a, x["h2"])).alias("k2"),
        )

    starts = F.filter(F.sequence(F.lit(0), F.col("at")), lambda s: s + run <= F.size("near"))
    through = F.transform(starts, lambda s: one(s, run))
    alone = F.when(F.col("long"), F.array(one(F.col("at"), 1)))
    runs = F.concat(through, F.coalesce(alone, F.slice(through, 1, 0)))
    return positions.select(*PLACE, F.explode(runs).alias("r")).select(*PLACE, "r.*")


def repeated_lines(docs: DataFrame, workspace: Workspace, run: int = RUN, long: int = LONG) -> DataFrame:
    """no_id, doc_id, key, gone: the positions of the lines that go, for documents that lose any."""
    positions = workspace.materialise(selected_positions(docs, run, long), "positions")
    place = F.struct(*PLACE, "pos")
    met = positions.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    met = workspace.materialise(met.where(F.col("low") != F.col("high")).select("fp", "n"), "met")
    runs = workspace.materialise(extended_runs(spread_join(positions, met, ["fp"], ["doc_id", "pos"]), run), "runs")
    start = F.struct(*PLACE, "start")
    first = runs.groupBy("k1", "k2").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n"))
    first = workspace.materialise(first.where(F.col("first") != F.col("last")).select("k1", "k2", "first", "n"), "first")
    later = spread_join(runs, first, ["k1", "k2"], ["doc_id", "start"]).where(start != F.col("first"))
    lost = later.select(*PLACE, F.explode("lines").alias("line"))
    gone = workspace.materialise(lost.groupBy(*PLACE).agg(F.collect_set("line").alias("gone")), "gone")
    for name in ("positions", "met", "runs", "first"):
        workspace.drop(name)
    return gone


def _marked(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row, text and gone (null where nothing goes) of every row of docs."""
    rows, right = _identified(docs), gone.select(F.col("doc_id").alias("id"), F.col("key").alias("own"), "gone")
    # A merge join at every size: whole texts are dealt out by id, and the plan doesn't turn over as the table grows.
    return rows.join(right.hint("merge"), rows["doc_id"].eqNullSafe(right["id"]) & (rows["key"] == right["own"]), "left").select("row", "text", "gone")


def _kept() -> Column:
    """What stays of text. The lines are bound to a variable, so they are split once, and positions are subtracted as sets."""
    bound = F.array(F.struct(_lines(F.col("text")).alias("lines"), F.col("gone").alias("gone")))

    def left(s: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(s["lines"], i)), "\n")

    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(bound, left)[0])


def drop_repeated_lines(docs: DataFrame, workspace: Workspace, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with repeated lines taken out of text; n_chars, where there is such a column, follows."""
    kept = _marked(docs, repeated_lines(docs, workspace, run, long)).select("row", _kept().alias("kept"))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = _marked(docs, repeated_lines(docs, Workspace(spark, "line-dedup")))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(_kept(), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), counted AS (
  SELECT doc_id, i, lines[i] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
  WHERE regexp_matches(lines[i], '[^\x20\x09-\x0D]')
), runs AS (
  SELECT a.doc_id, a.i AS i1, b.i AS i2,
         row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.k) AS nth
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.k = a.k + 1
), longs AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS nth
  FROM counted WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, i1 AS i FROM runs WHERE nth > 1 UNION ALL SELECT doc_id, i2 FROM runs WHERE nth > 1
        UNION ALL SELECT doc_id, i FROM longs WHERE nth > 1) GROUP BY doc_id
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(lines, chr(10))
              ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""
