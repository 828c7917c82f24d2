"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger has two tables that only grow:
versions holds each (path, blob) that was ever recorded, findings one row for each scanned blob and
rule version. A scan reads only the blobs that the findings lack for the present rules, each once
however many paths carry it, and findings are joined back to all paths, of the present table or of
every version on record. A scan that fails or is run by two writers at once may leave a row twice;
readers take one of each, so no document is doubled.

Spans are code points, end exclusive. A kind's matches are leftmost and non-overlapping; a match
that fails its kind's length rule is dropped, not retried. Positions are built from the gaps that
split() leaves between the matches. The paths of a blob that very many carry are dealt to many
places (common.spread_join).

Edge cases: null and empty texts have no span; rows that repeat a doc_id each get their row; null
ids pass through; an empty table gives an empty result. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from quern.llm.bitmap import build_filter, probe_filter
from quern.llm.common import Workspace, digest, spread_join, table


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. value_group has to hold at least least characters. base: part of the fixed rules."""

    kind: str
    pattern: str
    value_group: int
    least: int
    base: bool = True


# Fixed values of the query contract.
_ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", _ASSIGN, 2, 12),
    # A run shorter than the limit can't hold a longer one, so these two need no length filter after the match.
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    # Added by this scanner.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, base=False),
)
RULE_VERSION = "2"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule, in order of start."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.value_group))
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.from_json(F.lit("[]"), SPAN)
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.length(piece["gap"])
        end = start + F.length(piece["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        grown = F.when(F.length(piece["value"]) >= rule.least, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"])
        return F.struct(end.alias("at"), grown.alias("spans"))

    found = F.aggregate(pieces, begin, step, lambda done: done["spans"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(none)


def all_spans(text: Column, rules=RULES) -> Column:
    return F.array_sort(F.flatten(F.array(*[rule_spans(text, rule, rank) for rank, rule in enumerate(rules)])))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


class BlobLedger:
    """Versions and findings under one folder; keep the folder to scan incrementally."""

    VERSION = "path string, blob string"
    FINDING = f"blob string, rule_version string, spans {SPAN}"

    def __init__(self, spark: SparkSession, path: str, rules=RULES, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rules, self.rule_version = spark, path, rules, rule_version

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])

    def findings(self) -> DataFrame:
        """blob, spans of the present rule version, one row for each blob."""
        own = self._read("findings", self.FINDING).where(F.col("rule_version") == self.rule_version)
        return own.groupBy("blob").agg(F.first("spans").alias("spans"))

    def versions(self) -> DataFrame:
        """path, blob: every version on record, once."""
        return self._read("versions", self.VERSION).distinct()

    def scan(self, texts: DataFrame, workspace: Workspace) -> int:
        """Append the findings of the unseen blobs of texts (blob, text), once each; the number of blobs that were scanned.

        The unseen blobs are found without texts; a filter over them (bitmap.py) keeps the texts of
        all others out of the shuffle.
        """
        unseen = texts.select("blob").distinct().join(self.findings().select("blob"), "blob", "left_anti")
        unseen = workspace.materialise(unseen, f"unseen-{self.rule_version}")
        bitmap = workspace.materialise(build_filter(unseen, "blob"), f"unseen-filter-{self.rule_version}")
        once = probe_filter(texts.select("blob", "text"), bitmap, "blob").groupBy("blob").agg(F.first("text").alias("text"))
        once = once.join(unseen.hint("merge"), "blob", "left_semi")
        found = once.select("blob", F.lit(self.rule_version).alias("rule_version"), all_spans(F.col("text"), self.rules).alias("spans"))
        found.write.mode("append").parquet(f"{self.path}/findings")
        return unseen.count()

    def record(self, paths: DataFrame) -> None:
        """Append the (path, blob) pairs that aren't on record."""
        fresh = paths.select("path", "blob").where("path is not null").distinct().join(self.versions(), ["path", "blob"], "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/versions")

    def historical_findings(self) -> DataFrame:
        """path, blob, spans of every version on record whose blob was scanned under the present rules."""
        return self.versions().join(self.findings(), "blob")


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), blob."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), digest(text).alias("blob"))


def scan_documents(docs: DataFrame, ledger: BlobLedger, workspace: Workspace) -> DataFrame:
    """doc_id, spans: the findings of every row of docs by way of the ledger, in which docs are recorded as present versions."""
    texts = addressed(docs)
    ledger.scan(texts, workspace)
    paths = workspace.materialise(texts.select("doc_id", "blob"), "paths")
    ledger.record(paths.select(F.col("doc_id").cast("string").alias("path"), "blob"))
    sizes = paths.groupBy("blob").agg(F.count("*").alias("n"))
    found = workspace.materialise(sizes.join(ledger.findings(), "blob"), "present")
    return spread_join(paths, found, ["blob"], ["doc_id"]).select("doc_id", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "secrets")
    ledger = BlobLedger(spark, f"{workspace.path}/ledger")
    spans = F.col("spans")
    n_base = sum(rule.base for rule in RULES)
    base = F.filter(spans, lambda s: s["rank"] < n_base)
    counts = [_count(spans, rule.kind).alias(f"n_{rule.kind}") for rule in RULES if rule.base]
    found = scan_documents(table(spark, sf_dir, "documents"), ledger, workspace)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _oracle() -> str:
    columns, kinds = [], []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        columns.append(
            f"regexp_extract_all(text, '{pattern}', 0) AS w{rank}, regexp_extract_all(text, '{pattern}', {rule.value_group}) AS v{rank}, "
            f"string_split_regex(text, '{pattern}') AS g{rank}"
        )
        kinds.append(
            f"SELECT doc_id, rn, '{rule.kind}' AS kind, {rank} AS rank, len(v{rank}[i]) >= {rule.least} AS good, "
            f"list_sum(list_transform(g{rank}[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w{rank}[1:i-1], lambda x: len(x))), 0) AS start, "
            f"len(w{rank}[i]) AS size FROM (SELECT *, unnest(range(1, len(w{rank}) + 1)) AS i FROM found)"
        )
    named = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    one = "kind || ':' || start || ':' || (start + size)"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, rn, {', '.join(columns)} FROM docs),
spans AS ({' UNION ALL '.join(kinds)}),
kept AS (
  SELECT rn, {named},
         string_agg({one}, ',' ORDER BY start, rank) FILTER (WHERE rank < {sum(r.base for r in RULES)}) AS base,
         string_agg({one}, ',' ORDER BY start, rank) AS spans
  FROM (SELECT rn, kind, rank, start::BIGINT AS start, size FROM spans WHERE good) GROUP BY rn
)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES if r.base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN kept USING (rn)
"""


ORACLE_SQL = _oracle()
