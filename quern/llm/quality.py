"""Quality rules: a learned decision list over text statistics.

Statistics come from one pass over whole texts. The list is learned from labelled statistics by
sequential covering: a conjunction of threshold tests is grown on two thirds of the labelled rows
for the best gain, pruned on the other third while that doesn't hurt its worth, and kept if it is
precise enough; the rows it covers are taken out and the next is grown. The list is emitted as
ordered Spark conditionals, so applying it is a projection.

The labelled rows are a bounded sample: the max_rows rows with the lowest hash of their id
(parameter of learn_rules, 20,000 by default). Everything else covers all rows.

Edge cases: null text has no words and fails the base; a label that is null or whose document is
missing isn't learned from; several labels for one id are all used; with fewer than two classes
the list is empty and keeps what passes the base; rows that repeat get equal verdicts; null ids
pass through; an empty table gives an empty result. Extra columns pass through keep_documents,
whatever their names. Texts over BLOCK bytes are measured in blocks, so that memory takes some tens
of bytes for each word of the longest text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import table

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_distinct_words", "longest_word")
MAX_LABELLED = 20_000
MIN_WORDS = 50
BLOCK = 1 << 20
_BLANK, _SOLID = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes]) -> int:
    """How many positions lie in a window of three words that is found again."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    return _covered(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))


def _covered(hit: np.ndarray) -> int:
    covered = np.zeros(len(hit) + 2, bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    if len(text) > BLOCK:
        return _long_statistics(text)
    words = text.split()
    solid = text.translate(None, BLANK_BYTES).decode()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(solid),
        _without(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        _without(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _without(text, b"0123456789"),
        len(set(words)),
        max(map(len, words), default=0),
    )


def _without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def _long_statistics(text: bytes, block: int = BLOCK) -> tuple[int, ...]:
    """The same in blocks that end at blanks. Words and lines are told apart by hash: 64 bits for words, three of them for a window, 128 for lines."""
    hashes, chars, longest, at = [], 0, 0, 0
    sums = [0, 0, 0]
    while at < len(text):
        blank = _BLANK.search(text, at + block) if at + block < len(text) else None
        end = blank.start() if blank else len(text)
        part = text[at:end]
        words = part.split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        # Continuation bytes begin no character.
        solid = np.frombuffer(part.translate(None, BLANK_BYTES), np.uint8)
        chars += int(np.count_nonzero((solid & 0xC0) != 0x80))
        longest = max(longest, max(map(len, words), default=0))
        sums = [n + _without(part, some) for n, some in zip(sums, (SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"), strict=True)]
        at = end
    word, n_lines, seen = np.concatenate(hashes), 0, set()
    at = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        if _SOLID.search(text, at, end):
            n_lines += 1
            seen.add(xxhash.xxh3_128_digest(text[at:end]))
        at = end + 1
    return len(word), chars, sums[0], n_lines - len(seen), _repeated_hashes(word), n_lines, sums[1], sums[2], len(np.unique(word)), longest


def _repeated_hashes(word: np.ndarray) -> int:
    if len(word) < 3:
        return 0
    windows = np.stack([word[:-2], word[1:-1], word[2:]], axis=1)
    order = np.lexsort(windows.T)
    same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return _covered(hit)


def with_statistics(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """row (the columns of docs as a struct, without the text if that isn't kept), text if it is, and the struct stats."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].alias("text"))
    names, kept = BASE + EXTRA, ["row", "text"] if keep_text else ["row"]
    schema = StructType([*[row.schema[c] for c in kept], StructField("stats", StructType([StructField(n, LongType()) for n in names]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            columns = list(zip(*map(statistics, texts_of(chunk)), strict=True))
            stats = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))
            yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in kept], stats], [*kept, "stats"])

    return row.mapInArrow(run, schema)


def features(stats: str = "stats") -> dict[str, Column]:
    """The inputs of the rules: rates, so that a threshold means the same for short and long texts."""

    def per(part: str, whole: str) -> Column:
        return F.col(f"{stats}.{part}") / F.greatest(F.col(f"{stats}.{whole}"), F.lit(1))

    return {
        "words": F.col(f"{stats}.n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "digit_rate": per("n_digits", "word_chars"),
        "distinct_rate": per("n_distinct_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "longest_word": F.col(f"{stats}.longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def condition(self, inputs: dict[str, Column]) -> Column:
        return inputs[self.feature] > self.threshold if self.above else inputs[self.feature] <= self.threshold


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    found = np.ones(len(next(iter(x.values()))), bool)
    for test in rule:
        found &= test.holds(x)
    return found


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Test | None]:
    """The test with the highest gain: rejected rows kept times the growth of log precision."""
    p0, n0 = int(bad[inside].sum()), int((~bad)[inside].sum())
    base = np.log2(p0 / (p0 + n0))
    best, chosen = 0.0, None
    for name, values in x.items():
        own, labels = values[inside], bad[inside]
        order = np.argsort(own, kind="stable")
        own, labels = own[order], labels[order]
        ends = np.flatnonzero(np.diff(own) > 0)
        if not len(ends):
            continue
        p, t = np.cumsum(labels)[ends], ends + 1
        for above, pos, size in ((False, p, t), (True, p0 - p, p0 + n0 - t)):
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / size) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, chosen = float(gain[k]), Test(name, above, float((own[ends[k]] + own[ends[k] + 1]) / 2))
    return best, chosen


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_tests and (~bad)[inside].any():
        _, test = _best_test(x, bad, inside)
        if test is None:
            break
        rule += (test,)
        inside &= test.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """(p - n) / (p + n) on the pruning rows, smoothed."""
    inside = covers(rule, x)
    p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
    return (p - n) / (p + n + 2)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    options = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(options, key=lambda r: (round(_worth(r, x, bad), 9), -len(r)))


def cover(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.8, least: int = 5, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Ordered rules that reject, max_rules at most of max_tests tests each: the size of the model, whatever the data.

    A rule stays if, over grown and pruned rows together, it covers least rows at the asked precision.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_tests)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        inside = covers(rule, x) & left
        hits = int(bad[inside].sum())
        if hits < least or hits < precision * int(inside.sum()):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, precision: float = 0.8) -> list[Rule]:
    """Rules from the labelled rows of docs whose base doesn't fail."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").select(F.col("doc_id").alias("__id"), "quality").limit(max_rows)
    # At most max_rows pairs of numbers, so the broadcast is bounded.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).drop("__id")
    measured = with_statistics(chosen, keep_text=False)
    inputs = features()
    order, quality = F.xxhash64("row.doc_id").alias("__order"), F.col("row.quality").alias("quality")
    rows = measured.where(~base_failed()).select(order, quality, *[c.alias(n) for n, c in inputs.items()]).toPandas()
    rows = rows.sort_values(["__order", "quality", *inputs], kind="stable")
    x = {name: rows[name].to_numpy(float) for name in inputs}
    return cover(x, rows["quality"].to_numpy() == 0, precision)


def base_failed(stats: str = "stats") -> Column:
    words = F.col(f"{stats}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * words)


def rejecting_rule(rules: list[Rule], stats: str = "stats") -> Column:
    """Number of the first rule that rejects, null if none does: ordered conditionals."""
    inputs = features(stats)
    chain = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules):
        condition = rule[0].condition(inputs)
        for test in rule[1:]:
            condition &= test.condition(inputs)
        chain = chain.when(condition, F.lit(number))
    return chain


def judge(docs: DataFrame, labels: DataFrame, keep_text: bool = False) -> DataFrame:
    """row and stats (see with_statistics) with base_failed, rule and kept."""
    rules = learn_rules(docs, labels)
    judged = with_statistics(docs, keep_text).withColumn("base_failed", base_failed()).withColumn("rule", rejecting_rule(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass the base and every rule; their columns as they were."""
    kept = judge(docs, labels, keep_text=True).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"stats.{n}").alias(n) for n in BASE], "base_failed", "kept", "rule")
