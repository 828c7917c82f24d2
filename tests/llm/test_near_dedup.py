"""The pipeline's near-dedup against all pairs of five-word shingle sets."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, components, near_dedup, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def expected(rows):
    """Lowest id of each component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_an_edited_copy_goes(spark):
    words = [f"w{i}" for i in range(124)]
    edited = [*words[:40], "other", *words[41:80], "another", *words[81:]]
    apart = [w if i % 9 else f"x{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(apart))]
    assert kept(spark, rows) == [1, 3] == expected(rows)


def test_all_pairs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SAMPLE", 2)
    monkeypatch.setattr(near_dedup, "FREQUENT", 2)
    r = random.Random(11)
    boilerplate = [f"b{i}" for i in range(30)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for k in range(25):
        words = [r.choice("abcdefgh") * r.randint(1, 9) + str(r.randint(0, 99)) for _ in range(r.randint(6, 160))]
        base = words + boilerplate if k % 2 else words
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            edited = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 30))):
                edited[r.randrange(len(edited))] = f"e{r.randint(0, 10**6)}"
            texts.append(" ".join(edited))
    rows = list(enumerate(texts))
    want = expected(rows)
    assert len(want) < len({t for _, t in rows}) - 5
    assert kept(spark, rows) == want


def test_simhash_links_first(spark):
    """All similar sets within two bits are linked by their fingerprints, equal ones included, and no others; the exact join adds the rest."""
    r = random.Random(8)
    texts = ["", "one two", "a b c d e"]
    for _ in range(12):
        base = [f"{r.choice('abcdefgh')}{r.randint(0, 999)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(6):
            edited = list(base)
            for _ in range(r.choice([1, 1, 2, 6])):
                edited[r.choice([0, 299, r.randrange(300)])] = f"e{r.randint(0, 10**6)}"
            texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    workspace = common.Workspace(spark, "test")
    described = near_dedup.prefixes(docs, near_dedup.frequent_shingles(docs))
    sets = workspace.materialise(described.withColumn("low", F.col("doc_id")).withColumn("node", F.col("doc_id")), "sets")
    found = near_dedup.fingerprint_links(docs, sets, workspace)
    own, prints = [shingles(t) for t in texts], {x["node"]: x["print"] % (1 << 64) for x in sets.collect()}
    assert prints == {i: int(simhash.fingerprint_of_hashes(near_dedup.shingle_set(t.encode()))) for i, t in enumerate(texts)} and prints[0] == 0
    linked = {(x["a"], x["b"]) for x in found.collect()}
    near = {(i, j) for j in range(len(texts)) for i in range(j) if similar(own[i], own[j]) and bin(prints[i] ^ prints[j]).count("1") <= 2}
    assert 5 < len(linked) and linked <= {(i, j) for j in range(len(texts)) for i in range(j) if similar(own[i], own[j])}
    root = {x["node"]: x["root"] for x in components.components(found, common.Workspace(spark, "test")).collect()}
    assert all(i in root and root[i] == root[j] for i, j in near)
    every = near_dedup.links(docs, sets, workspace, found=found)
    assert linked <= {(x["a"], x["b"]) for x in every.collect()} and len(near) < sum(similar(own[i], own[j]) for j in range(len(texts)) for i in range(j))
    assert kept(spark, list(enumerate(texts))) == expected(list(enumerate(texts)))


def test_the_pipeline_takes_fingerprints(spark, monkeypatch):
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *given: seen.append(1) or links(*given))
    assert kept(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")]) == [1, 3] and seen


def test_prefix_lengths():
    for n in range(1, 200):
        shared = next(i for i in range(n + 1) if 5 * i >= 4 * n)
        assert near_dedup.prefix_length(n) == n - shared + 1


def test_a_crowd_of_edited_copies(spark, monkeypatch):
    """Leaders link a crowd; what they don't link is paired across, whichever part is the body."""
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 9, 20])):
            words[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"w{k}" for k in range(100)] + [f"{g}x{k}" for k in range(20)] + [f"y{i}{k}" for k in range(i)])) for i, g in enumerate("aabbcabc")]
    want = expected(rows)
    assert 1 < len(want) < 30 and kept(spark, rows) == want


def test_a_crowd_makes_few_pairs(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 120], f"e{i}", *base[i % 120 + 1 :]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    workspace = common.Workspace(spark, "test")
    described = near_dedup.prefixes(docs, near_dedup.frequent_shingles(docs.limit(0)))
    sets = workspace.materialise(described.select("key", F.col("doc_id").alias("low"), F.col("doc_id").alias("node"), "n", "prefix", "parity"), "sets")
    linked = near_dedup.links(docs, sets, workspace)
    root = components.components(linked, common.Workspace(spark, "test"))
    assert root.count() == 300 and root.select("root").distinct().count() == 1
    assert linked.count() < 300 * 40
