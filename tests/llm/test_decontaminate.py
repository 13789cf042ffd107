"""Containment search against sets of shingles."""

import re

from pyspark.sql import functions as F

from quirelake.llm import decontaminate


def shingles(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(n, len(w)) if n else 0
    return w, n


def plain(docs, items, threshold=0.8, k=5):
    out = {}
    for item, text in items:
        w, n = shingles(text, k)
        want = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in docs:
            b, _ = shingles(body, k)
            have = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            if want and len(want & have) >= threshold * len(want) - 1e-9:
                out[doc, item] = max(out.get((doc, item), 0), len(want & have) / len(want))
    return out


def test_matches_sets(spark, sf):
    """Whole items, items with words changed, reversed and cut, in front of long texts."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(901, "Two words"), (902, ""), (903, None), (904, "the"), (901, "Two words")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    for i, (k, t) in enumerate(items[:40]):
        w = (t or "").split()
        docs.append((5000 + i, " ".join([*docs[i % 9][1].split(), *w[: len(w) * (95 - i) // 100], "mid"]).upper()))
        docs.append((6000 + i, " ".join("changed" if j % 23 == i % 23 else x for j, x in enumerate(w))))
    docs += [(7000, None), (7001, ""), (None, items[0][1]), (6000, docs[0][1]), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("w", F.lit("w"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(d, b).collect()}
    assert got == plain(docs, items)
    assert decontaminate.contained_items(d.limit(0), b).count() == 0
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0


def test_shuffled_join_finds_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(decontaminate.contained_items(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)
    assert sorted(decontaminate.contained_items(docs, items).collect()) == want


def test_sketches_lose_nothing(spark):
    """Every item keeps as many low hashes as it may lack, and one more."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(5 + i))) for i in range(60)], "item_id long, text string")
    got = decontaminate.item_shingles(items, "item_id", "text", 0.8, 5).groupBy("item_id", "size").agg(F.count_if("sketch").alias("k")).collect()
    for r in got:
        most_lacking = r["size"] - -(-8 * r["size"] // 10)
        assert r.k >= min(r["size"], most_lacking + 1)


def test_a_text_of_many_items_makes_no_pairs_of_all(spark):
    """200 items in one text: hits meet the items of their own shingle only."""
    rng = __import__("random").Random(2)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items))], "doc_id long, text string")
    found = decontaminate.contained_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
