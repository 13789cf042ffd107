"""The Pareto mix: targets, bounds, probabilities and odd input."""

import pytest
from pyspark.sql import functions as F

from quirelake.llm import mixing


def plain_targets(sizes, weights, repeats):
    """Targets by giving what capped sources leave to the others, over and over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        unit = (total - sum(repeats * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if unit * weight[s] > repeats * sizes[s]}
        if not over:
            return {s: repeats * sizes[s] if s in capped else unit * weight[s] for s in order}
        capped |= over


def test_targets_and_bounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 17 == 1, F.lit(None)).otherwise(F.col("source")))
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].to_numpy().tolist())) == sorted(map(tuple, again[["doc_id", "taken"]].to_numpy().tolist()))
    key = got.source.where(got.source.notna(), None)
    sizes = got.groupby(key, dropna=False)["size"].sum()
    sizes = {None if k != k else k: int(v) for k, v in sizes.items()}
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for (s, part) in got.groupby(key, dropna=False):
        s = None if s != s else s
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert set(part.source_size) == {sizes[s]}
        assert abs(part.taken.sum() - want[s]) <= max(0.05 * want[s], part["size"].max() / 2)
    assert (got.taken <= 3 * got["size"]).all()
    assert (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()


def test_inclusion_grows_with_level(spark):
    """Over many seeds, long documents are drawn as often as their level says against short ones."""
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * (3 if i % 4 < 2 else 60)) for i in range(400)], "doc_id long, source string, text string")
    means = []
    for seed in range(3):
        got = mixing.mix(docs, weights=(1, 3), seed=seed).toPandas()
        part = got[got.source == "a"]
        means.append(part[part["size"] == 60].copies.mean() / max(part[part["size"] == 3].copies.mean(), 1e-9))
    assert 2 < sum(means) / 3 < 4.5  # levels 6 and 2


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, None, "", 1), (1, "a", "x y", 2), (1, "a", "x y", 2), (2, "", "one", 3), (3, "b", "word " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, m_size int").withColumn("target", F.lit(9)).withColumn("p", F.lit(9))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert len({r.copies for r in got if r.source == "a"}) == 1
    kept = mixing.mix(docs, keep_columns=True)
    assert kept.select("row.*").columns == docs.columns and kept.count() == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("doc_id is null")).count() == 1
