"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns what it keeps of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, mixing, near_copies, quality_rules, toxicity
from quirelake.llm.common import cut_lineage, packed, table

#: Keys of rows to be left out up to which they are broadcast; beyond, they are joined by shuffle.
SMALL_KEYS = 1_000_000


def _without(docs: DataFrame, keys: DataFrame, on: list) -> DataFrame:
    """docs without the rows that match a row of keys, (docs' column, keys' column) pairs being compared null for null."""
    return _matching(docs, cut_lineage(keys), on, "left_anti")


def _matching(docs: DataFrame, keys: DataFrame, on: list, how: str) -> DataFrame:
    keys = F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys
    match = F.lit(True)
    for mine, theirs in on:
        match = match & mine.eqNullSafe(keys[theirs])
    return docs.join(keys, match, how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject. Null, empty and short texts fail the base rules; repeated rows share their fate; an empty table gives an empty one."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    counted = quality_rules.with_counts(packed(docs), ["row"], "row.text")
    return counted.filter(~quality_rules.base_failed() & quality_rules.keeps(rules)).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3. Null and empty texts score what the model's bias says; repeated rows share their fate; an empty table gives an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(packed(docs), model, ["row"], "row.text").filter("score < 0.3").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and of several rows of it one.

    A null id comes after all others. Texts without words, null ones included, are one group. An empty table gives an empty one.
    """
    groups = cut_lineage(near_copies.near_copy_groups(docs))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    keys = [F.col("doc_id").alias("k_id"), F.col("version").alias("k_version")]
    gone = groups.filter(~stays).select(*keys).distinct()
    repeated = groups.filter(stays).groupBy(*keys).count().filter("count > 1").select("k_id", "k_version")
    on = [(docs["doc_id"], "k_id"), (F.xxhash64(docs["text"]), "k_version")]
    repeated = cut_lineage(repeated)
    if repeated.isEmpty():
        return _without(docs, gone, on)
    left = _without(docs, gone.union(repeated), on)
    rows = _matching(docs, repeated, on, "left_semi")
    rows = packed(rows).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("version"))
    return left.union(rows.dropDuplicates(["id", "version"]).select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows go by id and text, so that a clean text whose id another row has, or that has none, stays."""
    found = decontaminate.contained_versions(docs, table(spark, sf_dir, "benchmark"))
    keys = found.select(F.col("doc_id").alias("k_id"), F.col("version").alias("k_version")).distinct()
    return _without(docs, keys, [(docs["doc_id"], "k_id"), (F.xxhash64(docs["text"]), "k_version")])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, and source_size and target of their source in place of any columns of these names.

    Documents without words are never taken; null is a source like others; each of several equal rows is a document; an empty table gives an empty one.
    """
    mixed = mixing.mix(docs, keep_columns=True).filter("copies > 0")
    added = ["copies", "source_size", "target"]
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)
