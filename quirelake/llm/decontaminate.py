"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A test item is the set of its word shingles. Items are partitioned by set size. A partition's items have
MinHash sketches of one length: the shingles with the lowest hashes, as many as an item of the
partition's largest size may lack at the threshold, and one more. A text that contains an item to the
threshold thus holds at least one shingle of its sketch, however long the text is: the search
loses nothing, unlike sketches of both sides. All runs of words of all texts are hashed and looked up in the sketches; only
texts that meet one are read again, for the shingles of items that they hold, compared as strings and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage

#: Shingles of all items, or texts that meet a sketch, up to which they are broadcast; beyond, they are joined by shuffle.
SMALL_ROWS = 500_000
#: What lies between words: anything but letters and digits.
_BETWEEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _hash(w: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, start + k) for k in range(n)))


def runs(texts: DataFrame, keys: list[str], text: str, lengths: list[int]) -> DataFrame:
    """The key columns with w, i, n and h of each run of n words of a text, for each n in lengths: w[i] is its first word, h its hash.

    Positions, not texts, are what is exploded, and nothing on the way is a lambda, so that it all runs in generated code and w is
    never copied to a run's row as long as only h goes on. The split leaves an empty string before or after the words at most.
    """
    w = texts.select(*keys, F.split(F.lower(F.col(text)), _BETWEEN).alias("w"))
    w = w.withColumn("lead", (F.get("w", F.lit(0)) == "").cast("int")).withColumn("end", F.size("w") - (F.get("w", F.size("w") - 1) == "").cast("int"))
    last = F.col("end") - min(lengths)
    # a filter here would be moved down and split the text again
    placed = w.select(*keys, "w", "end", F.explode(F.when(last >= F.col("lead"), F.sequence(F.col("lead"), last))).alias("i"))
    if len(lengths) == 1:
        return placed.select(*keys, "w", "i", F.lit(lengths[0]).alias("n"), _hash(F.col("w"), F.col("i"), lengths[0]).alias("h"))
    each = F.array(*(F.when(F.col("i") + n <= F.col("end"), F.struct(F.lit(n).alias("n"), _hash(F.col("w"), F.col("i"), n).alias("h"))) for n in lengths))
    return placed.select(*keys, "w", "i", F.explode(each).alias("r")).filter("r is not null").select(*keys, "w", "i", "r.n", "r.h")


def item_shingles(items: DataFrame, item_id: str, text: str, threshold: float, shingle: int) -> DataFrame:
    """One row a distinct shingle of an item: item_id, n (words), shingle, h, size (of the item's set), sketch.

    An item of fewer words than a shingle is one shingle of all its words; one without words has none.
    Items with the same id are one item with all their shingles.
    """
    words = items.select(F.col(f"`{item_id}`").alias("item_id"), tokens(F.col(f"`{text}`")).alias("w")).filter("size(w) > 0")
    words = words.withColumn("n", F.least(F.lit(shingle), F.size("w")))
    placed = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))))
    h = F.coalesce(*(F.when(F.col("n") == n, _hash(F.col("w"), F.col("i"), n)) for n in range(1, shingle + 1)))
    each = placed.select("item_id", "n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("shingle"), h.alias("h")).distinct()
    own = Window.partitionBy("item_id")
    each = cut_lineage(each.withColumn("size", F.count(F.lit(1)).over(own)).withColumn("partition", F.floor(F.log2("size") * 2)))
    largest = each.groupBy("partition").agg(F.max("size").alias("largest"))  # a row for each half power of two
    lacking = F.col("largest") - F.ceil(F.col("largest") * threshold - 1e-9)
    each = each.join(F.broadcast(largest), "partition")
    return each.withColumn("sketch", F.row_number().over(own.orderBy("h", "shingle")) <= lacking + 1).select("item_id", "n", "shingle", "h", "size", "sketch")


def contained_versions(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, shingle: int = 5
) -> DataFrame:
    """(doc_id, version, item_id, item_shingles, found): all items of whose shingles a text holds threshold or more; version is the text's xxhash64.

    Null and empty texts hold nothing and no empty item is found. Rows with the same id and text are one. A null id
    is an id. Empty tables give an empty one. Only the named columns are read.
    """
    each = cut_lineage(item_shingles(items, item_id, item_text, threshold, shingle))
    facts = each.agg(F.count(F.lit(1)).alias("rows"), F.collect_set("n").alias("lengths")).first()
    small = F.broadcast if facts["rows"] <= SMALL_ROWS else (lambda df: df)
    lengths = sorted(facts["lengths"]) or [shingle]
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_text}`").alias("text")).withColumn("version", F.xxhash64("text"))
    sketches = each.filter("sketch").select("h", "item_id").distinct()
    met = runs(texts, ["doc_id", "version"], "text", lengths).select("doc_id", "version", "h").join(small(sketches), "h")
    met = cut_lineage(met.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("item_id").alias("k")).distinct())
    whose = met.select("d", "v").distinct()
    whose = F.broadcast(whose) if met.count() <= SMALL_ROWS else whose
    again = texts.join(whose, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_semi")
    hits = runs(again, ["doc_id", "version"], "text", lengths).join(small(each.select("h").distinct()), "h", "left_semi")
    hits = hits.select("doc_id", "version", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("shingle")).distinct()
    held = hits.join(small(each.select("shingle", "item_id", "size")), "shingle")
    found = held.groupBy("doc_id", "version", "item_id").agg(F.count(F.lit(1)).alias("found"), F.first("size").alias("item_shingles"))
    found = found.filter(F.col("found") >= F.col("item_shingles") * threshold - 1e-9)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & F.col("item_id").eqNullSafe(F.col("k"))
    found = found.join(met, same, "left_semi")
    return found.select(F.col("doc_id").alias(doc_id), "version", F.col("item_id").alias(item_id), "item_shingles", "found")


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, shingle: int = 5
) -> DataFrame:
    """(doc_id, item_id, item_shingles, found, containment) of contained_versions; of several texts with one id the one that holds most of an item speaks."""
    found = contained_versions(docs, items, doc_id, doc_text, item_id, item_text, threshold, shingle)
    best = found.groupBy(F.col(doc_id), F.col(item_id)).agg(F.max("item_shingles").alias("item_shingles"), F.max("found").alias("found"))
    return best.select(doc_id, item_id, "item_shingles", "found", (F.col("found") / F.col("item_shingles")).alias("containment"))


ORACLE = r"""
with iw as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark
), sh as (
  select distinct item_id, least(5, len(w)) as n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) as s
  from iw where len(w) > 0
), it as (select *, count(*) over (partition by item_id) as item_shingles from sh),
ns as (select distinct n from sh),
dw as (
  select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from (select distinct doc_id, text from documents)
), ds as (
  select distinct doc_id, text, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as s from dw, ns where len(w) >= n
), f as (select doc_id, text, item_id, count(*) as found, any_value(item_shingles) as item_shingles from ds join it using (n, s) group by doc_id, text, item_id)
select doc_id, item_id, max(item_shingles)::bigint as item_shingles, max(found)::bigint as found, max(found)::double / max(item_shingles)::double as containment
from f where found >= 0.8 * item_shingles - 1e-9 group by doc_id, item_id
"""
