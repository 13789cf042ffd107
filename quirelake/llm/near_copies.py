"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The Gray-order index of `simhash` links texts whose SimHashes of the same shingles are a few bits apart; these
links are cheap, but at a similarity of 0.8 fingerprints are ten bits apart on average. What they leave apart meets in
MinHash bands, whose recall depends on the similarity alone, not on where a copy was edited: a pair at 0.8
shares one of 16 bands of four with a probability of 0.9998. Every link is verified by the shingle sets of
both whole texts. Pairs that are one component already need no comparison, so each band's rows are compared
with the one of them that is most central, and only then those that are still apart with each other, as far as a prefix
filter by shingle, place and size, which loses none, lets them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage, in_arrow, join_names, sweep
from quirelake.llm.components import connected_components
from quirelake.llm.simhash import fingerprint_links, majority, shingle_hashes, words

SHINGLE, BANDS, ROWS = 5, 16, 4
#: Bits that fingerprints of index links differ in at most, and the index's blocks.
RADIUS, BLOCKS = 2, 6
#: The similarity from which texts are copies, as a fraction.
AT_LEAST = (4, 5)
#: Comparisons with one text that share a copy of it.
SHARE = 256
#: Sets from which a shingle counts as common and comes last in the order of shingles.
COMMON = 8
#: Keys up to which they are broadcast; beyond, they are joined by shuffle.
SMALL_KEYS = 1_000_000

_RNG = np.random.default_rng(42)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(found: list[bytes]) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles; fewer words than a shingle are one, no words are none."""
    return np.unique(shingle_hashes(found, SHINGLE)) if found else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band of the set's MinHashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        mixed = (shingles[at : at + 4096, None] ^ _XOR) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, mixed.min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), seed=k) for k in range(BANDS)], np.uint64)


def with_bands(rows: DataFrame) -> DataFrame:
    """(doc_id, version, node, size, fp, bands) of (doc_id, version, text); node is a hash of the text's words, size the number of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, bands = [], [], [], []
            for text in batch.column(2):
                found = words(text.as_py())
                hashes = shingle_hashes(found, SHINGLE) if found else np.zeros(0, np.uint64)
                own = np.unique(hashes)
                node.append(xxhash.xxh64_intdigest(b" ".join(found), seed=42))
                size.append(len(own))
                fp.append(majority(hashes) if found else 0)
                bands.append(band_keys(own).view(np.int64) if found else [])
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            made = [signed[0], pa.array(size, pa.int64()), signed[1], pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "version", "node", "size", "fp", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, run, f"doc_id {kind}, version long, node long, size long, fp long, bands array<long>")


def with_shingles(rows: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words(t.as_py())).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return in_arrow(rows, run, "node long, shingles array<long>")


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys


def _sizes_allow(a: str, b: str) -> Column:
    """Sets that differ more in size cannot be similar enough."""
    return F.least(a, b) * AT_LEAST[1] >= F.greatest(a, b) * AT_LEAST[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. Copies of a set with many pairs are dealt out."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies")).filter("copies > 1")
    many = _small(cut_lineage(many))
    slot = F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")
    dealt = pairs.join(many, "b", "left").select("a", "b", slot.alias("slot"))
    dealt = dealt.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("own")), "a")
    held = sets.join(many, sets.node == many.b, "left").select(F.col("node").alias("b"), F.col("shingles").alias("other"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("slot"))
    both = F.size(F.array_intersect("own", "other"))
    alike = both * AT_LEAST[1] >= (F.size("own") + F.size("other") - both) * AT_LEAST[0]
    return dealt.join(held, ["b", "slot"]).filter(alike).select("a", "b")


def index_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the Gray-order index links, in proportion to the nodes (node, fp): a star around one node of each fingerprint, and the index's stars between these."""
    hubs = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")))
    links = fingerprint_links(hubs.select(F.col("hub").alias("node"), "fp"), RADIUS, BLOCKS)
    repeated = hubs.filter("n > 1").select("fp", "hub")
    same = nodes.join(_small(cut_lineage(repeated)), "fp").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return links.unionByName(same).distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b), with a_comp and b_comp, of rest's nodes of different comp that can be similar enough; rest: (node, size, comp).

    In any one order of all shingles, two sets share no more than what follows the first that they have in common, itself
    included, in either. So a shingle at some place of a set bounds how large a partner that meets it there may be (cap), and few places in
    front need a look. The order here is that of the sets, with shingles that many share last, by their number; only these are joined and sorted, and
    what is written down for later holds the front of a set as one row. Places that no partner in reach meets, by the
    smallest set and the largest cap among a shingle's places, are left out before the join, and pairs within a shingle's most frequent
    component are never made. No pair is lost.
    """
    num, den = AT_LEAST
    own = sets.join(_small(rest), "node").select("node", "size", "comp", "shingles")
    each = own.select("node", F.explode("shingles").alias("s"))
    common = cut_lineage(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON))
    last = each.join(_small(common), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("last"))
    last = last.select("node", F.col("last.s").alias("last"))
    none = F.array().cast("array<bigint>")
    order = F.concat(F.array_except("shingles", F.coalesce("last", none)), F.coalesce("last", none))
    lacking = F.col("size") - F.ceil(F.col("size") * num / den - 1e-9)
    front = cut_lineage(own.join(last, "node", "left").select("node", "size", "comp", F.slice(order, F.lit(1), (lacking + 1).cast("int")).alias("front")))
    first = front.select("node", "size", "comp", F.posexplode("front").alias("place", "s"))
    first = first.withColumn("cap", F.floor((F.col("size") - F.col("place")) * (num + den) / num + 1e-9) - F.col("size")).drop("place")
    by = first.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("cap").alias("high"))
    by = by.groupBy("s").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.min("low").alias("low"), F.max("high").alias("high"))
    shared = cut_lineage(by.filter("comps > 1 and high >= low").select("s", "major", "low", "high"))
    near = cut_lineage(first.join(_small(shared), "s").filter("cap >= low and size <= high").select("s", "node", "size", "comp", "cap", "major"))
    one = near.filter("comp <> major").select("s", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("comp").alias("a_comp"), F.col("cap").alias("a_cap"))
    met = one.join(near, "s").filter("comp <> a_comp and size <= a_cap and a_size <= cap and (comp = major or a < node)")
    return met.select("a", F.col("node").alias("b"), "a_comp", F.col("comp").alias("b_comp"))


def central_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each band's nodes with the one of them whose bands hold most nodes; met: (band, node, size, score)."""
    centre = F.max(F.struct("score", F.col("node").alias("b"), F.col("size").alias("b_size")))
    heads = cut_lineage(met.groupBy("band").agg(centre.alias("one")).select("band", "one.b", "one.b_size"))
    return met.join(_small(heads), "band").filter((F.col("node") != F.col("b")) & _sizes_allow("size", "b_size")).select(F.col("node").alias("a"), "b").distinct()


def components(met: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) that all verified pairs of a band and the verified ones of pairs make; nodes without a link may be missing."""
    roots = cut_lineage(connected_components(verified(pairs, sets)))
    state = cut_lineage(met.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("comp")))
    apart = state.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("band")
    rest = cut_lineage(state.join(_small(cut_lineage(apart)), "band").select("node", "size", "comp").distinct())
    sweep(met.sparkSession)
    more = cut_lineage(prefix_pairs(rest, sets).distinct())
    alike = verified(more.select("a", "b"), sets).join(more, ["a", "b"]).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    joined = cut_lineage(connected_components(alike).select(F.col("node").alias("comp"), F.col("root").alias("top")))
    named = state.select("node", "comp").distinct().unionByName(roots.select("node", F.col("root").alias("comp"))).distinct()
    return named.join(_small(joined), "comp", "left").select("node", F.coalesce("top", "comp").alias("root"))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, version, root, first), one row a row of docs: rows of one root are connected by texts with a similarity of AT_LEAST.

    Words are runs without ASCII white space, A-Z lower-cased; texts of the same words are copies, texts without words are copies of
    each other. version is a hash of the text; first (doc_id, version) is the group's row with the smallest id, null after all, of
    several of it the one with the smallest version. Shingles are compared as 64-bit hashes. Repeated rows stay; an empty table
    gives an empty one.
    """
    narrow = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    kept = cut_lineage(with_bands(narrow))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    nodes = kept.groupBy("node").agg(F.min(place).alias("from"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    nodes = cut_lineage(nodes)
    pairs = index_pairs(nodes.filter("size > 0").select("node", "fp"))
    entries = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = cut_lineage(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = cut_lineage(entries.join(_small(shared), "band").select("band", "node", "size", "n"))
    met = met.drop("n").join(met.groupBy("node").agg(F.sum("n").alias("score")), "node")
    met = cut_lineage(met)
    pairs = cut_lineage(pairs.union(central_pairs(met)).distinct())
    sweep(docs.sparkSession)
    ends = met.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(nodes.join(ends, "node", "left_semi").select("node", F.col("from.doc_id").alias("k_id"), F.col("from.version").alias("k_version")))
    texts = narrow.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("version") == F.col("k_version")))
    sets = cut_lineage(with_shingles(texts.select("node", "text")).dropDuplicates(["node"]))
    roots = components(met, sets, pairs)
    named = cut_lineage(nodes.join(roots, "node", "left").select("node", "n", "from", F.coalesce("root", "node").alias("root")))
    first = named.groupBy("root").agg(F.min("from").alias("first"), F.count(F.lit(1)).alias("n"))
    named = join_names(named.select("node", F.col("n").alias("rows"), "root"), first, "root").withColumnRenamed("rows", "n")
    return join_names(kept.select("doc_id", "version", "node"), named, "node").select("doc_id", "version", "root", F.struct("first.doc_id", "first.version").alias("first"))
