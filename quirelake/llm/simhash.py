"""SimHash near-duplicate groups through a Gray-order hierarchical index.

A fingerprint's 64 bits are cut into blocks. Two fingerprints within `radius` bits agree in all but
`radius` blocks at most, so they share the masked pattern of one choice of the other blocks: these
patterns are the index's upper nodes, and they deal fingerprints out to tasks. Within a node the free
bits are sorted by Gray rank, so that equal prefixes are neighbours; runs with a common prefix are
factored into one inner node a level. The self-search walks pairs of nodes from the top, adds up the
differing bits of the patterns and drops a pair of nodes, with all below, once they exceed the radius.
A node has 2 ** (free bits) fingerprints at most, whatever the input; copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage, in_arrow, join_names
from quirelake.llm.components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_CHUNK = 1 << 16
#: Pairs of index nodes looked at in one go.
_PAIRS = 1 << 17


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `shingle` words, or of all of them if they are fewer."""
    if shingle == 1:
        parts = words
    elif len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, max(1, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        if len(octets) < 256:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned SimHash of a text: bit i is set if over half of the shingles' XXH64 have it; 0 without words."""
    found = words(text)
    return majority(shingle_hashes(found, shingle, seed)) if found else 0


def with_fingerprints(df: DataFrame, keys: list[str], text: str, shingle: int) -> DataFrame:
    """The key columns and fp, the signed fingerprint."""
    shaped = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(keys))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(made.view(np.int64))], names=[*keys, "fp"])

    schema = ", ".join([*(f"`{k}` {shaped.schema[k].dataType.simpleString()}" for k in keys), "fp long"])
    return in_arrow(shaped, run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _layout(radius: int, blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of free blocks: the mask of the others and the (shift, width) of the free ones."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    out = []
    for free in combinations(spans, radius):
        gone = sum(((1 << w) - 1) << s for s, w in free)
        out.append((((1 << 64) - 1) & ~gone, list(free)))
    return out


def _gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray sequence; a fold, as nesting would write each step out twice."""
    return F.aggregate(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32))), code, lambda x, by: x.bitwiseXOR(F.call_function("shiftrightunsigned", x, by)))


def _pairs(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the pair, of the left child and of the right child, for all children of pairs of nodes."""
    size = size_a * size_b
    pair = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    return pair, k // size_b[pair], k % size_b[pair]


def search_groups(group: np.ndarray, rank: np.ndarray, width: int, radius: int) -> np.ndarray:
    """For each code its component's first row; rows are sorted by group and Gray rank.

    Two rows of a group link if their codes differ in radius bits at most. Only components come out, never pairs.
    """
    n = len(group)
    root = np.arange(n)
    code = (rank ^ (rank >> np.uint64(1))).astype(np.uint64)
    cuts = [*range(6, width, 6), width]
    # starts[level]: the first rows of the level's nodes; the leaves are single rows
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    starts = [np.flatnonzero(new)]
    for cut in cuts[:-1]:
        prefix = code >> np.uint64(width - cut)
        new[1:] |= prefix[1:] != prefix[:-1]
        starts.append(np.flatnonzero(new))
    starts.append(np.arange(n))
    children = [np.searchsorted(below, np.append(own, n)) for own, below in zip(starts, starts[1:], strict=False)]
    sizes_of = [np.diff(c) for c in children]

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]

    def walk(level: int, a: np.ndarray, b: np.ndarray, acc: np.ndarray) -> None:
        if level == len(starts) - 1:
            unite(a, b)
            return
        child, size = children[level], sizes_of[level]
        work = np.cumsum(size[a] * size[b])
        lo = 0
        while lo < len(a):
            done = work[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(work, done + _PAIRS, side="right")))
            x, y = a[lo:hi], b[lo:hi]
            pair, i, j = _pairs(size[x], size[y])
            i, j = child[x][pair] + i, child[y][pair] + j
            keep = i <= j if level + 1 < len(starts) - 1 else i < j
            pair, i, j = pair[keep], i[keep], j[keep]
            low, high = (cuts[level - 1] if level else 0), cuts[level]
            part = (code >> np.uint64(width - high)) & np.uint64((1 << (high - low)) - 1)
            rows_i, rows_j = starts[level + 1][i], starts[level + 1][j]
            more = acc[lo:hi][pair] + np.bitwise_count(part[rows_i] ^ part[rows_j])
            keep = more <= radius
            if keep.any():
                walk(level + 1, i[keep], j[keep], more[keep])
            lo = hi

    sizes = np.diff(np.append(starts[0], n))
    many = np.flatnonzero(sizes > 1)
    if len(many):
        walk(0, many, many, np.zeros(len(many), np.int64))
    return root


def fingerprint_links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges (a, b) that connect the same nodes as all pairs within the radius do.

    nodes: (node long, fp long), one row a node. Two nodes link if their fp differ in radius bits at most. Of each index
    group only a star comes out, around the component's smallest node, so that edges stay in proportion to the nodes and
    groups of different masks that hold the same component give the same edges.
    """
    layout = _layout(radius, blocks)
    widths = [sum(w for _, w in free) for _, free in layout]
    entries = []
    for k, (mask, free) in enumerate(layout):
        code = F.lit(0).cast("long")
        for shift, w in free:
            part = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
            code = F.shiftleft(code, w).bitwiseOR(part)
        entries.append(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("pattern"), code.alias("code")))
    dealt = nodes.select("node", F.explode(F.array(*entries)).alias("e")).select("e.mask", "e.pattern", _gray_rank(F.col("e.code")).alias("rank"), "node")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, "mask", "pattern").sortWithinPartitions("mask", "pattern", "rank", "node")

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        fresh = np.ones(len(table), bool)
        fresh[1:] = (col["mask"][1:] != col["mask"][:-1]) | (col["pattern"][1:] != col["pattern"][:-1])
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        for width in set(widths):
            at = np.flatnonzero(~alone & np.isin(col["mask"], [k for k, w in enumerate(widths) if w == width]))
            if not len(at):
                continue
            root = search_groups(group[at], col["rank"][at].view(np.uint64), width, radius)
            ends = col["node"][at]
            lowest = ends.copy()
            np.minimum.at(lowest, root, ends)
            hub = lowest[root]
            linked = np.flatnonzero(hub != ends)
            yield pa.RecordBatch.from_arrays([pa.array(ends[linked]), pa.array(hub[linked])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole batches of a group that goes on
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in (0, 1))
            first = tuple(held[0].column(c)[0].as_py() for c in (0, 1))
            if rows < 50_000 or first == last:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            same = (table.column("mask").to_numpy() == last[0]) & (table.column("pattern").to_numpy() == last[1])
            cut = int(np.argmax(same))
            yield from solve(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return in_arrow(dealt, run, "a long, b long", rows=1 << 16)


def near_duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 6) -> DataFrame:
    """One row a document: (doc_id, version, fp, root, component_id), the last the smallest doc_id reachable over links.

    Fingerprints link at radius differing bits or fewer. Words are runs without ASCII white
    space, A-Z lower-cased. Null and empty texts have fingerprint 0 and link like any other. version is a hash of the text, root
    names the group whatever its ids. A null doc_id is never the smallest; a group of nulls alone has a null component_id. Repeated rows stay
    and share a group; ties cannot arise as groups are sets. An empty table gives an empty one. Only the
    named columns are read, so others may have any name.
    """
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    kept = cut_lineage(with_fingerprints(narrow, ["doc_id", "version"], "text", shingle))
    nodes = kept.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp"))
    roots = connected_components(fingerprint_links(nodes.select("node", "fp"), radius, blocks))
    linked = nodes.select("node", "low").join(roots, "node")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    named = nodes.select("node", "low", "n").join(roots.join(lowest, "root"), "node", "left")
    alone = F.col("root").isNull()
    named = named.select("node", "n", F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"), F.when(alone, F.col("low")).otherwise(F.col("component")).alias("component_id"))
    found = join_names(kept.select("doc_id", "version", "fp", F.col("fp").alias("node")), named, "node")
    return found.select(F.col("doc_id").alias(doc_id), "version", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
