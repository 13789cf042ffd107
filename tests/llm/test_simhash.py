"""SimHash groups against plain bit counts and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import simhash
from quirelake.llm.components import connected_components


def plain_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(codes, links):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if links(codes[i], codes[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


TEXTS = [None, "", "  \n", "one", "ONE", "one two", "One  Two\tthree", "Ä b Ä b Ä b", "x " * 1000, "a\x0bb\x85c", "é É e"]


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("text", [*TEXTS, " ".join(str(i % 97) for i in range(3000))])
def test_fingerprint(text, k):
    assert simhash.fingerprint(text, k) == plain_fingerprint(text, k)


def test_groups_match_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicate_groups(docs).select("doc_id", "fp", "component_id").toPandas().sort_values("doc_id")
    codes = [int(x) for x in got.fp.to_numpy().view(np.uint64)]
    groups = plain_groups(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for d, g in zip(got.doc_id, groups, strict=True):
        low[g] = min(low.get(g, d), d)
    assert [low[g] for g in groups] == got.component_id.tolist()


@pytest.mark.parametrize(("radius", "blocks"), [(1, 4), (2, 6), (3, 6)])
def test_links_of_crowded_codes(spark, radius, blocks):
    """Many codes within few bits of few centres, in chains and copies."""
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = set()
    for _ in range(600):
        c = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    codes = sorted(codes)
    signed = [simhash._signed(c) for c in codes]
    nodes = spark.createDataFrame([(c, c) for c in signed], "node long, fp long")
    made = {r.node: r.root for r in connected_components(simhash.fingerprint_links(nodes, radius, blocks)).collect()}
    groups = plain_groups(codes, lambda a, b: (a ^ b).bit_count() <= radius)
    by = {}
    for c, g in zip(signed, groups, strict=True):
        by.setdefault(g, set()).add(made.get(c, c))
    assert all(len(v) == 1 for v in by.values())
    assert len(set.union(*by.values())) == len(by)


def test_large_group_over_batches(spark):
    """One index group longer than an Arrow batch and than the reader's window."""
    base = 0x0123456789ABCDEF
    codes = sorted({base ^ k for k in range(1 << 17)})
    nodes = spark.createDataFrame([(c, c) for c in map(simhash._signed, codes[::8])], "node long, fp long")
    roots = connected_components(simhash.fingerprint_links(nodes, 1, 4))
    assert roots.select("root").distinct().count() == 1
    assert roots.count() == len(codes[::8])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (5, None), *chain[:5]], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "same text of five words", "x"), (3, "same text of five words", "y"), (3, "same text of five words", "y"), (None, "alone " * 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(1)).withColumn("node", F.lit("n"))
    got = simhash.near_duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.version): r.component_id for r in got}
    assert {v for (d, _), v in found.items() if d in (1, 2)} == {1}
    assert {r.component_id for r in got if r.doc_id == 3} == {3}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0
