"""Near copies of the pipeline: the groups of brute force, and what edits of each kind are found."""

import random
from itertools import combinations

import numpy as np
import pytest

from quirelake.llm import near_copies, stages


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if root[i] != root[j] and alike(sets[i], sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == k) for k in root}


def zipf(rng, n):
    return [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n)]


def edited(rng, w, kind, share):
    n = max(1, round(share * len(w)))
    if kind == "appended":
        return w + [f"x{rng.random()}" for _ in range(n)]
    if kind == "truncated":
        return w[:-n]
    at = rng.randrange(len(w) - n)
    if kind == "block":
        return w[:at] + [f"x{rng.random()}" for _ in range(n)] + w[at + n :]
    w = list(w)
    for i in rng.sample(range(len(w)), max(1, n // 5)):
        w[i] = f"x{rng.random()}"
    return w


KINDS = {"appended": 0.24, "truncated": 0.19, "block": 0.1, "scattered": 0.1}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_groups_are_those_of_brute_force(spark):
    """Similarities on both sides of 0.8, in a group around one text and apart."""
    rng = random.Random(3)
    base = zipf(rng, 100)
    texts = [" ".join(base)]
    texts += [" ".join(edited(rng, base, kind, share * rng.uniform(0.4, 1.5))) for _ in range(25) for kind, share in KINDS.items()]
    for n in (3, 5, 30, 80):
        w = zipf(rng, n)
        texts += [" ".join(w), " ".join(w).upper(), " ".join([*w, "end"])]
    got = {}
    for r in near_copies.near_copy_groups(frame(spark, texts)).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == groups(texts)


def test_long_prose_of_one_skewed_vocabulary_stays(spark, sf):
    """Word counts are alike in all of these, passages in none."""
    rng = random.Random(4)
    docs = frame(spark, [" ".join(f"w{int(rng.paretovariate(1.2)) % 400}" for _ in range(6000)) for _ in range(40)])
    assert stages.dedup_stage(spark, docs, sf).count() == 40


@pytest.mark.parametrize("kind", KINDS)
def test_bands_find_each_kind_of_copy(kind):
    """At a similarity from 0.8 to 0.85, whatever the length."""
    rng = random.Random(kind)
    for n in (60, 150, 400):
        met = all_pairs = 0
        while all_pairs < 100:
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            c = edited(rng, w, kind, KINDS[kind] * rng.uniform(0.85, 1.15))
            a, b = shingles(" ".join(w)), shingles(" ".join(c))
            if not 0.8 <= len(a & b) / len(a | b) <= 0.85:
                continue
            keys = [near_copies.band_keys(near_copies.shingle_set([x.encode() for x in t])) for t in (w, c)]
            all_pairs += 1
            met += bool(np.any(keys[0] == keys[1]))
        assert met >= 0.98 * all_pairs


def test_prefix_pairs_lose_none_and_write_fronts_only(spark, monkeypatch):
    """Shingles that many sets share come last in every set; no row a shingle of each set is written down."""
    rng = random.Random(6)

    def draw(n):
        return [rng.getrandbits(64) for _ in range(n)]

    base = draw(200)
    sets = [set(base[rng.randrange(30) :]) | set(draw(rng.randrange(30))) for _ in range(30)]
    for _ in range(4):  # shingles of their own, in too few sets to be common
        own = draw(100)
        sets += [set(own[k:]) for k in (0, 5, 10)]
    written = []

    def counted(df, cut=near_copies.cut_lineage):
        written.append((kept := cut(df)).count())
        return kept

    monkeypatch.setattr(near_copies, "cut_lineage", counted)
    rows = [(i, np.sort(np.array(list(s), np.uint64)).view(np.int64).tolist()) for i, s in enumerate(sets)]
    rest = spark.createDataFrame([(i, len(s), i) for i, s in rows], "node long, size long, comp long")
    got = near_copies.prefix_pairs(rest, spark.createDataFrame(rows, "node long, shingles array<long>"))
    got = {tuple(sorted((r.a, r.b))) for r in got.collect()}
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])}
    assert len(want) > 50 and want <= got
    assert max(written) < 0.5 * sum(map(len, sets))
