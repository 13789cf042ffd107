"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import in_arrow, refuse_clash
from quirelake.llm.sampling import sampled

BITS = 13
#: Documents that centroids are fitted on at most.
MAX_TRAIN = 4_000
_BLOCK = 1 << 18
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of 1 to 3 characters of the lower-cased text, anything but letters being a space; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    odd, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    for at in range(0, len(codes), _BLOCK):
        x = codes[at : at + _BLOCK + 2]
        own = min(_BLOCK, len(codes) - at)
        two = x[:-1] * np.uint32(31337) + x[1:]
        three = two[:-1] * np.uint32(31337) + x[2:]
        for grams in (x[:own], two[:own], three[:own]):
            counts += np.bincount((grams * odd) >> shift, minlength=1 << BITS)
    return counts


@dataclass(frozen=True)
class Centroids:
    """idf by gram; unit centroids, one a row; each one's language and the distance beyond which it rejects."""

    idf: np.ndarray
    centre: np.ndarray
    lang: tuple[str, ...]
    reach: np.ndarray

    def place(self, counts: np.ndarray) -> tuple[int, float]:
        """Nearest centroid and cosine."""
        v = counts * self.idf
        cos = self.centre @ v / max(float(np.sqrt(v @ v)), 1e-12)
        best = int(np.argmax(cos))
        return best, float(np.clip(cos[best], 0.0, 1.0))


def cluster(x: np.ndarray, clusters: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids by spherical k-means; starts are drawn far from those drawn before."""
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    for _ in range(min(clusters, len(x)) - 1):
        far = np.maximum(1 - np.max(x @ np.array(centre).T, axis=1), 0) ** 2
        if far.sum() <= 1e-9:
            break
        centre.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", clusters: int = 4, max_train: int = MAX_TRAIN) -> Centroids | None:
    """Centroids from whole texts with a language; None if there are none. Distinct rows above max_train are sampled by a hash of key and text; a row that repeats is one."""
    rows = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null")
    rows = sampled(rows, max_train, 13)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the sampled keys, so bounded
        for batch in batches:
            key, names, at, n = [], [], [], []
            for k, name, t in zip(batch.column("key").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if k not in seen and not seen.add(k) and (c := gram_counts(t.as_py())) is not None:
                    key.append(k)
                    names.append(name)
                    at.append(np.flatnonzero(c).astype(np.int32))
                    n.append(c[at[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(names, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["key", "lang", "at", "n"]
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, n, last = [], [], [], None
        for batch in batches:
            for key, name, x, y in zip(batch.column("key").to_pylist(), batch.column("lang").to_pylist(), batch.column("at"), batch.column("n"), strict=True):
                if key != last:
                    names.append(name)
                    at.append(x.values.to_numpy())
                    n.append(y.values.to_numpy())
                last = key
        if not names:
            return
        df = np.bincount(np.concatenate(at), minlength=1 << BITS)
        idf = (np.log((1 + len(names)) / (1 + df)) + 1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0.0]), pa.array([idf.astype(np.float64)], pa.list_(pa.float64()))], names=["lang", "reach", "v"])
        for name in sorted(set(names)):
            own = [i for i, x in enumerate(names) if x == name]
            x = np.zeros((len(own), 1 << BITS), np.float32)
            for r, i in enumerate(own):
                x[r, at[i]] = n[i] * idf[at[i]]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            c = cluster(x, clusters)
            cos = x @ c.T
            near = np.argmax(cos, axis=1)
            for k in range(len(c)):
                far = 1 - cos[near == k, k]
                reach = float(far.mean() + 4 * far.std()) if len(far) else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([reach]), pa.array([c[k].astype(np.float64)], pa.list_(pa.float64()))], names=["lang", "reach", "v"])

    counted = in_arrow(rows, count, "key long, lang string, at array<int>, n array<float>")
    made = in_arrow(counted.repartition(1).sortWithinPartitions("key"), train, "lang string, reach double, v array<double>").collect()
    if not made:
        return None
    rest = made[1:]
    return Centroids(np.array(made[0].v, np.float32), np.array([r.v for r in rest], np.float32), tuple(r.lang for r in rest), np.array([r.reach for r in rest]))


def identify(docs: DataFrame, model: Centroids | None, keys: list[str], text: str = "text", unknown: str = "und", reject: bool = False) -> DataFrame:
    """The key columns, lang_pred, score (cosine to the nearest centroid, 0 to 1) and far (beyond that centroid's reach).

    Whole texts are read. Null texts, texts without a letter and, without a model, all are `unknown` with score 0; with reject, far ones
    are unknown as well. Repeated rows stay; an empty table gives an empty one. A key with the name of a column that comes out is
    refused with a ValueError; other columns may have any name.
    """
    refuse_clash(keys, ["lang_pred", "score", "far"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score, far = [], [], []
            for t in batch.column(len(keys)):
                counts = gram_counts(t.as_py()) if model else None
                k, cos = model.place(counts) if counts is not None else (-1, 0.0)
                far.append(k < 0 or 1 - cos > model.reach[k])
                lang.append(unknown if k < 0 or (reject and far[-1]) else model.lang[k])
                score.append(cos)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, "lang_pred", "score", "far"])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return in_arrow(narrow, run, f"{kinds}, lang_pred string, score double, far boolean")
