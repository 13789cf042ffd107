"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import in_arrow, refuse_clash, with_text
from quirelake.llm.linear import Ftrl, WordHasher, gram_features, sigmoid
from quirelake.llm.sampling import labelled

BITS = 20
#: Labelled rows that a model is fitted on at most; a label's sample is broadcast, so this bounds that too.
MAX_TRAIN = 16_000
#: Features of all those rows together on which it is fitted at most; rows in the order of their hash.
MAX_FEATURES = 60_000_000
#: Bias of a model without labelled rows: nothing is toxic.
NO_LABELS = -20.0


def _features(text: str | None, hasher: WordHasher) -> np.ndarray:
    h = hasher((text or "").lower())
    return gram_features(h, BITS) if len(h) else np.empty(0, np.int32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, epochs: int = 5, min_rows: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) of the coordinates that L1 left, from the whole texts of the documents in labels.

    Of several labels of an id the highest counts; null ids and labels teach nothing. Distinct labelled rows above
    max_train are sampled by a hash of id and text; a row that repeats is one. Features of fewer than min_rows of them are left out. Rows are featurised where they lie; one task
    fits on their indices, in the order of a hash of id and text, so that reruns agree.
    """
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    rows = labelled(docs, marked, doc_id, text, max_train, 11)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        seen: set[int] = set()  # of the sampled keys, so bounded
        for batch in batches:
            fresh = [i for i, k in enumerate(batch.column("key").to_pylist()) if k not in seen and not seen.add(k)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            found = pa.array([np.unique(_features(t.as_py(), hasher)) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), found], names=["key", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y, held, last = [], [], 0, None
        rows_with = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for key, label, x in zip(batch.column("key").to_pylist(), batch.column("y").to_pylist(), batch.column("at"), strict=True):
                if key != last and held < MAX_FEATURES:
                    y.append(label)
                    at.append(x.values.to_numpy())
                    rows_with[at[-1]] += 1  # the indices of a row are distinct
                    held += len(at[-1])
                last = key
        if not y:
            return
        for i, x in enumerate(at):
            at[i] = x[rows_with[x] >= min_rows]
        model = Ftrl(1 << BITS, alpha=0.4, l1=8.0)
        order = np.random.default_rng(5)
        for _ in range(epochs):
            for i in order.permutation(len(y)).tolist():
                model.learn(at[i], float(y[i] > 0))
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], model.bias()))], names=["at", "w"])

    fitted = in_arrow(in_arrow(rows, featurise, "key long, y int, at array<int>").repartition(1).sortWithinPartitions("key"), train, "at long, w double").toPandas()
    if fitted.empty:
        return np.empty(0, np.int64), np.empty(0), NO_LABELS
    bias = float(fitted.w[fitted["at"] == -1].sum())
    fitted = fitted[fitted["at"] >= 0]
    return fitted["at"].to_numpy(), fitted.w.to_numpy(), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and score, 0 to 1, of each whole text: a feature counts once however often it occurs.

    Null and empty texts score what the bias says. Repeated rows stay; an empty table gives an empty one. A key named score is
    refused with a ValueError; other columns may have any name.
    """
    refuse_clash(keys, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32), model[2]))
    narrow, texts = with_text(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[kept] = w
        hasher = WordHasher()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, t in enumerate(texts(batch)):
                found = _features(t.as_py(), hasher)
                found = np.unique(found[dense[found] != 0])
                out[i] = bias + float(dense[found].sum(dtype=np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sigmoid(out))], names=[*keys, "score"])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return in_arrow(narrow, run, f"{kinds}, score double")
