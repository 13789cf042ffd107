"""Quality classifier by co-training on two views of a document, its words and its metadata.

Both views learn from a bounded sample of labelled rows. In each round both score all rows without a label where these lie;
of all that a view is sure of, the surest, a bounded number, become pseudo-labels for the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.linear import Ftrl, gram_features, platt, sigmoid
from quirelake.llm.common import cut_lineage, in_arrow, refuse_clash
from quirelake.llm.sampling import bounded_sample, sampled

BITS = 18
META_BITS = 14
#: Labelled rows that the views are fitted on at most, and what they may take of features, rows in the order of their hash.
MAX_LABELLED = 8_000
MAX_FEATURES = 40_000_000
#: Rounds of exchange; the share of all rows without a label, and how many at most, that a view gives pseudo-labels in a round, the surest; how sure it must be.
ROUNDS, SHARE, MAX_GIVEN, SURE = 2, 0.08, 1_000, 0.9
#: What a character is to a piece.
WORDS, MARKS, UPPER, LOWER, NOT_ALNUM = 1, 2, 4, 8, 16
_BASE = 0x9E3779B97F4A7C15


def _kind(char: str) -> int:
    if char.isspace():
        return 0
    word = char.isalnum() or char == "_"
    return (WORDS if word else MARKS) | UPPER * char.isupper() | LOWER * (char.islower() or char.istitle() and not char.isupper()) | NOT_ALNUM * (not char.isalnum())


class PieceHasher:
    """64-bit hashes of a text's pieces, runs of letters, digits and _ or runs of marks; marks and case tell quality.

    The lowest bit tells upper case and the next one marks, for which a text's characters are looked at as an array. A text is read
    in blocks of `block` characters, longer where a piece is.
    """

    def __init__(self, block: int = 1 << 20) -> None:
        self.block = block
        self.kinds = np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)
        self.powers = self._powers(1 << 10)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, _BASE, np.uint64))

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= self.block:
            return self._read(text, True)[0]
        found, at, size = [], 0, self.block
        while at < len(text):
            last = at + size >= len(text)
            own, end = self._read(text[at : at + size], last)
            found.append(own)
            at, size = at + end, self.block if end else 2 * size
        return np.concatenate(found)

    def _read(self, text: str, last: bool) -> tuple[np.ndarray, int]:
        """The hashes of the runs of a block, and where they end: the last run of a block in front of others may go on in the next."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[np.minimum(chars, 0xFFFF)]
        for i in np.flatnonzero(chars > 0xFFFF).tolist():
            kinds[i] = _kind(text[i])
        runs = kinds & (WORDS | MARKS)
        starts = np.flatnonzero(np.diff(runs, prepend=np.uint8(255)))
        end = len(chars)
        if not last:
            end, starts = int(starts[-1]), starts[:-1]
            chars, kinds = chars[:end], kinds[:end]
        if not len(starts):
            return np.zeros(0, np.uint64), end
        lengths = np.diff(starts, append=end)
        if lengths.max() > len(self.powers):
            self.powers = self._powers(2 * int(lengths.max()))
        place = np.arange(end) - np.repeat(starts, lengths)
        h = np.add.reduceat(chars * self.powers[place], starts)
        told = np.bitwise_or.reduceat(kinds, starts)
        pieces = runs[starts] > 0
        h, told = h[pieces], told[pieces]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        upper = (told & (UPPER | LOWER)) == UPPER
        return (h & ~np.uint64(3)) | upper | ((told & NOT_ALNUM) > 0) * np.uint64(2), end


def _shape(h: np.ndarray) -> list[str]:
    """Coarse classes of a text's pieces, so that unseen words still say something."""
    n = max(1, len(h))
    ordered = np.sort(h)
    distinct = min(1, len(h)) + np.count_nonzero(ordered[1:] != ordered[:-1])
    upper, marks = int((h & np.uint64(1)).sum()), int((h >> np.uint64(1) & np.uint64(1)).sum())
    return [f"upper {10 * upper // n}", f"marks {10 * marks // n}", f"distinct {10 * distinct // n}"]


def text_view(text: str | None, hasher: PieceHasher, kept: np.ndarray | None = None) -> np.ndarray:
    """Distinct indices of pieces, of pairs of neighbours and of the shape; with kept, of those that it marks only."""
    h = hasher(text or "")
    shape = np.array([xxhash.xxh64_intdigest(s) >> (64 - BITS) for s in _shape(h)], np.int32)
    own = gram_features(h, BITS, grams=2, skips=0) if len(h) else shape[:0]
    if kept is not None:
        own, shape = own[kept[own]], shape[kept[shape]]
    return np.unique(np.append(own, shape))


def meta_view(source: str | None, lang: str | None, text: str | None) -> np.ndarray:
    """Source, language, and the page's build: size, lines and their lengths in classes, alone and in pairs."""
    text = text or ""
    lines = text.count("\n") + 1
    size = len(text)
    told = [f"source {source}", f"lang {lang}", f"size {size.bit_length()}", f"lines {lines.bit_length()}", f"line {(size // lines).bit_length()}"]
    told += [f"{told[2]} {told[3]}", f"{told[1]} {told[4]}"]
    return np.unique(np.array([xxhash.xxh64_intdigest(s) >> (64 - META_BITS) for s in told], np.int32))


@dataclass(frozen=True)
class Views:
    """Weights of both views, the slope and offset that calibrate each, the prior log-odds, and what each round exchanged."""

    text_at: np.ndarray
    text_w: np.ndarray
    text_bias: float
    meta_at: np.ndarray
    meta_w: np.ndarray
    meta_bias: float
    calibration: tuple[float, ...]
    exchanged: tuple[int, ...]


def learn(views: list[list[np.ndarray]], label: np.ndarray, given: list[np.ndarray]) -> tuple[list[Ftrl], list[tuple[float, float]]]:
    """Models of two views and their calibrations.

    label: 1, 0 or -1 for a row without. A fourth of the labelled rows calibrates the views and is never learned. given[k]: pseudo-labels
    that view k learns at half weight, -1 where it has none.
    """
    known = np.flatnonzero(label >= 0)
    fold = known[np.arange(len(known)) % 4 == 3]
    train = np.setdiff1d(known, fold)
    models, calibrations = [], []
    for k, size in enumerate((1 << BITS, 1 << META_BITS)):
        model = Ftrl(size, alpha=0.2, l1=(2.0, 0.5)[k])
        rows = [(i, float(label[i]), 1.0) for i in train.tolist()] + [(i, float(given[k][i]), 0.5) for i in np.flatnonzero(given[k] >= 0).tolist()]
        order = np.random.default_rng(9)
        for _ in range(3):
            for j in order.permutation(len(rows)).tolist():
                i, y, w = rows[j]
                model.learn(views[k][i], y, w)
        margin = np.array([model.margin(views[k][i]) for i in fold])
        models.append(model)
        calibrations.append(platt(margin, label[fold].astype(float)) if len(fold) else (1.0, 0.0))
    return models, calibrations


def _featurised(rows: DataFrame) -> DataFrame:
    """(key, y, a, b): both views' features of (key, y, source, lang, text), each key once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PieceHasher()
        seen: set[int] = set()  # of bounded samples
        for batch in batches:
            fresh = [i for i, k in enumerate(batch.column("key").to_pylist()) if k not in seen and not seen.add(k)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            said, meta = [], []
            for s, lang, t in zip(*(batch.column(c) for c in ("source", "lang", "text")), strict=True):
                t = t.as_py()
                said.append(text_view(t, hasher))
                meta.append(meta_view(s.as_py(), lang.as_py(), t))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(said, kind), pa.array(meta, kind)], names=["key", "y", "a", "b"])

    return in_arrow(rows.select("key", "y", "source", "lang", "text"), run, "key long, y int, a array<int>, b array<int>")


def _trained(rows: DataFrame, given: list[dict[int, int]], told: list[int]) -> Views | None:
    """Views learned by one task from the features of bounded samples, in the order of their keys; None without labels."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views: list[list[np.ndarray]] = [[], []]
        y: list[int] = []
        keys: list[int] = []
        held, last = 0, None
        for batch in batches:
            for key, label, a, b in zip(batch.column("key").to_pylist(), batch.column("y").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if key != last and held < MAX_FEATURES:
                    keys.append(key)
                    y.append(label)
                    views[0].append(a.values.to_numpy())
                    views[1].append(b.values.to_numpy())
                    held += len(views[0][-1])
                last = key
        label = np.array(y, int)
        if not (label >= 0).any():
            return
        models, calibration = learn(views, label, [np.array([g.get(k, -1) if n < 0 else -1 for k, n in zip(keys, y, strict=True)], int) for g in given])
        rate = float(np.clip(label[label >= 0].mean(), 1e-3, 1 - 1e-3))
        for k, m in enumerate(models):
            w = m.weights()
            kept = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept) + 1, k)), pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], m.bias()))], names=["k", "at", "w"])
        rest = [*calibration[0], *calibration[1], float(np.log(rate / (1 - rate)))]
        yield pa.RecordBatch.from_arrays([pa.array([2] * len(rest)), pa.array(range(len(rest)), pa.int64()), pa.array(rest)], names=["k", "at", "w"])

    made = in_arrow(rows.repartition(1).sortWithinPartitions("key"), train, "k long, at long, w double").toPandas()
    if made.empty:
        return None
    parts = []
    for k in (0, 1):
        own = made[(made.k == k) & (made["at"] >= 0)]
        parts += [own["at"].to_numpy().astype(np.int32), own.w.to_numpy().astype(np.float32), float(made[(made.k == k) & (made["at"] < 0)].w.iloc[0])]
    return Views(*parts, tuple(made[made.k == 2].sort_values("at").w.tolist()), tuple(told))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, max_given: int = MAX_GIVEN, sure: float = SURE
) -> Views | None:
    """Both views, after rounds of exchange; None without labels. Needs text, source and lang.

    Of several labels of an id the lowest counts; null ids and labels teach nothing. Distinct labelled rows above max_labelled are sampled by a
    hash of id and text. In each round all rows without a label are scored, copies as one, and of those that a view gives
    `sure` or more, or 1 - sure or less, the surest SHARE of all, max_given at most, classes in their labelled proportion, teach the other view.
    """
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), (F.col(f"`{label}`") > 0).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    marked = F.broadcast(cut_lineage(bounded_sample(marked, F.col("id"), max_labelled, 19)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), "source", "lang", "text")
    known = sampled(rows.join(marked, "id").withColumn("key", F.xxhash64("id", "text")), max_labelled, 20)
    features = cut_lineage(_featurised(known))
    model = _trained(features, [{}, {}], [])
    if model is None:
        return None
    rest = rows.join(marked, "id", "left_anti").withColumn("key", F.xxhash64("text", "source", "lang"))
    rate = float(1 / (1 + np.exp(-model.calibration[4])))
    given: list[dict[int, int]] = [{}, {}]
    told: list[int] = []
    for _ in range(rounds):
        scored = score(rest, model, ["key"]).groupBy("key").agg(F.max("text_score").alias("p0"), F.max("meta_score").alias("p1"))
        scored = cut_lineage(scored)
        take = min(max_given, max(1, int(SHARE * scored.count())))
        new = 0
        for k in (0, 1):
            mine = F.col(f"p{k}")
            had = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in sorted(given[1 - k])], "key long"))
            left = scored.join(had, "key", "left_anti")
            high = left.filter(mine >= sure).orderBy(mine.desc(), "key").limit(int(np.ceil(take * rate))).collect()
            low = left.filter(mine <= 1 - sure).orderBy(mine, "key").limit(int(np.ceil(take * (1 - rate)))).collect()
            given[1 - k] |= {r["key"]: 1 for r in high} | {r["key"]: 0 for r in low}
            new += len(high) + len(low)
        told.append(new)
        if not new:
            break
        chosen = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in sorted({*given[0], *given[1]})], "key long"))
        taught = _featurised(rest.join(chosen, "key", "left_semi").withColumn("y", F.lit(-1)))
        model = _trained(features.unionByName(taught), given, told)
    return Views(model.text_at, model.text_w, model.text_bias, model.meta_at, model.meta_w, model.meta_bias, model.calibration, tuple(told))


def score(docs: DataFrame, model: Views | None, keys: list[str]) -> DataFrame:
    """The key columns, text_score and meta_score, each view's calibrated probability of quality, and score, which combines them.

    Both log-odds are added and the prior's, which both hold, taken off once. Whole texts are read; null and empty texts, null
    sources and languages are values like others. Without a model all scores are 0.5. Repeated rows stay; an empty table gives an empty one.
    A key with the name of a column that comes out is refused with a ValueError; other columns may have any name.
    """
    refuse_clash(keys, ["text_score", "meta_score", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(*[F.col(f"`{k}`") for k in keys], F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = len(keys)
        if m:
            text_w, meta_w = np.zeros(1 << BITS, np.float32), np.zeros(1 << META_BITS, np.float32)
            text_w[m.text_at], meta_w[m.meta_at] = m.text_w, m.meta_w
            kept = text_w != 0
        hasher = PieceHasher()
        for batch in batches:
            a, b = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            prior = 0.0
            if m:
                for i, (s, lang, t) in enumerate(zip(*batch.columns[n:], strict=True)):
                    t = t.as_py()
                    a[i] = text_w[text_view(t, hasher, kept)].sum(dtype=np.float64)
                    b[i] = meta_w[meta_view(s.as_py(), lang.as_py(), t)].sum(dtype=np.float64)
                a, b = m.calibration[0] * (a + m.text_bias) + m.calibration[1], m.calibration[2] * (b + m.meta_bias) + m.calibration[3]
                prior = m.calibration[4]
            made = [pa.array(sigmoid(x)) for x in (a, b, a + b - prior)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*keys, "text_score", "meta_score", "score"])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return in_arrow(narrow, run, f"{kinds}, text_score double, meta_score double, score double")
