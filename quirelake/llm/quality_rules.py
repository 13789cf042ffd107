"""Quality rules: text statistics, and ordered decision lists learned from labelled ones by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import in_arrow, refuse_clash, with_text
from quirelake.llm.sampling import labelled

#: Labelled rows that rules are learned from at most; their statistics, not their texts, go to the driver.
MAX_TRAIN = 20_000
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = b" \t\n\v\f\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 1 << 21:
        codes = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # three ids don't fit 64 bits: number the pairs first
        codes = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; null counts as empty. Letters A-Z count as upper, `!?.,;:` as marks, lines are those with a word."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_BLANK)]
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    chars = len(text or "") - gone(_BLANK)
    return len(words), chars, gone(_SYMBOLS), len(lines) - len(set(lines)), _repeat_words(words), gone(_UPPER), gone(b"!?.,;:"), len(lines)


def with_counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and COUNTS of each whole text; null counts as empty, repeated rows stay, an empty table gives an empty one.

    A key with the name of a count is refused with a ValueError; other columns may have any name.
    """
    refuse_clash(keys, list(COUNTS))
    narrow, texts = with_text(df, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t.as_py()) for t in texts(batch)]
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *COUNTS])

    kinds = ", ".join([*(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} long" for c in COUNTS)])
    return in_arrow(narrow, run, kinds)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


def statistics() -> dict[str, Column]:
    """What a condition may test, from COUNTS."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "line_words": _share("n_words", "n_lines"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.threshold if self.above else stats[self.name] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, steps: int) -> Condition | None:
    """The condition with the largest FOIL gain on the rows inside, thresholds lying between neighbouring values or quantiles."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best, most = None, 1e-9
    for name in sorted(x):
        values, label = x[name][inside], bad[inside]
        order = np.argsort(values, kind="stable")
        values, pos = values[order], np.cumsum(label[order])
        ends = np.flatnonzero(values[1:] > values[:-1])
        if len(ends) > steps:
            ends = ends[np.linspace(0, len(ends) - 1, steps).astype(int)]
        if not len(ends):
            continue
        below_p, below = pos[ends], ends + 1
        for above, p, n in ((False, below_p, below - below_p), (True, p0 - below_p, n0 - (below - below_p))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > most:
                most, best = float(gain[k]), Condition(name, above, float((values[ends[k]] + values[ends[k] + 1]) / 2))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.8, steps: int = 256) -> list[Rule]:
    """Rules for bad rows, in order: each grown on two thirds of the rows left, pruned on the others, and then its rows set aside.

    Growing adds the condition with the largest FOIL gain until no good row is covered. Pruning cuts last
    conditions for the best (bad - good) / (bad + good) on the pruning rows. A rule whose precision there, by
    Laplace's rule over all rows left, stays under `precision` ends the list.
    """
    n = len(bad)
    third = np.arange(n) % 3 == 0
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (bad & left).any():
        grow, prune = left & ~third, left & third
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (inside & ~bad).any() and (inside & bad).any():
            c = _best_condition(x, bad, inside, steps)
            if c is None:
                break
            rule += (c,)
            inside &= c.holds(x)
        if not rule:
            break

        def worth(k: int, rule: Rule = rule, prune: np.ndarray = prune) -> float:
            hit = _covers(rule[:k], x, n) & prune
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0

        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:k]
        hit = _covers(rule, x, n) & left
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        on_prune = hit & third
        checked = ((on_prune & bad).sum() + 1) / (on_prune.sum() + 2)
        if p < 2 or (p + 1) / (p + q + 2) < precision or checked < precision - 0.15:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def keeps(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: false at the first rule that holds, else true."""
    stats = statistics()
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(stats)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> list[Rule]:
    """Rules from the labelled rows that pass the base rules. Of several labels of an id the lowest counts; null ids and labels teach nothing.

    Distinct labelled rows above max_train are sampled by a hash of id and text, a row that repeats is one; their statistics are gathered by the driver.
    """
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    stats = statistics()
    rows = with_counts(labelled(docs, marked, doc_id, text, max_train, 17), ["key", "y"]).filter(~base_failed())
    rows = rows.select("key", "y", *[c.alias(n) for n, c in stats.items()]).dropDuplicates(["key"]).toPandas().sort_values("key")
    return learn_rules({n: rows[n].to_numpy() for n in stats}, (rows["y"] <= 0).to_numpy())
