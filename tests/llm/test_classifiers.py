"""Toxicity, language, quality rules and co-training: held-out accuracy, plain counts and odd input."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import cotraining, language, linear, quality_rules, queries, sampling, toxicity
from quirelake.llm.common import held_out, unit_hash

SF01 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    some = labels.filter(unit_hash(F.col("doc_id"), 1) < 0.5)
    return docs.join(some.select("doc_id"), "doc_id", "left_semi").cache(), some


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_held_out(spark, larger):
    docs, labels = larger
    model = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    got = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.85
    assert got[got.score >= 0.3].toxic.mean() > 0.8
    assert 0 < len(model[0]) < 20_000
    assert toxicity.fit(docs.repartition(5), labels.filter(~held_out(F.col("doc_id"))))[2] == model[2]


def test_language_held_out(spark, larger):
    docs, _ = larger
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    got = language.identify(docs, model, ["doc_id", "lang"]).filter(held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()
    far = language.identify(spark.createDataFrame([(1, "Ωμέγα και άλφα " * 20)], "doc_id long, text string"), model, ["doc_id"], reject=True).first()
    assert far.far and far.lang_pred == "und"


def test_quality_rules_separate(spark, larger):
    docs, labels = larger
    rules = quality_rules.fit(docs, labels)
    assert rules
    got = quality_rules.with_counts(docs, ["doc_id"]).filter(~quality_rules.base_failed()).withColumn("kept", quality_rules.keeps(rules)).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.05


def test_co_training_held_out(spark, larger):
    docs, labels = larger
    few = labels.filter(~held_out(F.col("doc_id"))).filter(unit_hash(F.col("doc_id"), 2) < 0.5)
    model = cotraining.fit(docs, few)
    got = cotraining.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97
    assert model.exchanged and model.exchanged[0] > 0
    assert abs(got.score.mean() - got.quality.mean()) < 0.08


def test_views_learn_from_each_other():
    """A view that starts with few labels learns from what the other is sure of."""
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 600)
    a = [np.array([10 + t, *(100 + rng.integers(0, 50, 3))], np.int32) for t in truth]
    b = [np.unique(np.array([20 + 2 * rng.integers(0, 40) + t], np.int32)) for t in truth]
    label = np.where(np.arange(600) < 40, truth, -1)
    none = np.full(600, -1)
    models, ((slope, offset), _) = cotraining.learn([a, b], label, [none, none])
    p = linear.sigmoid(slope * np.array([models[0].margin(x) for x in a]) + offset)
    told = np.where((label < 0) & (np.abs(p - 0.5) > 0.2), p > 0.5, -1).astype(int)
    taught, _ = cotraining.learn([a, b], label, [none, told])
    right = lambda m: np.mean([(m.margin(x) > 0) == (t == 1) for x, t in zip(b, truth, strict=True)])
    assert (told >= 0).sum() > 100
    assert right(taught[1]) > right(models[1]) + 0.1


def test_pseudo_labels_come_from_all_rows(spark, larger):
    """With a bound of 50 labels the surest of thousands of rows teach; all fit the plain scorer on whole texts."""
    docs, labels = larger
    model = cotraining.fit(docs, labels.filter(~held_out(F.col("doc_id"))), max_labelled=500, max_given=50)
    assert len(model.exchanged) <= cotraining.ROUNDS and 0 < model.exchanged[0] <= 104
    hasher = cotraining.PieceHasher()
    text_w, meta_w = dict(zip(model.text_at.tolist(), model.text_w.tolist(), strict=True)), dict(zip(model.meta_at.tolist(), model.meta_w.tolist(), strict=True))
    got = {r.doc_id: r for r in cotraining.score(docs, model, ["doc_id"]).collect()}
    c = model.calibration
    for r in docs.limit(40).collect():
        a = c[0] * (model.text_bias + sum(text_w.get(i, 0) for i in set(cotraining.text_view(r.text, hasher).tolist()))) + c[1]
        b = c[2] * (model.meta_bias + sum(meta_w.get(i, 0) for i in set(cotraining.meta_view(r.source, r.lang, r.text).tolist()))) + c[3]
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(a + b - c[4], -35, 35)))) < 1e-5


def test_pieces_are_hashed_alike_in_any_block():
    """Against a plain reading: a hash a piece, equal for equal pieces only, with its case and marks; blocks cut no piece."""
    texts = ["", " \t", "One two, ONE... a_b __ \u00c9T\u00c9 \u01c5\u00c5 x\u00b2 \u00a0 \U0001d400B \U0001f600\U0001f600! \ud800 9\x1c8 A1 \u2160\u0345", "word" * 3000 + " !" + "?" * 2500 + " end", "ab cd " * 50]
    seen: dict[str, int] = {}
    for text in texts:
        pieces = re.findall(r"\w+|[^\w\s]+", text)
        got = cotraining.PieceHasher()(text)
        assert len(got) == len(pieces)
        for piece, h in zip(pieces, got.tolist(), strict=True):
            assert seen.setdefault(piece, h) == h
            assert (h & 1, h >> 1 & 1) == (piece.isupper(), not piece.isalnum())
        for block in (1, 2, 7, 64):
            assert cotraining.PieceHasher(block)(text).tolist() == got.tolist()
    assert len(set(seen.values())) == len(seen)


def test_toxicity_is_the_plain_sum(spark, sf):
    """Scores of whole texts against a plain reading of the n-grams and skip-grams that the model kept."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    at, w, bias = toxicity.fit(docs, labels)
    weight = dict(zip(at.tolist(), w.astype(np.float32).tolist(), strict=True))
    odd, top = linear._ODD, (1 << 64) - 1
    for r in toxicity.score(docs, (at, w, bias), ["doc_id", "text"]).limit(40).collect():
        h = [linear.xxhash.xxh64_intdigest(x) for x in re.findall(r"[^\W_]+", (r.text or "").lower())]
        shift = 64 - toxicity.BITS
        found = {(x * odd[0] & top) >> shift for x in h}
        found |= {((x * odd[1] + y) * (odd[0] ^ 2) & top) >> shift for x, y in zip(h, h[1:], strict=False)}
        for gap in (1, 2):
            found |= {((x * odd[2] + y * (odd[3] ^ gap << 8)) * odd[0] & top) >> shift for x, y in zip(h, h[gap + 1 :], strict=False)}
        total = bias + sum(weight.get(i, 0.0) for i in found)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(total, -35, 35)))) < 1e-5


def test_samples_are_bounded_by_rows(spark):
    """Null and repeated ids, and repeated rows, add nothing over the bound."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)] + [(2, "same")] * 300, "doc_id long, text string")
    marked = spark.createDataFrame([(1, 1), (2, 0)], "id long, y int")
    got = sampling.labelled(docs, marked, "doc_id", "text", 100, 5)
    assert 40 < got.select("key").distinct().count() <= 110
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"))
    assert language.fit(nulls, max_train=50) is not None


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(1)
    model = linear.Ftrl(1000, l1=2.0)
    for _ in range(3000):
        y = rng.integers(0, 2)
        model.learn(np.unique(np.append(rng.integers(10, 1000, 5), y)), float(y))
    w = model.weights()
    assert w[0] < -1 and w[1] > 1
    assert (w != 0).sum() < 300


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t#|é\x85\x0b", max_size=80)))
def test_text_counts(text):
    assert quality_rules.text_counts(text)[:5] == plain_counts(text)


def test_rule_query_counts(spark, sf):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000").collect():
        g = got[r.doc_id]
        want = plain_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)


def test_decision_list_order():
    x = {"a": np.repeat([0.0, 1.0, 2.0, 3.0], 60), "b": np.tile(np.arange(60.0), 4)}
    bad = (x["a"] == 3) | ((x["a"] == 1) & (x["b"] > 40))
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(240, bool)
    for r in rules:
        hit |= quality_rules._covers(r, x, 240)
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn_rules(x, np.zeros(240, bool)) == []
    assert quality_rules.learn_rules({k: v[:0] for k, v in x.items()}, bad[:0]) == []


ODD = [(None, None, None, None), (1, "", "en", "s"), (2, "   \n", None, None), (2, "   \n", None, None), (3, "word " * 60_000, "de", ""), (None, "1234 %%", "en", "s"), (4, "die Katze sitzt auf der Matte", "de", "s")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("key", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n_words", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 1, 1), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        got = toxicity.score(docs, model, ["doc_id"])
        assert got.count() == len(ODD) and got.filter("score is null or score < 0 or score > 1").count() == 0
        rules = quality_rules.fit(docs, some)
        assert quality_rules.with_counts(docs, ["doc_id"]).withColumn("k", quality_rules.keeps(rules)).filter("k is not null").count() == len(ODD)
        views = cotraining.fit(docs, some)
        assert cotraining.score(docs, views, ["doc_id"]).filter("score between 0 and 1").count() == len(ODD)
    for frame in (docs, docs.filter("lang is null")):
        found = language.identify(docs, language.fit(frame), ["doc_id", "text"]).collect()
        assert all(r.lang_pred == "und" and r.score == 0 for r in found if not re.search("[a-z]", r.text or ""))
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0
    assert cotraining.score(empty, cotraining.fit(empty, labels), ["doc_id"]).count() == 0
    assert language.identify(empty, language.fit(empty), ["doc_id"]).count() == 0
    assert quality_rules.fit(empty, labels) == [] and quality_rules.with_counts(empty, ["doc_id"]).count() == 0
