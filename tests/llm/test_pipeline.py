"""The pipeline's stages: what they keep, planted cases, and odd input."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from quirelake.llm import stages


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert list(out.columns) == [*docs.columns, "copies", "source_size", "target"]
    assert 0 < len(out) < docs.count()
    assert out.doc_id.is_unique and out.copies.between(1, 3).all()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_go_and_others_stay(spark, sf):
    rows = [(i, " ".join(words(i, 40 + 20 * (i % 30)))) for i in range(120)]
    rng = random.Random(5)
    copies = 0
    for i in range(0, 120, 2):
        w = rows[i][1].split()
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = "edited"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, rows[i][1].split()))
        if len(a & b) >= 0.8 * len(a | b):
            rows.append((1000 + i, " ".join(w)))
            copies += 1
    rows += [(2000 + i, rows[i][1].upper()) for i in range(1, 120, 10)] + [(5, rows[5][1])] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in stages.dedup_stage(spark, docs, sf).collect()]
    assert len(kept) == len(set(kept))
    assert set(range(120)) <= set(kept)
    left = [d for d in kept if d >= 120]
    assert not [d for d in left if d >= 2000]
    assert not left and copies > 30


def test_decontamination(spark, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = " ".join(words(1, 300))
    rows = [(i, f"{clean} {t}. {clean}" if i % 2 else clean) for i, t in enumerate(items)] + [(None, items[0]), (None, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.decontamination_stage(spark, docs.filter("doc_id is not null"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(items)) if i % 2 == 0]
    assert [r.text for r in stages.decontamination_stage(spark, docs.filter("doc_id is null"), sf).collect()] == [clean]
    shared = spark.createDataFrame([(1, items[0]), (1, clean), (2, clean)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in stages.decontamination_stage(spark, shared, sf).collect()) == [(1, clean), (2, clean)]


def test_odd_rows_go_through_every_stage(spark, sf):
    text = " ".join(words(3, 80))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, None, None, 1), (2, text, None, None, 1), (3, text + " end", "en", "s", 1), (None, " ".join(words(4, 90)), "en", "t", 1), (9, " ".join(words(9, 40_000)), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "score", "row", "k_id", "version", "copies", "target", "m_size", "source_size", "level", "p", "__text"):
        docs = docs.withColumn(name, F.lit("x"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, sf)
            if i < 4:
                assert out.columns == part.columns
            assert out.count() <= part.count()
    assert stages.quality_stage(spark, docs, sf).filter("text is null or text = ''").count() == 0
    assert [r.doc_id for r in stages.dedup_stage(spark, docs.filter("doc_id in (2, 3)"), sf).collect()] == [2]


def test_guard_of_the_entry_module():
    """Only the entry module forgives a missing subpackage."""
    for path in ("corpus_pipeline.py", "quirelake/llm/stages.py", "quirelake/llm/queries.py"):
        assert not re.search(r"except (ModuleNotFound|Import)Error", open(path).read())
