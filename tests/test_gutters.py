"""Free columns of pages against counting every bin of every line."""

import random
from collections import defaultdict
from itertools import groupby

import pytest

from quirelake.operators import layout


def plain(words, min_lines):
    pages = defaultdict(list)
    for page, line, x0, x1 in words:
        pages[page].append((line, x0, x1))
    out = set()
    for page, ws in pages.items():
        lo, hi = min(int(a // 2) for _, a, _ in ws), max(int(b // 2) for _, _, b in ws)
        taken = {(line, k) for line, a, b in ws for k in range(int(a // 2), int(b // 2) + 1)}
        for k in range(lo, hi + 1):
            free = sorted({line for line, _, _ in ws if (line, k) not in taken})
            runs = [len(list(g)) for _, g in groupby(enumerate(free), lambda x: x[1] - x[0])]
            if max(runs, default=0) >= min_lines:
                out.add((page, k, max(runs)))
    return out


@pytest.mark.parametrize("cells", [1 << 21, 200])
def test_free_columns(spark, monkeypatch, cells):
    monkeypatch.setattr(layout, "_CELLS", cells)
    rng, words = random.Random(7), []
    for page in range(60):
        wide = rng.choice([40, 90, 300])
        for line in rng.sample(range(30), rng.randint(1, 22)):
            for _ in range(rng.randint(1, 3)):
                a = rng.uniform(-20, wide)
                words.append((page, line, a, a + rng.uniform(0, 30)))
    df = spark.createDataFrame(words, "page long, line long, x0 double, x1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # pages lie across batches
    try:
        for n in (1, 3, 5):
            got = layout.gutter_runs(df, ["page"], min_lines=n).collect()
            assert {tuple(r) for r in got} == plain(words, n) and len(got) == len(plain(words, n))
        assert not layout.gutter_runs(df.limit(0), ["page"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bins_are_no_rows_before_the_result(spark):
    """Pages of 40 lines across a million bins: bins as rows of their own would be 40 million a page."""
    words = spark.range(3).selectExpr("id as page", "explode(sequence(1, 40)) as line").selectExpr("page", "cast(line as long) as line", "explode(array(0D, 2000000D)) as x0").selectExpr("*", "x0 + 5 as x1")
    found = layout.gutter_runs(words, ["page"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "sequence(lo" not in plan and "FLOOR" in plan.upper()
    assert layout.gutter_runs(words, ["page"], bin_width=2000.0).count() == 3 * 999
    assert found.filter("page = 0").count() == 1_000_003 - 2 * 3
