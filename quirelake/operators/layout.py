"""Layout statistics over word boxes, each a plan of groups and windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

# Page numbers and scanner stamps; where furniture lies and how often it repeats; headings by size.
PAGE_NUMBER = r"(?i)^(?:(?:seite|page|pag\.?|p\.|s\.)\s*)?[-–]?\s*\d{1,4}\s*[-–]?(?:\s*(?:von|of|/|de|di|sur)\s*\d{1,4})?$"
STAMP = r"(?i)^(?:gescannt|scanned|scan\b|eingegangen|received|fax\s*(?:from|von))|\d{1,2}[./]\d{1,2}[./]\d{2,4}\s+\d{1,2}:\d{2}"
BAND, REPEATS = 0.09, 0.4
HEADING_RATIO, HEADING_RATIO_OCR, HEADING_MIN_CHARS = 1.15, 1.3, 3
SKEW_MIN, SKEW_WORDS, SKEW_WIDTH = 0.0015, 4, 100.0
UNIT = 4.0
#: Cells of page, line and bin that are counted at a time.
_CELLS = 1 << 21


def masked(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"\d+", "#"))


def furniture(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """lines (doc, page, text, y0, y1, height) with furniture: page numbers, stamps, and what repeats in a band from its second page on."""
    n = lines.groupBy(doc).agg(F.countDistinct(page).alias("n"))
    in_band = (F.col("y1") < BAND * F.col("height")) | (F.col("y0") > (1 - BAND) * F.col("height"))
    marked = lines.withColumns({"mask": masked(F.col("text")), "top": F.col("y0") < 0.5 * F.col("height"), "in_band": in_band})
    seen = marked.filter("in_band").groupBy(doc, "mask", "top").agg(F.countDistinct(page).alias("pages"), F.min(page).alias("first_page"))
    joined = marked.join(seen, [doc, "mask", "top"], "left").join(n, doc)
    text = F.trim("text")
    repeats = (F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.lit(REPEATS) * F.col("n")))) & (F.col(page) != F.col("first_page"))
    verdict = F.col("in_band") & (text.rlike(PAGE_NUMBER) | text.rlike(STAMP) | repeats)
    return joined.withColumn("furniture", F.coalesce(verdict, F.lit(False))).drop("mask", "top", "in_band", "pages", "first_page", "n")


def page_unit(words: DataFrame, keys: list[str]) -> DataFrame:
    """Median width of a character of each page's words of three letters or more, else 4 points."""
    wide = F.when((F.length("text") >= 3) & ~F.col("rotated"), (F.col("x1") - F.col("x0")) / F.length("text"))
    return words.groupBy(*keys).agg(F.coalesce(F.median(wide), F.lit(UNIT)).alias("unit"))


def skew(words: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Median slope of each page's long lines; next to none counts as none."""
    x = (F.col("x0") + F.col("x1")) / 2
    by_line = words.groupBy(*keys, line).agg(F.regr_slope(F.col("y1"), x).alias("slope"), F.count(F.lit(1)).alias("n"), (F.max("x1") - F.min("x0")).alias("width"))
    slopes = by_line.groupBy(*keys).agg(F.median(F.when((F.col("n") >= SKEW_WORDS) & (F.col("width") >= SKEW_WIDTH), F.col("slope"))).alias("slope"))
    return slopes.withColumn("slope", F.when(F.abs("slope") >= SKEW_MIN, F.col("slope")).otherwise(0.0))


def deskew(words: DataFrame, slopes: DataFrame, keys: list[str]) -> DataFrame:
    x = (F.col("x0") + F.col("x1")) / 2
    return words.join(slopes, keys).withColumns({"y0": F.col("y0") - F.col("slope") * x, "y1": F.col("y1") - F.col("slope") * x}).drop("slope")


def body_stats(words: DataFrame, doc: str) -> DataFrame:
    """(doc, body_em, body_bold_ratio): the size, to half points, of most characters, the smaller of equals; the share of bold ones."""
    sized = words.withColumn("em", F.rint(F.col("size") * 2) / 2).withColumn("chars", F.length("text"))
    by_size = sized.groupBy(doc, "em").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("bold"), F.col("chars")).otherwise(0)).alias("bold"))
    return by_size.groupBy(doc).agg(F.max_by("em", F.struct("chars", -F.col("em"))).alias("body_em"), (F.sum("bold") / F.sum("chars")).alias("body_bold_ratio"))


def heading_levels(words: DataFrame, doc: str, ocr: bool = False) -> DataFrame:
    """(doc, em, level) of the sizes well above the body's with three characters or more: the largest is 1, none beyond 3."""
    sized = words.withColumn("em", F.rint(F.col("size") * 2) / 2).groupBy(doc, "em").agg(F.sum(F.length("text")).alias("chars"))
    big = sized.join(body_stats(words, doc), doc).filter((F.col("em") >= (HEADING_RATIO_OCR if ocr else HEADING_RATIO) * F.col("body_em")) & (F.col("chars") >= HEADING_MIN_CHARS))
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.col("em").desc()))
    return big.select(doc, "em", F.least(rank, F.lit(3)).alias("level"))


def _free_columns(rows: pa.Table, min_lines: int) -> pa.RecordBatch:
    """What gutter_runs returns of whole pages, their rows side by side: keys, line, lo, hi.

    Pages of one number of lines form a grid of page, line and bin, of _CELLS cells at a time; a run is carried from line to line for all of its bins.
    """
    import numpy as np
    import pyarrow as pa

    names, far = rows.column_names[:-3], np.iinfo(np.int64)
    first = np.flatnonzero(_changes(rows, names))
    page = np.repeat(np.arange(len(first)), np.diff([*first, len(rows)]))
    line, lo, hi = (rows.column(k) for k in ("line", "lo", "hi"))
    has_line, boxed = (~np.asarray(line.is_null()), ~np.asarray(lo.is_null()) & ~np.asarray(hi.is_null()))
    one, other = np.asarray(lo.fill_null(far.max)), np.asarray(hi.fill_null(far.min))
    start, end = np.minimum.reduceat(one, first), np.maximum.reduceat(other, first)
    spanned = (start != far.max) & (end != far.min)
    start, end = np.minimum(start, end), np.maximum(start, end)
    width = np.where(spanned, end - start + 1, 0)

    line = np.asarray(line.fill_null(0))
    order = np.lexsort((line, page))
    order = order[has_line[order]]
    p, at = page[order], line[order]
    fresh = np.append(True, (np.diff(p) != 0) | (np.diff(at) != 0))[: len(p)]
    slots = np.bincount(p[fresh], minlength=len(first))
    slot = np.cumsum(fresh) - 1 - (np.cumsum(slots) - slots)[p]
    broken = np.append(True, (np.diff(p) != 0) | (np.diff(at) != 1))[: len(p)]  # a line after another than the one before

    found = []
    held = spanned & (slots >= max(min_lines, 1))
    for n in np.unique(slots[held]):
        pages = np.flatnonzero(held & (slots == n))
        pages = pages[np.argsort(width[pages], kind="stable")]
        while len(pages):
            some = pages[: max(1, int(np.searchsorted(width[pages] * np.arange(1, len(pages) + 1) * n, _CELLS, side="right")))]
            pages = pages[len(some) :]
            q, widest = len(some), int(width[some].max())
            place = np.full(len(first), -1)
            place[some] = np.arange(q)
            mine = place[p] >= 0
            g, k, r = place[p[mine]], slot[mine], order[mine]
            breaks = np.zeros((q, n), bool)
            breaks[g[fresh[mine]], k[fresh[mine]]] = broken[mine][fresh[mine]]
            box = boxed[r]
            g, k, r = g[box], k[box], r[box]
            a, b = np.minimum(one[r], other[r]) - start[some][g], np.maximum(one[r], other[r]) + 1 - start[some][g]
            step = max(1, _CELLS // (q * int(n)))
            for w in range(0, widest, step):
                wide = min(step, widest - w)
                edges = np.zeros((q, n, wide + 1), np.int32)
                np.add.at(edges, (g, k, np.clip(a - w, 0, wide)), 1)
                np.add.at(edges, (g, k, np.clip(b - w, 0, wide)), -1)
                taken = np.cumsum(edges, axis=2, dtype=np.int32)[:, :, :wide] > 0
                run, best = np.zeros((q, wide), np.int32), np.zeros((q, wide), np.int32)
                for x in range(n):
                    run[breaks[:, x]] = 0
                    run += 1
                    run[taken[:, x]] = 0
                    np.maximum(best, run, out=best)
                best[np.arange(w, w + wide) >= width[some][:, None]] = 0
                y, z = np.nonzero(best >= max(min_lines, 1))
                found.append((some[y], start[some][y] + w + z, best[y, z].astype(np.int64)))
    of, bins, runs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keys = rows.select(names).take(pa.array(first[of])).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in keys.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(bins, pa.int64()), pa.array(runs, pa.int64())], [*names, "bin", "run"])


def _changes(rows: pa.Table, names: list[str]):
    """Whether a row is the first of its keys, the rows being sorted."""
    import numpy as np

    out = np.zeros(len(rows), bool)
    out[:1] = True
    for n in names:
        codes = np.asarray(rows.column(n).combine_chunks().dictionary_encode().indices)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def gutter_runs(words: DataFrame, keys: list[str], line: str = "line", bin_width: float = 2.0, min_lines: int = 5) -> DataFrame:
    """(keys, bin, run): 2-point columns of a page that stay free of words over min_lines lines in a row or more.

    Words go to their page's task as the first and last bin that they cover; bins and lines are spread there, in arrays that are counted and left, so that
    neither is shuffled. Lines in a row have numbers in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        kept: list[pa.RecordBatch] = []  # rows of the page that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([kept[-1].slice(kept[-1].num_rows - 1), batch] if kept else [batch])
            last = int(np.flatnonzero(_changes(joined, keys))[-1]) - bool(kept)
            if last < 0 or not kept and not last:
                kept.append(batch)
                continue
            yield _free_columns(pa.Table.from_batches([*kept, batch.slice(0, last)]).combine_chunks(), min_lines)
            kept = [batch.slice(last)]
        if kept:
            yield _free_columns(pa.Table.from_batches(kept).combine_chunks(), min_lines)

    spans = words.select(*keys, F.col(line).cast("long").alias("line"), F.floor(F.col("x0") / bin_width).alias("lo"), F.floor(F.col("x1") / bin_width).alias("hi")).dropna(subset=keys)
    kinds = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys)
    return spans.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, bin long, run long")
