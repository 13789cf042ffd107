"""Around OCR engines: which pages need one, what fits the budget, and what to make of their output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import strip
from quirelake.schema import Limits

# Bounds of the render resolution, when a page is tried again with another segmentation.
MIN_DPI, MAX_DPI = 72, 300
RETRY_MIN_CONF, RETRY_MIN_INK = 70.0, 0.02


def image_cover(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each page that its images cover: boxes (keys, bx0..by1, px0..py1) clipped to the page, summed, 1 at most."""
    wide = F.greatest(F.lit(0.0), F.least("bx1", "px1") - F.greatest("bx0", "px0"))
    high = F.greatest(F.lit(0.0), F.least("by1", "py1") - F.greatest("by0", "py0"))
    area = (F.max("px1") - F.max("px0")) * (F.max("py1") - F.max("py0"))
    return boxes.groupBy(*keys).agg(F.least(F.lit(1.0), F.when(area > 0, F.sum(wide * high) / area).otherwise(0.0)).alias("cover"))


def render_dpi(width_px: Column, width_pt: Column) -> Column:
    """The image's own resolution to tens, between 72 and 300."""
    native = F.greatest(F.lit(MIN_DPI), F.rint(width_px / (width_pt / 72.0)))
    return F.greatest(F.lit(MIN_DPI), (F.rint(F.least(F.lit(MAX_DPI), native) / 10.0) * 10).cast("int"))


def schedule(pages: DataFrame, doc: str, page: str, limits: Limits = Limits()) -> DataFrame:
    """pages (doc, page, needs_ocr, megapixels, failed) with status: not_needed, oversize, skipped, failed or done.

    Pages are tried in document order until the cap; oversize pages are never tried and don't count.
    """
    tries = F.col("needs_ocr") & (F.col("megapixels") <= limits.max_ocr_image_megapixels)
    place = F.sum(tries.cast("int")).over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    status = (
        F.when(~F.col("needs_ocr"), "not_needed")
        .when(F.col("megapixels") > limits.max_ocr_image_megapixels, "oversize")
        .when(place > limits.max_ocr_pages, "skipped")
        .when(F.col("failed"), "failed")
        .otherwise("done")
    )
    return pages.withColumn("status", status)


def summary(pages: DataFrame, doc: str) -> DataFrame:
    """Counts by document of pages read by OCR, skipped, failed and taken from the text layer, and the mean confidence."""
    count = lambda c: F.count_if(c).alias
    return pages.groupBy(doc).agg(
        count(F.col("status") == "done")("ocr_pages"),
        count(F.col("status").isin("skipped", "oversize"))("skipped_pages"),
        count(F.col("status") == "failed")("failed_pages"),
        count((F.col("status") == "not_needed") & (F.coalesce("text", F.lit("")) != ""))("text_pages"),
        F.round(F.avg(F.when(F.col("status") == "done", F.col("conf"))), 2).alias("mean_conf"),
    )


def cache_key(content: Column, rotation: Column, dpi: Column, language: str, psm: int, engine: str, preproc: str) -> Column:
    """Hash of everything that changes what an engine reads."""
    told = F.concat(content, F.lit("|rot="), rotation.cast("string"), F.lit("|dpi="), dpi.cast("string"), F.lit(f"|lang={language}|psm={psm}|engine={engine}|pre={preproc}"))
    return F.sha2(told, 256)


def cache_misses(pages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return pages.join(cache.select(key), key, "left_anti")


def cache_hits(pages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return pages.join(cache, key)


def parse_tsv(pages: DataFrame, keys: list[str], tsv: str = "tsv", scale: float = 1.0) -> DataFrame:
    """One row a word of an engine's TSV: text, box in points, conf, block, par, line, line_h; word is its place.

    Level 4 rows give the height of the line for the words below; malformed rows and blank words are left out.
    """
    rows = pages.select(*keys, F.posexplode(F.split(F.col(tsv), "\n")).alias("at", "raw")).withColumn("f", F.split("raw", "\t"))
    num = lambda k: F.col("f")[k].try_cast("double")
    rows = rows.filter((F.size("f") == 12) & F.col("f")[0].isin("4", "5"))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    high = F.last(F.when(F.col("f")[0] == "4", num(9)), ignorenulls=True).over(order)
    w = rows.withColumn("high", high).filter((F.col("f")[0] == "5") & (strip(F.col("f")[11]) != ""))
    ints = {"block": 2, "par": 3, "line": 4}
    out = w.select(
        *keys,
        "at",
        strip(F.col("f")[11]).alias("text"),
        F.round(num(6) * scale, 2).alias("x0"),
        F.round(num(7) * scale, 2).alias("y0"),
        F.round((num(6) + num(8)) * scale, 2).alias("x1"),
        F.round((num(7) + num(9)) * scale, 2).alias("y1"),
        num(10).alias("conf"),
        *[F.col("f")[k].try_cast("int").alias(n) for n, k in ints.items()],
        F.round(F.when(F.col("high") > 0, F.col("high")).otherwise(num(9)) * scale, 2).alias("line_h"),
    )
    return out.dropna(subset=["x0", "y0", "x1", "y1", "conf", "block", "par", "line"])


def words_to_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """Text in the engine's order: blanks between words, a line break where the line changes, an empty line where the block does."""
    order = Window.partitionBy(*keys).orderBy("at")
    before = lambda c: F.lag(c).over(order)
    gap = (
        F.when(before("block").isNull(), "")
        .when(before("block") != F.col("block"), "\n\n")
        .when((before("par") != F.col("par")) | (before("line") != F.col("line")), "\n")
        .otherwise(" ")
    )
    marked = words.withColumn("piece", F.concat(gap, F.col("text")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return marked.groupBy(*keys).agg(joined.alias("text"), F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 2).alias("mean_conf"))


def frame_to_page(words: DataFrame, m: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Word boxes through an affine map (x', y') = (ax + cy + e, bx + dy + f), corners put in order again."""
    a, b, c, d, e, f = m
    xs = [F.col(x) * a + F.col(y) * c + e for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [F.col(x) * b + F.col(y) * d + f for x in ("x0", "x1") for y in ("y0", "y1")]
    scale = ((a * a + b * b) ** 0.5 + (c * c + d * d) ** 0.5) / 2.0
    boxes = {"x0": F.round(F.least(*xs), 2), "y0": F.round(F.least(*ys), 2), "x1": F.round(F.greatest(*xs), 2), "y1": F.round(F.greatest(*ys), 2)}
    return words.withColumns(boxes | {"line_h": F.round(F.col("line_h") * scale, 2)})


def invert(m: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = m
    det = a * d - b * c
    if abs(det) < 1e-12:
        return (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    p, q, r, s = d / det, -b / det, -c / det, a / det
    return (p, q, r, s, -(e * p + f * r), -(e * q + f * s))


def should_retry(conf: Column, ink: Column, rules: Column, text_lines: Column) -> Column:
    return F.coalesce((conf < RETRY_MIN_CONF) & (ink >= RETRY_MIN_INK), F.lit(False)) | ((rules >= 3) & (text_lines < 0.5 * (rules - 1)))


def better(first: Column, second: Column) -> Column:
    """Of two results (struct<n_words, conf, ...>) the second if it has more words at hardly less confidence."""
    conf = lambda r: F.coalesce(r["conf"], F.lit(0.0))
    return F.when((second["n_words"] > first["n_words"]) & (conf(second) >= conf(first) - 5.0), second).otherwise(first)


def page_text(layer: Column, decision: Column, ocr: Column) -> Column:
    """The layer, or OCR's text in its place or after it."""
    own, read = strip(F.coalesce(layer, F.lit(""))), strip(F.coalesce(ocr, F.lit("")))
    return F.when(~decision["needs_ocr"] | (read == ""), own).when(decision["keep_text_layer"] & (own != ""), F.concat_ws("\n\n", own, read)).otherwise(read)
