"""Evaluation metrics of rendered pages against what they should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"""\d{2}\.\d{2}\.\d{4}|\d{1,3}(?:['’ ]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"""


def norm(text: Column) -> Column:
    """Plain apostrophes, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "’‘´`\u00a0\u202f", "''''  "), r"\s+", " ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(norm(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def strip_markdown(line: Column) -> Column:
    t = F.trim(line)
    return F.when(t.startswith("#"), F.trim(F.regexp_replace(t, "^#+", ""))).when(t.startswith("- "), F.substring(t, F.lit(3), F.length(t))).otherwise(t)


def numeric_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    return F.transform(found, lambda t: F.when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), t).otherwise(F.regexp_replace(t, r"['’\s]", "")))


def _counts(df: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    return df.select(*keys, F.explode(items).alias("item")).groupBy(*keys, "item").agg(F.count(F.lit(1)).alias(name))


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, item, n): tokens that left has more often than right, and how many more."""
    a, b = _counts(left, keys, tokens(F.col(text)), "a"), _counts(right, keys, tokens(F.col(text)), "b")
    more = a.join(b, [*keys, "item"], "left").select(*keys, "item", (F.col("a") - F.coalesce("b", F.lit(0))).alias("n"))
    return more.filter("n > 0")


def numeric_scores(expected: DataFrame, found: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, precision, recall, f1) of numeric tokens as multisets."""
    a, b = _counts(expected, keys, numeric_tokens(F.col(text)), "a"), _counts(found, keys, numeric_tokens(F.col(text)), "b")
    both = a.join(b, [*keys, "item"], "full").groupBy(*keys)
    hit = F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))))
    p, r = hit / F.greatest(F.sum(F.coalesce("b", F.lit(0))), F.lit(1)), hit / F.greatest(F.sum(F.coalesce("a", F.lit(0))), F.lit(1))
    return both.agg(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def kendall_tau(ranks: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """(keys, tau) of short sequences: each row carries its group's sequence as one array, so that no pairs are joined."""
    seq = ranks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias("s"))
    signs = lambda f: F.aggregate(
        F.transform("s", lambda x, i: F.size(F.filter(F.slice("s", i + 2, F.size("s")), lambda y: f(x, y)))), F.lit(0), lambda a, x: a + x
    )
    up, down = signs(lambda x, y: x < y), signs(lambda x, y: x > y)
    return seq.select(*keys, ((up - down) / F.greatest(up + down, F.lit(1))).alias("tau"))


def row_integrity(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows_n, rows_ok): expected rows (keys, label, cells array) whose cells and most label tokens share one line of the page."""
    own = lines.groupBy(*keys).agg(F.collect_list(norm(F.col("line"))).alias("lines"))
    want = rows.select(*keys, tokens(F.col("label")).alias("label"), F.transform("cells", norm).alias("cells"))
    fits = lambda ln: F.forall("cells", lambda c: F.contains(ln, c)) & (
        F.size(F.filter("label", lambda w: F.contains(ln, w))) >= 0.8 * F.greatest(F.size("label"), F.lit(1))
    )
    ok = F.exists(F.coalesce("lines", F.array().cast("array<string>")), fits)
    return want.join(own, keys, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(ok).alias("rows_ok"))


def key_values(pairs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ok): expected pairs (keys, label, value) of which value and most label tokens share one line."""
    rows = pairs.select(*keys, F.regexp_replace("label", ":+$", "").alias("label"), F.array("value").alias("cells"))
    return row_integrity(rows, lines, keys).select(*keys, F.col("rows_n").alias("n"), F.col("rows_ok").alias("ok"))


def character_error(expected: Column, found: Column) -> Column:
    return F.levenshtein(expected, found) / F.greatest(F.length(expected), F.lit(1))
