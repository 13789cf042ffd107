"""Scalar string operators as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.schema import Limits

# White space as Python's str.split sees it, controls, bidi overrides.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x00-\x08\x0A-\x1F\x7F-\x{9F}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
# Token classes.
AMOUNT = r"""^[(\-–−+]?(?:CHF|Fr\.|EUR|€|\$)?\s?[(\-–−]?\d{1,3}(?:[’'`´ ]\d{3})*(?:[.,]\d{1,2})?[)%]?$|^[(\-–−]?\d+(?:[.,]\d{1,2})[)%]?$|^[-–—]{1,2}$"""
OCR_AMOUNT = r"""^[(\-–−+_.]?\d{1,3}(?:[’'`´:,. ]\d{3})*(?:[.,:]\d{1,2})[.:,°)%]?$"""
DATEYEAR = r"^(?:\d{1,2}\.\d{1,2}\.(?:19|20)?\d{2}|(?:19|20)\d{2}(?:/\d{2,4})?)$"
NUMLIKE = r"""^[(\-–−+]?[\d'’.,/%]+[)%]?$"""
LETTERS3 = r"[A-Za-zÄÖÜäöüßÀ-ÿ]{3}"
# Thresholds of the OCR decision.
MIN_IMAGE_COVER, FULL_PAGE_COVER, STAMP_MAX_CHARS = 0.30, 0.85, 200
MIN_USABLE_CHARS, MIN_ALPHA_TOKENS, MARK_RATE, GARBAGE_RATE, GARBAGE_MIN_LEN = 20, 2, 0.05, 0.15, 4
NUMERIC_TOKEN = r"""^[\d'’.,:/%+\-()\[\]]*\d[\d'’.,:/%+\-()\[\]]*$"""
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
VOWELS = "aeiouyäöüéèêàâôûïîœæø"
PLAIN_PUNCT = r"""[^\p{L}\p{Nd}.,;:!?'"()\[\]{}\-–—/\\&%+*=<>#@§°_|~`´^’“”„«»…·•]"""
# PDF permission bits, in order.
PERMISSIONS = ((4, "print"), (8, "modify"), (16, "copy"), (32, "annotate"), (256, "form"), (512, "accessibility"), (1024, "assemble"), (2048, "print_high_res"))
# Token estimate, per digit, mark, letter and word.
TOKEN_COST = (1.07, 1.07, 0.24, 0.49)
URL_SCHEMES = ("http", "https", "mailto", "tel")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def canonicalize(text: Column, nfc: bool = False) -> Column:
    """NFC, CRLF and CR as LF, lines without trailing blanks, two newlines in a row at most, ends stripped.

    Idempotent. Text below U+0300 is NFC already: with nfc, only other text is sent to Python.
    """
    if nfc:
        text = F.coalesce(_nfc(F.when(text.rlike(r"[\x{0300}-\x{10FFFF}]"), text)), text)
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, rf"(?m)(?:(?!\n){BLANK})++$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def has_bidi(text: Column) -> Column:
    return text.rlike(BIDI)


def sanitize_scalar(value: Column, limits: Limits = Limits()) -> Column:
    """struct<value, category>: the stripped value, null if empty or hostile, cut at the cap; what was done to it, else null."""
    s = strip(value)
    hostile = has_control(s) | has_bidi(s)
    cap = limits.max_metadata_value_length
    kept = F.when(hostile | (s == ""), F.lit(None).cast("string")).otherwise(F.substring(s, 1, cap))
    category = F.when(hostile, "control_chars").when(F.length(s) > cap, "truncated")
    return F.struct(kept.alias("value"), category.alias("category"))


def path_error(path: Column, limits: Limits = Limits()) -> Column:
    """Why a path is refused, by class only, or null."""
    return (
        F.when(F.length(path) > limits.max_path_length, "too long")
        .when(F.instr(path, "\x00") > 0, "NUL")
        .when(has_bidi(path), "bidi override")
        .when(has_control(path), "control character")
    )


def metadata_url_ok(url: Column) -> Column:
    """Relative URLs pass; empty and scheme-relative ones don't; schemes must be listed."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, r"^([^:]*):", 1))
    return F.when((u == "") | u.startswith("//"), F.lit(False)).when(~u.contains(":"), F.lit(True)).otherwise(scheme.isin(*URL_SCHEMES))


def markdown_url_ok(url: Column) -> Column:
    """Only absolute URLs with a listed scheme."""
    return F.lower(F.regexp_extract(strip(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin(*URL_SCHEMES)


def is_amount(t: Column) -> Column:
    return t.rlike(AMOUNT) | t.rlike(OCR_AMOUNT)


def is_dateyear(t: Column) -> Column:
    return t.rlike(DATEYEAR)


def is_numlike(t: Column) -> Column:
    return t.rlike(NUMLIKE)


def has_letters(t: Column) -> Column:
    return t.rlike(LETTERS3)


def clean_cell(t: Column) -> Column:
    return strip(F.regexp_replace(F.translate(t, "|\n", "/ "), r"[ \t\xA0\x{202F}]+", " "))


def lint_row(t: Column) -> Column:
    """One line without tabs and without a sentence boundary inside."""
    t = strip(F.regexp_replace(t, r"[ \t\xA0\x{202F}]+", " "))
    return F.regexp_replace(t, rf"(?<=[.!?]){BLANK}+(?=[A-ZÜÖÄ\d\"'(])", "")


def est_tokens(t: Column) -> Column:
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    marks = F.length(t) - digits - letters - F.regexp_count(t, F.lit(BLANK))
    d, p, a, w = TOKEN_COST
    return F.ceil(d * digits + p * marks + a * letters + w * F.size(words(t))).cast("long")


def pdf_date(value: Column) -> Column:
    """ISO 8601 of a PDF date, as precise as it is; an offset that doesn't parse is Z; null if there's no year."""
    g = lambda k: F.regexp_extract(value, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(.*)$", k)
    zone = F.regexp_replace(g(7), "'", "")
    offset = F.when(zone.rlike(r"^[+\-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).when(
        zone.rlike(r"^[+\-]\d{2}$"), F.concat(zone, F.lit(":00"))
    )
    day = F.concat(g(1), F.when(g(2) != "", F.concat(F.lit("-"), g(2))).otherwise(""), F.when(g(3) != "", F.concat(F.lit("-"), g(3))).otherwise(""))
    or0 = lambda k: F.when(g(k) != "", g(k)).otherwise("00")
    clock = F.concat(F.lit("T"), g(4), F.lit(":"), or0(5), F.lit(":"), or0(6), F.coalesce(offset, F.lit("Z")))
    return F.when(g(1) != "", F.concat(day, F.when(g(4) != "", clock).otherwise("")))


def permissions(bits: Column) -> Column:
    """Names of the granted rights, or null if there are none."""
    names = F.concat_ws(",", *[F.when(bits.bitwiseAND(F.lit(m)) != 0, n) for m, n in PERMISSIONS])
    return F.nullif(names, F.lit(""))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def _token_is_garbage(t: Column) -> Column:
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    odd = F.regexp_count(t, F.lit(PLAIN_PUNCT))
    no_vowel = (letters >= 8) & ~F.lower(t).rlike(f"[{VOWELS}]")
    marked = t.contains("(cid:") | t.contains("�") | t.rlike(PRIVATE_USE)
    return F.when(marked, True).when(t.rlike(NUMERIC_TOKEN), False).otherwise(((letters == 0) & (digits == 0)) | (odd / F.length(t) > 0.30) | no_vowel)


def layer_is_garbage(text: Column) -> Column:
    """Too many unmapped glyphs for the tokens there are, or too many long tokens that are no words."""
    tokens = words(text)
    marks = F.regexp_count(text, F.lit(r"\(cid:\d+\)|\x{FFFD}|" + PRIVATE_USE))
    long_ = F.filter(tokens, lambda t: F.length(t) >= GARBAGE_MIN_LEN)
    bad = F.size(F.filter(long_, _token_is_garbage))
    return (F.size(tokens) > 0) & ((marks / F.greatest(F.size(tokens), F.lit(1)) > MARK_RATE) | (bad / F.greatest(F.size(long_), F.lit(1)) > GARBAGE_RATE))


def layer_is_usable(text: Column) -> Column:
    s = strip(text)
    alphabetic = F.size(F.filter(words(s), lambda t: F.regexp_count(t, F.lit(r"\p{L}")) >= 2))
    return (F.length(s) >= MIN_USABLE_CHARS) & ~layer_is_garbage(s) & (alphabetic >= MIN_ALPHA_TOKENS)


def decide_page(text: Column, cover: Column, use_ocr: str = "auto") -> Column:
    """struct<needs_ocr, keep_text_layer, reason> of a page; use_ocr is auto, always or never."""
    t = strip(F.coalesce(text, F.lit("")))

    def out(needs: bool, keep: bool, reason: str) -> Column:
        return F.struct(F.lit(needs).alias("needs_ocr"), F.lit(keep).alias("keep_text_layer"), F.lit(reason).alias("reason"))

    if use_ocr == "never":
        return out(False, True, "ocr_disabled")
    rules = F.when(cover < MIN_IMAGE_COVER, out(False, True, "no_image"))
    if use_ocr == "always":
        return rules.otherwise(out(True, False, "forced"))
    return (
        rules.when(t == "", out(True, False, "no_text"))
        .when(layer_is_garbage(t), out(True, False, "garbage_text"))
        .when((cover >= FULL_PAGE_COVER) & (F.length(t) < STAMP_MAX_CHARS), out(True, True, "full_page_scan"))
        .when(layer_is_usable(t), out(False, True, "usable_text"))
        .when(F.length(t) < MIN_USABLE_CHARS, out(True, True, "short_text"))
        .otherwise(out(True, True, "sparse_text"))
    )
