"""Limits, options and the result's schema."""

from __future__ import annotations

from dataclasses import dataclass

#: One extraction as a row; child tables carry the same fields with the document's key.
EXTRACTION = (
    "spec_version string, source struct<mime_type:string, sha256:string, size_bytes:bigint, filename:string, path:string>, "
    "metadata struct<title:string, author:string, language:string, created:string, modified:string, page_count:int, word_count:bigint, extra:map<string,string>>, "
    "content struct<text:string, pages:array<struct<index:int, text:string, line_start:int, line_end:int>>, "
    "sections:array<struct<heading:string, level:int, text:string, line_start:int, line_end:int>>, markdown:string, "
    "sentences:array<struct<index:int, text:string, char_start:int, char_end:int, line_start:int, line_end:int, page_index:int, page_number:int, section_index:int>>, "
    "tables:array<struct<client_table_hint:string, title:string, headers:array<string>, rows:array<array<string>>, page:int, bbox:array<double>>>>, "
    "warnings array<string>, extractor struct<name:string, version:string>, error struct<kind:string, what:string, `limit`:double, observed:double>"
)
SPEC_VERSION = "1.3.0"

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Resource caps. Sentence and OCR caps keep what fits and count the rest; the others make an error row."""

    max_input_bytes: int = 100 * MIB
    max_pages: int = 10_000
    max_decompression_ratio: float = 100.0
    max_text_bytes: int = 50 * MIB
    max_recursion_depth: int = 256
    max_markdown_expansion_ratio: float = 3.0
    max_sentences: int = 100_000
    max_path_length: int = 4096
    max_metadata_value_length: int = 4096
    max_xmp_bytes: int = MIB
    max_ocr_pages: int = 500
    ocr_time_budget_seconds: float = 240.0
    ocr_page_timeout_seconds: float = 60.0
    max_ocr_workers: int = 8
    max_ocr_image_megapixels: float = 40.0
    max_cell_chars: int = 1024
    max_table_rows: int = 5000
    max_table_cols: int = 64
    max_tables: int = 50
