"""Quality gates as ordered CASE expressions: pages, OCR results, engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NOT_SPACE, arabic_ratio, replacement_count

# Thresholds and reasons of the gates.
MIN_CHARS, MAX_REPLACED = 50, 0.02
MIN_WORDS, MIN_CONFIDENCE = 5, 60.0
OCR_REASONS = ["blank_or_no_text", "too_short", "high_replacement_ratio"]


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_SPACE)


def page_gate(text: Column, reviewed: Column | None = None) -> tuple[Column, Column]:
    """(status, reason) of a page's text; lengths are of the whole text, white space included."""
    chars = F.length(F.coalesce(text, F.lit("")))
    lost = F.coalesce(replacement_count(text) / F.nullif(chars, F.lit(0)), F.lit(0.0))
    reason = F.when(blank(text), "blank_or_no_text").when(chars < MIN_CHARS, "too_short").when(lost > MAX_REPLACED, "high_replacement_ratio").otherwise("")
    if reviewed is not None:
        reason = F.when(reviewed, "reviewed_transcription").otherwise(reason)
    status = F.when(reason.isin("", "reviewed_transcription"), "approved").otherwise("excluded")
    return status, reason


def inventory_gate(chars: Column) -> Column:
    """Gate by the stored length alone: a blank page of MIN_CHARS spaces passes here. Only for inventories."""
    return F.when(F.coalesce(chars, F.lit(0)) <= 0, "blank_or_no_text").when(chars < MIN_CHARS, "too_short").otherwise("")


def ocr_gate(text: Column, words: Column, confidence: Column, error: Column) -> tuple[Column, Column]:
    chars = F.length(F.coalesce(text, F.lit("")))
    reason = (
        F.when(F.length(F.coalesce(error, F.lit(""))) > 0, F.split_part(error, F.lit(":"), F.lit(1)))
        .when(blank(text), "ocr_blank_or_no_text")
        .when(chars < MIN_CHARS, "ocr_too_short")
        .when(F.coalesce(words, F.lit(0)) < MIN_WORDS, "ocr_too_few_words")
        .when(F.coalesce(confidence, F.lit(0.0)) < MIN_CONFIDENCE, "ocr_low_confidence")
        .otherwise("")
    )
    return F.when(reason == "", "approved").otherwise("excluded"), reason


def needs_ocr(reason: Column) -> Column:
    return reason.isin(OCR_REASONS)


def resolve(text_status: Column, text_reason: Column, ocr_status: Column, ocr_reason: Column, ocr_error: Column) -> tuple[Column, Column, Column]:
    """(status, reason, whether OCR is used): the OCR result replaces the text if it is approved or had no error; an error only prefixes the reason."""
    tried = needs_ocr(text_reason) & ocr_status.isNotNull()
    used = tried & ((ocr_status == "approved") | (F.length(F.coalesce(ocr_error, F.lit(""))) == 0))
    prefixed = F.when(text_reason.startswith("ocr_"), text_reason).otherwise(F.concat(F.lit("ocr_"), text_reason))
    return F.when(used, ocr_status).otherwise(text_status), F.when(used, ocr_reason).when(tried, prefixed).otherwise(text_reason), used


def choose_engine(text_a: Column, text_b: Column, prefer_b: Column | None = None) -> Column:
    """'a' or 'b': b where preferred and not blank; else a if not blank and Arabic enough or b is blank; else b."""
    ratio = arabic_ratio(F.when(blank(text_a), text_b).otherwise(text_a))
    plain = F.when(~blank(text_a) & ((ratio >= 0.5) | blank(text_b)), "a").otherwise("b")
    if prefer_b is None:
        return plain
    return F.when(prefer_b, F.when(blank(text_b), "a").otherwise("b")).otherwise(plain)
