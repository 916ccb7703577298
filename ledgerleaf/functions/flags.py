"""Page and document flags as arrays, in the order of the rules; routing predicates; states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Flag names and thresholds that results must share.
HEADER_WORDS = ("page ", "county", "contract", "agreement")
OCR_TRIGGERS = ("no_text_extracted", "low_text_density", "suspected_scanned_page", "suspected_image_only_page", "suspected_garbled_text", "ocr_recommended")
SKIP = ("likely_blank_page", "likely_low_information_page", "skip_llm_repair")
LLM = ("llm_markdown_recommended", "llm_repair_recommended", "llm_vision_markdown_recommended", "llm_normalization_recommended")
DOC_LLM = (*LLM, "ocr_still_needs_review")
DOC_OCR = ("has_ocr_pages", "has_low_quality_ocr_pages", "ocr_improved_some_pages", "ocr_still_needs_review", "has_likely_blank_pages", "has_low_information_pages", "llm_markdown_recommended", "llm_repair_recommended", "llm_normalization_recommended")
DOC_ORIENTATION = ("has_validated_page_images", "has_rotated_page_images")
OCR_POOR = ("ocr_failed", "ocr_low_text_density", "ocr_low_confidence", "ocr_suspected_garbled_text", "ocr_high_symbol_ratio", "ocr_high_whitespace_noise", "ocr_not_better_than_pdf_text")
LOW_QUALITY = ("no_text_extracted", "low_text_density", "suspected_scanned_page", "suspected_image_only_page", "suspected_garbled_text", "high_symbol_ratio", "high_whitespace_noise", "ocr_low_text_density", "ocr_low_confidence", "ocr_suspected_garbled_text", "ocr_high_symbol_ratio", "ocr_high_whitespace_noise", "ocr_failed")


def chosen(*rules: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order, each once."""
    return F.array_distinct(F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull()))


def any_of(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))


def has(flags: Column, name: str) -> Column:
    return F.array_contains(flags, name)


def without(flags: Column, *names: str) -> Column:
    """Difference that keeps order and repeats."""
    return F.filter(flags, lambda f: ~f.isin(*names))


def page_signals(text: Column, images: Column, ratios: tuple[Column, Column, Column] | None = None, chars: Column | None = None) -> Column:
    """Flags of a page; `ratios` are its alpha, symbol and newline ratios and `chars` its length where these are columns already."""
    alpha, symbol, newline = ratios or (T.alpha_ratio(text), T.symbol_ratio(text), T.newline_ratio(text))
    n, low = F.length(text) if chars is None else chars, F.lower(text)
    garbled = (alpha < 0.35) & (n >= 40)
    header = low.contains(HEADER_WORDS[0])
    for w in HEADER_WORDS[1:]:
        header = header | low.contains(w)
    return chosen(
        (n == 0, "no_text_extracted"),
        ((n > 0) & (n < 40), "low_text_density"),
        (images & (n == 0), "suspected_image_only_page"),
        (images & (n == 0), "suspected_scanned_page"),
        (images & (n < 40), "image_render_recommended"),
        (garbled, "suspected_garbled_text"),
        ((symbol > 0.35) & (n >= 40), "high_symbol_ratio"),
        ((newline > 0.12) & (n >= 80), "high_whitespace_noise"),
        ((n < 120) & header, "possible_header_footer_only"),
        (text.contains("\t") | text.contains("  ") | text.contains("|"), "possible_table_or_form_content"),
        ((n == 0) | garbled, "ocr_recommended"),
    )


def ocr_signals(text: Column, conf: Column, pdf_chars: Column, blank: Column, low_info: Column, ratios: tuple[Column, Column, Column, Column] | None = None, chars: Column | None = None) -> Column:
    """Flags of a recogniser's run; `ratios` are the text's alpha, symbol, newline and numeric token ratios and `chars` its length where these are columns already."""
    alpha, symbol, newline, numeric = ratios or (T.alpha_ratio(text), T.symbol_ratio(text), T.newline_ratio(text), T.numeric_token_ratio(text))
    n = F.length(text) if chars is None else chars
    blank, low_info = blank & (n < 15), low_info & (n < 15)
    some = n > 0
    sparse, unsure = some & (n < 40), some & (conf < 55)
    garbled = some & (alpha < 0.35) & (n >= 40)
    form = some & (numeric > 0.3)
    hand = some & (conf < 45) & (n < F.greatest(pdf_chars, F.lit(80)))
    return chosen(
        (F.lit(True), "ocr_attempted"),
        (low_info, "likely_low_information_page"),
        (low_info, "skip_llm_repair"),
        (blank, "likely_blank_page"),
        (blank, "skip_llm_repair"),
        (some, "ocr_succeeded"),
        (~some, "ocr_failed"),
        (sparse, "ocr_low_text_density"),
        (unsure, "ocr_low_confidence"),
        (garbled, "ocr_suspected_garbled_text"),
        (some & (symbol > 0.35) & (n >= 40), "ocr_high_symbol_ratio"),
        (some & (newline > 0.12) & (n >= 80), "ocr_high_whitespace_noise"),
        (form, "ocr_possible_table_or_form_content"),
        (hand, "ocr_possible_handwriting"),
        (some & (n > pdf_chars + 50), "ocr_improved_over_pdf_text"),
        (some & (n <= pdf_chars + 50), "ocr_not_better_than_pdf_text"),
        (form, "llm_markdown_recommended"),
        ((~some & ~blank & ~low_info) | sparse | unsure | garbled | hand, "llm_repair_recommended"),
    )


def given(path: Column) -> Column:
    return path.isNotNull() & (path != "")


def ocr_target(flags: Column, ocr_path: Column) -> Column:
    return ~given(ocr_path) & any_of(flags, *OCR_TRIGGERS)


def markdown_candidate(flags: Column, ocr_path: Column, markdown_path: Column) -> Column:
    source = given(ocr_path) | any_of(flags, "suspected_scanned_page", "suspected_image_only_page", "ocr_low_confidence", "ocr_high_whitespace_noise", "ocr_improved_over_pdf_text")
    return ~given(markdown_path) & ~any_of(flags, *SKIP) & any_of(flags, "possible_table_or_form_content", "ocr_possible_table_or_form_content") & source


def repair_candidate(flags: Column, ocr_path: Column, repair_path: Column) -> Column:
    worse = has(flags, "ocr_not_better_than_pdf_text")
    need = (
        any_of(flags, "ocr_failed", "ocr_possible_handwriting")
        | (any_of(flags, "ocr_low_confidence", "ocr_suspected_garbled_text") & worse)
        | (has(flags, "no_text_extracted") & has(flags, "ocr_recommended") & ~given(ocr_path))
        | (has(flags, "suspected_garbled_text") & ~given(ocr_path))
    )
    return ~given(repair_path) & ~any_of(flags, *SKIP) & need


def vision_candidate(flags: Column, image_path: Column, vision_path: Column) -> Column:
    need = any_of(flags, "suspected_scanned_page", "suspected_image_only_page", "no_text_extracted", "ocr_low_confidence", "ocr_failed", "possible_table_or_form_content", "ocr_possible_table_or_form_content")
    return ~given(vision_path) & given(image_path) & ~any_of(flags, *SKIP) & need


def confidence_bucket(method: Column, flags: Column, conf: Column, ocr_chars: Column, chars: Column) -> Column:
    poor, pdf_poor = any_of(flags, *OCR_POOR), any_of(flags, *LOW_QUALITY)
    ocr = (
        F.when(has(flags, "ocr_failed") | (ocr_chars == 0), "ocr_failed")
        .when((conf >= 80) & ~poor, "ocr_high_confidence")
        .when((conf >= 50) & ~any_of(flags, "ocr_suspected_garbled_text", "ocr_not_better_than_pdf_text"), "ocr_medium_confidence")
        .when(poor, "ocr_low_confidence")
        .when(ocr_chars >= F.greatest(chars, F.lit(80)), "ocr_medium_confidence")
        .otherwise("ocr_low_confidence")
    )
    return F.when(method == "ocr", ocr).when(method == "pdf_text", F.when(pdf_poor, "pdf_text_low_confidence").otherwise("pdf_text_high_confidence")).otherwise("other_or_unknown")


def document_rollup(flags: str = "flags", pages: Column | None = None) -> Column:
    """An aggregate over a document's pages: its flags in rule order; `pages` is how many pages a row stands for, one if not given."""
    pages = F.lit(1) if pages is None else pages
    anyp = lambda *names: F.bool_or(any_of(F.col(flags), *names))
    scanned = F.sum(F.when(has(F.col(flags), "suspected_scanned_page"), pages).otherwise(0))
    return chosen(
        (anyp("low_text_density", "suspected_garbled_text"), "has_low_quality_pages"),
        (anyp("suspected_scanned_page"), "has_scanned_pages"),
        (anyp("ocr_recommended"), "ocr_recommended"),
        ((scanned > 0) & (scanned >= F.greatest(F.sum(pages), F.lit(1)) / 2), "mostly_image_based"),
        (F.count_distinct(F.array_sort(flags)) > 1, "mixed_text_quality"),
        (anyp("suspected_scanned_page", "suspected_garbled_text"), "manual_review_recommended"),
    )


def _rollup(base: Column, gone: tuple[str, ...], *rules: tuple[Column, str]) -> Column:
    """Base flags without those that are set anew, then the new ones in rule order; each once."""
    return F.array_distinct(F.concat(without(base, *gone), chosen(*rules)))


def ocr_rollup(base: Column, flags: str = "flags") -> Column:
    """AGG-09: an aggregate over a document's pages; `base` is the document's flags as an aggregate."""
    on = lambda *names: F.bool_or(any_of(F.col(flags), *names))
    return _rollup(
        base,
        DOC_OCR,
        (on("ocr_attempted"), "has_ocr_pages"),
        (on("ocr_low_text_density", "ocr_low_confidence", "ocr_suspected_garbled_text"), "has_low_quality_ocr_pages"),
        (on("ocr_improved_over_pdf_text"), "ocr_improved_some_pages"),
        (on("likely_blank_page"), "has_likely_blank_pages"),
        (on("likely_low_information_page"), "has_low_information_pages"),
        (on("llm_markdown_recommended"), "llm_markdown_recommended"),
        (on("llm_repair_recommended"), "ocr_still_needs_review"),
        (on("llm_repair_recommended"), "llm_repair_recommended"),
    )


def llm_rollup(base: Column, flags: str = "flags") -> Column:
    """AGG-10: an aggregate over a document's pages."""
    on = lambda name: F.bool_or(has(F.col(flags), name))
    repair = on("llm_repair_recommended")
    return _rollup(base, DOC_LLM, (on("llm_markdown_recommended"), "llm_markdown_recommended"), (repair, "llm_repair_recommended"), (repair, "ocr_still_needs_review"), (on("llm_vision_markdown_recommended"), "llm_vision_markdown_recommended"))


def orientation_rollup(base: Column, validated: Column, rotated: Column) -> Column:
    """AGG-11: an aggregate over a document's pages."""
    return _rollup(base, DOC_ORIENTATION, (F.bool_or(validated), "has_validated_page_images"), (F.bool_or(rotated), "has_rotated_page_images"))


def orientation_score(conf: Column, tokens: Column, chars: Column, alpha: Column, symbol: Column) -> Column:
    none = chars == 0
    score = F.coalesce(conf, F.lit(0.0)) + 1.5 * F.least(tokens, F.lit(40)) + F.least(chars, F.lit(400)) / 40
    score = score + 35 * F.when(none, 0.0).otherwise(alpha) - 25 * F.when(none, 1.0).otherwise(symbol)
    return F.bround(score - F.when(none, 40).otherwise(0) - F.when(tokens < 4, 10).otherwise(0), 4)


def page_notes_advice(total: Column, pages: Column, top_share: Column, dense: Column) -> Column:
    wanted = (total >= 40000) | ((total >= 25000) & (pages >= 25) & (top_share <= 0.45)) | ((total >= 25000) & (dense >= 15))
    return F.when(wanted, "recommended").when(total <= 12000, "not_needed").otherwise("borderline")
