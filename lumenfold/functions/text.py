"""Text functions: columns in, columns out, all inside generated code unless said otherwise."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Patterns of the elements of a summary, in report order.
SUMMARY_SECTIONS = {
    "objective": r"(?i)\b(objective|aim|purpose|research question)\b",
    "methods": r"(?i)\b(method|study design|retrospective|prospective|randomi[sz]ed|trial)\b",
    "species_sample": r"(?i)\b(dog|dogs|canine|cat|cats|feline|horse|horses|equine|cow|cattle|bovine|n\s*=\s*\d+|\d+\s+(dogs|cats|horses|cattle|animals|patients))\b",
    "results": r"(?i)\b(result|finding|significant|p\s*[<=>]|increased|decreased|associated)\b",
    "clinical_significance": r"(?i)\b(clinical|clinician|practice|treatment|diagnosis|prognosis|recommend)\b",
    "limitations": r"(?i)\b(limit|limitation|small sample|bias|retrospective design|further research)\b",
}
# Patterns of the sections of a paper, by category.
PAPER_SECTIONS = {
    "introduction": r"(?i)\b(?:introduction|intro|literature\s+review|study\s+rationale|rationale|objectives?|aims?|study\s+aims|purpose|study\s+purpose|background|study\s+background|overview)\b",
    "methods": r"(?i)\b(?:materials\s+and\s+methods|methods\s+and\s+materials|patients\s+and\s+methods|subjects\s+and\s+methods|research\s+design|study\s+design|experimental\s+design|study\s+protocol|research\s+(?:methods|procedure)|experimental\s+(?:methods|procedure)|study\s+(?:population|cohort|sample)|statistical\s+analysis|statistical\s+methods|methodology|methods)\b",
    "results": r"(?i)\b(?:results|findings\b|study\s+findings|key\s+findings)\b",
    "discussion": r"(?i)\b(?:discussion|general\s+discussion|clinical\s+implications\b|implications\b|interpretation\b|interpretations\b|commentary\b)\b",
    "conclusion": r"(?i)\b(?:conclusions?|concluding\s+remarks|discussion\s+and\s+conclusions?|clinical\s+impact|clinical\s+relevance|study\s+summary)\b",
}
# Headings of a bibliography, alone on a line, or inside a line above a numbered entry.
REFERENCES = r"(?im)\n\s*(?:#{1,6}\s+)?(?:references?|reference\s+list|cited\s+references?|bibliography|works\s+cited|literature\s+cited)\s*(?:\n|\z)"
REFERENCES_INLINE = r"(?i)\n[^\n]{0,200}\bREFERENCES?\b[^\n]*\n(?=\s*(?:\d+[\.\):]|\[\d+\]))"
# Terms of the rubric.
SPECIES_TERMS = ("dog", "dogs", "canine", "cat", "cats", "feline", "horse", "horses", "equine", "cow", "cows", "bovine", "cattle", "bird", "avian")
CLINICAL_TERMS = ("clinical", "treatment", "diagnosis", "prognosis", "outcome", "risk", "therapy", "management", "disease", "signs", "survival", "mortality")
COMPLETENESS_TERMS = {
    "objective": ("objective", "aim", "purpose", "question"),
    "methods": ("method", "study", "retrospective", "prospective", "randomized"),
    "population": ("dogs", "cats", "canine", "feline", "horses", "sample", "cases"),
    "results": ("result", "found", "increased", "decreased", "associated"),
    "significance": ("clinical", "relevance", "suggests", "important", "practice"),
    "limitations": ("limit", "caution", "small sample", "retrospective"),
}
DOI = r"10\.\d{4,9}/\S+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)


def ngrams(words: Column, n: int) -> Column:
    """Sliding n-grams joined by a space; none if there are fewer than ``n`` words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def compression_ratio(reference: Column, candidate: Column) -> Column:
    ref = F.size(tokens(reference))
    return F.when(ref > 0, F.size(tokens(candidate)) / ref).otherwise(F.lit(0.0))


def extractive_coverage(reference: Column, candidate: Column) -> Column:
    """Share of the candidate's token occurrences that the reference has."""
    ref, cand = F.array_distinct(tokens(reference)), tokens(candidate)
    return F.when(F.size(cand) > 0, F.size(F.filter(cand, lambda t: F.array_contains(ref, t))) / F.size(cand)).otherwise(F.lit(0.0))


def section_flags(text: Column, patterns: dict[str, str] = SUMMARY_SECTIONS) -> Column:
    return F.struct(*[F.coalesce(text.rlike(p), F.lit(False)).alias(name) for name, p in patterns.items()])


def section_count(text: Column, patterns: dict[str, str] = SUMMARY_SECTIONS) -> Column:
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns.values()), F.lit(0))


def section_ratio(text: Column, patterns: dict[str, str] = SUMMARY_SECTIONS) -> Column:
    return section_count(text, patterns) / F.lit(len(patterns))


def matching_sections(text: Column, patterns: dict[str, str] = PAPER_SECTIONS) -> Column:
    """Names of the categories that appear, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of two letters or more, hyphens inside allowed."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z-]+)"), F.lit(1)))


def number_set(text: Column) -> Column:
    """Distinct numeric claims, with decimals and percent signs."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\b\d+(?:\.\d+)?%?\b)"), F.lit(1)))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def token_estimate(text: Column) -> Column:
    """Unicode words and single punctuation marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"))


def prompt_tokens(text: Column) -> Column:
    """Token forecast without a tokenizer: words times 1.33, cut to an integer."""
    return F.floor(word_count(text) * F.lit(1.33)).cast("long")


def length_comparison(abstract: Column, summary: Column) -> Column:
    """(ratio rounded to 3, label) of word counts; the label is decided on the rounded ratio."""
    count = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z'-]*"))
    ratio = F.when(count(abstract) > 0, F.round(count(summary) / count(abstract), 3))
    label = F.when(ratio.isNull(), "unknown").when(F.abs(ratio - 1.0) <= 0.02, "same").when(ratio < 1, "shorter").otherwise("longer")
    return F.struct(ratio.alias("ratio"), label.alias("label"))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapse_newlines(text: Column) -> Column:
    """At most one empty line in a row."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def drop_noise(text: Column, patterns: list[str]) -> Column:
    """Remove watermark blocks, then surplus empty lines."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return F.trim(collapse_newlines(text))


def _before(text: Column, pattern: str, last: bool) -> Column:
    """What stands before a match, without white space at its end; null if there is none."""
    flags, body = pattern.split(")", 1)
    found = F.regexp_extract(text, f"(?s)\\A(.*{'' if last else '?'}){flags}:{body})", 1)
    return F.when(text.rlike(pattern), F.regexp_replace(found, r"\s+\z", ""))


def cut_at_last_heading(text: Column) -> Column:
    """What stands before the last bibliography heading, or before one inside a line if no line is only that."""
    return F.coalesce(_before(text, REFERENCES, True), _before(text, REFERENCES_INLINE, True), text)


def cut_at_first_heading(text: Column) -> Column:
    """What stands before the first heading: for validation, where a cut too early is the safe error."""
    return F.coalesce(_before(text, REFERENCES, False), text)


def truncate_at_sentence(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut behind the last period if that keeps more than half."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), ".")
    at = F.lit(limit) - back + 1
    cut = F.when((back > 0) & (at > limit / 2), F.substring(text, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip_tags(text: Column) -> Column:
    return collapse_space(F.regexp_replace(text, r"<[^>]+>", " "))


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """HTML entities to characters (the entity table is Python's; Arrow batches)."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def title_key(text: Column) -> Column:
    """Titles that differ in tags, entities, case or spacing get the same key."""
    return F.lower(strip_tags(unescape_entities(text)))


def filename_part(text: Column, limit: int = 80) -> Column:
    """Lower-case ASCII letters and digits, other runs as ``_``; ``untitled`` if nothing is left."""
    ascii_only = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "_")
    cut = F.regexp_replace(F.substring(F.regexp_replace(slug, r"^_+|_+$", ""), 1, limit), r"_+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))


def doi_slug(doi: Column) -> Column:
    return F.regexp_replace(F.translate(doi, "/:.", "___"), r"^_+|_+$", "")


def paper_filename(journal: Column, title: Column, doi: Column, budget: int = 180) -> Column:
    """``journal__title__doi.pdf`` within a length budget that the title gives way to (20 at least)."""
    j, d, t = filename_part(journal, 40), doi_slug(doi), filename_part(title, budget)
    room = F.greatest(F.lit(20), F.lit(budget) - F.length(j) - F.length(d) - 8)
    return F.concat(j, F.lit("__"), F.regexp_replace(F.substring(t, F.lit(1), room), r"_+$", ""), F.lit("__"), d, F.lit(".pdf"))


def dois(text: Column) -> Column:
    """DOIs in a text in first-seen order, lower-cased, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({DOI})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[\].,;:)}\"'>]+$", ""))))


def base_stem(stem: Column) -> Column:
    """A file stem without its run suffix."""
    return F.regexp_replace(stem, r"(_\d{8}[T_]\d{6}Z?|_run\d+)$", "")


def slug_of_stem(stem: Column) -> Column:
    """The part behind the last double underscore."""
    return F.element_at(F.split(stem, "__"), -1)


def stable_int(text: Column) -> Column:
    """The first eight hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def links(page: Column) -> Column:
    """href targets in document order."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)["']"""), F.lit(1))


def pdf_link(page: Column) -> Column:
    """The PDF a page names: citation meta tag, then alternate link, then the first anchor to a .pdf."""
    meta = F.regexp_extract(page, r"""(?i)<meta\s+name=["']citation_pdf_url["']\s+content=["']([^"']+)["']""", 1)
    link = F.regexp_extract(page, r"""(?i)<link\s[^>]*type=["']application/pdf["'][^>]*href=["']([^"']+)["']""", 1)
    anchor = F.regexp_extract(page, r"""(?i)<a\s[^>]*href=["']([^"']+\.pdf[^"']*)["']""", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (meta, link, anchor)])


def rubric_scores(output: Column, source: Column) -> Column:
    """Four 1-5 ladders (grounding, unsupported claims, relevance, completeness) and their mean rounded to 2."""
    out, low = word_set(output), F.lower(F.coalesce(output, F.lit("")))
    share = F.size(F.array_intersect(word_set(source), out)) / F.greatest(F.lit(1), F.size(out))
    loose = F.size(F.array_except(number_set(output), number_set(source)))
    accuracy = F.when(F.trim(low) == "", 1).when(loose >= 2, 2).when(loose == 1, 3).when(share >= 0.75, 5).when(share >= 0.45, 4).otherwise(3)
    risk = F.when((loose >= 2) | (share < 0.25), 2).when((loose > 0) | (share < 0.45), 3).when(share >= 0.75, 5).otherwise(4)
    terms = lambda words: F.size(F.array_intersect(out, F.array(*map(F.lit, words))))
    species, clinical = terms(SPECIES_TERMS) > 0, terms(CLINICAL_TERMS)
    relevance = F.when(species & (clinical >= 2), 5).when(species & (clinical == 1), 4).when(species | (clinical >= 1), 3).otherwise(2)
    parts = sum((F.greatest(*[low.contains(w) for w in words]).cast("int") for words in COMPLETENESS_TERMS.values()), F.lit(0))
    whole = F.when(parts >= 6, 5).when(parts >= 5, 4).when(parts >= 3, 3).when(parts >= 1, 2).otherwise(1)
    mean = F.bround((accuracy + risk + relevance + whole) / 4, 2)
    return F.struct(accuracy.alias("accuracy"), risk.alias("hallucination"), relevance.alias("relevance"), whole.alias("completeness"), mean.alias("overall"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if not a or not b:
        return 0
    number = {t: k for k, t in enumerate(dict.fromkeys(b))}
    right = np.array([number[t] for t in b])
    row = np.zeros(len(b) + 1, np.int64)
    for t in a:
        k = number.get(t, -1)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(right == k, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(DoubleType())
def rouge_l_recall(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """LCS over tokens by reference tokens; takes arrays of tokens (a dynamic program has no SQL form)."""
    return pd.Series([lcs_length(list(r), list(c)) / len(r) if r is not None and len(r) and c is not None else 0.0 for r, c in zip(reference, candidate)])
