"""Numeric, conditional and JSON functions of the evaluation tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

# Criteria in report order with their weights.
WEIGHTS = {"faithfulness": 1.5, "completeness": 1.0, "clinical_usefulness": 1.2, "clarity": 0.8, "safety": 1.3}
# Fixed values: (input, output) USD a million tokens, and the shares of cached reads and writes.
PRICES = {"openai": (5.0, 30.0, 0.5, 1.0), "anthropic": (5.0, 25.0, 0.1, 1.25), "gemini": (4.0, 18.0, 0.1, 1.0)}
# Keywords by label; the order decides where only the first label counts.
SPECIES = {
    "Canine": ("dog", "dogs", "canine", "canines", "puppy", "puppies"),
    "Feline": ("cat", "cats", "feline", "felines", "kitten", "kittens"),
    "Equine": ("horse", "horses", "equine", "equines", "foal", "foals", "mare"),
    "Bovine": ("cow", "cows", "bovine", "cattle", "calf", "calves", "bull"),
    "Avian": ("bird", "birds", "avian", "parrot", "parrots", "raptor"),
}
DESIGNS = {
    "RCT": ("randomized controlled", "randomised controlled", "rct"),
    "Prospective Observational": ("prospective", "cohort study", "observational study"),
    "Retrospective Case Series": ("retrospective", "medical records", "case series"),
    "Systematic Review": ("systematic review", "meta-analysis", "meta analysis"),
    "Case Report": ("case report", "case presentation"),
}
TOPICS = {
    "Oncology": ("tumor", "tumour", "cancer", "neoplasia", "lymphoma", "sarcoma"),
    "Cardiology": ("cardiac", "heart", "arrhythmia", "cardiomyopathy", "echocardiograph"),
    "Gastroenterology": ("gastro", "pancreat", "intestin", "hepat", "liver", "vomit", "diarrhea"),
    "Orthopedics": ("fracture", "orthoped", "bone", "joint", "cruciate", "arthr"),
    "Neurology": ("neuro", "seizure", "spinal", "intervertebral", "disc", "epileps"),
    "Dermatology": ("skin", "dermat", "atop", "pruritus", "alopecia"),
    "Infectious Disease": ("infection", "bacterial", "viral", "parasit", "antimicrobial", "antibiotic"),
    "Endocrinology": ("diabet", "thyroid", "adrenal", "cushings", "hyperadrenocorticism"),
}
# Titles of what is no research article.
REJECTED_TITLES = tuple(
    "(?i)" + p
    for p in (
        r"^\s*correction\s+to\b", r"^\s*corrigendum\b", r"^\s*erratum\b", r"^\s*retraction\b", r"\bexpression\s+of\s+concern\b", r"\bissue\s+information\b",
        r"^\s*contents?\s*$", r"\btable\s+of\s+contents\b", r"\bfront\s+matter\b", r"\bresearch\s+abstract\s+program\b", r"\bresearch\s+report\s+program\b",
        r"\bconference\s+abstracts?\b", r"\bproceedings\b", r"\beditorial\b", r"\bletter\s+to\s+the\s+editor\b", r"\bbook\s+review\b", r"\bcommentary\b",
        r"^\s*case\s+report\s*[\:\-—]", r"^\s*case\s+series\s*[\:\-—]", r"^\s*case\s+study\s*[\:\-—]", r"^\s*short\s+communication\b", r"^\s*brief\s+communication\b",
        r"^\s*brief\s+report\b", r"^\s*imaging\s+diagnosis\b", r"^\s*imaging\s+findings?\b", r"^\s*rapid\s+communication\b",
    )
)
# Types of articles that are left out, and of those that count as secondary.
EXCLUDED_TYPES = ("short communication", "brief communication", "brief report", "case report", "case series", "case study", "imaging diagnosis", "imaging findings", "rapid communication")
SECONDARY_TYPES = ("systematic review", "meta-analysis", "scoping review", "narrative review")


def clamp(value: Column, low: float, high: float) -> Column:
    """Between ``low`` and ``high``; null if it is no number."""
    number = value.try_cast("double")
    return F.when(F.isnan(number), None).otherwise(F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number))))


def clamp_or_low(value: Column, low: float, high: float) -> Column:
    """The older rule: what is no number counts as the lowest score."""
    return F.coalesce(clamp(value, low, high), F.lit(low))


def weighted_mean(scores: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Mean of the criteria that are there, by weight; null if none is. Missing is never zero."""
    total = sum((F.when(scores[k].isNotNull(), scores[k] * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    base = sum((F.when(scores[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(base > 0, total / base)


def plain_mean(scores: dict[str, Column]) -> Column:
    return weighted_mean(scores, {k: 1.0 for k in scores})


def missing(scores: dict[str, Column]) -> Column:
    """Names of the absent criteria, in their order."""
    return F.filter(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in scores.items()]), lambda x: x.isNotNull())


def composite(accuracy: Column, completeness: Column, relevance: Column, organization: Column) -> Column:
    """The former 1-10 composite of four scores between 0 and 3."""
    return F.round((1.5 * accuracy + completeness + 1.2 * relevance + 0.8 * organization) / 13.5 * 9 + 1, 2)


def quality_score(jury: Column) -> Column:
    """1-5 to 1-10, half to even; 99 marks a score that is not there."""
    return F.when(jury.isNull() | (jury <= 0), 99).otherwise(F.bround((jury - 1) / 4 * 9 + 1, 0).cast("int"))


def claim_count(stated: Column, claims: Column) -> Column:
    """At least as many as are listed."""
    listed = F.coalesce(F.size(claims), F.lit(0))
    return F.greatest(F.coalesce(stated.try_cast("int"), listed), listed)


def needs_review(confidence: Column, score: Column, claims: Column) -> Column:
    major = F.coalesce(F.exists(claims, lambda c: c["severity"] == "major"), F.lit(False))
    return F.coalesce(confidence < 3, F.lit(False)) | F.coalesce(score == 99, F.lit(False)) | major


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def flag(count: Column) -> Column:
    """Whether anything was counted; unknown stays unknown."""
    return F.when(count.isNotNull(), count > 0)


def category(score: Column) -> Column:
    """The nearest whole score from 1 to 5, half to even."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(score, 0).cast("int")))


def density_band(cosine: Column) -> Column:
    return F.when(cosine.isNull(), "unknown").when(cosine >= 0.85, "high").when(cosine < 0.5, "low").otherwise("moderate")


def batch_cost(status: Column, usd: Column) -> Column:
    """What a result cost: nothing unless it succeeded."""
    return F.when(status == "success", F.coalesce(usd, F.lit(0.0))).otherwise(0.0)


def alpha_verdict(alpha: Column, n: Column, least: int = 30) -> Column:
    return F.when(alpha.isNull(), "unavailable").when(n < least, "underpowered").when(alpha >= 0.8, "strong").when(alpha >= 0.667, "acceptable").when(alpha >= 0, "weak").otherwise("systematic disagreement")


def correlation_verdict(r: Column, n: Column, least: int = 30) -> Column:
    return F.when(r.isNull(), "unavailable").when(n < least, "underpowered").when(r < 0, "negative").when(r >= 0.7, "strong").when(r >= 0.4, "moderate").otherwise("weak")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, batched: Column, read: Column | None = None, written: Column | None = None, read_share: float = 0.1, write_share: float = 1.25) -> Column:
    """USD from prices a million tokens; batches cost half; cached reads and writes have their own share."""
    r, w = F.coalesce(read, F.lit(0)) if read is not None else F.lit(0), F.coalesce(written, F.lit(0)) if written is not None else F.lit(0)
    plain = F.greatest(F.lit(0), tokens_in - r - w)
    usd = (plain * price_in + r * price_in * read_share + w * price_in * write_share + tokens_out * price_out) / 1_000_000
    return usd * F.when(batched, 0.5).otherwise(1.0)


def price_per_item(price: float, items: int) -> float:
    if items <= 0:
        raise ValueError("a subscription needs a positive number of papers")
    return price / items


def cell_score(raw: Column, low: int = 1, high: int = 5) -> Column:
    """(value, invalid) of a scoresheet cell: blank is missing, out of range is invalid."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    number = text.try_cast("double")
    ok = number.isNotNull() & number.between(low, high)
    return F.struct(F.when(ok, number).alias("value"), ((text != "") & ~F.coalesce(ok, F.lit(False))).alias("invalid"))


def cell_bool(raw: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text == "", None).otherwise(text.isin("yes", "y", "true", "1"))


def extraction_status(raw_words: Column, clean_words: Column, there: Column) -> Column:
    """PASS, WARN or FAIL of a cleaned text against its source."""
    ratio = F.when(raw_words > 0, clean_words / raw_words).otherwise(0.0)
    fail = ~there | (raw_words < 500) | (clean_words < 1500) | (ratio < 0.3)
    return F.when(fail, "FAIL").when((ratio < 0.5) | (clean_words < 3000), "WARN").otherwise("PASS")


def _lowered(text: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of the lower-cased text, which is made once however often the expression names it."""
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), of), F.lit(0))


def _has(low: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a substring; the first that is ends the search."""
    return reduce(lambda x, y: x | y, [low.contains(w) for w in words], F.lit(False))


def all_labels(text: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """Every label one of whose keywords is a substring."""
    found = lambda low: F.filter(F.array(*[F.when(_has(low, ws), F.lit(k)) for k, ws in keywords.items()]), lambda x: x.isNotNull())
    return _lowered(text, found)


def first_label(text: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """The first label one of whose keywords is a substring; null if none has one."""
    return _lowered(text, lambda low: F.coalesce(*[F.when(_has(low, ws), F.lit(k)) for k, ws in keywords.items()]))


def mock_row(version: Column, reasoning: Column, note: str = "dry run") -> Column:
    """Rows of a rehearsal: by version suffix or by the fixed note; null-safe."""
    return F.coalesce(version.endswith("-DRYRUN"), F.lit(False)) | F.coalesce(F.trim(reasoning) == note, F.lit(False))


def rejection(title: Column, authors: Column, abstract: Column, patterns: tuple[str, ...] = REJECTED_TITLES) -> Column:
    """First reason to reject a candidate, or null."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    matched = F.greatest(*[F.coalesce(title.rlike(p), F.lit(False)) for p in patterns], F.lit(False))
    return F.when(blank(title), "no_title").when(matched, "title_pattern").when((F.coalesce(F.size(authors), F.lit(0)) <= 0) & blank(abstract), "no_authors_and_abstract")


def text_gate(readable: Column, pages: Column, sections: Column, words: Column) -> Column:
    """First check that a paper's text fails, in order; null if it passes."""
    return F.when(~readable, "corrupt").when(pages < 3, "too_few_pages").when(sections < 3, "too_few_sections").when(words == 0, "empty_text").when(words < 3000, "too_few_words")


def article_type(text: Column, excluded: tuple[str, ...] = EXCLUDED_TYPES, secondary: tuple[str, ...] = SECONDARY_TYPES) -> Column:
    """excluded before secondary before primary, by phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    return F.when(has(excluded), "excluded").when(has(secondary), "secondary").otherwise("primary")


def custom_id(text: Column) -> Column:
    """(slug, summarizer) of ``slug__summarizer``."""
    return F.struct(F.regexp_extract(text, r"^(.*)__([^_].*?)$", 1).alias("slug"), F.regexp_extract(text, r"^(.*)__([^_].*?)$", 2).alias("summarizer"))


def _balanced(text: str) -> str | None:
    """The first balanced {...} of a text, strings respected."""
    start = text.find("{")
    depth, quoted, k = 0, False, start
    while 0 <= k < len(text):
        c = text[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : k + 1]
        k += 1
    return None


def _delimiters(block: str) -> str:
    """Single quotes that delimit strings (behind or before a bracket, colon or comma) as double ones; apostrophes stay."""
    return re.sub(r"(?<=[{\[:,\s])'|'(?=\s*[}\]:,])", '"', block)


def parse_reply(raw: str | None, criteria: tuple[str, ...] = tuple(WEIGHTS)) -> dict[str, object]:
    """Scores of a judge's reply and how they were found: json, json_block, json_repaired, regex or sentinel."""
    raw = raw or ""
    tries = [("json", raw.strip())]
    if (block := _balanced(raw)) is not None:
        tries.append(("json_block", block))
        tries.append(("json_repaired", re.sub(r",\s*([}\]])", r"\1", re.sub(r"\bNone\b", "null", _delimiters(block)))))
    for method, text in tries:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            nested = found.get("criteria_scores", found)
            nested = nested if isinstance(nested, dict) else {}
            scores = {c: (nested[c].get("score") if isinstance(nested.get(c), dict) else nested.get(c)) for c in criteria}
            scores = {c: float(v) for c, v in scores.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
            if scores:
                return {"method": method, "scores": {c: min(5.0, max(1.0, v)) for c, v in scores.items()}}
    scores = {c: m for c in criteria if (m := re.search(rf"{c.replace('_', '[ _]')}\W{{0,12}}([1-5](?:\.\d+)?)\b", raw, re.I))}
    if scores:
        return {"method": "regex", "scores": {c: float(m[1]) for c, m in scores.items()}}
    return {"method": "sentinel", "scores": {}}


@F.pandas_udf(StructType([StructField("method", StringType()), StructField("scores", MapType(StringType(), DoubleType()))]))
def parsed_reply(raw: pd.Series) -> pd.DataFrame:
    """:func:`parse_reply` for a column (irregular text has no SQL form; Arrow batches)."""
    return pd.DataFrame([parse_reply(x) for x in raw], columns=["method", "scores"])
