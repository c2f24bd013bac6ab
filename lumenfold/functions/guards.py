"""Gates, settings and checks of a run: what may be tried, what may be spent, what a judge may see."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE, CANDIDATE = "{REFERENCE_TEXT}", "{CANDIDATE_SUMMARY}"


def open_access(is_open: Column, locations: Column, direct: Column, required: bool = True, least: int = 1, prefer_direct: bool = False) -> Column:
    """Whether a candidate may be collected: everything, or open ones with enough places (and a direct file)."""
    if not required:
        return F.lit(True)
    ok = F.coalesce(is_open, F.lit(False)) & (F.coalesce(locations.cast("int"), F.lit(0)) >= least)
    return ok & F.coalesce(direct, F.lit(False)) if prefer_direct else ok


def blocked(status: Column, code: Column, *texts: Column) -> Column:
    """Whether an attempt met a wall: a 403 by status or code, or a page that names the wall."""
    said = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    named = said.contains("cloudflare") | said.contains("cf-ray") | said.contains("just a moment")
    return F.coalesce(status == 403, F.lit(False)) | F.coalesce(code == "HTTP_403", F.lit(False)) | named


def fresh(cached: Column, source: Column) -> Column:
    """Whether a cache is no older than its source; not if either time is unknown."""
    return F.coalesce(cached >= source, F.lit(False))


def prompt_segments(template: str, reference: Column, candidate: Column) -> Column:
    """rubric, reference and candidate parts of a judge's prompt, which put together are the whole prompt.

    Text between the two markers belongs to the part before it. No other column can enter: a judge never sees who wrote.
    """
    first, second = template.index(REFERENCE), template.index(CANDIDATE)
    if second < first:
        raise ValueError("the reference comes before the candidate")
    between, end = template[first + len(REFERENCE) : second], template[second + len(CANDIDATE) :]
    return F.struct(F.lit(template[:first]).alias("rubric"), F.concat(reference, F.lit(between)).alias("reference"), F.concat(candidate, F.lit(end)).alias("candidate"))


def first_setting(settings: Mapping[str, str], names: list[str], default: str | None = None) -> str | None:
    """The first of the named settings that is not blank."""
    return next((v for n in names if (v := settings.get(n, "").strip())), default)


def prices_of(regular: tuple[float, ...], premium: tuple[float, ...], tier: str) -> tuple[float, ...]:
    """Prices of a tier; premium prices that equal the regular ones have not been filled in, and would misstate what is spent."""
    if tier == "premium" and premium == regular:
        raise ValueError("the premium prices are still the regular ones")
    return premium if tier == "premium" else regular


def checked_rubric(rubric: Mapping[str, object], version: str, dimensions: tuple[str, ...], low: int = 1, high: int = 5) -> None:
    """Raise unless the rubric has this version and range and exactly these dimensions, each described and anchored at every score."""
    if rubric.get("version") != version:
        raise ValueError(f"version must be {version}")
    if rubric.get("score_range") != {"min": low, "max": high}:
        raise ValueError(f"scores must be from {low} to {high}")
    found = rubric.get("dimensions")
    if not isinstance(found, Mapping) or tuple(found) != dimensions:
        raise ValueError(f"dimensions must be {', '.join(dimensions)}")
    for name, spec in found.items():
        if not isinstance(spec, Mapping) or not spec.get("description") or not isinstance(spec.get("anchors"), Mapping) or set(spec["anchors"]) != set(range(low, high + 1)):
            raise ValueError(f"dimension {name} needs a description and anchors from {low} to {high}")


def authorised(budget: float, what: str, rehearsal: bool = False) -> None:
    """Raise unless a budget has been set; a rehearsal spends nothing."""
    if budget <= 0 and not rehearsal:
        raise RuntimeError(f"no budget has been set for {what}")


def same_file(candidate: str | None, canonical: str) -> bool:
    """Whether a path is the canonical one, however it is written; no path stands for the canonical one."""
    if candidate is None:
        return True
    return os.path.normcase(os.path.realpath(candidate)) == os.path.normcase(os.path.realpath(canonical))
