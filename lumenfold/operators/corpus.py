"""Joins of papers, manifests, texts, slots and files, each of which says what became of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.dedup import last_by, with_fallback


def slot_done(status: Column, mock: Column, rehearsal: bool = False) -> Column:
    """Whether a slot needs no more work: a success that is no mock, or any success of a rehearsal."""
    ok = F.coalesce(status == "success", F.lit(False))
    return ok if rehearsal else ok & ~F.coalesce(mock, F.lit(False))


def slot_usable(status: Column, summary: Column, lenient: bool = False) -> Column:
    """Success with a text; the lenient rule also takes slots that never had a status."""
    ok = status == "success"
    if lenient:
        ok = status.isNull() | ok
    return F.coalesce(ok & (F.coalesce(summary, F.lit("")) != ""), F.lit(False))


def strata_value(own: Column, strata: Column) -> Column:
    """The row's own value, else that of its strata, else ``unknown``; empty strings are no value."""
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.nullif(strata.cast("string"), F.lit("")), F.lit("unknown"))


def strata_list(own: Column, strata: Column) -> Column:
    """The same for lists, joined by ``, ``; an empty list of the row's own falls back, one of the strata is unknown."""
    chosen = F.when(F.size(own) > 0, own).otherwise(strata)
    return F.coalesce(F.nullif(F.array_join(F.transform(chosen, lambda x: x.cast("string")), ", "), F.lit("")), F.lit("unknown"))


def score_fields(unweighted: Column, jury: Column, weighted: Column) -> list[Column]:
    """Typed scores: the unweighted one falls back to the jury's; what is no number is null."""
    number = lambda c: c.cast("string").try_cast("double")
    return [F.coalesce(number(unweighted), number(jury)).alias("unweighted"), number(weighted).alias("weighted")]


def evaluation_instances(papers: DataFrame, manifest: DataFrame, texts: DataFrame, slots: DataFrame, key: str, seq: str, labels: list[str], limit: int | None = None, lenient: bool = False) -> DataFrame:
    """What a judge reads: key, labels, reference, provider, summary, one row for each usable slot.

    Papers (key, seq, labels) without a text or a key drop out; ``limit`` counts papers that have a text, in order of ``seq``, before their
    slots are looked at. A label is the paper's own, else its manifest row's, else ``unknown``. The manifest has one row a key.
    """
    named = papers.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    usable = named.join(texts.select(key, "reference").where(F.col("reference").isNotNull()), key)
    if limit is not None:
        usable = usable.orderBy(seq, key).limit(limit)
    known = manifest.select(key, *[F.col(c).alias(f"__{c}") for c in labels])
    out = usable.join(known, key, "left")
    out = out.select(key, "reference", *[strata_value(F.col(c), F.col(f"__{c}")).alias(c) for c in labels])
    return out.join(slots.where(slot_usable(F.col("status"), F.col("summary"), lenient)).select(key, "provider", "summary"), key)


def reference_text(processed: Column, abstract: Column, title: Column) -> Column:
    """The best text there is: processed, abstract, title."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (processed, abstract, title)])


def cached_text(records: DataFrame, texts: DataFrame, name: str, slug: str, suffix: str, value: str = "text") -> DataFrame:
    """``value`` of the text whose stem is the record's name, else its slug, else ends in ``__`` and its suffix.

    ``texts`` (stem, value) has one row a stem; of several with one suffix the least stem counts. Keys are equal, never searched.
    """
    ends = texts.select(F.element_at(F.split("stem", "__"), -1).alias(suffix), "stem", value).where(F.col("stem").contains("__"))
    ends = ends.groupBy(suffix).agg(F.min_by(value, "stem").alias(value))
    by_stem = lambda key: texts.select(F.col("stem").alias(key), value)
    return with_fallback(records, [(by_stem(name), [name]), (by_stem(slug), [slug]), (ends, [suffix])], value)


def tasks_of(scenarios: DataFrame, tasks: DataFrame, categories: DataFrame) -> DataFrame:
    """Each scenario with its task and the task's category, null where the taxonomy does not know it.

    ``tasks``: scenario, task, category; ``categories``: category, category_name. Of a scenario on several tasks the first task counts.
    """
    first = tasks.groupBy("scenario").agg(F.min_by(F.struct("task", "category"), "task").alias("x")).select("scenario", "x.*")
    return scenarios.join(first, "scenario", "left").join(categories, "category", "left").select(*scenarios.columns, "task", "category", "category_name")


def unblinded(sheet: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scoresheet rows with what their key says, in order; and rows that no key knows, to be warned about."""
    return sheet.join(keys, on).orderBy(*on), sheet.join(keys.select(*on).distinct(), on, "left_anti")


def with_journal(rows: DataFrame, journals: DataFrame, key: str, journal: str = "journal") -> DataFrame:
    """The row's journal, else the map's, else ``unknown``. The map has one row a key."""
    known = journals.select(key, F.col(journal).alias("__journal"))
    return rows.join(known, key, "left").withColumn(journal, strata_value(F.col(journal), F.col("__journal"))).drop("__journal")


def file_claims(files: DataFrame, file: str, candidates: str, records: DataFrame, key: str) -> DataFrame:
    """file, key, status of each file: ``claimed``, ``not_in_manifest``, or ``unresolved`` if it names no key.

    ``candidates`` are a file's possible keys, the best first; the first one decides.
    """
    best = files.select(file, F.lower(F.trim(F.get(F.col(candidates), F.lit(0)).cast("string"))).alias(key))
    known = records.select(F.lower(F.trim(F.col(key).cast("string"))).alias(key)).distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col(key).isNull() | (F.col(key) == ""), "unresolved").when(F.col("__known"), "claimed").otherwise("not_in_manifest")
    return best.join(known, key, "left").select(file, key, status.alias("status"))


def rename_plan(files: DataFrame, old: str, new: str) -> DataFrame:
    """old, new, status: ``missing`` (no new name), ``unchanged``, ``collision`` (several files want it, or one that keeps it has it), ``rename``."""
    wanted = files.where(F.col(new).isNotNull()).groupBy(new).agg(F.count("*").alias("__wanted"))
    out = files.join(wanted, new, "left")
    status = F.when(F.col(new).isNull(), "missing").when(F.col(old) == F.col(new), "unchanged").when(F.col("__wanted") > 1, "collision").otherwise("rename")
    return out.select(old, new, status.alias("status"))


def missing_report(manifest: DataFrame, have: DataFrame, failures: DataFrame, key: str, seq: list[str], reason: str) -> DataFrame:
    """Manifest rows that are not there, with the reason of their last failure or ``never_tried``."""
    gone = manifest.join(have.select(key).distinct(), key, "left_anti")
    last = last_by(failures, [key], seq).select(key, F.col(reason).alias("__reason"))
    return gone.join(last, key, "left").withColumn(reason, F.coalesce("__reason", F.lit("never_tried"))).drop("__reason")


def reset_slots(slots: DataFrame, ids: DataFrame, key: str, status: str = "status", of: str = "pending", to: str | None = None) -> DataFrame:
    """Slots whose id is in the set and whose status is ``of`` get another one; all others stay as they are."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    changed = F.when(F.col("__hit") & (F.col(status) == of), F.lit(to).cast("string")).otherwise(F.col(status))
    return slots.join(hit, key, "left").withColumn(status, changed).drop("__hit")


def latest_file(files: DataFrame, base: str, stem: str, path: str) -> DataFrame:
    """For each base name the file whose stem is the greatest, which is the latest where stems end in a time."""
    return files.groupBy(base).agg(F.max(F.struct(stem, path)).alias("x")).select(base, f"x.{stem}", f"x.{path}")


def observed_version(rows: DataFrame, configured: DataFrame, judge: str, version: str, seq: list[str]) -> DataFrame:
    """judge, version, observed: the version that a judge's last row names, else the configured one."""
    last = last_by(rows.where(F.coalesce(F.col(version), F.lit("")) != ""), [judge], seq).select(judge, F.col(version).alias("__seen"))
    out = configured.join(last, judge, "left")
    return out.select(judge, F.coalesce("__seen", version).alias(version), F.col("__seen").isNotNull().alias("observed"))


def key_frequency(pages: DataFrame, document: str, page: str, keys: str, most_pages: int = 5) -> DataFrame:
    """document, key, n_pages, first_page, place: on how many of the first pages each key stands, one count a page.

    A document's own key stands in the header of every page, keys of its references once.
    """
    some = pages.where(F.col(page) < most_pages).select(document, page, F.explode(F.array_distinct(keys)).alias("key"))
    counts = some.groupBy(document, "key").agg(F.count("*").alias("n_pages"), F.min(page).alias("first_page"))
    order = F.array_sort(F.collect_list(F.struct(F.negate("n_pages").alias("m"), "first_page", "key")))
    ranked = counts.groupBy(document).agg(order.alias("x")).select(document, F.posexplode("x").alias("place", "x"))
    return ranked.select(document, "x.key", F.negate("x.m").alias("n_pages"), "x.first_page", (F.col("place") + 1).alias("place"))


def by_first_item(rows: DataFrame, group: str, key: str, item: str) -> DataFrame:
    """group and its distinct keys, in the order of their first item."""
    first = rows.groupBy(group, key).agg(F.min(item).alias("first_item"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_item", F.col(key).alias("k")))), lambda x: x["k"]).alias("keys"))


def units_of_sample(rows: DataFrame, sample: DataFrame, unit: str) -> DataFrame:
    """All rows of the sampled units: a sample of articles carries its summaries along."""
    return rows.join(sample.select(unit).distinct(), unit, "left_semi")


def unresolved_jobs(jobs: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Submitted jobs whose results have not been merged; to submit again while there are any would pay twice."""
    return jobs.join(merged.select(key).distinct(), key, "left_anti")


def refuse_if_any(rows: DataFrame, message: str) -> None:
    """Raise if a guard's table has a row (the job reads one at most)."""
    if not rows.isEmpty():
        raise RuntimeError(message)


def next_number(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: one more than the largest number that the pattern's group finds in the names, 1 if none does."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(column, pattern, 1).try_cast("int")), F.lit(0)) + 1).alias("next_number"))


def revealed(rows: DataFrame, wanted: DataFrame, journals: DataFrame, key: str, cost: str) -> DataFrame:
    """Rows, journal and total cost of each wanted key, with nothing for a key that has no rows."""
    some = rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_rows"), F.sum(cost).alias("total_cost"))
    return with_journal(some.withColumn("journal", F.lit(None).cast("string")), journals, key)


def outcome_counts(rows: DataFrame, outcome: Column, by: list[str] | None = None) -> DataFrame:
    """How many rows had each outcome."""
    return rows.groupBy(*(by or []), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def key_set(*tables: DataFrame, key: str) -> DataFrame:
    """Distinct keys of some tables, trimmed and lower-cased; empty ones are none."""
    out = None
    for t in tables:
        one = t.select(F.lower(F.trim(F.col(key).cast("string"))).alias(key))
        out = one if out is None else out.unionByName(one)
    return out.where(F.coalesce(F.col(key), F.lit("")) != "").distinct()


#: Fixed value: parts of a record of the bibliographic interface that a manifest row needs.
RECORD = "DOI string, title array<string>, published struct<`date-parts`: array<array<int>>>, author array<struct<given: string, family: string>>, abstract string"


def manifest_row(record: Column, journal: Column) -> Column:
    """A struct doi, title, year, authors, abstract, journal from a record's JSON; null without a key."""
    r = F.from_json(record, RECORD)
    author = lambda a: F.trim(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(" "), F.substring(F.coalesce(a["given"], F.lit("")), 1, 1)))
    doi = F.nullif(F.trim(r["DOI"]), F.lit(""))
    fields = {
        "doi": doi,
        "title": F.coalesce(F.get(r["title"], F.lit(0)), F.lit("No title available")),
        "year": F.get(F.get(r["published"]["date-parts"], F.lit(0)), F.lit(0)),
        "authors": F.coalesce(F.transform(r["author"], author), F.array().cast("array<string>")),
        "abstract": F.coalesce(r["abstract"], F.lit("")),
        "journal": journal,
    }
    return F.when(doi.isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()]))


#: Sections of a summary in their order, and how many entries of a list are shown.
SECTIONS = (("Background", "objective"), ("Methods", "key_methods"), ("Results", "key_findings"), ("Limitations", "limitations"), ("Conclusions", "clinical_significance"))
LIST_CAPS = {"key_methods": 4, "key_findings": 5, "limitations": 4}
NOT_REPORTED = "Not reported"


def _entries(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def repaired_summary(fields: dict[str, Column]) -> Column:
    """A whole summary from a partial one: scalars become ``Not reported``, lists empty, prose is put together from the sections."""
    out = {k: F.coalesce(F.nullif(fields.get(k, F.lit(None).cast("string")), F.lit("")), F.lit(NOT_REPORTED)) for k in ("headline", "objective", "study_design", "species", "clinical_significance")}
    out |= {k: _entries(fields[k]) if k in fields else F.array().cast("array<string>") for k in LIST_CAPS}
    said = [F.trim(F.array_join(out[k], " ")) if k in LIST_CAPS else F.trim(out[k]) for _, k in SECTIONS]
    parts = F.filter(F.array(*[F.when((x != "") & (x != NOT_REPORTED), F.concat(F.lit(f"{label}: "), x)) for (label, _), x in zip(SECTIONS, said)]), lambda x: x.isNotNull())
    prose = F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), out["headline"])
    out["summary_text"] = F.coalesce(F.nullif(fields.get("summary_text", F.lit(None).cast("string")), F.lit("")), prose)
    return F.struct(*[c.alias(k) for k, c in out.items()])


def readable_summary(summary: Column) -> Column:
    """Sections under their titles, lists as bullets of which the first few are shown."""

    def body(key: str) -> Column:
        if key not in LIST_CAPS:
            return F.trim(F.coalesce(F.nullif(summary[key], F.lit("")), F.lit(NOT_REPORTED)))
        shown = F.transform(F.slice(summary[key], 1, LIST_CAPS[key]), lambda x: F.concat(F.lit("- "), x))
        return F.coalesce(F.nullif(F.array_join(shown, "\n"), F.lit("")), F.lit(NOT_REPORTED))

    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{label}\n"), body(key)) for label, key in SECTIONS])
