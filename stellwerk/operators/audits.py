"""Audits: salary intervals, sidecars, translation pairs, gold labels, annotations, leakage, readiness."""

from __future__ import annotations

import json
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Unit domain of the interval audit (fixed values).
CURRENCIES = ("EUR",)
PERIODS = ("annual", "annum", "month", "monthly", "per month", "per year", "year", "yearly")
DIRECTIONS = ("de-en", "en-de")
LABELS = ("required", "mentioned")
TEXT_FIELDS = ("title", "location", "federal_state", "experience_level", "employment_type", "remote_type")


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def intervals(df: DataFrame) -> DataFrame:
    """All counters in one scan. Classes overlap: an interval may be invalid and of unsupported units at once."""
    lo, hi = F.col("salary_min"), F.col("salary_max")
    both = lo.isNotNull() & hi.isNotNull()
    supported = F.upper(F.trim(F.coalesce("salary_currency", F.lit("")))).isin(*CURRENCIES) & F.lower(F.trim(F.coalesce("salary_period", F.lit("")))).isin(*PERIODS)
    tests = {
        "salary_min": lo.isNotNull(), "salary_max": hi.isNotNull(), "salary_currency": F.col("salary_currency").isNotNull(), "salary_period": F.col("salary_period").isNotNull(),
        "any_salary_bound": lo.isNotNull() | hi.isNotNull(), "complete_intervals": both, "partial_intervals": lo.isNull() != hi.isNull(), "invalid_numeric_intervals": both & ((lo < 0) | (hi < 0) | (lo > hi)), "unsupported_units": both & ~supported, "valid_intervals": both & (lo >= 0) & (hi >= lo) & supported,
    } | {c: _filled(c) for c in TEXT_FIELDS} | {"normalized_skills": F.coalesce(F.size("normalized_skills"), F.lit(0)) > 0}
    return df.agg(F.count(F.lit(1)).alias("postings"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def blockers(audit: dict) -> list[str]:
    """Why salaries can't be modelled from what the audit found."""
    out = []
    if not audit["valid_intervals"]:
        out.append("no valid salary interval")
    if not audit["normalized_skills"]:
        out.append("no normalized skills in the postings")
    if audit["unsupported_units"]:
        out.append("intervals in unsupported units")
    return out


def sidecar(side: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows, rows with skills, assignments, distinct and repeated ids, ids with and without a posting. Ids of jobs are made distinct first."""
    known = jobs.select(F.col("job_id").alias("k")).distinct()
    j = side.join(known, side["job_id"] == known["k"], "left")
    n = F.coalesce(F.size("skill_ids"), F.lit(0))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(n > 0).alias("rows_with_skills"), F.coalesce(F.sum(n), F.lit(0)).alias("assignments"), F.countDistinct("job_id").alias("distinct_ids"), (F.count(F.lit(1)) - F.countDistinct("job_id")).alias("duplicate_rows"), F.countDistinct(F.when(F.col("k").isNotNull(), F.col("job_id"))).alias("matched_ids"), F.countDistinct(F.when(F.col("k").isNull(), F.col("job_id"))).alias("unmatched_ids"))


def orphans(jobs: DataFrame, side: DataFrame) -> DataFrame:
    """``postings_without_sidecar, sidecar_without_posting`` (distinct ids)."""
    a, b = jobs.select("job_id").distinct(), side.select("job_id").distinct()
    left = a.join(b, "job_id", "left_anti").agg(F.count(F.lit(1)).alias("postings_without_sidecar"))
    return left.join(F.broadcast(b.join(a, "job_id", "left_anti").agg(F.count(F.lit(1)).alias("sidecar_without_posting"))))


def pair_lines(lines: DataFrame, value: str = "value", order: str = "pos") -> DataFrame:
    """``pos, reason`` of translation-pair lines; reason is null for a valid first occurrence. Checks stand in a fixed order, one reason a line."""
    fields = ("segment_id", "direction", "source", "reference", "hypothesis")
    t = lines.filter(F.trim(value) != "").withColumn("j", F.try_parse_json(F.col(value)))
    kind = F.schema_of_variant("j")
    get = {f: F.try_variant_get("j", f"$.{f}", "string") for f in fields}
    text = {f: F.schema_of_variant(F.try_variant_get("j", f"$.{f}", "variant")) == "STRING" for f in fields}
    ok = lambda f: F.coalesce(text[f] & (F.trim(get[f]) != ""), F.lit(False))
    reason = F.when(F.col("j").isNull(), "invalid_json").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "record_not_object").when(~ok("segment_id"), "missing_segment_id").when(~(ok("direction") & F.coalesce(get["direction"].isin(*DIRECTIONS), F.lit(False))), "unsupported_direction")
    for f in fields[2:]:
        reason = reason.when(~ok(f), f"missing_{f}")
    r = t.select(F.col(order).alias("pos"), get["segment_id"].alias("segment_id"), get["direction"].alias("direction"), reason.alias("reason"))
    # only valid lines compete for an id; the others, however many lack one, are spread by their place
    n = F.row_number().over(Window.partitionBy(F.when(F.col("reason").isNull(), F.col("segment_id")), F.when(F.col("reason").isNotNull(), F.col("pos"))).orderBy("pos"))
    return r.withColumn("n", n).select("pos", "segment_id", "direction", F.when(F.col("reason").isNull() & (F.col("n") > 1), "duplicate_segment_id").otherwise(F.col("reason")).alias("reason"))


def pair_report(lines: DataFrame) -> dict:
    """Counts by reason and direction, and the status of a pair file."""
    rows = pair_lines(lines).groupBy("reason", "direction").agg(F.count(F.lit(1)).alias("n")).collect()
    valid = sum(r["n"] for r in rows if r["reason"] is None)
    invalid = sum(r["n"] for r in rows if r["reason"] is not None)
    reasons: dict[str, int] = {}
    for r in rows:
        if r["reason"]:
            reasons[r["reason"]] = reasons.get(r["reason"], 0) + r["n"]
    status = "not_evaluable" if not valid else "input_needs_review" if invalid else "pairs_validated_scoring_not_implemented"
    return {"status": status, "records_read": valid + invalid, "valid_records": valid, "invalid_records": invalid, "duplicate_segment_ids": reasons.get("duplicate_segment_id", 0), "invalid_reasons": reasons, "directions": {r["direction"]: r["n"] for r in rows if r["reason"] is None}}


def gold(labels: DataFrame, taxonomy: DataFrame, languages: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """Rows, ids missing or repeated, unknown languages, null lists, unknown skills, and positive labels of a gold table."""
    known = taxonomy.agg(F.collect_set("skill_id").alias("known"))  # as long as the taxonomy
    g = labels.join(F.broadcast(known))
    ids = F.coalesce("skill_ids", F.array().cast("array<string>"))
    return g.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("job_id").isNull() | (F.trim("job_id") == "")).alias("rows_without_id"), (F.count("job_id") - F.countDistinct("job_id")).alias("repeated_ids"), F.count_if(~F.coalesce(F.col("primary_language").isin(*languages), F.lit(False))).alias("other_languages"), F.count_if(F.col("skill_ids").isNull()).alias("null_lists"), F.coalesce(F.sum(F.size(F.array_except(ids, "known"))), F.lit(0)).alias("unknown_skills"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("positive_labels"))


def leakage(gold_rows: DataFrame, side: DataFrame) -> DataFrame:
    """Gold ids, and those that the weak-label sidecar holds, too, with and without skills there."""
    s = side.groupBy("job_id").agg(F.max(F.coalesce(F.size("skill_ids"), F.lit(0))).alias("n"))
    j = gold_rows.select("job_id").distinct().join(s, "job_id", "left")
    return j.agg(F.count(F.lit(1)).alias("gold_ids"), F.count("n").alias("in_sidecar"), F.count_if(F.col("n") > 0).alias("in_sidecar_with_skills"))


def outside_manifest(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Annotated ids that the manifest does not list; any row is an error of the benchmark."""
    return annotations.select("job_id").distinct().join(manifest.select("job_id").distinct(), "job_id", "left_anti")


def progress(annotations: DataFrame, manifest: DataFrame, pilot: DataFrame | None = None) -> DataFrame:
    """``annotator, split, done, total, remaining`` of each annotator and split, and ``pilot_remaining`` (of all splits) where a pilot is given."""
    m = manifest.select("job_id", "split").distinct()
    totals = m.groupBy("split").agg(F.countDistinct("job_id").alias("total"))
    reviewed = annotations.filter("skills is not null").select("annotator", "job_id").distinct()
    done = reviewed.join(m, "job_id").groupBy("annotator", "split").agg(F.countDistinct("job_id").alias("done"))
    every = reviewed.select("annotator").distinct().join(F.broadcast(totals.agg(F.collect_list("split").alias("s")))).select("annotator", F.explode("s").alias("split"))  # an annotator may have begun one split only
    out = every.join(done, ["annotator", "split"], "left").join(F.broadcast(totals), "split").withColumn("done", F.coalesce("done", F.lit(0)))
    out = out.select("annotator", "split", "done", "total", (F.col("total") - F.col("done")).alias("remaining"))
    if pilot is None:
        return out
    p = pilot.select("job_id").distinct()
    seen = reviewed.join(p, "job_id").groupBy("annotator").agg(F.count(F.lit(1)).alias("_seen"))
    size = p.agg(F.count(F.lit(1)).alias("_pilot"))
    return out.join(seen, "annotator", "left").join(F.broadcast(size)).select(*out.columns, (F.col("_pilot") - F.coalesce("_seen", F.lit(0))).alias("pilot_remaining"))


def annotations_from_csv(rows: DataFrame, annotator: str) -> DataFrame:
    """``job_id, annotator, skills`` of ``job_id, skill, label`` rows; a blank skill is a review without skills. Repeated skills and unknown labels are errors, and nothing is given then."""
    r = rows.select(F.trim("job_id").alias("job_id"), F.trim(F.coalesce("skill", F.lit(""))).alias("skill"), F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("label"))
    bad = r.filter((F.col("skill") != "") & ~F.col("label").isin(*LABELS)).limit(1).collect()
    if bad:
        raise ValueError(f"label {bad[0]['label']!r} of {bad[0]['job_id']} is unknown")
    twice = r.filter("skill <> ''").groupBy("job_id", "skill").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"skill {twice[0]['skill']} stands twice for {twice[0]['job_id']}")
    return r.groupBy("job_id").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("skill", "label")), lambda e: e["skill"] != "")).alias("skills")).select("job_id", F.lit(annotator).alias("annotator"), "skills")


def readiness(packages: tuple[str, ...], artifacts: tuple[str, ...]) -> dict:
    """Gates on installed packages and files that are there; nothing is measured or invented."""
    gates = {f"package {p}": find_spec(p) is not None for p in packages} | {f"file {a}": Path(a).is_file() for a in artifacts}
    return {"gates": gates, "ready": all(gates.values()), "missing": [k for k, v in gates.items() if not v]}


def baseline_scores(path: str | Path) -> dict | None:
    """Overall scores of a baseline report, None if there is none."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")).get("overall") if p.is_file() else None
