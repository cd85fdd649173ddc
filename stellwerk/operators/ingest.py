"""Raw records to canonical postings: projection, rejection, first-wins deduplication, statistics, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions import ids, text
from stellwerk.schema import ALIASES, POSTING

REDACTED = ("title", "company", "location", "description")


def canonical(records: DataFrame, source: str) -> DataFrame:
    """Canonical postings with `_pos`, `_reject` (null if valid), `_emails`, `_phones` and `_key`; columns that are not there count as null."""
    have = set(records.columns)
    pick = lambda field: F.coalesce(*[F.col(n) if n in have else F.lit(None).cast("string") for n in ALIASES[field]], F.lit(None).cast("string"))
    about = text.first_location(F.col("about_work")) if "about_work" in have else F.lit(None).cast("string")
    raw = {f: pick(f) for f in ALIASES} | {"location": F.coalesce(pick("location"), about)}
    # cleaned first, in a projection of its own: each pattern runs once a row
    df = records.select(F.col("_pos") if "_pos" in have else F.lit(None).cast("long").alias("_pos"), F.coalesce("_invalid", F.lit(False)).alias("_invalid") if "_invalid" in have else F.lit(False).alias("_invalid"), *[text.clean(c).alias(f) for f, c in raw.items()])
    counts = [text.redaction_counts(F.col(f)) for f in REDACTED]
    df = df.withColumns({"_emails": sum((a for a, _ in counts[1:]), counts[0][0]), "_phones": sum((b for _, b in counts[1:]), counts[0][1])})
    df = df.withColumns({f: text.redact(F.col(f)) for f in REDACTED})
    content = ids.content_hash(*(F.col(f) for f in REDACTED))
    df = df.withColumns({"_reject": F.when(F.col("_invalid"), "invalid_source_record").when(F.col("title").isNull(), "missing_title"), "job_id": ids.job_id(F.col("source_url"), content), "_key": ids.dedup_key(F.col("source_url"), content), "source": F.lit(source), "collection_date": text.parse_date(F.col("collection_date")), "publication_date": text.parse_date(F.col("publication_date"))})
    missing = {f.name: F.lit(None).cast(f.dataType) for f in POSTING if f.name not in df.columns}
    return df.withColumns(missing).select(*POSTING.names, "_pos", "_reject", "_emails", "_phones", "_key")


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. One shuffle by key; a window group limit drops later rows before it."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def ingest(records: DataFrame, source: str) -> DataFrame:
    """Valid postings, each key once."""
    valid = canonical(records, source).filter("_reject is null")
    return first_wins(valid, F.col("_key"), [F.col("_pos")]).select(*POSTING.names)


def reject_reasons(records: DataFrame, source: str) -> DataFrame:
    """``reason, n`` of rejected records."""
    return canonical(records, source).filter("_reject is not null").groupBy(F.col("_reject").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def statistics(records: DataFrame, source: str) -> DataFrame:
    """Read, valid, invalid, output and duplicate rows, and redactions over valid rows before deduplication, in one pass."""
    valid = F.col("_reject").isNull()
    return canonical(records, source).agg(
        F.count(F.lit(1)).alias("records_read"), F.count_if(valid).alias("records_valid"), F.count_if(~valid).alias("records_invalid"), F.countDistinct(F.when(valid, F.col("_key"))).alias("records_output"),
        (F.count_if(valid) - F.countDistinct(F.when(valid, F.col("_key")))).alias("duplicates"), F.coalesce(F.sum(F.when(valid, F.col("_emails"))), F.lit(0)).alias("email_redactions"), F.coalesce(F.sum(F.when(valid, F.col("_phones"))), F.lit(0)).alias("phone_redactions"),
    )


def coverage(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``field, non_null, total, fraction`` of each column: one aggregation, then one row per column."""
    names = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("non_null")) for i, c in enumerate(names)])
    rows = one.select("total", F.explode(pairs).alias("p"))
    return rows.select("p.field", "p.non_null", "total", F.coalesce(F.try_divide(F.col("p.non_null").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("fraction"))


#: Analyses of the weekly report and the fields that they need (fixed values); a job family is in no field.
ANALYSES = {"publication_week_trends": ("publication_date",), "geographic_trends": ("federal_state",), "remote_work_trends": ("remote_type",), "salary_trends": ("salary_min", "salary_max"), "language_requirements": ("language_requirements",)}


def unavailable_analyses(df: DataFrame) -> DataFrame:
    """``analysis, reason`` of the analyses whose fields hold no value at all. One aggregation."""
    fields = list(dict.fromkeys(f for fs in ANALYSES.values() for f in fs))
    some = lambda f: F.size(f) > 0 if df.schema[f].dataType.typeName() == "array" else F.trim(F.col(f).cast("string")) != ""
    one = df.agg(*[F.count_if(some(f)).alias(f) for f in fields])
    lost = [F.when(sum((F.col(f) for f in fs[1:]), F.col(fs[0])) == 0, F.struct(F.lit(a).alias("analysis"), F.lit(f"{' and '.join(fs)} {'has' if len(fs) == 1 else 'have'} no populated values").alias("reason"))) for a, fs in ANALYSES.items()]
    family = F.struct(F.lit("job_family_volume").alias("analysis"), F.lit("no validated job-family field is available").alias("reason"))
    return one.select(F.explode(F.filter(F.array(*lost, family), lambda x: x.isNotNull())).alias("x")).select("x.analysis", "x.reason")


def residual(df: DataFrame, columns: tuple[str, ...] = REDACTED) -> DataFrame:
    """Rows whose text still matches a mail address or a phone number."""
    joined = F.concat_ws(" ", *columns)
    return df.agg(F.count_if(joined.rlike(text.EMAIL_RESIDUAL)).alias("email_rows"), F.count_if(joined.rlike(text.PHONE)).alias("phone_rows"))


def quality_report(records: DataFrame, written: DataFrame, source: str) -> dict:
    """Statistics, coverage, residual scan, date range and gates of a written table."""
    stats, left = statistics(records, source).first().asDict(), residual(written).first().asDict()
    fields = {r["field"]: (r["non_null"], r["fraction"]) for r in coverage(written).collect()}
    span = written.agg(F.count(F.lit(1)).alias("rows"), F.min("collection_date").alias("first"), F.max("collection_date").alias("last")).first().asDict()
    gates = {"row_count_matches": span["rows"] == stats["records_output"], "no_residual_contacts": left["email_rows"] == 0 and left["phone_rows"] == 0, "title_always_present": span["rows"] == fields["title"][0]}
    return {"statistics": stats, "residual": left, "field_coverage": {k: {"non_null": a, "fraction": b} for k, (a, b) in fields.items()}, "collection_dates": span, "gates": gates, "passed": all(gates.values())}
