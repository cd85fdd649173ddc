"""Schemas of the tables, and checks that Spark does not make on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D = T.StringType(), T.DateType()
POSTING = T.StructType(
    [T.StructField(n, _S, n not in ("job_id", "source", "title")) for n in ("job_id", "source", "source_url", "title", "company", "location", "federal_state", "remote_type", "employment_type", "experience_level")]
    + [T.StructField(n, T.DoubleType()) for n in ("salary_min", "salary_max")]
    + [T.StructField(n, _S) for n in ("salary_currency", "salary_period", "description", "requirements", "responsibilities", "benefits")]
    + [T.StructField(n, T.ArrayType(_S)) for n in ("language_requirements", "extracted_skills", "normalized_skills")]
    + [T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("publication_date", _D), T.StructField("collection_date", _D)]
)
SIDECAR = T.StructType([T.StructField("job_id", _S, False), T.StructField("skill_ids", T.ArrayType(_S))])
GOLD = T.StructType([T.StructField("job_id", _S), T.StructField("primary_language", _S), T.StructField("skill_ids", T.ArrayType(_S))])
ANNOTATION = T.StructType([T.StructField("job_id", _S), T.StructField("annotator", _S), T.StructField("skills", T.MapType(_S, _S))])
MANIFEST = T.StructType([T.StructField(n, _S) for n in ("job_id", "split", "stratum", "heuristic_language")])
MATCH_QUERY = T.StructType([T.StructField(n, _S) for n in ("query_id", "candidate_id", "split")] + [T.StructField("candidate_skill_ids", T.ArrayType(_S)), T.StructField("source_job_id", _S)])
JUDGEMENT = T.StructType([T.StructField("query_id", _S), T.StructField("job_id", _S), T.StructField("grade", T.IntegerType()), T.StructField("judge", _S)])
#: Fields of raw records that are read, with their accepted names in order; all others are dropped.
ALIASES = {
    "title": ("title", "job_title", "position"),
    "company": ("company", "employer", "firm"),
    "location": ("location", "city", "place"),
    "description": ("description", "job_description", "description_text", "info_1"),
    "source_url": ("source_url", "url", "oj_id"),
    "collection_date": ("collection_date", "date_scrape", "fetched_at"),
    "publication_date": ("publication_date", "posted_date", "date_posted"),
}
RAW = T.StructType([T.StructField(n, _S) for n in [*dict.fromkeys(n for names in ALIASES.values() for n in names), "about_work", "_corrupt_record"]])


def require_columns(df: DataFrame, names: list[str] | tuple[str, ...], what: str) -> None:
    """An error that names the missing columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} has no column {', '.join(missing)}")


def require_values(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    """An error where a required value is null or empty."""
    bad = df.filter(" or ".join(f"`{n}` is null or trim(`{n}`) = ''" for n in names)).limit(1).count()
    if bad:
        raise ValueError(f"{what} has rows without {' or '.join(names)}")


def require_one_to_one(jobs: DataFrame, sidecar: DataFrame, key: str = "job_id") -> None:
    """An error unless both tables hold the same keys, each once."""
    c = jobs.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(sidecar.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    r = c.agg(F.count_if((F.col("a") != 1) | (F.col("b") != 1)).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"the sidecar is not one-to-one with the postings: {r['bad']} keys differ")
