"""Star schema of postings and skills: derived fields only, no text of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.sources.writers import write_parquet

#: Banners that stand in the location field (fixed value of the reports, and those of further sources).
LOCATION_JUNK = ("Sei einer der ersten Bewerber", "Jetzt als Erste bewerben!", "Gehöre zu den Ersten, die sich bewerben", "Be among the first to apply")
MIN_CITY_JOBS, MIN_PAIR_JOBS = 200, 20


def dim_skill(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("skill_id", "label", "category")


def fact_job(postings: DataFrame, sidecar: DataFrame) -> DataFrame:
    """One row per posting; a posting without a sidecar row counts no skills."""
    sizes = sidecar.select("job_id", F.coalesce(F.size("skill_ids"), F.lit(0)).cast("long").alias("n"))
    j = postings.select("job_id", "location", "collection_date").join(sizes, "job_id", "left")
    return j.select("job_id", F.col("location").alias("location_raw"), "collection_date", F.when(~F.coalesce(F.col("location").isin(*LOCATION_JUNK), F.lit(False)), F.col("location")).alias("city"), F.coalesce("n", F.lit(0)).cast("long").alias("skill_count"), (F.coalesce("n", F.lit(0)) > 0).alias("has_skills"))


def bridge_job_skill(sidecar: DataFrame) -> DataFrame:
    """``job_id, skill_id`` as listed; null and empty lists vanish."""
    return sidecar.select("job_id", F.explode("skill_ids").alias("skill_id"))


def skill_by_city(fact: DataFrame, bridge: DataFrame, least: int = MIN_CITY_JOBS) -> DataFrame:
    """``city, skill_id, jobs, city_jobs, share_of_city_jobs`` of cities with at least `least` postings."""
    cities = fact.filter("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("city_jobs")).filter(F.col("city_jobs") >= least)
    # the cities are pre-aggregated and few beside the postings; the optimiser may broadcast them by their size
    j = bridge.join(fact.select("job_id", "city").join(cities, "city"), "job_id")
    return j.groupBy("city", "skill_id", "city_jobs").agg(F.count(F.lit(1)).alias("jobs")).select("city", "skill_id", "jobs", "city_jobs", F.round(F.col("jobs") / F.col("city_jobs"), 4).alias("share_of_city_jobs"))


def skill_pairs(bridge: DataFrame, least: int = MIN_PAIR_JOBS) -> DataFrame:
    """``skill_a, skill_b, jobs`` (a < b) in at least `least` postings, a repeated skill counting once."""
    b = bridge.filter("skill_id is not null").distinct()
    j = b.select("job_id", F.col("skill_id").alias("skill_a")).join(b.select("job_id", F.col("skill_id").alias("skill_b")), "job_id").filter("skill_a < skill_b")
    return j.groupBy("skill_a", "skill_b").agg(F.count(F.lit(1)).alias("jobs")).filter(F.col("jobs") >= least)


def measures(fact: DataFrame, bridge: DataFrame) -> DataFrame:
    """``skill_id, jobs, skill_share, ads_with_skills_pct``: the report measures by skill."""
    total = fact.agg(F.countDistinct("job_id").alias("all_jobs"), F.round(100 * F.try_divide(F.count_if("has_skills").cast("double"), F.count(F.lit(1)).cast("double")), 4).alias("ads_with_skills_pct"))
    return bridge.groupBy("skill_id").agg(F.countDistinct("job_id").alias("jobs")).join(F.broadcast(total)).select("skill_id", "jobs", F.round(F.try_divide(F.col("jobs").cast("double"), F.col("all_jobs").cast("double")), 4).alias("skill_share"), "ads_with_skills_pct")


def export(postings: DataFrame, sidecar: DataFrame, taxonomy: DataFrame, folder: str) -> dict[str, int]:
    """Write the five tables and return their row counts."""
    spark = postings.sparkSession
    fact, bridge = fact_job(postings, sidecar), bridge_job_skill(sidecar)
    tables = {"dim_skill": dim_skill(taxonomy), "fact_job": fact, "bridge_job_skill": bridge, "agg_skill_by_city": skill_by_city(fact, bridge), "agg_skill_pairs": skill_pairs(bridge)}
    counts = {}
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{folder}/{name}.parquet").count()
    return counts
