"""Weekly cohorts of postings and their skills. Weeks begin on Monday; rows without a date are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.session import collect_bounded

#: Skills that a taxonomy may have in a weekly grid.
MOST_SKILLS = 20_000


def week(date: str | Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def weekly_postings(postings: DataFrame, date: str = "collection_date") -> DataFrame:
    """``week_start, postings`` of observed weeks."""
    return postings.filter(F.col(date).isNotNull()).groupBy(week(date).alias("week_start")).agg(F.count(F.lit(1)).alias("postings"))


def weekly_skills(postings: DataFrame, sidecar: DataFrame, date: str = "collection_date") -> DataFrame:
    """``week_start, skill_id, postings``."""
    dated = postings.filter(F.col(date).isNotNull()).select("job_id", week(date).alias("week_start"))
    return dated.join(sidecar.select("job_id", F.explode("skill_ids").alias("skill_id")), "job_id").groupBy("week_start", "skill_id").agg(F.count(F.lit(1)).alias("postings"))


def spine(weekly: DataFrame) -> DataFrame:
    """Every calendar week from the first to the last: ``week_start, postings, has_observations, compared_with_week, weeks_since``.

    The comparison week is the last observed one, so it is found among observed weeks before the gaps are filled in. There are
    as many rows as weeks: the window without a partition stays small whatever the number of postings.
    """
    seen = weekly.withColumn("previous", F.lag("week_start").over(Window.orderBy("week_start")))
    all_ = weekly.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_start"))
    j = all_.join(seen, "week_start", "left")
    return j.select("week_start", F.coalesce("postings", F.lit(0)).alias("postings"), F.col("postings").isNotNull().alias("has_observations"), F.col("previous").alias("compared_with_week"), F.floor(F.datediff("week_start", "previous") / 7).cast("int").alias("weeks_since"))


def top_skills(weekly: DataFrame, skills: DataFrame, n: int = 10) -> DataFrame:
    """``week_start, rank, skill_id, postings, share_pct``: the n most frequent skills of each week, ties by id."""
    w = Window.partitionBy("week_start").orderBy(F.desc("postings"), "skill_id")
    top = skills.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.join(F.broadcast(weekly.withColumnRenamed("postings", "total")), "week_start").select("week_start", "rank", "skill_id", "postings", F.round(100 * F.col("postings") / F.col("total"), 4).alias("share_pct"))


def share_deltas(weekly: DataFrame, skills: DataFrame, taxonomy: DataFrame, n: int = 5) -> DataFrame:
    """``week_start, compared_with_week, direction, rank, skill_id, current_postings, previous_postings, delta_points``.

    Every skill of the taxonomy has a share in every observed week (0 if absent); zero deltas leave before rounding, and the
    direction follows the rounded delta. Weeks x taxonomy is bounded by both lists.
    """
    seen = weekly.select("week_start", F.col("postings").alias("total")).withColumn("compared_with_week", F.lag("week_start").over(Window.orderBy("week_start"))).withColumn("total_before", F.lag("total").over(Window.orderBy("week_start")))
    grid = seen.filter("compared_with_week is not null").withColumn("skill_id", F.explode(F.array(*[F.lit(r[0]) for r in collect_bounded(taxonomy.select("skill_id").distinct().orderBy("skill_id"), MOST_SKILLS, "the taxonomy")])))
    now = skills.select("week_start", "skill_id", F.col("postings").alias("current_postings"))
    before = skills.select(F.col("week_start").alias("compared_with_week"), "skill_id", F.col("postings").alias("previous_postings"))
    g = grid.join(now, ["week_start", "skill_id"], "left").join(before, ["compared_with_week", "skill_id"], "left").fillna(0, ["current_postings", "previous_postings"])
    d = g.withColumn("delta", F.col("current_postings") / F.col("total") - F.col("previous_postings") / F.col("total_before")).filter("delta <> 0").withColumn("delta_points", F.round(100 * F.col("delta"), 4)).filter("delta_points <> 0")
    d = d.withColumn("direction", F.when(F.col("delta_points") > 0, "increase").otherwise("decrease"))
    w = Window.partitionBy("week_start", "direction").orderBy(F.desc(F.abs("delta_points")), "skill_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("week_start", "compared_with_week", "direction", "rank", "skill_id", "current_postings", "previous_postings", "delta_points")


def summary(weekly: DataFrame) -> DataFrame:
    """Observed, calendar and missing weeks, smallest and largest observed volume and their ratio."""
    s = weekly.agg(F.count(F.lit(1)).alias("observed_weeks"), F.min("postings").alias("min_postings"), F.max("postings").alias("max_postings"), (F.floor(F.datediff(F.max("week_start"), F.min("week_start")) / 7) + 1).alias("calendar_weeks"))
    return s.select("observed_weeks", "calendar_weeks", (F.col("calendar_weeks") - F.col("observed_weeks")).alias("missing_weeks"), "min_postings", "max_postings", F.round(F.try_divide(F.col("max_postings").cast("double"), F.col("min_postings").cast("double")), 2).alias("volume_ratio"))


def report(postings: DataFrame, sidecar: DataFrame, taxonomy: DataFrame, top: int = 20) -> dict:
    """The weekly report as a document. Counts per week and skill are few; cohorts say nothing about the growth of a market."""
    weekly, skills = weekly_postings(postings).cache(), weekly_skills(postings, sidecar).cache()
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "market_growth_inference_allowed": False,
        "summary": weekly.transform(summary).first().asDict(),
        "weeks": rows(spine(weekly).orderBy("week_start")),
        "top_skills_by_week": rows(top_skills(weekly, skills).orderBy("week_start", "rank")),
        "share_deltas": rows(share_deltas(weekly, skills, taxonomy).orderBy("week_start", "direction", "rank")),
        "top_skills": rows(skills.groupBy("skill_id").agg(F.sum("postings").alias("postings")).orderBy(F.desc("postings"), "skill_id").limit(top)),
    }
    weekly.unpersist()
    skills.unpersist()
    return out
