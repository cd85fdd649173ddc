"""Queries over the tables of a directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.operators import units
from stellwerk.plans import reports
from stellwerk.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Salaries in whole euros a year, between 8,000 and 400,000."""
    amounts = units.to_common_unit(table(spark, d, "jobs"), table(spark, d, "unit_rates"))
    return amounts.filter(F.col("eur_per_year").between(8_000, 400_000)).select("job_id", "eur_per_year").distinct()


def p2_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every amount with the unit that it was read in; what stays open is null."""
    return units.to_common_unit(table(spark, d, "jobs"), table(spark, d, "unit_rates")).distinct()


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """Amounts whose two fields name units of unit_rates as they stand there (case and blanks apart), read from the fields alone."""
    jobs = table(spark, d, "jobs", "job_id", "salary_min", "salary_currency", "salary_period").withColumn("description", F.lit(None).cast("string"))
    units_ = lambda kind, field: F.broadcast(table(spark, d, "unit_rates").filter(F.col("unit_kind") == kind).select(F.lower("unit").alias(field)))
    named = jobs.withColumns({"c": F.lower(F.trim("salary_currency")), "p": F.lower(F.trim("salary_period"))}).join(units_("currency", "c"), "c").join(units_("period", "p"), "p")
    return units.to_common_unit(named, table(spark, d, "unit_rates")).select("job_id", "currency", "period", "eur_per_year").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_amounts, p2_fields)} | reports.QUERIES
SQL: dict[str, str] = {
    "p2_fields": """
        SELECT DISTINCT j.job_id, c.unit AS currency, p.unit AS period, CAST(round(CAST(j.salary_min AS DECIMAL(38, 4)) * CAST(c.factor AS DECIMAL(9, 6)) * CAST(p.factor AS DECIMAL(9, 2))) AS BIGINT) AS eur_per_year
        FROM jobs j
        JOIN unit_rates c ON c.unit_kind = 'currency' AND lower(c.unit) = lower(trim(j.salary_currency))
        JOIN unit_rates p ON p.unit_kind = 'period' AND lower(p.unit) = lower(trim(j.salary_period))
        WHERE j.salary_min IS NOT NULL AND j.job_id IS NOT NULL""",
} | reports.SQL
