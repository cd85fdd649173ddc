"""Queries pN_... of this subpackage over the tables of a directory, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import bpe, canonical, consensus, cooccur, language, mixing, pii, residue, toxic
from stellwerk.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(table(spark, d, "jobs", "job_id", *pii.FIELDS))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Postings whose personal items are typed placeholders."""
    return pii.redact(table(spark, d, "jobs", "job_id", *pii.FIELDS).distinct())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.typed_places(table(spark, d, "jobs", "job_id", "location"), table(spark, d, "city_reference"))


def p3_fact_job(spark: SparkSession, d: str) -> DataFrame:
    """Every fact_job.city with the entry that it means; 0 reports an unmatched value."""
    return canonical.map_values(table(spark, d, "fact_job", "job_id", "city"), table(spark, d, "city_reference"), "job_id", "city")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values of jobs.location that mean no entry, with their number of postings."""
    v = canonical.map_values(table(spark, d, "jobs", "job_id", "location").distinct(), table(spark, d, "city_reference"), "job_id", "location")
    return v.filter("city_id = 0").groupBy("location").agg(F.countDistinct("job_id").alias("n_jobs"))


def _languages(spark: SparkSession, d: str, what: Callable[..., DataFrame]) -> DataFrame:
    return what(table(spark, d, "jobs", "job_id", "source", "source_url", "description"), table(spark, d, "manifest"), table(spark, d, "skill_gold_v1"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, language.wrong_labels)


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every paragraph of every posting, and of the posting."""
    return _languages(spark, d, language.all_paragraphs)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "annotations"), table(spark, d, "adjudicated")).select("job_id", "skill_id", "label").distinct()


def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Hit and false-alarm rates of every annotator."""
    return consensus.reliability(table(spark, d, "annotations"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement of every pair of annotators."""
    return consensus.agreement(table(spark, d, "annotations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "jobs")).select("job_id", "field_name").distinct()


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    """Recurring residue messages with kind, rows and whether several sources deliver them."""
    return residue.recurring_messages(table(spark, d, "jobs"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Postings with residue fields set to null."""
    return residue.without_residue(table(spark, d, "jobs", "job_id", "source", "location", "description").distinct())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.frequent_together(table(spark, d, "job_skills"), table(spark, d, "dim_skill"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs, with counts, lift, the count expected under the null, tail and false-discovery rate."""
    return cooccur.associated_pairs(table(spark, d, "job_skills"), table(spark, d, "dim_skill"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_emitted(spark: SparkSession, d: str) -> DataFrame:
    """Every emitted copy of a document."""
    return mixing.emitted(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxic.found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, d, "documents")
    return toxic.scored(docs, toxic.fitted(docs, table(spark, d, "doc_labels")))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of every source."""
    return toxic.rates(table(spark, d, "documents"), table(spark, d, "doc_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_fact_job, p3_unmatched, p4_found, p4_paragraphs, p5_found, p5_reliability, p5_agreement, p6_found, p6_messages, p6_clean, p7_found, p7_pairs, p8_ids, p9_shares, p9_emitted, p10_found, p10_scores, p10_rates)}

SQL: dict[str, str] = {
    "p7_found": """
        WITH kept AS (
            SELECT DISTINCT j.job_id, d.skill_id AS s
            FROM (SELECT job_id, lower(trim(unnest(skill_ids))) AS s FROM job_skills WHERE job_id IS NOT NULL) j
            JOIN (SELECT DISTINCT skill_id FROM dim_skill) d ON d.skill_id = j.s),
        n_all AS (SELECT count(DISTINCT job_id) AS n FROM job_skills),
        single AS (SELECT s, count(*) AS n FROM kept GROUP BY s),
        pair AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM kept a JOIN kept b ON a.job_id = b.job_id AND a.s < b.s GROUP BY a.s, b.s)
        SELECT p.a AS skill_a, p.b AS skill_b
        FROM pair p JOIN single x ON x.s = p.a JOIN single y ON y.s = p.b, n_all
        WHERE p.n >= 5 AND p.n * n_all.n >= 4 * x.n * y.n""",
}
