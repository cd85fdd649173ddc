"""Postings ranked by skill overlap with profiles, gaps with evidence, query-set checks, pools."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.ids import shuffle_key
from stellwerk.operators import lexicon, skillsets
from stellwerk.session import written_table

DECIMALS = skillsets.DECIMALS


def components(matched: Column, profile_size: Column, job_size: Column) -> dict[str, Column]:
    """Precision, coverage and their harmonic mean, rounded: ties are broken on the rounded values."""
    p, c = matched / profile_size, matched / job_size
    return {"candidate_skill_precision": F.round(p, DECIMALS), "job_skill_coverage": F.round(c, DECIMALS), "harmonic_f1": F.round(F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)), DECIMALS)}


def check_sidecar(sidecar: DataFrame, known: list[str]) -> None:
    """An error that names skills of the sidecar which the taxonomy does not have."""
    strange = sidecar.select(F.explode(F.array_except("skill_ids", F.array(*map(F.lit, known)))).alias("s")).distinct().orderBy("s").limit(10).collect()
    if strange:
        raise ValueError(f"the sidecar has skills that are not in the taxonomy: {', '.join(str(r[0]) for r in strange)}")


def rank(sidecar: DataFrame, profile: list[str], k: int, known: list[str] | None = None, excluded: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The k best postings of a profile: ``rank, job_id, match_score, ...``. A scan, a filter, and a top-k; k rows reach one task.

    known: the taxonomy in its order, in which the profile's skills are listed; strict: unknown skills of the sidecar are an error.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = list(dict.fromkeys(profile))
    if not wanted:
        raise ValueError("the profile has no skills")
    if known is not None:
        if strange := sorted(set(wanted) - set(known)):
            raise ValueError(f"the profile has skills that are not in the taxonomy: {', '.join(strange)}")
        wanted = [s for s in known if s in set(wanted)]
        if strict:
            check_sidecar(sidecar, known)
    mine = F.array(*map(F.lit, wanted))
    rows = sidecar.filter(~F.col("job_id").isin(excluded)) if excluded else sidecar
    rows = rows.withColumn("ids", F.array_distinct("skill_ids")).withColumn("m", F.size(F.array_intersect("ids", mine))).filter("m > 0")
    scored = rows.select("job_id", "ids", F.col("m").alias("matched_skill_count"), F.lit(len(wanted)).alias("candidate_skill_count"), F.size("ids").alias("job_skill_count"), *[c.alias(n) for n, c in components(F.col("m"), F.lit(len(wanted)), F.size("ids")).items()])
    best = scored.orderBy(F.desc("harmonic_f1"), F.desc("job_skill_coverage"), "job_id").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("harmonic_f1"), F.desc("job_skill_coverage"), "job_id")))
    keep = lambda test: F.filter(mine, test)
    return ranked.select("rank", "job_id", F.col("harmonic_f1").alias("match_score"), "candidate_skill_precision", "job_skill_coverage", "harmonic_f1", "matched_skill_count", "candidate_skill_count", "job_skill_count", keep(lambda s: F.array_contains("ids", s)).alias("matched_skills"), keep(lambda s: ~F.array_contains("ids", s)).alias("candidate_skills_not_in_job"), F.array_except("ids", mine).alias("gap_skills"), F.lit("unverified").alias("requirement_status"))


def counters(sidecar: DataFrame, profile: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Postings scanned, excluded, with skills, with overlap. Excluded ones are scanned but feed nothing else."""
    mine, out = F.array(*map(F.lit, profile)), F.col("job_id").isin(excluded) if excluded else F.lit(False)
    has = ~out & (F.coalesce(F.size("skill_ids"), F.lit(0)) > 0)
    return sidecar.agg(F.count(F.lit(1)).alias("postings_scanned"), F.count_if(out).alias("postings_excluded_by_id"), F.count_if(has).alias("postings_with_skills"), F.count_if(has & F.arrays_overlap("skill_ids", mine)).alias("postings_with_candidate_overlap"))


def corpus_counts(sidecar: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """``skill_id, corpus_posting_count``."""
    rows = sidecar.filter(~F.col("job_id").isin(excluded)) if excluded else sidecar
    return rows.select(F.explode(F.array_distinct("skill_ids")).alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("corpus_posting_count"))


def gaps(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """``rank, job_id, skill_id, corpus_posting_count, gap_rank``: skills of ranked postings that the profile lacks, most frequent first."""
    g = ranked.select("rank", "job_id", F.explode("gap_skills").alias("skill_id")).join(counts, "skill_id", "left")
    return g.withColumn("gap_rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("corpus_posting_count"), "skill_id"))).select("rank", "job_id", "skill_id", "corpus_posting_count", "gap_rank")


def gap_evidence(gap_rows: DataFrame, postings: DataFrame, taxonomy: lexicon.Taxonomy, width: int = 60) -> DataFrame:
    """Gaps with the number of their places in the posting's text and the first two snippets; texts are read for ranked postings only."""
    wanted = F.broadcast(gap_rows.select("job_id").distinct())  # at most k postings
    texts = postings.join(wanted, "job_id", "left_semi").select("job_id", lexicon.posting_text(F.col("title"), F.col("description")).alias("text"))
    places = lexicon.spans(texts, taxonomy, "job_id", F.col("text")).join(F.broadcast(texts), "job_id")
    from_ = F.greatest(F.col("start") - width, F.lit(0))
    snippet = F.trim(F.replace(F.substr("text", from_ + 1, F.col("end") + width - from_), F.lit("\n"), F.lit(" ")))
    n = F.row_number().over(Window.partitionBy("job_id", "skill_id").orderBy("start"))
    by_skill = places.withColumn("n", n).groupBy("job_id", "skill_id").agg(F.count(F.lit(1)).alias("occurrences_in_ad"), F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 2, F.struct("n", snippet.alias("s"))))), lambda x: x["s"]).alias("snippets"))
    return gap_rows.join(by_skill, ["job_id", "skill_id"], "left").fillna(0, ["occurrences_in_ad"])


def answered(queries: DataFrame, sidecar: DataFrame, k: int, grades: bool = False) -> DataFrame:
    """``query_id, source_job_id, candidate_skill_ids, best, n1, n2, n3`` of every query: its k best postings in order (``job_id, f1, cov, m``), and with
    grades how many postings share at least 1, 2 and 3 skills with it.

    queries: ``query_id, candidate_skill_ids``, and ``source_job_id`` where a query's own posting must not answer it.
    """
    own = F.col("source_job_id") if "source_job_id" in queries.columns else F.lit(None).cast("string")
    q = queries.select("query_id", own.alias("source_job_id"), "candidate_skill_ids", F.array_sort(F.array_distinct("candidate_skill_ids")).alias("c"))
    # one more than asked for takes the place of a query's own posting
    got = q.join(skillsets.answers(q, sidecar, k + 1, grades), "c", "left")

    def scored(x: Column) -> Column:
        parts = components(x["m"], F.size("c"), x["n_s"])
        f1, cov = parts["harmonic_f1"], parts["job_skill_coverage"]
        return F.struct((-f1).alias("by_f1"), (-cov).alias("by_cov"), x["job_id"].alias("job_id"), f1.alias("f1"), cov.alias("cov"), x["m"].alias("m"))

    others = F.filter(F.coalesce("best", F.array()), lambda x: ~x["job_id"].eqNullSafe(F.col("source_job_id")))
    best = F.slice(F.array_sort(F.transform(others, scored)), 1, k)
    return got.select("query_id", "source_job_id", "candidate_skill_ids", best.alias("best"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n1", "n2", "n3")])


def rank_queries(queries: DataFrame, sidecar: DataFrame, k: int) -> DataFrame:
    """``query_id, job_id, rank, harmonic_f1, job_skill_coverage`` of the k best postings of every query that share a skill with it."""
    rows = answered(queries, sidecar, k).select("query_id", F.posexplode("best").alias("at", "r"))
    return rows.select("query_id", "r.job_id", F.col("r.f1").alias("harmonic_f1"), F.col("r.cov").alias("job_skill_coverage"), (F.col("at") + 1).alias("rank"))


def check_queries(queries: DataFrame, known: DataFrame) -> None:
    """Errors for repeated ids, unknown splits, a candidate in both splits, and unknown skills."""
    c = queries.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("d"), F.count_if(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False))).alias("s")).first()
    if c["n"] != c["d"]:
        raise ValueError("a query id stands twice or is missing")
    if c["s"]:
        raise ValueError("a query's split is neither dev nor test")
    if queries.groupBy("candidate_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a candidate stands in both splits")
    strange = queries.select(F.explode("candidate_skill_ids").alias("skill_id")).join(known.select("skill_id"), "skill_id", "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"unknown skill {strange[0][0]}")


def _hash(seed: int, key: str) -> str:
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def pools(queries: DataFrame, sidecar: DataFrame, k: int, seed: int, candidates: int = 5000) -> DataFrame:
    """``query_id, jobs, shared, matcher, random``: the judging pool of every query, its k best and k random postings in blind order
    with the number of skills that each shares with the query, both without the query's source posting. Random ones come from the
    first `candidates` ids of the seeded order (a sampling frame, drawn once and sent to the executors, which draw by query id)."""
    spark = queries.sparkSession
    sidecar = written_table(sidecar.select("job_id", "skill_ids"), "sidecar")
    frame = spark.sparkContext.broadcast({r[0]: frozenset(r[1] or ()) for r in sidecar.orderBy(shuffle_key(F.col("job_id"), seed), "job_id").limit(candidates).collect()})
    rows = answered(queries, sidecar, k).select("query_id", "source_job_id", "candidate_skill_ids", F.col("best.job_id").alias("matcher"), F.col("best.m").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skills = frame.value
        ids = list(skills)
        for batch in batches:
            jobs, shared, drawn = [], [], []
            for query, source, wanted, matcher, m in zip(*(c.to_pylist() for c in batch.columns)):
                banned = {*matcher, source}
                # at most k + 1 of the drawn ids are banned
                draw = random.Random(_hash(seed, query)).sample(ids, min(2 * k + 1, len(ids)))
                drawn.append([j for j in draw if j not in banned][:k])
                wanted = {s for s in wanted or () if s is not None}
                common = {j: len(wanted & skills[j]) for j in drawn[-1]} | dict(zip(matcher, m))
                jobs.append(sorted(common, key=lambda j: _hash(seed, query + j)))
                shared.append([common[j] for j in jobs[-1]])
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(jobs, texts), pa.array(shared, pa.list_(pa.int32())), batch.column(3), pa.array(drawn, texts)], ["query_id", "jobs", "shared", "matcher", "random"])

    return rows.mapInArrow(run, "query_id string, jobs array<string>, shared array<int>, matcher array<string>, random array<string>")


def pool(queries: DataFrame, sidecar: DataFrame, k: int, seed: int, candidates: int = 5000) -> list[dict]:
    """The pools of a query file of a size to be judged by hand, as a list by query id."""
    return [r.asDict() for r in pools(queries, sidecar, k, seed, candidates).orderBy("query_id").collect()]
