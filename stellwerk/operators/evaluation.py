"""Scores: precision and recall of pair sets with slices, kappa, ranking metrics, bootstrap, partition indices."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOTSTRAP = 1000
#: Grades of judged postings (fixed domain), and fully judged queries that a comparison needs.
GRADES, LEAST_QUERIES = (0, 1, 2, 3), 20
SYSTEMS = ("matcher", "random")
METRICS = ("precision_at_k", "recall_at_k_pooled", "mrr", "ndcg_at_k")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def confusion(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``in_gold, in_pred``: a union grouped by pair, one shuffle."""
    both = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*keys).agg((F.max("g") == 1).alias("in_gold"), (F.max("p") == 1).alias("in_pred"))


def precision_recall(pairs: DataFrame, slices: list[str] | None = None) -> DataFrame:
    """``[slices,] tp, fp, fn, precision, recall, f1``."""
    g, p = F.col("in_gold"), F.col("in_pred")
    one = pairs.groupBy(*(slices or [])).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return one.select(*(slices or []), "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def kappa_counts(both: Column, only_a: Column, only_b: Column, total: Column) -> Column:
    """Cohen's kappa of two yes/no judges from their counts; null where chance agreement is complete or nothing is shared."""
    t = total.cast("double")
    observed = 1 - F.try_divide(only_a + only_b, t)
    pa, pb = F.try_divide(both + only_a, t), F.try_divide(both + only_b, t)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.try_divide(observed - chance, F.nullif(1 - chance, F.lit(0.0)))


def annotator_pairs(reviews: DataFrame, n_skills: int) -> DataFrame:
    """``annotator_a, annotator_b, jobs, both, only_a, only_b, kappa`` of reviews ``annotator, job_id, ids`` (arrays), each pair once.

    Reviewers of a posting meet in a hash join on it; their number is bounded by the list of annotators.
    """
    a = reviews.select(F.col("annotator").alias("annotator_a"), "job_id", F.col("ids").alias("x"))
    b = reviews.select(F.col("annotator").alias("annotator_b"), "job_id", F.col("ids").alias("y"))
    j = a.join(b, "job_id").filter("annotator_a < annotator_b")
    g = j.groupBy("annotator_a", "annotator_b").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.size(F.array_intersect("x", "y"))).alias("both"), F.sum(F.size(F.array_except("x", "y"))).alias("only_a"), F.sum(F.size(F.array_except("y", "x"))).alias("only_b"))
    return g.withColumn("kappa", kappa_counts(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("jobs") * n_skills))


def review_status(pairs: DataFrame, annotators: int, least_jobs: int = 20) -> str:
    """multi_annotator_reviewed with at least two annotators and enough shared postings, else insufficient_overlap."""
    top = pairs.agg(F.max("jobs").alias("m")).first()["m"] or 0
    return "multi_annotator_reviewed" if annotators >= 2 and top >= least_jobs else "insufficient_overlap"


def binary_ranking(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, precision_at_k, recall_at_k, mrr, ndcg_at_k`` of ranked ``query_id, job_id, rank`` and relevant ``query_id, job_id``."""
    total = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "job_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = total.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select("query_id", (F.col("hits") / k).alias("precision_at_k"), (F.col("hits") / F.col("n_rel")).alias("recall_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg_at_k"))


def graded_ranking(ranked: DataFrame, grades: DataFrame, k: int, relevant: int = 2) -> DataFrame:
    """As above with grades: gain 2^g - 1, the ideal over all judged grades, relevant from grade `relevant`; unjudged counts as 0."""
    # the ideal order needs only how many postings have each grade: no sort of all judged postings of a query
    counted = grades.groupBy("query_id").agg(*[F.count_if(F.col("grade") >= g).alias(f"n{g}") for g in GRADES[1:]])
    top = ranked.filter(F.col("rank") <= k).join(grades, ["query_id", "job_id"])
    got = top.groupBy("query_id").agg(F.collect_list(F.struct("rank", "grade")).alias("top"))  # at most k
    return graded_scores(counted.join(got, "query_id", "left"), k, relevant)


def graded_scores(rows: DataFrame, k: int, relevant: int = 2, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The metrics of ``keys, top, n1, n2, n3``: grades of the ranked postings as ``rank, grade``, and how many judged postings
    have at least each grade."""
    discount = lambda i: F.log2(i + 1.0)
    at = lambda i: sum((F.when(i <= F.col(f"n{g}"), float(2 ** (g - 1))).otherwise(0.0) for g in GRADES[1:]), F.lit(0.0))
    top = F.coalesce("top", F.array())
    hits = F.filter(top, lambda x: x["grade"] >= relevant)
    j = rows.select(
        *keys,
        F.col(f"n{relevant}").alias("n_rel"),
        F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + at(i) / discount(i)).alias("idcg"),
        F.size(hits).alias("hits"),
        F.array_min(F.transform(hits, lambda x: x["rank"])).alias("first"),
        F.aggregate(F.array_sort(top), F.lit(0.0), lambda s, x: s + F.coalesce(F.pow(F.lit(2.0), x["grade"]) - 1, F.lit(0.0)) / discount(x["rank"])).alias("dcg"),
    )
    return j.select(*keys, (F.col("hits") / k).alias("precision_at_k"), ratio(F.col("hits"), F.col("n_rel")).alias("recall_at_k_pooled"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio(F.col("dcg"), F.col("idcg")).alias("ndcg_at_k"))


def macro_means(per_query: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """``queries_evaluated`` and the mean of each metric over queries, rounded to six digits."""
    return per_query.agg(F.count(F.lit(1)).alias("queries_evaluated"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def mean_intervals(rows: list[list[float]], seed: int, draws: int = BOOTSTRAP) -> list[tuple[float, float, float]]:
    """Of each column, the mean and the 95 % percentile interval of the mean over resampled rows.

    The draws are those of ``random.Random(seed).choices``: numpy continues the same generator.
    """
    values, stream = np.array(rows, np.longdouble), np.random.RandomState()
    _, (*key, at), _ = random.Random(seed).getstate()
    stream.set_state(("MT19937", np.array(key, np.uint32), at))
    n = len(values)
    mean = lambda x: x.sum(axis=0).astype(float) / n
    means = np.sort(np.array([mean(values[(stream.random_sample(n) * n).astype(np.int64)]) for _ in range(draws)]), axis=0)
    return [tuple(map(float, t)) for t in zip(mean(values), means[int(0.025 * draws)], means[int(0.975 * draws) - 1])]


def matching_report(queries: DataFrame, sheet: DataFrame, pools: DataFrame, k: int, seed: int) -> dict:
    """The matcher against random draws on judged pools, behind gates.

    queries: ``query_id, source_job_id``; sheet: ``query_id, job_id, grade`` (null: not judged yet); pools: ``query_id, matcher,
    random``. A sheet row of an unknown query, a grade outside 0 to 3, and a source posting in its own pool are errors. With
    fewer than LEAST_QUERIES fully judged queries no metric is given.
    """
    strange = sheet.join(queries.select("query_id"), "query_id", "left_anti").select("query_id").limit(1).collect()
    if strange:
        raise ValueError(f"the sheet judges an unknown query {strange[0][0]}")
    if sheet.filter(F.col("grade").isNotNull() & ~F.col("grade").isin(*GRADES)).limit(1).count():
        raise ValueError("a grade is not 0, 1, 2, 3 or null")
    leak = pools.join(queries.filter("source_job_id is not null").select("query_id", "source_job_id"), "query_id").filter(F.array_contains(F.concat("matcher", "random"), F.col("source_job_id"))).limit(1).collect()
    if leak:
        raise ValueError(f"the source posting of {leak[0]['query_id']} stands in its own ranking")
    entry = F.struct("job_id", "grade")
    judged = sheet.groupBy("query_id").agg(F.count_if(F.col("grade").isNull()).alias("open"), F.collect_list(entry).alias("judged"), *[F.count_if(F.col("grade") >= g).alias(f"n{g}") for g in GRADES[1:]])
    out: dict = {"k": k, "minimum_queries": LEAST_QUERIES, "queries_total": queries.count(), "queries_fully_judged": judged.filter("open = 0").count()}
    if out["queries_fully_judged"] < LEAST_QUERIES:
        return out | {"status": "insufficient_labels"}
    whole = judged.filter("open = 0").join(pools.select("query_id", "matcher", "random"), "query_id", "left")

    def top(system: str) -> Column:
        """Grades of a system's ranking, as the sheet has them."""
        return F.flatten(F.transform(system, lambda job, i: F.transform(F.filter("judged", lambda x: x["job_id"] == job), lambda x: F.struct((i + 1).alias("rank"), x["grade"].alias("grade")))))

    # both systems in one pass; one row a query judged by hand
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), top(s).alias("top")) for s in SYSTEMS]))
    rows = graded_scores(whole.withColumn("x", both).select("query_id", "x.system", "x.top", "n1", "n2", "n3"), k, keys=("system", "query_id"))
    by: dict[str, list] = {s: [] for s in SYSTEMS}
    for system, *values in rows.orderBy("system", "query_id").select("system", *METRICS).collect():
        by[system].append(values)
    return out | {"status": "scored", "systems": {s: dict(zip(METRICS, mean_intervals(v, seed))) for s, v in by.items()}}


def bootstrap(counts: list[tuple[int, int, int]], seed: int, draws: int = BOOTSTRAP) -> dict[str, tuple[float, float]]:
    """95 % percentile intervals of micro precision, recall and F1 over resampled postings. Labelled postings are few; runs on the driver."""
    rng = random.Random(seed)
    out: dict[str, list[float]] = {"precision": [], "recall": [], "f1": []}
    for _ in range(draws):
        tp, fp, fn = (sum(c) for c in zip(*rng.choices(counts, k=len(counts))))
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        for name, v in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r) if p + r else 0.0)):
            out[name].append(v)
    low, high = int(0.025 * draws), int(0.975 * draws) - 1
    return {k: (sorted(v)[low], sorted(v)[high]) for k, v in out.items()}


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """``ari`` of two partitions given as columns of one table: contingency counts, then pair counts; 1 where it is not defined."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    pairs = cells.agg(F.sum(two(F.col("n"))).alias("cell"), F.sum("n").alias("total"))
    of_a = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("first"))
    of_b = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("second"))
    j = pairs.join(F.broadcast(of_a)).join(F.broadcast(of_b))  # one row each
    expected = F.try_divide(F.col("first") * F.col("second"), two(F.col("total")))
    return j.select(F.coalesce(F.try_divide(F.col("cell") - expected, F.nullif((F.col("first") + F.col("second")) / 2 - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))
