"""Consensus of several annotators' labels by the triplet moment method.

Two binary questions are answered for every skill of every reviewed posting: does the posting show it, and, if it does, does
it require it. For annotators whose mistakes are independent given the truth, the chance-corrected agreement of a pair (its
covariance) is the product of one factor each, so any three annotators give the factor of each of them from their three
pairwise agreements; the median over all triplets is taken. With the prevalence, factors and marginal rates give each
annotator's hit and false-alarm rate, and votes are combined as log odds of these.

Scale: the votes are written once; the pairwise counts come from one pass over postings with the co-occurrence counts (the
positions are "annotator reviewed", "annotator says shown", "annotator says required"), summed before the shuffle; at most
(3 x annotators)^2 numbers reach the driver, which solves the triplets. Votes are combined by one grouped sum. The cuts come
from all settled postings: their scores are counted by value, and the counts run on through ranges of scores in executors.

Defined cases: names, ids and labels are compared without surrounding blanks and case; repeated submissions of an annotator
for a posting count once, the most frequent label per skill winning and the higher one on ties; null maps are no review; an
empty map is a review without skills; unknown labels say nothing; ties of the vote go to the lower label; an annotator with
fewer than three partners gets the rate of the whole; settled labels replace the vote; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.cooccur import pair_counts
from stellwerk.session import collect_bounded, written_table


def _clean(c: str | Column) -> Column:
    return F.lower(F.trim(c))


def votes_of(annotations: DataFrame) -> DataFrame:
    """``annotator, job_id, skill_id, level`` (2 required, 1 mentioned), and one row with a null skill for each review.

    One row a label and one grouping: the labels of an annotator for a skill of a posting are counted as they are summed.
    """
    rows = annotations.filter("annotator is not null and job_id is not null and skills is not null").select(_clean("annotator").alias("annotator"), "job_id", "skills")
    review = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = rows.select("annotator", "job_id", F.explode(F.concat(review, F.map_entries("skills"))).alias("e"))
    level = F.when(_clean("e.value") == "required", 2).when(_clean("e.value") == "mentioned", 1)
    rows = rows.select("annotator", "job_id", _clean("e.key").alias("skill_id"), level.alias("level")).filter("skill_id is null or (skill_id <> '' and level is not null)")
    counted = rows.groupBy("annotator", "job_id", "skill_id").agg(F.count_if(F.col("level") == 2).alias("n2"), F.count_if(F.col("level") == 1).alias("n1"))
    return counted.select("annotator", "job_id", "skill_id", F.when(F.col("skill_id").isNotNull(), F.when(F.col("n2") >= F.col("n1"), 2).otherwise(1)).alias("level"))


def triplet_factors(cov: np.ndarray, seen: np.ndarray, least: int = 20) -> np.ndarray:
    """Factor of each annotator with factor_i * factor_j = cov_ij, by the weighted median over triplets of enough common items.

    Its sign is that of the annotator's agreement with all others: one who mixes the answers up gets a negative factor.
    """
    k = len(cov)
    out = np.full(k, np.nan)
    upper = np.triu(np.ones((k, k), bool), 1)
    usable = upper & (seen >= least) & (np.abs(cov) > 1e-6)
    for i in range(k):
        # all pairs of the others at once
        weight = np.minimum(np.minimum(seen[i][:, None], seen[i][None]), seen)
        both = cov[i][:, None] * cov[i][None]
        at = usable & (weight >= least) & (both * cov > 0)
        at[i], at[:, i] = False, False
        if at.any():
            values, weights = both[at] / cov[at], weight[at]
            order = np.argsort(values, kind="stable")
            run = np.cumsum(weights[order])
            sign = np.sign((cov[i] * seen[i]).sum() - cov[i, i] * seen[i, i]) or 1.0
            out[i] = sign * np.sqrt(values[order][np.searchsorted(run, run[-1] / 2)])
    return out


def rates(both: np.ndarray, marginal: np.ndarray, seen: np.ndarray, prevalence: float | None = None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Hit rate, false-alarm rate, prevalence and pairwise kappa from counts on common items.

    both[i, j]: items both say yes to; marginal[i, j]: items i says yes to among those j has judged, too; seen[i, j]: common items.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.maximum(seen, 1)
        p_i, p_j = marginal / n, marginal.T / n
        cov = both / n - p_i * p_j
        chance = p_i * p_j + (1 - p_i) * (1 - p_j)
        agree = 1 - p_i - p_j + 2 * both / n
        kappa = np.where(chance < 1, (agree - chance) / np.maximum(1 - chance, 1e-12), np.nan)
    factor = triplet_factors(cov, seen)
    own = np.diag(marginal) / np.maximum(np.diag(seen), 1)
    fallback = np.nanmedian(factor) if np.isfinite(factor).any() else 0.6 * np.sqrt(np.nanmean(own * (1 - own)) if len(own) else 0.1)
    factor = np.where(np.isfinite(factor), factor, fallback)
    if prevalence is None:
        # the mean of marginal rates, corrected once for false alarms by the best annotators
        weight = np.maximum(factor, 1e-6) ** 2 * np.diag(seen)
        prevalence = float((own * weight).sum() / max(weight.sum(), 1e-9))
    prevalence = min(max(prevalence, 1e-3), 1 - 1e-3)
    d = np.clip(factor / np.sqrt(prevalence * (1 - prevalence)), -0.995, 0.995)
    floor = min(0.002, prevalence / 4)
    false = np.clip(own - prevalence * d, floor, 1 - floor)
    hit = np.clip(false + d, floor, 1 - floor)
    return hit, false, prevalence, kappa


class Fit:
    """What the moments give, as small tables."""

    def __init__(self, annotators: list[str], n_skills: int, counts: np.ndarray, reviews: np.ndarray):
        k = len(annotators)
        self.annotators = annotators
        seen, shown, required = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
        cells = reviews * n_skills  # common cells of two annotators: common postings x all skills
        self.reviews, self.common = np.diag(reviews), reviews
        self.hit, self.false, self.prior, self.kappa = rates(counts[shown, shown], counts[shown, seen], cells)
        # among cells both show: who requires
        both = counts[shown, shown]
        self.hit2, self.false2, self.prior2, self.kappa2 = rates(counts[required, required], counts[required, shown], both)


#: Annotators whose pairwise agreements the driver solves: k^3 / 6 triplets.
MOST_ANNOTATORS = 5_000


def fit(votes: DataFrame) -> Fit:
    annotators = sorted(r[0] for r in collect_bounded(votes.select("annotator").distinct(), MOST_ANNOTATORS, "the annotators"))
    skills = votes.filter("skill_id is not null").select("skill_id").distinct().count()
    k = len(annotators)
    listed = F.broadcast(votes.sparkSession.createDataFrame(list(enumerate(annotators)), "at int, annotator string"))
    # of each posting: who reviewed it, and of each of its cells who shows and who requires the skill; an annotator once each
    shown = F.when(F.col("level") == 2, F.array(F.col("at") + k, F.col("at") + 2 * k)).when(F.col("level") == 1, F.array(F.col("at") + k)).otherwise(F.array(F.col("at")))
    cells = votes.join(listed, "annotator").groupBy("job_id", "skill_id").agg(F.flatten(F.collect_list(shown)).alias("s"))
    posting = cells.groupBy("job_id").agg(F.flatten(F.collect_list(F.when(F.col("skill_id").isNull(), F.col("s")))).alias("r"), F.collect_list(F.when(F.col("skill_id").isNotNull(), F.col("s"))).alias("c"))
    # a row for each cell (reviewers, and who shows and requires it) and one for the posting, its reviewers moved behind those
    whole = F.array(F.transform("r", lambda x: x + 3 * k))
    rows = posting.select(F.explode(F.concat(whole, F.transform("c", lambda s: F.concat("r", s)))).alias("x"))
    both = np.zeros((4 * k, 4 * k), np.int64)
    for r in collect_bounded(pair_counts(rows, "x", max(1, 4 * k)), max(1, both.size), "the agreement counts"):
        both[r["a"], r["b"]] = both[r["b"], r["a"]] = r["n"]
    counts, reviews = both[: 3 * k, : 3 * k], both[3 * k :, 3 * k :]
    return Fit(annotators, max(1, skills), counts, reviews)


#: Log odds are whole multiples of 1 / UNIT: the sum of the same votes is one score in any order of rows.
UNIT = 1 << 40


def _odds(p: float, q: float) -> int:
    return round((math.log(max(p, 1e-6)) - math.log(max(q, 1e-6))) * UNIT)


def consensus(annotations: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """``job_id, skill_id, label, margin``: labels required and mentioned; "none" is left out."""
    spark = annotations.sparkSession
    votes = written_table(votes_of(annotations), "votes")
    f = fit(votes)
    rows = [(a, _odds(f.hit[i], f.false[i]), _odds(1 - f.hit[i], 1 - f.false[i]), _odds(f.hit2[i], f.false2[i]), _odds(1 - f.hit2[i], 1 - f.false2[i])) for i, a in enumerate(f.annotators)]
    weights = F.broadcast(spark.createDataFrame(rows, "annotator string, yes bigint, no bigint, req bigint, men bigint"))
    w = votes.join(weights, "annotator")
    # every reviewer of a posting starts with a "no" for each skill; those who show it replace theirs
    silent = w.filter("skill_id is null").groupBy("job_id").agg(F.sum("no").alias("base"))
    said = w.filter("skill_id is not null").groupBy("job_id", "skill_id").agg(F.sum(F.col("yes") - F.col("no")).alias("shown"), F.sum(F.when(F.col("level") == 2, F.col("req")).otherwise(F.col("men"))).alias("required"))
    start, start2 = _odds(f.prior, 1 - f.prior), _odds(f.prior2, 1 - f.prior2)
    voted = said.join(silent, "job_id").select("job_id", "skill_id", (F.col("base") + F.col("shown") + start).alias("a"), (F.col("required") + start2).alias("b"))
    if adjudicated is None:
        return _labels(voted, 0, 0)
    settled = votes_of(adjudicated).groupBy("job_id", "skill_id").agg(F.max("level").alias("level"))
    settled = written_table(settled.join(votes.filter("skill_id is null").select("job_id"), "job_id", "left_semi"), "settled")
    cut, cut2 = _thresholds(voted, settled)
    done = settled.filter("skill_id is null").select("job_id")
    fixed = settled.filter("skill_id is not null").select("job_id", "skill_id", F.when(F.col("level") == 2, "required").otherwise("mentioned").alias("label"), F.lit(None).cast("double").alias("margin"))
    return _labels(voted, cut, cut2).join(done, "job_id", "left_anti").unionByName(fixed)


def _labels(voted: DataFrame, cut: int, cut2: int) -> DataFrame:
    kept = voted.filter(F.col("a") > cut)
    return kept.select("job_id", "skill_id", F.when(F.col("b") > cut2, "required").otherwise("mentioned").alias("label"), (F.least(F.col("a") - cut, F.abs(F.col("b") - cut2)) / UNIT).alias("margin"))


#: The fewest settled postings that allow to set the thresholds.
FEWEST = 20


def _thresholds(voted: DataFrame, settled: DataFrame) -> tuple[int, int]:
    """Log-odds cuts with the best F1 for showing a skill, and the fewest mistakes for requiring it, on all settled postings.

    The votes' odds take mistakes as independent; where annotators err on the same skills, the settled labels say by how much to ask for more.
    settled: reviewed postings' ``job_id, skill_id, level`` and a row with a null skill for each posting.
    """
    postings, total = settled.agg(F.count_if(F.col("skill_id").isNull()), F.count("skill_id")).first()
    if postings < FEWEST:
        return 0, 0
    known = F.col("level").isNotNull()
    rows = voted.join(settled.filter("skill_id is null").select("job_id"), "job_id", "left_semi").join(settled.filter("skill_id is not null"), ["job_id", "skill_id"], "left")
    # what is shown lies at the upper end of a; what is only mentioned lies at the upper end of -b
    both = F.array(F.struct(F.lit(True).alias("shown"), F.col("a").alias("score"), known.alias("right")), F.when(known, F.struct(F.lit(False).alias("shown"), (-F.col("b")).alias("score"), (F.col("level") == 1).alias("right"))))
    points = rows.select(F.explode(both).alias("p")).filter("p is not null").groupBy("p.shown", "p.score").agg(F.count(F.lit(1)).alias("n"), F.count_if("p.right").alias("right"))
    points = written_table(points.withColumn("part", F.shiftright("score", 34)), "scores")  # parts of 1/64
    # how many stand at a score or above it: those of the parts above, and those of its part
    parts, inside = Window.partitionBy("shown").orderBy(F.desc("part")), Window.partitionBy("shown", "part").orderBy(F.desc("score"))
    above = points.groupBy("shown", "part").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.max("score").alias("top"))
    above = above.select("shown", "part", (F.sum("n").over(parts) - F.col("n")).alias("n0"), (F.sum("right").over(parts) - F.col("right")).alias("right0"), F.lead("top").over(parts).alias("next"))
    n, right = F.col("n0") + F.sum("n").over(inside), F.col("right0") + F.sum("right").over(inside)
    run = points.join(above, ["shown", "part"]).select("shown", "score", F.coalesce(F.lead("score").over(inside), "next").alias("after"), n.alias("n"), right.alias("right"))
    gain = F.when(F.col("shown"), 2 * F.col("right") / (F.col("n") + total)).otherwise((2 * F.col("right") - F.col("n")).cast("double"))
    best = run.groupBy("shown").agg(F.max("score").alias("top"), F.max(F.struct(gain.alias("gain"), "score", F.coalesce("after", F.col("score") - UNIT).alias("after"))).alias("at"))
    cut, cut2 = 0, 0
    for shown, top, (gained, score, after) in best.collect():
        if shown:
            cut = (score + after) // 2
        else:  # where no cut makes fewer mistakes, all are required
            cut2 = (-score - after) // 2 if gained > 0 else -top - UNIT
    return cut, cut2


def reliability(annotations: DataFrame) -> DataFrame:
    """``annotator, n_reviews, hit_rate, false_alarm_rate, required_hit_rate, required_false_alarm_rate, mean_kappa`` of every annotator."""
    f = fit(written_table(votes_of(annotations), "votes"))
    rows = []
    for i, a in enumerate(f.annotators):
        others = [f.kappa[i, j] for j in range(len(f.annotators)) if j != i and f.common[i, j] and np.isfinite(f.kappa[i, j])]
        rows.append((a, int(f.reviews[i]), float(f.hit[i]), float(f.false[i]), float(f.hit2[i]), float(f.false2[i]), float(np.mean(others)) if others else None))
    return annotations.sparkSession.createDataFrame(rows, "annotator string, n_reviews bigint, hit_rate double, false_alarm_rate double, required_hit_rate double, required_false_alarm_rate double, mean_kappa double")


def agreement(annotations: DataFrame) -> DataFrame:
    """``annotator_a, annotator_b, n_common, kappa`` of every pair with common postings; kappa is null where chance agreement is complete."""
    f = fit(written_table(votes_of(annotations), "votes"))
    k = len(f.annotators)
    rows = [(f.annotators[i], f.annotators[j], int(f.common[i, j]), float(f.kappa[i, j]) if np.isfinite(f.kappa[i, j]) else None) for i in range(k) for j in range(i + 1, k) if f.common[i, j]]
    return annotations.sparkSession.createDataFrame(rows, "annotator_a string, annotator_b string, n_common bigint, kappa double")
