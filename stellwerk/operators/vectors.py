"""Skill vectors from co-occurrence: counts by corpus half, PPMI, cosine distance, average-linkage clusters, related skills.

Pair counts come from a join of a posting's own skills (bounded by the taxonomy); everything after them is as large as the
taxonomy squared, not as the corpus. Clustering is sequential and runs on the driver over at most MOST_ITEMS items.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.ids import corpus_half
from stellwerk.session import collect_bounded

MOST_ITEMS = 2000


def check_sidecar(sidecar: DataFrame, taxonomy: DataFrame) -> None:
    """Errors for empty or repeated ids, unknown skills, and an empty corpus half."""
    c = sidecar.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("d"), F.count_if(F.col("job_id").isNull() | (F.trim("job_id") == "")).alias("e"), F.countDistinct(corpus_half(F.col("job_id"))).alias("halves")).first()
    if c["e"] or c["n"] != c["d"]:
        raise ValueError("the sidecar has an empty or repeated job id")
    if sidecar.select(F.explode("skill_ids").alias("skill_id")).join(F.broadcast(taxonomy.select("skill_id")), "skill_id", "left_anti").limit(1).count():
        raise ValueError("the sidecar has an unknown skill")
    if c["halves"] < 2:
        raise ValueError("a half of the corpus is empty")


def halves(sidecar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``half, skill_id, n`` and ``half, a, b, n`` (a < b), ids of a posting counted once; and the postings of each half as skill null."""
    rows = sidecar.select(corpus_half(F.col("job_id")).alias("half"), "job_id", F.array_sort(F.array_distinct(F.coalesce("skill_ids", F.array().cast("array<string>")))).alias("ids"))
    single = rows.select("half", F.explode(F.concat(F.array(F.lit(None).cast("string")), "ids")).alias("skill_id")).groupBy("half", "skill_id").agg(F.count(F.lit(1)).alias("n"))
    left = rows.select("half", "ids", F.posexplode("ids").alias("i", "a"))
    pairs = left.select("half", "a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")).groupBy("half", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return single, pairs


def ppmi(single: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, n_ab, ppmi`` (a < b) of the whole corpus: max(0, ln(n_ab N / (n_a n_b))), N counting postings without skills, too."""
    whole = single.groupBy("skill_id").agg(F.sum("n").alias("n"))
    total = whole.filter("skill_id is null").select(F.col("n").cast("double").alias("n_all"))
    counts = whole.filter("skill_id is not null")
    ab = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    j = ab.join(F.broadcast(counts.select(F.col("skill_id").alias("a"), F.col("n").cast("double").alias("n_a"))), "a").join(F.broadcast(counts.select(F.col("skill_id").alias("b"), F.col("n").cast("double").alias("n_b"))), "b").join(F.broadcast(total))
    return j.select("a", "b", "n_ab", F.greatest(F.lit(0.0), F.log(F.col("n_ab") * F.col("n_all") / (F.col("n_a") * F.col("n_b")))).alias("ppmi"))


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """``i, j, v`` in both directions."""
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col(value).alias("v")).unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col(value).alias("v"))).filter("v <> 0")


def cosine(vectors: DataFrame) -> DataFrame:
    """``a, b, cosine`` (a < b) of rows of a sparse matrix ``i, j, v``; pairs without a common place have cosine 0 and no row."""
    norm = vectors.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    x, y = vectors.select(F.col("i").alias("a"), "j", F.col("v").alias("va")), vectors.select(F.col("i").alias("b"), "j", F.col("v").alias("vb"))
    dot = x.join(y, "j").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    j = dot.join(norm.select(F.col("i").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("i").alias("b"), F.col("norm").alias("nb")), "b")
    return j.select("a", "b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)))).alias("cosine"))


def related(similar: DataFrame, n: int = 5) -> DataFrame:
    """``skill_id, rank, related_id, cosine``: the n most similar skills of each, by rounded cosine, ties by id."""
    both = similar.select(F.col("a").alias("skill_id"), F.col("b").alias("related_id"), F.round("cosine", 6).alias("cosine")).unionByName(similar.select(F.col("b").alias("skill_id"), F.col("a").alias("related_id"), F.round("cosine", 6).alias("cosine")))
    w = Window.partitionBy("skill_id").orderBy(F.desc("cosine"), "related_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("skill_id", "rank", "related_id", "cosine")


def matrix(pairs: DataFrame, value: str, names: list[str]) -> np.ndarray:
    """The symmetric matrix of a bounded pair table."""
    at = {x: i for i, x in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in collect_bounded(pairs.select("a", "b", F.col(value).alias("v")), MOST_ITEMS**2, "the pair table"):
        if r["a"] in at and r["b"] in at:
            out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["v"]
    return out


def distances(vectors: np.ndarray) -> np.ndarray:
    """Cosine distances within [0, 1]; a zero vector is at distance 1 from all others."""
    norm = np.sqrt((vectors * vectors).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(np.outer(norm, norm) > 0, vectors @ vectors.T / np.outer(norm, norm), 0.0)
    d = 1 - np.clip(sim, 0, 1)
    np.fill_diagonal(d, 0)
    return d


def linkage(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges of average linkage; new groups are numbered on from n. Ties go to the lower pair of numbers."""
    n = len(d)
    big = np.full((2 * n - 1, 2 * n - 1), np.inf)
    big[:n, :n] = np.where(np.triu(np.ones((n, n), bool), 1), d, np.inf)
    size = np.zeros(2 * n - 1)
    size[:n] = 1
    out = []
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(np.argmin(big)), len(big))  # row-major: the first minimum has the lowest pair
        out.append((a, b))
        to_a, to_b = np.minimum(big[a], big[:, a]), np.minimum(big[b], big[:, b])
        mean = (size[a] * to_a + size[b] * to_b) / (size[a] + size[b])
        live = np.isfinite(mean[:new]) & (size[:new] > 0)
        live[[a, b]] = False
        big[:new, new][live] = mean[:new][live]
        size[new], size[a], size[b] = size[a] + size[b], 0, 0
        big[[a, b]] = np.inf
        big[:, [a, b]] = np.inf
    return out


def cut(merges: list[tuple[int, int]], n: int, clusters: int) -> list[list[int]]:
    """The partition into so many clusters, ordered by first member."""
    if not 1 <= clusters <= n:
        raise ValueError("the number of clusters must lie between 1 and the number of items")
    groups = {i: [i] for i in range(n)}
    for new, (a, b) in enumerate(merges[: n - clusters], n):
        groups[new] = sorted(groups.pop(a) + groups.pop(b))
    return sorted(groups.values())


def silhouette(d: np.ndarray, clusters: list[list[int]]) -> float:
    """Mean silhouette; items alone in their cluster count 0, fewer than two clusters give 0."""
    if len(clusters) < 2:
        return 0.0
    means = np.stack([d[:, g].mean(1) for g in clusters])
    total = 0.0
    for c, g in enumerate(clusters):
        if len(g) > 1:
            own = means[c, g] * len(g) / (len(g) - 1)
            other = np.delete(means[:, g], c, 0).min(0)
            top = np.maximum(own, other)
            total += float(np.where(top > 0, (other - own) / np.where(top > 0, top, 1), 0).sum())
    return total / len(d)


def best_partition(d: np.ndarray) -> tuple[list[list[int]], float]:
    """The cut with the best silhouette among 2 to 10 clusters, the coarser on ties; two items stay apart."""
    n = len(d)
    if n < 2:
        raise ValueError("clustering needs two items")
    if n == 2:
        return [[0], [1]], 0.0
    merges = linkage(d)
    options = [(silhouette(d, g), -k, g) for k in range(2, min(10, n - 1) + 1) for g in [cut(merges, n, k)]]
    score, _, groups = max(options, key=lambda x: x[:2])
    return groups, score


def rand_index(first: Iterable[int], second: Iterable[int]) -> float:
    """Adjusted Rand index of two label lists; 1 where it is not defined."""
    _, a = np.unique(list(first), return_inverse=True)
    _, b = np.unique(list(second), return_inverse=True)
    if not len(a):
        return 1.0
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    two = lambda x: (x * (x - 1) / 2).sum()
    cell, rows, cols, total = two(table), two(table.sum(1)), two(table.sum(0)), len(a) * (len(a) - 1) / 2
    spread = (rows + cols) / 2 - (rows * cols / total if total else 0)
    return float((cell - rows * cols / total) / spread) if total and spread else 1.0


def cluster_report(sidecar: DataFrame, taxonomy: DataFrame) -> dict:
    """Clusters of skills with a positive PPMI, their silhouette, and how well each corpus half gives the same partition."""
    single, pairs = halves(sidecar)
    single, pairs = single.cache(), pairs.cache()
    whole = ppmi(single, pairs)
    order = [r[0] for r in collect_bounded(taxonomy.select("skill_id"), MOST_ITEMS, "the taxonomy")]
    m = matrix(whole, "ppmi", order)
    kept = [i for i in range(len(order)) if m[i].max() > 0]
    names = [order[i] for i in kept]
    groups, score = best_partition(distances(m[np.ix_(kept, kept)]))
    parts = []
    for half in (0, 1):
        h = matrix(ppmi(single.filter(F.col("half") == half), pairs.filter(F.col("half") == half)), "ppmi", names)
        g = cut(linkage(distances(h)), len(names), len(groups)) if len(names) > 1 else [[0]]
        parts.append([next(c for c, x in enumerate(g) if i in x) for i in range(len(names))])
    single.unpersist()
    pairs.unpersist()
    return {"clusters": [[names[i] for i in g] for g in groups], "silhouette": round(score, 4), "split_half_ari": round(rand_index(*parts), 4), "excluded": [order[i] for i in range(len(order)) if i not in set(kept)], "market_growth_inference_allowed": False}
