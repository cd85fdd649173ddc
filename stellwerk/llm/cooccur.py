"""Items that stand together: exact pair counts and their surprise under a bipartite configuration null.

Counts: of up to MOST_ITEMS positions, each Arrow batch of baskets becomes a 0/1 matrix and one matrix product gives its pair
counts, summed over a partition. Longer lists are counted sparsely: the pairs of a slice of baskets are numbers in one array
of bounded length, sorted and counted there. Either way the partial counts are summed before they are shuffled, so the
shuffle carries at most one row per pair and slice, whatever the number of baskets and however hot an item is; the results
are equal.

Null: the maximum-entropy bipartite ensemble with the observed item counts and basket sizes as expectations. Baskets of
equal size have the same parameter, and so have items of equal count, so the fit works on (distinct sizes x distinct
counts). Under it the count of a pair is Poisson-binomial; its upper tail is taken by the saddlepoint formula with the
continuity correction, in executors, which costs the same at any number of baskets. Benjamini-Hochberg over all pairs of the
list gives the q values, by ranks of distinct p values in ranges.

Defined cases: null lists, null elements, empty strings and ids that are not in the list count for nothing, but their
basket counts; ids are compared without surrounding blanks and case; an id repeated within a basket, in one row or in
several, counts once; baskets without a key are left out; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.session import collect_bounded, written_table

#: Positions of a dense pair matrix in a task (int64, 32 MB, beside a product and a 0/1 matrix of 64 MB at most).
MOST_ITEMS = 2048
#: Pair numbers that a sparse slice holds at once.
CELLS = 1 << 22
#: Entries an item list may have, and how many of them are looked up in an expression rather than by a join.
MOST_LISTED, LITERALS = 1_000_000, 512
PAIRS = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])


def _dense(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width), np.int64)
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten())
        for start in range(0, len(lists), 8192):
            stop = min(len(lists), start + 8192)
            a, b = int(sizes[:start].sum()), int(sizes[:stop].sum())
            hot = np.zeros((stop - start, width), np.float32)
            hot[np.repeat(np.arange(stop - start), sizes[start:stop]), flat[a:b]] = 1
            product = hot.T @ hot
            np.add(total, product, out=total, casting="unsafe")
    i, j = np.nonzero(np.triu(total))
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["a", "b", "n"])


def _sparse(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pair numbers a * width + b of slices of baskets: of each element with itself and those after it."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        flat = np.asarray(lists.flatten()).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = flat[np.lexsort((flat, owner))]
        if not len(flat):
            continue
        once = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]
        flat, owner = flat[once], owner[once]
        ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))[owner]
        after = ends - np.arange(len(flat))  # partners of each element, itself included
        run = np.cumsum(after)
        start = 0
        while start < len(flat):
            stop = max(start + 1, int(np.searchsorted(run, (run[start - 1] if start else 0) + CELLS, "right")))
            n = after[start:stop]
            first = np.repeat(np.arange(start, stop), n)
            second = first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            keys, times = np.unique(flat[first] * width + flat[second], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(times.astype(np.int64))], ["a", "b", "n"])
            start = stop


def pair_counts(baskets: DataFrame, column: str, width: int) -> DataFrame:
    """Rows ``a, b, n`` with a <= b: the baskets (arrays of positions below `width`) that hold both; a = b counts single positions."""
    count = _dense if width <= MOST_ITEMS else _sparse
    rows = baskets.select(F.coalesce(F.col(column), F.array().cast("array<int>")).alias("x"))
    return rows.mapInArrow(lambda batches: count(batches, width), PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def fit_null(items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10, times: np.ndarray | None = None) -> np.ndarray:
    """Probabilities p[size, item] of the bipartite configuration ensemble: sum over baskets gives each item's count, sum over items each size.

    items: count of each item, or distinct counts that `times` items have each; sizes, baskets: distinct basket sizes and how
    many baskets have each.
    """
    items, sizes, baskets = items.astype(float), sizes.astype(float), baskets.astype(float)
    times = np.ones(len(items)) if times is None else times.astype(float)
    total = max((items * times).sum(), 1.0)
    y, x = items / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(rounds):
        x_new = np.where(sizes > 0, sizes / np.maximum((times * y / (1 + np.outer(x, y))).sum(1), 1e-300), 0)
        y_new = np.where(items > 0, items / np.maximum((baskets[:, None] * x_new[:, None] / (1 + np.outer(x_new, y))).sum(0), 1e-300), 0)
        moved = max(np.abs(x_new / np.maximum(x, 1e-300) - 1)[sizes > 0].max(initial=0), np.abs(y_new / np.maximum(y, 1e-300) - 1)[items > 0].max(initial=0))
        x, y = x_new, y_new
        if moved < tolerance:
            break
    xy = np.outer(x, y)
    return xy / (1 + xy)


def upper_tails(observed: np.ndarray, chances: np.ndarray, times: np.ndarray) -> np.ndarray:
    """P(X >= observed) for sums of Bernoulli variables, row by row: chances[row, class], `times` variables of each class.

    Lugannani-Rice with the lattice correction; exact at observed <= 0 (1), at the number of variables, and beyond it (0);
    near the mean a continuity-corrected normal tail.
    """
    k = np.asarray(observed, float)[:, None]
    p = np.clip(np.asarray(chances, float), 0.0, 1 - 1e-12)
    w = np.asarray(times, float)[None]
    possible = (w * (p > 0)).sum(1)
    low, high = np.full(len(p), -60.0), np.full(len(p), 60.0)
    for _ in range(70):
        s = (low + high) / 2
        e = p * np.exp(s)[:, None]
        less = (w * e / (1 - p + e)).sum(1) < k[:, 0]
        low, high = np.where(less, s, low), np.where(less, high, s)
    e = p * np.exp(s)[:, None]
    q = e / (1 - p + e)
    k0, k2 = (w * np.log1p(p * np.expm1(s)[:, None])).sum(1), (w * q * (1 - q)).sum(1)
    mean, var = (w * p).sum(1), (w * p * (1 - p)).sum(1)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    half = lambda x: 0.5 * erfc(x / math.sqrt(2)).astype(float)
    with np.errstate(all="ignore"):
        root = np.sign(s) * np.sqrt(np.maximum(0, 2 * (s * k[:, 0] - k0)))
        u = -np.expm1(-s) * np.sqrt(k2)
        tail = half(root) + np.exp(-root * root / 2) / math.sqrt(2 * math.pi) * (1 / u - 1 / root)
        tail = np.where(np.abs(s) < 1e-4, half((k[:, 0] - 0.5 - mean) / np.sqrt(var)), tail)
        every = np.exp((w * np.where(p > 0, np.log(np.where(p > 0, p, 1)), 0)).sum(1))
    out = np.clip(np.nan_to_num(tail, nan=1.0), 0, 1)
    out = np.where(k[:, 0] == possible, every, out)
    return np.where(k[:, 0] <= 0, 1.0, np.where(k[:, 0] > possible, 0.0, out))


def upper_tail(observed: int, chances: np.ndarray, times: np.ndarray) -> float:
    """One row of `upper_tails`."""
    return float(upper_tails(np.array([observed]), np.asarray(chances)[None], times)[0])


def false_discovery(p: np.ndarray, tests: int) -> np.ndarray:
    """Benjamini-Hochberg q values; `tests` counts all pairs tested, those that never occur (p = 1) included."""
    order = np.argsort(p, kind="stable")
    q = p[order] * tests / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    return out


def with_q_values(pairs: DataFrame, tests: int, ranges: int = 64) -> DataFrame:
    """The rows with their Benjamini-Hochberg `q_value`.

    Distinct p values with their number of rows are cut into ranges; ranks are running sums within a range after what the
    ranges before hold, and the least of p * tests / rank from a value on is taken within the range and over those after.
    """
    distinct = written_table(pairs.groupBy("p_value").agg(F.count(F.lit(1)).alias("n")), "p-values")
    cuts = sorted(set(distinct.approxQuantile("p_value", [i / ranges for i in range(1, ranges)], 0.005))) if ranges > 1 else []
    part = sum((F.when(F.col("p_value") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    cut = distinct.withColumn("part", part)
    size = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # at most `ranges` rows
    before, run = {}, 0
    for k in sorted(size):
        before[k], run = run, run + size[k]
    table = lambda values, kind: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]), F.col("part")) if values else F.lit(None).cast(kind)
    up = Window.partitionBy("part").orderBy("p_value")
    raw = cut.withColumn("raw", F.col("p_value") * tests / (table(before, "bigint") + F.sum("n").over(up)))
    least = {r["part"]: r["m"] for r in raw.groupBy("part").agg(F.min("raw").alias("m")).collect()}
    later, low = {}, 1.0
    for k in sorted(least, reverse=True):
        later[k], low = low, min(low, least[k])
    on = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = raw.select("p_value", F.least(F.min("raw").over(on), table(later, "double"), F.lit(1.0)).alias("q_value"))
    return pairs.join(q, "p_value")


def baskets_of(df: DataFrame, items: DataFrame, key: str, ids: str, item: str) -> tuple[DataFrame, list[str]]:
    """One row per distinct key: ``key, x`` (positions in the item list); the item list itself, in order."""
    names = sorted(r[0].strip().lower() for r in collect_bounded(items.filter(F.col(item).isNotNull()).select(item).distinct(), MOST_LISTED, "the item list"))
    names = list(dict.fromkeys(names))
    kept = df.filter(F.col(key).isNotNull())
    none = F.array().cast("array<int>")
    if len(names) <= LITERALS:
        place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.lit(None).cast("map<string,int>")
        # positions instead of strings are shuffled, at most once per row
        own = F.array_distinct(F.filter(F.transform(F.col(ids), lambda s: place[F.lower(F.trim(s))]), lambda v: v.isNotNull()))
        rows = kept.select(F.col(key).alias("key"), F.coalesce(own, none).alias("x"))
    else:
        listed = df.sparkSession.createDataFrame(list(enumerate(names)), "at int, name string")
        said = kept.select(F.col(key).alias("key"), F.explode(F.transform(F.col(ids), lambda s: F.lower(F.trim(s)))).alias("name"))
        rows = said.join(listed, "name").select("key", F.array("at").alias("x")).unionByName(kept.select(F.col(key).alias("key"), none.alias("x")))
    # rows of one key: redelivered, few; their union is a set below the item list's length
    return rows.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("x"))).alias("x")), names


def scored_pairs(df: DataFrame, items: DataFrame, key: str = "job_id", ids: str = "skill_ids", item: str = "skill_id") -> tuple[DataFrame, int]:
    """``skill_a, skill_b, n_ab, n_a, n_b, n_all, lift, expected, p_value`` of every pair that occurs, and how many pairs the list has."""
    spark = df.sparkSession
    baskets, names = baskets_of(df, items, key, ids, item)
    width = len(names)
    # position width + size marks the basket's size: one pass gives pair counts, single counts and the size histogram
    marked = baskets.select(F.concat(F.col("x"), F.array((F.lit(width) + F.size("x")).cast("int"))).alias("x"))
    counts = written_table(pair_counts(marked, "x", 2 * width + 1), "pairs")
    single, sizes = np.zeros(width, np.int64), np.zeros(width + 1, np.int64)
    for r in collect_bounded(counts.filter("a = b"), 2 * width + 1, "the single counts"):
        if r["a"] < width:
            single[r["a"]] = r["n"]
        else:
            sizes[r["a"] - width] = r["n"]
    n_all, present = int(sizes.sum()), np.flatnonzero(sizes)
    levels, level, times = np.unique(single, return_inverse=True, return_counts=True)
    chance = fit_null(levels, present, sizes[present], times=times) if n_all else np.zeros((0, len(levels)))
    sent = spark.sparkContext.broadcast((chance.astype(np.float64), level, single, sizes[present].astype(float), names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance, level, single, weights, names = sent.value
        step = max(1, (1 << 21) // max(1, len(weights)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                a, b, n = (np.asarray(c) for c in part.columns)
                both = (chance[:, level[a]] * chance[:, level[b]]).T
                cols = [pa.array([names[x] for x in a], pa.string()), pa.array([names[x] for x in b], pa.string()), part.column(2), pa.array(single[a]), pa.array(single[b]), pa.array(np.full(len(a), n_all, np.int64))]
                lift = n * float(n_all) / (single[a].astype(float) * single[b])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lift), pa.array(both @ weights), pa.array(upper_tails(n, both, weights))], ["skill_a", "skill_b", "n_ab", "n_a", "n_b", "n_all", "lift", "expected", "p_value"])

    schema = "skill_a string, skill_b string, n_ab bigint, n_a bigint, n_b bigint, n_all bigint, lift double, expected double, p_value double"
    return counts.filter((F.col("a") < F.col("b")) & (F.col("b") < width)).mapInArrow(run, schema), width * (width - 1) // 2


def associated_pairs(df: DataFrame, items: DataFrame, key: str = "job_id", ids: str = "skill_ids", item: str = "skill_id") -> DataFrame:
    """The columns of `scored_pairs`, and `q_value`."""
    pairs, tests = scored_pairs(df, items, key, ids, item)
    out = with_q_values(written_table(pairs, "scored-pairs"), max(1, tests))
    return out.select("skill_a", "skill_b", "n_ab", "n_a", "n_b", "n_all", "lift", "expected", "p_value", "q_value")


def frequent_together(df: DataFrame, items: DataFrame, least: int = 5, times: int = 4) -> DataFrame:
    """Pairs in at least `least` baskets whose count is at least `times` times the product of the single rates, in whole numbers."""
    p = scored_pairs(df, items)[0]
    kept = p.filter((F.col("n_ab") >= least) & (F.col("n_ab") * F.col("n_all") >= F.lit(times) * F.col("n_a") * F.col("n_b")))
    return kept.select("skill_a", "skill_b")
