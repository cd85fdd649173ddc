"""Mixing sources to target shares, measured in tokens.

Tokens are summed per source; the budget (by default all tokens of listed sources) is filled in proportion to the targets,
no source giving more than `max_repeats` times its tokens; what capped or empty sources leave is shared by the others in
proportion to their targets. A document comes out floor(rate) times, and once more if its seeded hash falls below the
fraction: a decision of each row alone, so no source, however large, meets in one task.

Defined cases: a null or empty text has no tokens and is emitted like others; a null source or one that is not listed has
rate 0 and is reported with a null target; a listed source that delivers nothing is reported with share 0; null max_repeats
count as 1, negative targets as 0; a source listed twice has its targets added and its smaller cap; with an empty table
every share is 0; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.bpe import VOCABULARY, count_tokens
from stellwerk.session import collect_bounded, written_table

#: Sources that a plan may list.
MOST_SOURCES = 100_000


def solve_rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Repetition rate of each listed source: tokens * rate is its part of the budget, at most its cap."""
    rates = {s: 0.0 for s in targets}
    open_ = {s for s, (share, cap) in targets.items() if share > 0 and cap > 0 and tokens.get(s, 0) > 0}
    left = float(sum(tokens.get(s, 0) for s in targets)) if total is None else float(total)
    while open_ and left > 0:
        shares = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / shares >= targets[s][1] * tokens[s]}
        if not full:
            for s in open_:
                rates[s] = left * targets[s][0] / shares / tokens[s]
            break
        for s in full:
            rates[s] = float(targets[s][1])
            left -= targets[s][1] * tokens[s]
        open_ -= full
    return rates


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), and one more where the seeded hash of the key falls below the fraction."""
    whole = F.floor(rate)
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (whole + (chance < rate - whole).cast("int")).cast("int")


def plan(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11, total: float | None = None) -> tuple[DataFrame, DataFrame, dict, dict]:
    """Documents with ``doc_id, source, n_tokens, copies``; targets, tokens and rates by source."""
    spark = documents.sparkSession
    sized = written_table(count_tokens(documents.select("doc_id", "source", "text"), "text", vocabulary), "tokens")
    wanted: dict[str, tuple[float, int]] = {}
    for r in collect_bounded(targets.filter("source is not null").select("source", "target_share", "max_repeats"), MOST_SOURCES, "the list of targets"):
        share, cap = max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else max(0, r["max_repeats"])
        old = wanted.get(r["source"])
        wanted[r["source"]] = (share + old[0], min(cap, old[1])) if old else (share, cap)
    listed = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    held = {r["source"]: r["n"] for r in collect_bounded(sized.join(listed, "source").groupBy("source").agg(F.sum("n_tokens").alias("n")), MOST_SOURCES, "the sources")}
    rates = solve_rates(held, wanted, total)
    rate = F.broadcast(spark.createDataFrame([(s, float(r)) for s, r in rates.items()], "source string, rate double"))
    out = sized.join(rate, "source", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed)), sized, wanted, rates


def emitted(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``doc_id, source, copy_no``: every emitted copy, numbered from 1."""
    rows = plan(documents, targets, **options)[0]
    return rows.filter("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, tokens, rate, emitted_tokens, actual_share, status`` of listed and other sources."""
    rows, _, wanted, rates = plan(documents, targets, **options)
    spark = documents.sparkSession
    reached = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("emitted_tokens"))
    listed = spark.createDataFrame([(s, t, c, rates[s]) for s, (t, c) in wanted.items()], "source string, target_share double, max_repeats bigint, rate double")
    j = listed.join(reached, "source", "full").fillna(0, ["n_docs", "tokens", "emitted_tokens"]).fillna(0.0, ["rate"])
    all_ = j.agg(F.sum("emitted_tokens").alias("all_tokens"))
    j = j.join(F.broadcast(all_)).withColumn("actual_share", F.coalesce(F.try_divide("emitted_tokens", "all_tokens"), F.lit(0.0)))
    status = F.when(F.col("target_share").isNull(), "not listed").when(F.col("tokens") == 0, "no tokens").when(F.col("rate") >= F.col("max_repeats"), "capped").otherwise("reached")
    return j.withColumn("status", status).select("source", "target_share", "max_repeats", "n_docs", "tokens", "rate", "emitted_tokens", "actual_share", "status")
