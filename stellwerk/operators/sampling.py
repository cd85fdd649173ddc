"""Deterministic samples: seeded order, strata with quotas, splits, pilots."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.ids import SEED, shuffle_key, split
from stellwerk.functions.text import GUESS_PREFIX, guess_language

#: Tokens that are skills and common words alike (fixed value).
AMBIGUOUS = r"\b(Go|R|Spring|Excel)\b"


def stratified(postings: DataFrame, sidecar: DataFrame, per_cell: int = 30, ambiguous: int = 60, excluded: DataFrame | None = None, seed: int = SEED, frame: int = 8000, ambiguous_frame: int = 600, least_chars: int = 300) -> DataFrame:
    """``job_id, split, stratum, heuristic_language``: the first per_cell postings of each (language, has skills) in seeded order,
    then up to `ambiguous` postings with an ambiguous token. The frames are the first postings of the seeded order, as the
    reports define their samples; ids are ordered before any text is read.
    """
    long = postings.filter(F.col("description").isNotNull() & (F.length("description") > least_chars))
    j = long.join(sidecar.select("job_id", (F.coalesce(F.size("skill_ids"), F.lit(0)) > 0).alias("hit")), "job_id")
    rows = j.select("job_id", "hit", guess_language(F.substring("description", 1, GUESS_PREFIX)).alias("heuristic_language"), shuffle_key(F.col("job_id"), seed).alias("o")).orderBy("o", "job_id").limit(frame)
    if excluded is not None:
        rows = rows.join(excluded.select("job_id").distinct(), "job_id", "left_anti")
    w = Window.partitionBy("heuristic_language", "hit").orderBy("o", "job_id")
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_cell).select("job_id", F.concat("heuristic_language", F.lit("_sidecar_"), F.when(F.col("hit"), "hit").otherwise("empty")).alias("stratum"), "heuristic_language")
    odd = postings.filter(F.col("description").rlike(AMBIGUOUS)).select("job_id").orderBy(shuffle_key(F.col("job_id"), seed), "job_id").limit(ambiguous_frame)
    if excluded is not None:
        odd = odd.join(excluded.select("job_id").distinct(), "job_id", "left_anti")
    odd = odd.join(first, "job_id", "left_anti").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "job_id"), 256), "job_id").limit(ambiguous)
    both = first.unionByName(odd.select("job_id", F.lit("ambiguous_token").alias("stratum"), F.lit("unknown").alias("heuristic_language")))
    return both.select("job_id", split(F.col("job_id"), seed).alias("split"), "stratum", "heuristic_language")


def pilot(manifest: DataFrame, per_stratum: int = 16, seed: int = SEED) -> DataFrame:
    """The first rows of each stratum by hash."""
    w = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(f"{seed}:pilot:"), "job_id"), 256), "job_id")
    return manifest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_stratum).drop("n")


def reading_pack(manifest: DataFrame, postings: DataFrame, chars: int = 1500) -> DataFrame:
    """Title and the beginning of the description of sampled postings, for reviewers."""
    return postings.join(manifest.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "title", F.substring("description", 1, chars).alias("description"))


def random_baseline(ids: list[str], banned: set[str], k: int, seed: int) -> list[str]:
    """k ids without the banned ones, by Python's generator, as the judged pools were drawn."""
    left = [i for i in ids if i not in banned]
    return random.Random(seed).sample(left, min(k, len(left)))
