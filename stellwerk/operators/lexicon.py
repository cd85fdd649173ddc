"""Skill extraction from a lexicon: longest alias at each start token, in the JVM by an n-gram join.

Every start token is tried (a match does not consume its tokens); of the aliases that begin at one token the longest wins,
equally long ones all count; an excluded phrase wins like an alias and then gives nothing. Aliases are compared folded,
strict ones as written.

Null and empty texts give empty lists; repeated rows give repeated results; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.functions import text
from stellwerk.session import collect_bounded

#: Entries an alias table may have to be sent to every executor.
MOST_ALIASES = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Skill:
    id: str
    label: str
    category: str
    aliases: tuple[str, ...]
    strict: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Taxonomy:
    version: str
    skills: tuple[Skill, ...]
    exclusions: tuple[str, ...] = ()

    @classmethod
    def parse(cls, raw: dict) -> Taxonomy:
        """Checks fields, unique ids, strict aliases being aliases, and no alias shared by two skills."""
        if not isinstance(raw.get("version"), str) or not isinstance(raw.get("skills"), list) or not raw["skills"]:
            raise ValueError("a taxonomy needs a version and skills")
        skills: list[Skill] = []
        owner: dict[str, str] = {}
        for entry in raw["skills"]:
            if missing := [k for k in ("id", "label", "category", "aliases") if not entry.get(k)]:
                raise ValueError(f"a skill lacks {', '.join(missing)}")
            skill = Skill(entry["id"], entry["label"], entry["category"], tuple(entry["aliases"]), frozenset(entry.get("case_sensitive_aliases", ())))
            if any(s.id == skill.id for s in skills):
                raise ValueError(f"skill id {skill.id} stands twice")
            if not all(isinstance(a, str) and _TOKEN.search(a) for a in skill.aliases):
                raise ValueError(f"skill {skill.id} has an alias without a token")
            if extra := skill.strict - set(skill.aliases):
                raise ValueError(f"strict aliases of {skill.id} are no aliases: {', '.join(sorted(extra))}")
            for alias in skill.aliases:
                folded = " ".join(alias.split()).casefold()
                if owner.setdefault(folded, skill.id) != skill.id:
                    raise ValueError(f"alias {alias} belongs to {owner[folded]} and {skill.id}")
            skills.append(skill)
        return cls(raw["version"], tuple(skills), tuple(raw.get("exclusions", ())))

    def rows(self) -> list[tuple[str, int, bool, str | None, int]]:
        """gram, number of tokens, strict, skill id (null for an exclusion), order of the skill."""
        out: dict[tuple, None] = {}
        for order, s in enumerate(self.skills):
            for alias in s.aliases:
                found = _TOKEN.findall(alias if alias in s.strict else alias.casefold())
                out["\x1f".join(found), len(found), alias in s.strict, s.id, order] = None
        for phrase in self.exclusions:
            found = _TOKEN.findall(phrase.casefold())
            out["\x1f".join(found), len(found), False, None, -1] = None
        return list(out)


def alias_table(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    rows = taxonomy.rows()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"{len(rows)} aliases are too many to broadcast")
    return spark.createDataFrame(rows, "gram string, n int, strict boolean, skill_id string, ord int")


def posting_text(title: Column, description: Column) -> Column:
    """Title and description with a blank between them; nulls and empty strings are left out."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))


def matches(df: DataFrame, aliases: DataFrame, key: str, value: Column) -> DataFrame:
    """``key, start, skill_id, ord``: the longest matches at each start token, exclusions out.

    Starts whose token begins no alias leave by a broadcast semi-join; the n-grams of the others are hashed against the
    alias table (broadcast: its size is checked on making). Only hits are shuffled, to find the longest of each start.
    """
    spark = df.sparkSession
    rows = collect_bounded(aliases, MOST_ALIASES, "the alias table")
    longest = max((r["n"] for r in rows), default=1)
    t = df.select(F.col(key).alias("key"), text.tokens(value).alias("raw"))
    t = t.withColumn("low", F.transform("raw", text.fold))
    starts = t.select("key", "raw", "low", F.posexplode("low").alias("start", "tok"))
    # a start can match only if its first token begins an alias
    firsts = sorted({r["gram"].split("\x1f")[0] for r in rows if not r["strict"]})
    strict_firsts = sorted({r["gram"].split("\x1f")[0] for r in rows if r["strict"]})
    begin = spark.createDataFrame([(g,) for g in firsts] or [(None,)], "tok string")
    begin_strict = spark.createDataFrame([(g,) for g in strict_firsts] or [(None,)], "tok string")
    hits = starts.join(F.broadcast(begin), starts["tok"] == begin["tok"], "left_semi").select("key", "start", F.lit(False).alias("strict"), F.slice("low", F.col("start") + 1, longest).alias("part"))
    hits_strict = starts.join(F.broadcast(begin_strict), F.element_at("raw", F.col("start") + 1) == begin_strict["tok"], "left_semi").select("key", "start", F.lit(True).alias("strict"), F.slice("raw", F.col("start") + 1, longest).alias("part"))
    grams = hits.unionByName(hits_strict).select("key", "start", "strict", F.explode(F.transform(F.sequence(F.lit(1), F.size("part")), lambda n: F.array_join(F.slice("part", 1, n), "\x1f"))).alias("gram"))
    found = grams.join(F.broadcast(aliases), ["gram", "strict"])
    best = found.groupBy("key", "start").agg(F.max("n").alias("top"), F.collect_set(F.struct("n", "skill_id", "ord")).alias("all"))  # at most longest x skills of one gram
    return best.select("key", "start", F.explode(F.filter("all", lambda m: (m["n"] == F.col("top")) & m["skill_id"].isNotNull())).alias("m")).select(F.col("key").alias(key), "start", "m.skill_id", "m.ord")


def skill_ids(df: DataFrame, aliases: DataFrame, key: str, value: Column) -> DataFrame:
    """``key, skill_ids`` of every row (empty where nothing matches), ids distinct and in taxonomy order. `key` must be unique."""
    found = matches(df, aliases, key, value).groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "skill_id"))), lambda s: s["skill_id"]).alias("skill_ids"))
    return df.select(key).join(found, key, "left").withColumn("skill_ids", F.coalesce("skill_ids", F.array().cast("array<string>")))


def span_finder(taxonomy: Taxonomy):
    """A function from a text to {skill id: [(start, end)]}, with the rules of `matches` on a prefix map of tokens."""
    index: dict[bool, dict[tuple[str, ...], set[str | None]]] = {False: {}, True: {}}
    prefixes: dict[bool, set[tuple[str, ...]]] = {False: set(), True: set()}
    for gram, _, strict, skill, _ in taxonomy.rows():
        key = tuple(gram.split("\x1f"))
        index[strict].setdefault(key, set()).add(skill)
        prefixes[strict].update(key[:i] for i in range(1, len(key) + 1))

    def find(value: str | None) -> dict[str, list[tuple[int, int]]]:
        found = list(_TOKEN.finditer(value or ""))
        out: dict[str, list[tuple[int, int]]] = {}
        for i in range(len(found)):
            best, who = 0, set()
            for strict in (False, True):
                part: tuple[str, ...] = ()
                for m in found[i:]:
                    part += (m[0] if strict else m[0].casefold(),)
                    if part not in prefixes[strict]:
                        break
                    if part in index[strict] and len(part) >= best:
                        who = who | index[strict][part] if len(part) == best else set(index[strict][part])
                        best = len(part)
            for skill in sorted(s for s in who if s is not None):
                out.setdefault(skill, []).append((found[i].start(), found[i + best - 1].end()))
        return out

    return find


def spans(df: DataFrame, taxonomy: Taxonomy, key: str, value: Column) -> DataFrame:
    """``key, skill_id, start, end``: character places of every match; offsets need Python, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(taxonomy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = span_finder(sent.value)
        for batch in batches:
            rows = [(k, s, a, b) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, places in find(v).items() for a, b in places]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["key", "skill_id", "start", "end"])

    return df.select(F.col(key).alias("key"), value.alias("value")).mapInArrow(run, "key string, skill_id string, start int, end int").withColumnRenamed("key", key)


def corpus_counts(extracted: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows, rows with skills and assignments; and the `top` skills, ties by id."""
    totals = extracted.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("skill_ids") > 0).alias("rows_with_skills"), F.coalesce(F.sum(F.size("skill_ids")), F.lit(0)).alias("assignments"))
    ranked = extracted.select(F.explode("skill_ids").alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill_id").limit(top)
    return totals, ranked
