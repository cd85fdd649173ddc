"""Languages of postings and their paragraphs by Bayesian fusion of evidence.

Text: a word model (one log-likelihood for each known word and language, unknown words say nothing) learned from a bounded
sample of the labelled postings, started from function words. Declared markup (``lang="de"``), the suffix of the page's
address, and a prior of the host, smoothed towards its source and that towards the whole corpus, are added as log odds.
The host counts are a grouped aggregation over the text evidence of every posting.

One pass reads the texts and keeps a few numbers a paragraph in a written table; joins and groupings use only those.

Defined cases: a null or blank text has no paragraphs; a paragraph without known words gets the language of the other
evidence with a low confidence; labels in any notation are compared by language, an unknown notation is no label; repeated
rows count once; a labelled id without a posting gives no row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.session import written_table

LANGS = ("de", "en", "fr", "nl", "pl")
#: Function words that start the word model.
SEEDS = {
    "de": "der die das und ist nicht mit für auf ein eine den von zu im wir sie bei sich dem des als auch ihr ihre unser oder werden haben sind aus nach du wird zur zum über",
    "en": "the and is of to for with you we are our at be this that on it as your from will have or an by they not in their has who which can",
    "fr": "le la les des et est un une pour avec nous vous dans sur notre votre que qui du en au aux ce par pas sont plus ou être ses leur chez",
    "nl": "de het een en van voor met wij je bij aan op zijn naar ons onze wordt niet om te dat deze ook of als uit heeft jij jouw ben door maar",
    "pl": "i w na do z się jest nie dla oraz od po przy nasz nasze praca pracy że jak przez za są być który lub twoje ci co jako we",
}
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "niemiecki", "duits"),
    "en": ("en", "eng", "english", "englisch", "anglais", "angielski", "engels"),
    "fr": ("fr", "fra", "fre", "french", "französisch", "français", "francais", "francuski", "frans"),
    "nl": ("nl", "nld", "dut", "dutch", "niederländisch", "nederlands", "néerlandais", "holenderski"),
    "pl": ("pl", "pol", "polish", "polnisch", "polski", "polonais", "pools"),
}
#: Address suffixes that lean to a language, as log odds against the others.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "uk": "en", "us": "en", "ie": "en", "fr": "fr", "nl": "nl", "pl": "pl"}
MARKUP_WEIGHT, SUFFIX_WEIGHT, HOST_WEIGHT, TEXT_WEIGHT, SMOOTHING = 2.0, 1.0, 1.0, 0.6, 20.0
#: Labelled postings that the word model is fitted on.
SAMPLE = 4000
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of few languages; they count like words.
_MARK = re.compile("[ąćęłńśźżàèéêçùœîôëßï]")
_BREAK = re.compile(r"\r\n|[\n\r  \u0085\v\f]")
_DECLARED = re.compile(r"<[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})", re.I)


def language_of_label(label: Column) -> Column:
    """The language a label states, null if none."""
    s = F.lower(F.trim(F.regexp_replace(label, r"[_-][A-Za-z]{2,4}\s*$", "")))
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(s.isin(*names), lang).otherwise(out)
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words, and the letters that few languages have."""
    low = text.lower()
    return _WORD.findall(low) if low.isascii() else _WORD.findall(low) + _MARK.findall(low)


def paragraphs(text: str | None) -> list[str]:
    """Non-blank pieces between line breaks."""
    return [p for p in _BREAK.split(text or "") if p.strip()]


class WordModel:
    """words -> row of `table`; row 0 is for words that are not known."""

    def __init__(self, logs: dict[str, np.ndarray]):
        self.rows = {w: i for i, w in enumerate(logs, 1)}
        self.table = np.vstack([np.zeros((1, len(LANGS))), *[v[None] for v in logs.values()]]).astype(np.float32)

    @classmethod
    def of_seeds(cls) -> WordModel:
        logs: dict[str, np.ndarray] = {}
        for i, lang in enumerate(LANGS):
            for w in SEEDS[lang].split():
                logs.setdefault(w, np.full(len(LANGS), -1.5))[i] = 0.5
        return cls(logs)

    @classmethod
    def fit(cls, texts: list[str], rounds: int = 3) -> WordModel:
        """Paragraphs are labelled by the model of the round before where it is sure, and word counts make the next model."""
        parts = [Counter(words_of(p)) for t in texts for p in paragraphs(t)]
        model = cls.of_seeds()
        for _ in range(rounds):
            counts: dict[str, np.ndarray] = {}
            for words in parts:
                scores = model.score_words(words)
                order = np.sort(scores)
                if order[-1] - order[-2] < 2:
                    continue
                best = int(scores.argmax())
                for w in words:
                    counts.setdefault(w, np.zeros(len(LANGS)))[best] += 1
            if not counts:
                break
            totals = np.sum(list(counts.values()), axis=0) + 500.0
            logs = {}
            for w, c in counts.items():
                if c.sum() >= 2:
                    share = (c + 0.2) / totals
                    logs[w] = np.clip(np.log(share / share.mean()), -3, 3)
            for w, v in zip(cls.of_seeds().rows, cls.of_seeds().table[1:]):
                logs.setdefault(w, v)
            model = cls(logs)
        return model

    def score_words(self, words: Counter) -> np.ndarray:
        total = np.zeros(len(LANGS))
        for w, n in words.items():
            if i := self.rows.get(w):
                total += min(n, 3) * self.table[i]
        return total

    def score(self, texts: list[str]) -> np.ndarray:
        """Sums over the words of each text."""
        get = self.rows.get
        lists = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
        return _sums(self.table[flat], sizes)[:-1]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row sums of consecutive groups, with a last empty one."""
    run = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return np.vstack([run[ends] - run[ends - sizes], np.zeros((1, values.shape[1]))]).astype(np.float32)


def fitted(jobs: DataFrame, labelled: DataFrame, text: str = "description") -> WordModel:
    """The word model from at most SAMPLE labelled postings, the same ones at every run."""
    ids = labelled.select("job_id").distinct().withColumn("h", F.xxhash64("job_id")).orderBy("h", "job_id").limit(SAMPLE)
    rows = jobs.filter(F.col(text).isNotNull()).join(F.broadcast(ids.select("job_id")), "job_id", "left_semi").groupBy("job_id").agg(F.min(text)).collect()
    return WordModel.fit([r[1] for r in sorted(rows)])


def text_evidence(jobs: DataFrame, model: WordModel, key: str = "job_id", text: str = "description") -> DataFrame:
    """``key, host, source, suffix, declared, logs, n_de ...``: the text log-likelihoods of all paragraphs in one array, and how many are of each language."""
    sent = jobs.sparkSession.sparkContext.broadcast(model)
    host = F.lower(F.regexp_extract("source_url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    rows = jobs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce("source", F.lit("")).alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            parts = [paragraphs(t) for t in texts]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            scores = sent.value.score([p for x in parts for p in x])
            best = np.zeros((len(scores), len(LANGS)), np.float32)
            if len(scores):
                sure = np.sort(scores, axis=1)
                best[np.arange(len(scores)), scores.argmax(1)] = sure[:, -1] - sure[:, -2] > 2
            counts = _sums(best, sizes)[:-1].astype(np.int32)
            declared = [(m[1].lower() if t and (m := _DECLARED.search(t)) else None) if t and "lang" in t else None for t in texts]
            logs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes * len(LANGS))].astype(np.int32)), pa.array(scores.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(declared, pa.string()), logs, *[pa.array(counts[:, i]) for i in range(len(LANGS))]], ["key", "host", "source", "declared", "logs", *[f"n_{x}" for x in LANGS]])

    schema = "key string, host string, source string, declared string, logs array<float>, " + ", ".join(f"n_{x} int" for x in LANGS)
    return rows.mapInArrow(run, schema)


def host_priors(evidence: DataFrame) -> DataFrame:
    """``host, source, prior`` (log probabilities): counts of a host smoothed towards its source, and those towards the corpus. A posting counts once."""
    names = [f"n_{x}" for x in LANGS]
    once = evidence.groupBy("key").agg(F.min(F.struct("host", "source", *names)).alias("r")).select("r.*")
    hosts = once.groupBy("host", "source").agg(*[F.sum(n).cast("double").alias(n) for n in names])
    sources = hosts.groupBy("source").agg(*[F.sum(n).alias(f"s_{n}") for n in names])
    corpus = hosts.agg(*[(F.coalesce(F.sum(n), F.lit(0.0)) + 1.0).alias(f"g_{n}") for n in names])
    total = lambda prefix: sum((F.col(f"{prefix}{n}") for n in names[1:]), F.col(f"{prefix}{names[0]}"))
    j = hosts.join(sources, "source").join(F.broadcast(corpus))
    for n in names:
        j = j.withColumn(f"p_{n}", (F.col(f"s_{n}") + SMOOTHING * F.col(f"g_{n}") / total("g_")) / (total("s_") + SMOOTHING))
    prior = F.array(*[F.log((F.col(n) + SMOOTHING * F.col(f"p_{n}")) / (total("") + SMOOTHING)) for n in names])
    return j.select("host", "source", prior.cast("array<float>").alias("prior"))


def languages(evidence: DataFrame, priors: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``key, kept..., para_no, lang, confidence, doc_lang, doc_confidence`` of every paragraph."""
    rest = list(kept)
    rows = evidence.join(priors, ["host", "source"], "left").select("key", *rest, "host", "declared", "logs", "prior")
    suffixes = {s: LANGS.index(x) for s, x in SUFFIXES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(LANGS)
        for batch in batches:
            n = 1 + len(rest)
            logs = batch.column(n + 2)
            sizes = np.diff(np.asarray(logs.offsets)) // k
            scores = np.asarray(logs.flatten(), np.float64).reshape(-1, k)
            prior = np.zeros((batch.num_rows, k))
            given = batch.column(n + 3)
            has = ~np.asarray(given.is_null())
            if has.any():
                prior[has] = HOST_WEIGHT * np.asarray(given.drop_null().flatten(), np.float64).reshape(-1, k)
            for i, (host, declared) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                if declared in LANGS:
                    prior[i, LANGS.index(declared)] += MARKUP_WEIGHT
                if host and (s := suffixes.get(host.rpartition(".")[2])) is not None:
                    prior[i, s] += SUFFIX_WEIGHT
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            post = TEXT_WEIGHT * scores + prior[owner]
            doc = TEXT_WEIGHT * _sums(scores.astype(np.float32), sizes)[:-1] / np.sqrt(np.maximum(sizes, 1))[:, None] + prior
            best, sure = _decide(post)
            doc_best, doc_sure = _decide(doc)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            names = np.array(LANGS, object)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(n)], pa.array(number, pa.int64()), pa.array(names[best], pa.string()), pa.array(sure), pa.array(names[doc_best][owner], pa.string()), pa.array(doc_sure[owner])], ["key", *rest, "para_no", "lang", "confidence", "doc_lang", "doc_confidence"])

    extra = "".join(f", `{c}` {evidence.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"key string{extra}, para_no bigint, lang string, confidence double, doc_lang string, doc_confidence double")


def _decide(post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(post):
        return np.zeros(0, np.int64), np.zeros(0)
    e = np.exp(post - post.max(1, keepdims=True))
    return post.argmax(1), e.max(1) / e.sum(1)


def labelled_rows(manifest: DataFrame, gold: DataFrame) -> DataFrame:
    """``label_table, job_id, stated`` of both tables, distinct."""
    a = manifest.select(F.lit("manifest").alias("label_table"), "job_id", language_of_label(F.col("heuristic_language")).alias("stated"))
    b = gold.select(F.lit("skill_gold_v1").alias("label_table"), "job_id", language_of_label(F.col("primary_language")).alias("stated"))
    return a.unionByName(b).filter("job_id is not null").distinct()


def all_paragraphs(jobs: DataFrame, manifest: DataFrame, gold: DataFrame) -> DataFrame:
    """Every posting's paragraphs with language and confidence, once per posting."""
    rows = labelled_rows(manifest, gold)
    evidence = written_table(text_evidence(jobs, fitted(jobs, rows)), "language")
    columns = ("host", "source", "declared", "logs")
    once = evidence.groupBy("key").agg(F.min(F.struct(*columns)).alias("r")).select("key", "r.*")
    return languages(once, host_priors(evidence)).withColumnRenamed("key", "job_id")


def wrong_labels(jobs: DataFrame, manifest: DataFrame, gold: DataFrame) -> DataFrame:
    """``label_table, job_id, para_no, lang`` of paragraphs whose language is not the one stated, or where none is stated."""
    rows = labelled_rows(manifest, gold)
    evidence = written_table(text_evidence(jobs, fitted(jobs, rows)), "language")
    priors = host_priors(evidence)
    wanted = evidence.join(rows.withColumnRenamed("job_id", "key"), "key")
    found = languages(wanted, priors, ("label_table", "stated"))
    return found.filter(F.col("stated").isNull() | (F.col("stated") != F.col("lang"))).select("label_table", F.col("key").alias("job_id"), "para_no", "lang").distinct()
