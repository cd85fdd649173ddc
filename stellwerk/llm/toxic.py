"""Abusive, hateful or sexual content: non-negative positive-unlabelled learning on sentences.

Texts are normalised against disguises (compatibility forms, look-alike letters, invisible signs, digits for letters,
stretched and spaced words), cut into sentences and hashed into words, word pairs and starred-word signs: of a batch of
sentences at once, as flat numpy arrays. Positive are the sentences that carry a document that raters confirmed; a linear
classifier minimises the class-prior-corrected, non-negative risk in numpy; between rounds the carrying sentences of
confirmed documents are chosen again by the classifier. A document's score is that of its worst sentence.

Which words stand out in confirmed documents is judged against the document frequencies of all documents, counted in one
aggregation (one row a feature and partition is shuffled, at most 2^BITS numbers reach the driver), and so is the mean
number of sentences that the class prior needs.

Bounds of the fit: at most CONFIRMED confirmed, CONFIRMED cleared and SAMPLE other documents (smallest hashes of their ids)
give the rows of the risk estimate; every document is counted and scored.

Defined cases: null, empty and blank texts score 0; raters' labels in any spelling, ties count as confirmed; a repeated
text gets equal scores under each id; without confirmed documents the built-in examples alone are the positives; without
unlabelled ones the risk of the positives alone is minimised; very long texts are scored whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.bpe import slices

CONFIRMED, SAMPLE = 4000, 6_000
BITS = 18
#: Share of documents that smooths the document frequency of a feature.
RARE = 1.5e-4
#: Set by reading documents of the test tables by score: without carrying sentences nearly all stay below 0.06, and most of
#: those from here on hold one. It is an odds cut of the fitted risk, no calibrated probability.
THRESHOLD = 0.09
#: Examples that any corpus' positives are joined by.
EXAMPLES = """
Du bist ein Idiot. Was für ein Vollidiot schreibt so einen Müll? Halt endlich die Fresse, du Penner. Verpiss dich, du Arschloch! Du dummes Schwein. Du bist echt zum Kotzen. Du widerlicher Mistkerl. Der Chef ist ein hirnloser Trottel. So ein dämliches Miststück. Kratz ab, du Versager. Geh sterben. Ich bring dich um. Ich brech dir alle Knochen. Ich weiß, wo du wohnst. Dich vermisst keiner. Fick dich. Du Wichser. Du Drecksack.
Ausländer raus. Die sind doch alle minderwertig. Die gehören alle vergast. Die stinken und klauen alle. Das ist alles Abschaum. Frauen gehören an den Herd. Solche Leute sind zu dumm für jede Arbeit. Diese Rasse taugt nichts. Behinderte sind eine Plage.
Zieh dich aus und ich besorg es dir. Ich will deine Brüste lutschen. Blas mir einen. Schick mir Nacktbilder. Ich hab mir einen runtergeholt. Trag morgen keinen Slip. Setz dich auf meinen Schoß und mach die Beine breit.
You are a fucking idiot. What kind of moron writes this crap? Shut your mouth, you stupid bitch. Go to hell, you piece of shit. You brainless clown. You are a waste of space. Drop dead, loser. Go kill yourself. I will kill you. I will break every bone in your body. I know where you live. Nobody would miss you. Fuck off, you asshole. You worthless scumbag.
Those people are vermin. They all steal and stink. Chase them all out of the country. Women belong in the kitchen. They are too stupid to work. That race is worthless. Immigrants are a plague. They are subhuman.
Send me nudes. Suck my dick. Take off your clothes in my office. I want to lick your tits. You get promoted if you sleep with me. Leave your underwear at home. I jerked off thinking of you. Spread your legs for me.
""".strip()
_LOOKALIKES = str.maketrans("аеорсухіӏвнкмтԁѕјгαεορυχ", "aeopcyxilbhkmtdsjraeopux")
_LOOKALIKE = re.compile("[" + "".join(map(chr, _LOOKALIKES)) + "]")
_LEET = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile(r"[.!?]\s+|\n+")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .][^\W\d_]){3,}\b")
_WORD = re.compile(r"[^\W_]*\*+[\w*]*|[^\W_]+")
_STRETCH = re.compile(r"([^\W\d])\1{2,}")
#: Signs that show nothing (format characters) and marks that combine with the letter before (fixed ranges of Unicode).
_INVISIBLE = re.compile("[\u00ad\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u0600-\u0605\u061c\u064b-\u065f\u06dd\u070f\u08e2\u180b-\u180f\u1ab0-\u1ace\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20f0\u302a-\u302d\ufe00-\ufe0f\ufe20-\ufe2f\ufeff\ufff9-\ufffb\U0001d173-\U0001d17a\U000e0001-\U000e01ef]+")


def normalise(text: str) -> str:
    """Lower case with disguises undone as far as they can be."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text.lower())
    low = text.lower()
    if not low.isascii() and _LOOKALIKE.search(low):
        low = low.translate(_LOOKALIKES)
    low = _SPACED.sub(lambda m: m[0].replace(" ", "").replace(".", ""), low)
    # looking for three equal letters first costs less than the pattern
    return _STRETCH.sub(r"\1", low) if any(c * 3 in low for c in set(low)) else low


def _word(w: str) -> tuple[int, ...]:
    """The hashed features of one word, at most three; the first stands for it in pairs."""
    if "*" in w:
        plain = w.replace("*", "")
        return (zlib.crc32(f"*{w[0]}{len(w)}{w[-1]}".encode()), zlib.crc32(b"*starred"), zlib.crc32(f"*{len(plain) > 0}".encode()))
    if w.isdigit():
        return (zlib.crc32(b"0"),)
    mixed = any(c.isdigit() for c in w)
    if mixed:
        w = w.translate(_LEET)
    out = [zlib.crc32(w.encode())]
    if mixed and w.isalpha():
        out.append(zlib.crc32(b"#leet"))
    if len(w) >= 6:
        out.append(zlib.crc32(f"{w[:5]}~".encode()))
    return tuple(out)


class Hasher:
    """Words met so far with their features; hashes many sentences at once."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []
        self.table = np.zeros((0, 3), np.int64)

    def places(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat distinct features of each normalised sentence, in order, and how many each has."""
        if len(self.index) > 1_000_000:
            self.__init__()
        index, ids, sizes = self.index, [], []
        for s in sentences:
            words = _WORD.findall(s)
            sizes.append(len(words))
            for w in words:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(self.rows)
                    self.rows.append((*_word(w), -1, -1)[:3])
                ids.append(i)
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, np.int64).reshape(-1, 3)
        words = self.table[np.array(ids, np.int64)] if ids else np.zeros((0, 3), np.int64)
        owner = np.repeat(np.arange(len(sentences)), np.array(sizes, np.int64))
        heads = words[:, 0]
        out, whose = [words.ravel()], [np.repeat(owner, 3)]
        for step, (a, b, c) in ((1, (31, 17, 7)), (2, (131, 37, 11))):
            same = owner[step:] == owner[:-step]
            out.append((heads[:-step] * a + heads[step:] * b + c)[same])
            whose.append(owner[step:][same])
        flat, owner = np.concatenate(out), np.concatenate(whose)
        real = flat >= 0
        keys = np.sort((owner[real] << BITS) | (flat[real] & ((1 << BITS) - 1)))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(sentences))


def features(sentences: list[str]) -> list[np.ndarray]:
    """The places of each sentence, as arrays."""
    flat, sizes = Hasher().places(sentences)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def sentences(text: str | None) -> list[str]:
    """Normalised sentences; a sentence repeated in a text stands once."""
    if not text or text.isspace():
        return []
    return list(dict.fromkeys(s for s in (p.strip() for p in _SENTENCE.split(normalise(text))) if s))


class Rows:
    """Sparse binary rows, each scaled to length one."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.ids], len(self.sizes)) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, (g * self.scale)[self.owner], 1 << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, steps: int = 160, rate: float = 0.15, shrink: float = 1e-5, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with the logistic loss.

    Where the second part falls below -slack, a step is taken against it instead, as the non-negative estimator does.
    """
    w, b = np.zeros(1 << BITS), -2.0
    m, v = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    n_p, n_u = max(1, len(positive.sizes)), max(1, len(unlabelled.sizes))
    for step in range(1, steps + 1):
        s_p, s_u = positive.dot(w) + b, unlabelled.dot(w) + b
        rest = (np.log1p(np.exp(np.minimum(s_u, 30))).sum() / n_u - prior * np.log1p(np.exp(np.minimum(s_p, 30))).sum() / n_p) if len(s_u) else 0.0
        up_p, up_u = prior * _sigmoid(s_p) / n_p, _sigmoid(s_u) / n_u  # slopes of the losses as negatives
        if rest >= -slack:
            g_p, g_u = -prior * _sigmoid(-s_p) / n_p - up_p, up_u
        else:
            g_p, g_u = up_p, -up_u
        g = np.append(positive.back(g_p) + unlabelled.back(g_u) + shrink * w, g_p.sum() + g_u.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Corpus:
    """Over all documents: in how many each feature stands, the number of documents that hold sentences, and of sentences."""

    def __init__(self, counts: np.ndarray, documents: int, sentences: int):
        self.counts, self.documents, self.sentences = counts, documents, sentences

    @classmethod
    def of(cls, texts: list[str | None], hasher: Hasher | None = None) -> Corpus:
        cut = [ss for ss in map(sentences, texts) if ss]
        index: dict[str, int] = {}
        which = np.array([index.setdefault(s, len(index)) for ss in cut for s in ss], np.int64)
        flat, sizes = (hasher or Hasher()).places(list(index))  # each distinct sentence once
        parts = np.array(list(map(len, cut)), np.int64)
        wide = sizes[which]
        owner = np.repeat(np.repeat(np.arange(len(cut)), parts), wide)
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        once = np.sort((owner << BITS) | flat[place])
        once = once[np.r_[True, once[1:] != once[:-1]]] if len(once) else once
        return cls(np.bincount(once & ((1 << BITS) - 1), minlength=1 << BITS), len(cut), int(parts.sum()))


def corpus_counts(documents: DataFrame) -> Corpus:
    """The counts of all documents: summed within each partition, then one row a feature and partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, parts, hasher = np.zeros(1 << BITS, np.int64), 0, 0, Hasher()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                c = Corpus.of(texts[a:b], hasher)
                total += c.counts
                docs, parts = docs + c.documents, parts + c.sentences
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2].astype(np.int32)), pa.array(np.r_[total[at], docs, parts])], ["feature", "n"])

    rows = documents.select("text").filter("text is not null").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most 2^BITS + 2 rows
    feature, n = np.asarray(got["feature"]), np.asarray(got["n"])
    out = np.zeros((1 << BITS) + 2, np.int64)
    out[feature] = n
    return Corpus(out[: 1 << BITS], int(out[-1]), int(out[-2]))


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._hasher = Hasher()
        self._seen: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_hasher": Hasher(), "_seen": {}}

    def score_sentences(self, new: list[str]) -> np.ndarray:
        """Log odds of normalised sentences."""
        ids, sizes = self._hasher.places(new)
        sums = np.bincount(np.repeat(np.arange(len(new)), sizes), self.weights[ids], len(new))
        return sums / np.sqrt(np.maximum(sizes, 1)) + self.bias

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts. Sentences of templates come again and again, so their log odds are kept for a while."""
        if len(self._seen) > 300_000:
            self._seen = {}
        seen, cut = self._seen, [sentences(t) for t in texts]
        new = list({s for ss in cut for s in ss if s not in seen})
        seen.update(zip(new, self.score_sentences(new).tolist()))
        best = [max([seen[s] for s in ss], default=None) for ss in cut]
        return [0.0 if x is None else 1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in best]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    @classmethod
    def fit(cls, confirmed: list[str], cleared: list[str], sample: list[str], corpus: Corpus | None = None, rounds: int = 2) -> Classifier:
        """confirmed, cleared: texts that raters found toxic or not; sample: texts of all kinds; corpus: counts over all documents (else of the sample)."""
        bad, good, all_rows = ([sentences(t) for t in texts] for texts in (confirmed, cleared, sample))
        corpus = corpus or Corpus.of(sample + cleared)
        distinct = list(dict.fromkeys(s for ss in bad + good + all_rows for s in ss))
        known = dict(zip(distinct, features(distinct)))
        examples = features(sentences(EXAMPLES))
        # rate of toxic documents among rated ones, drawn towards 3 % where few are rated
        share = (len(confirmed) + 0.03 * 50) / (len(confirmed) + len(cleared) + 50)
        fine = {s for ss in good for s in ss}
        pool = [s for ss in all_rows for s in ss] + [s for ss in good for s in ss]
        unlabelled = Rows([known[s] for s in pool])
        # one carrying sentence a toxic document; cleared documents add sentences to the pool, but none of these
        prior = min(0.3, share * corpus.documents / max(1, corpus.sentences) * sum(map(len, all_rows)) / max(1, len(pool))) or 0.01
        # round 0: in each confirmed document, words that stand far more often in confirmed than in other documents
        n_bad, n_all = max(1, len(bad)), max(1, corpus.documents)
        c_bad = np.bincount(np.concatenate([np.unique(np.concatenate([known[s] for s in ss])) for ss in bad if ss] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
        c_good = np.bincount(np.concatenate([np.unique(np.concatenate([known[s] for s in ss])) for ss in good if ss] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
        # the smoothing is a rate, not a count, so that a word's odds do not depend on the size of the corpus
        elsewhere = corpus.counts / n_all + 0.5 * c_good / max(1, len(good)) + RARE
        odds = np.log((c_bad + 0.1) / n_bad / elsewhere)
        first, bias0 = fit_nnpu(Rows(examples), unlabelled, prior, 60)
        weights, bias = first + 0.6 * np.where(c_bad >= 2, odds, np.minimum(odds, 0)), bias0
        value = lambda s, w: float(w[known[s]].sum() / max(1, len(known[s])) ** 0.5)
        chosen = [[max(ss, key=lambda s: (value(s, weights), s))] if ss else [] for ss in bad]
        # raters err: a sentence stays only if a classifier that has not seen its document takes it for toxic, too
        for _ in range(rounds):
            kept: list[list[str]] = [[] for _ in bad]
            for fold in (0, 1):
                w, b = fit_nnpu(Rows([known[s] for i, ss in enumerate(chosen) if i % 2 != fold for s in ss] + examples), unlabelled, prior, 70)
                for i in range(fold, len(bad), 2):
                    kept[i] = [s for s in bad[i] if value(s, w) + b > -2.5 and s not in fine]
            chosen = kept
        weights, bias = fit_nnpu(Rows([known[s] for ss in chosen for s in ss] + examples), unlabelled, prior, 100)
        # sentences of the sample that are as good as certain join the positives for the last fit
        sure = sorted({s for s, x in zip(pool, unlabelled.dot(weights) + bias) if x > 0.0} - fine)
        weights, bias = fit_nnpu(Rows([known[s] for ss in chosen for s in ss] + [known[s] for s in sure] + examples), unlabelled, prior, 120)
        return cls(weights, bias)


def confirmed_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` by the majority of the raters' opinions; ties count as toxic."""
    word = F.lower(F.trim("label"))
    votes = labels.filter("doc_id is not null and label is not null").groupBy("doc_id", F.lower(F.trim("rater")).alias("rater")).agg(F.max((word != "none").cast("int")).alias("bad"))
    return votes.groupBy("doc_id").agg((F.avg("bad") >= 0.5).alias("toxic"))


def fitted(documents: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of bounded samples, the same ones at every run."""
    ids = confirmed_ids(labels)
    order = F.xxhash64("doc_id")
    some = lambda df, n: df.withColumn("h", order).orderBy("h", "doc_id").limit(n).select("doc_id")
    parts = some(ids.filter("toxic"), CONFIRMED).withColumn("part", F.lit("bad")).unionByName(some(ids.filter("not toxic"), CONFIRMED).withColumn("part", F.lit("good")))
    parts = parts.unionByName(some(documents.select("doc_id"), SAMPLE).withColumn("part", F.lit("any")))
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(parts), "doc_id").select("part", "doc_id", "text").collect()
    rows = sorted(set(map(tuple, rows)))
    corpus = corpus_counts(documents)
    return _fit(*(tuple(t for p, _, t in rows if p == kind) for kind in ("bad", "good", "any")), corpus.counts.tobytes(), corpus.documents, corpus.sentences)


@lru_cache(maxsize=2)
def _fit(confirmed: tuple[str, ...], cleared: tuple[str, ...], sample: tuple[str, ...], counts: bytes, n_documents: int, n_sentences: int) -> Classifier:
    """The classifier of these texts and counts, fitted once in a driver process."""
    return Classifier.fit(list(confirmed), list(cleared), list(sample), Corpus(np.frombuffer(counts, np.int64), n_documents, n_sentences))


def scored(documents: DataFrame, classifier: Classifier, kept: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, kept..., score`` of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(classifier)
    rest = list(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest) + 1).to_pylist()
            scores = [x for a, b in slices(texts) for x in sent.value.scores(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest) + 1], pa.array(scores, pa.float64())], ["doc_id", *rest, "score"])

    schema = "doc_id bigint" + "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in rest) + ", score double"
    return documents.select("doc_id", *rest, "text").mapInArrow(run, schema)


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, fitted(documents, labels)).filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, n_docs, n_toxic, rate`` per source."""
    s = scored(documents, fitted(documents, labels), ("source",))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_toxic"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate"))
