"""Personal information in free text: a linear-chain conditional random field, decoded by Viterbi in numpy batches.

Tokens are runs of letters, runs of digits, runs of capitals and digits, and single signs, each with the white space before it. A token's type is its set
of word-shape features (shape, length class, endings and words seen in the labelled table), so the many different words of
a corpus share few types; the scores of a type at the seven places of the window are one row of a matrix. A batch is one
flat array of types: emissions are seven gathers, and Viterbi runs over thousands of lines at once, ordered by length.

The model is trained once per driver process on the labelled table of `pii_table` alone, then it is broadcast. Nothing is taken
from the corpus: neither the fit nor the checks know how frequent a word is, so a name counts however many rows it signs, and
a row's items are the same in a table of any size.

Defined cases: null and empty texts hold no items and stay as they are; texts of any length are read whole, line by line;
marks of an earlier redaction are kept; a repeated row gives equal rows, which count once; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import pii_table
from stellwerk.llm.bpe import slices
from stellwerk.llm.pii_table import KINDS

FIELDS = ("description", "requirements", "benefits")
#: O, then B and I of each kind.
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
REACH = 3
#: Tokens times lines that are decoded at once, and characters of the texts that are read at once: memory does not depend on how texts are cut.
CELLS, CHARACTERS = 1 << 17, 1 << 20
_TOKEN = re.compile(r"\s*(?:(?=[A-Z]+\d|\d+[A-Z])[A-Z\d]{5,}(?![a-z])|[^\W\d_]+|\d+|[^\w\s]|_)|\s+$")
_AT = re.compile(r"(?i)@|&#64;|＠|[(\[{]\s*(?:at|ät|a)\s*[)\]}]|\s(?:at|ät)\s")
_DOT = re.compile(r"(?i)\.|\b(?:dot|punkt|point|kropka|punt)\b")
_WORD_DIGITS = re.compile(r"(?i)\b(?:null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zero|one|two|three|four|five|six|seven|eight|nine)\b")


def _shape(word: str) -> str:
    if word.islower():
        return "x"
    if word.isupper():
        return "X" if len(word) == 1 else "XX"
    return "Xx" if word[0].isupper() and word[1:].islower() else "xX"


class Crf:
    """Feature index, weights ``w[place, feature, label]`` and transitions ``t[label, label]``."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {}
        self.words: set[str] = set()
        self.endings: set[str] = set()
        self.weights = np.zeros((0, 0, 0), np.float32)
        self.moves = np.zeros((len(LABELS), len(LABELS)), np.float32)
        self.ids: dict[str, int] = {}
        self.types: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, 0, 0), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ids": {}, "types": {}, "rows": [], "table": None}

    def traits(self, token: str) -> tuple[str, ...]:
        """The features of a token; equal for all tokens of a type."""
        core = token.lstrip()
        space = "s" if len(core) < len(token) else "-"
        if not core:
            return (space, "blank")
        c = core[0]
        if len(core) > 4 and core.isalnum() and not core.isalpha() and not core.isdigit():  # a run of capitals and digits
            return (space, "code", f"code{min(len(core), 13)}", f"code{space}")
        if c.isdigit():
            n = len(core)
            out = [space, f"d{min(n, 13)}", f"d{min(n, 13)}{space}"]
            if c in "0０":
                out.append("d0")
            if core in self.words:
                out.append(f"w={core}")
            return tuple(out)
        if not c.isalpha():
            return (space, f"p={core}", f"p={core}{space}")
        low, shape = core.lower(), _shape(core)
        out = [space, f"a{shape}", f"a{shape}{space}", f"l{min(len(core), 6)}"]
        if low in self.words:
            out.append(f"w={low}")
            out.append(f"w={low}{shape}")
        else:
            out.append("rare")
            out.append(f"rare{shape}{space}")
        for k in (3, 4, 6):
            if len(low) > k and (k, low[-k:]) in self.endings:
                out.append(f"e={low[-k:]}")
        return tuple(out)

    def fit(self, table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 20, batch: int = 96, rate: float = 0.05, shrink: float = 3e-5, seed: int = 3) -> Crf:
        """Maximum likelihood with an L2 term, by Adam over forward-backward expectations of mini-batches."""
        lines = [(_TOKEN.findall(text), text, spans) for text, spans in table]
        seen = Counter(t.strip().lower() for tokens, _, _ in lines for t in dict.fromkeys(tokens))
        entity = Counter()
        outside = Counter()
        labelled = []
        for tokens, _, spans in lines:
            y, at = [], 0
            for t in tokens:
                start = at + len(t) - len(t.lstrip())
                at += len(t)
                kind = next(((k, a) for a, b, k in spans if a <= start < b), None)
                if kind is None:
                    y.append(0)
                    outside[t.strip().lower()] += 1
                else:
                    first = not y or y[-1] == 0 or start == kind[1] or (y[-1] + 1) // 2 - 1 != KINDS.index(kind[0])
                    y.append(1 + 2 * KINDS.index(kind[0]) + (0 if first else 1))
                    entity[t.strip().lower()] += 1
            labelled.append((tokens, y))
        # a word is a cue if it is frequent in the table; the invented fillers are not
        self.words = {w for w, n in seen.items() if n >= 6 and w and (not w.isdigit() or len(w) <= 4)}
        ends = Counter((k, w[-k:]) for w, n in seen.items() for k in (3, 4, 6) if len(w) > k and w.isalpha())
        self.endings = {e for e, n in ends.items() if n >= 4}
        rng = np.random.default_rng(seed)
        kinds: dict[tuple, int] = {(): 0}
        xs, ys = [], []
        for tokens, y in labelled:
            xs.append(np.array([kinds.setdefault(self.traits(t), len(kinds)) for t in tokens], np.int64))
            ys.append(np.array(y, np.int64))
        for traits in kinds:
            for f in traits:
                self.features.setdefault(f, len(self.features))
        hot = np.zeros((len(kinds), len(self.features)), np.float32)
        for traits, i in kinds.items():
            hot[i, [self.features[f] for f in traits]] = 1
        n_labels, places = len(LABELS), 2 * REACH + 1
        w = np.zeros((places, len(self.features), n_labels), np.float32)
        moves = np.zeros((n_labels, n_labels), np.float32)
        for k in range(len(KINDS)):  # an inner label follows only its own kind
            for j in range(n_labels):
                if j not in (1 + 2 * k, 2 + 2 * k):
                    moves[j, 2 + 2 * k] = -30
        fixed = moves < 0
        mean = [np.zeros_like(w), np.zeros_like(moves)]
        var = [np.zeros_like(w), np.zeros_like(moves)]
        order = np.argsort([len(x) for x in xs], kind="stable")
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        step = summed = 0
        sums = [np.zeros_like(w), np.zeros_like(moves)]  # the mean over the second half of the steps is kept
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                rows = batches[b]
                step += 1
                size = max(len(xs[i]) for i in rows)
                x = np.zeros((len(rows), size + 2 * REACH), np.int64)
                y = np.zeros((len(rows), size), np.int64)
                mask = np.zeros((len(rows), size), bool)
                for r, i in enumerate(rows):
                    x[r, REACH : REACH + len(xs[i])] = xs[i]
                    y[r, : len(ys[i])] = ys[i]
                    mask[r, : len(ys[i])] = True
                scores = hot @ w.transpose(1, 0, 2).reshape(len(self.features), -1)
                scores = scores.reshape(len(kinds), places, n_labels)
                e = sum(scores[x[:, o : o + size], o] for o in range(places))
                grad_e, grad_m = _expectations(e, moves, y, mask)
                flat = np.zeros((len(kinds), places, n_labels), np.float32)
                for o in range(places):
                    ids = x[:, o : o + size][mask]
                    for lab in range(n_labels):
                        flat[:, o, lab] = np.bincount(ids, grad_e[..., lab][mask], len(kinds))
                g = (hot.T @ flat.reshape(len(kinds), -1)).reshape(len(self.features), places, n_labels).transpose(1, 0, 2) / len(rows)
                for j, (p, gr) in enumerate(((w, g + shrink * w), (moves, grad_m / len(rows) + shrink * np.where(fixed, 0, moves)))):
                    mean[j] = 0.9 * mean[j] + 0.1 * gr
                    var[j] = 0.99 * var[j] + 0.01 * gr * gr
                    p -= rate * (1 - 0.8 * epoch / epochs) * (mean[j] / (1 - 0.9**step)) / (np.sqrt(var[j] / (1 - 0.99**step)) + 1e-6)
                moves[fixed] = -30
                if epoch >= epochs // 2:
                    sums[0] += w
                    sums[1] += moves
                    summed += 1
        self.weights, self.moves = sums[0] / summed, sums[1] / summed
        return self

    # decoding

    def _ready(self) -> None:
        if self.table is None or not len(self.table):
            self.ids, self.types, self.rows = {}, {}, []
            self._type(())  # row 0 pads the ends of lines
            self._pack()

    def _type(self, traits: tuple[str, ...]) -> int:
        if traits not in self.types:
            known = [self.features[f] for f in traits if f in self.features]
            self.types[traits] = len(self.rows)
            self.rows.append(self.weights[:, known].sum(1) if known else np.zeros(self.weights.shape[::2], np.float32))
        return self.types[traits]

    def _pack(self) -> None:
        self.table = np.ascontiguousarray(np.array(self.rows, np.float32).transpose(1, 0, 2))

    def encode(self, tokens: list[str]) -> list[int]:
        ids = self.ids
        if len(ids) > 400_000:
            ids.clear()
        for t in set(tokens).difference(ids):
            ids[t] = self._type(self.traits(t))
        if len(self.rows) != self.table.shape[1]:
            self._pack()
        return [ids[t] for t in tokens]

    def decode(self, lines: list[list[str]]) -> list[np.ndarray | None]:
        """Labels of each line's tokens, None where all are outside."""
        self._ready()
        out: list[np.ndarray | None] = [None] * len(lines)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        if not sizes.sum():
            return out
        flat = np.fromiter(self.encode([t for x in lines for t in x]), np.int64, int(sizes.sum()))
        # REACH pads after every line, and before the first
        starts = np.cumsum(sizes + REACH) - sizes
        padded = np.zeros(int((sizes + REACH).sum()) + REACH, np.int64)
        owner = np.repeat(np.arange(len(lines)), sizes)
        place = starts[owner] + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded[place] = flat
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        a = 0
        while a < len(order):  # lines of falling length, as many as fill CELLS cells with the first one's
            rows = order[a : a + max(1, CELLS // int(sizes[order[a]]))]
            a += len(rows)
            n = sizes[rows]
            # time-major: [token, line, label]
            pos = np.minimum(starts[rows][None] + np.arange(n[0])[:, None], len(padded) - REACH - 1)
            e = self.table[0][padded[pos - REACH]]
            for o in range(1, 2 * REACH + 1):
                e += self.table[o][padded[pos + o - REACH]]
            labels = _viterbi(e, self.moves, n)
            for i in np.flatnonzero(labels.any(0)):
                out[rows[i]] = labels[: n[i], i]
        return out


def _expectations(e: np.ndarray, moves: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by emissions and transitions, by scaled forward-backward."""
    n, size, k = e.shape
    top = e.max(2, keepdims=True)
    p = np.exp(e - top)
    m = np.exp(np.maximum(moves, -30))
    alpha, scale = np.zeros_like(e), np.ones((n, size), e.dtype)
    alpha[:, 0] = p[:, 0]
    for t in range(size):
        if t:
            alpha[:, t] = (alpha[:, t - 1] @ m) * p[:, t]
        s = alpha[:, t].sum(1)
        scale[:, t] = s
        alpha[:, t] /= s[:, None]
    beta = np.ones_like(e)
    pair = np.zeros((k, k), np.float64)
    for t in range(size - 2, -1, -1):
        inner = p[:, t + 1] * beta[:, t + 1] / scale[:, t + 1][:, None]
        here = mask[:, t + 1]
        pair += (alpha[here, t].T @ inner[here]) * m
        beta[:, t] = np.where(here[:, None], inner @ m.T, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    grad = post * mask[..., None]
    r, t = np.nonzero(mask)
    grad[r, t, y[r, t]] -= 1
    both = mask[:, 1:]
    pair -= np.bincount((y[:, :-1][both] * k + y[:, 1:][both]), minlength=k * k).reshape(k, k)
    return grad, pair.astype(np.float32)


def _viterbi(e: np.ndarray, moves: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best label paths ``[token, line]`` of emissions ``[token, line, label]``, lines ordered by falling length n.

    Forward, only the best sums are kept, with the lines along the last axis; the way back looks the choices up again.
    """
    size, rows, k = e.shape
    live = np.searchsorted(-n, -np.arange(size), "left")  # lines longer than t
    sums = np.empty((size, k, rows), np.float32)
    sums[0] = e[0].T
    step = np.empty((k, k, rows), np.float32)
    for t in range(1, size):
        m = live[t]
        now = step[:, :, :m]
        np.add(sums[t - 1, :, None, :m], moves[:, :, None], out=now)
        np.max(now, axis=0, out=sums[t, :, :m])
        sums[t, :, :m] += e[t, :m].T
    out = np.zeros((size, rows), np.int8)
    last = np.zeros(rows, np.int64)
    for t in range(size - 1, -1, -1):
        m = live[t]
        after = live[t + 1] if t + 1 < size else 0
        if m > after:  # lines that end here
            last[after:m] = sums[t, :, after:m].argmax(0)
        if after:
            last[:after] = (sums[t, :, :after] + moves[:, last[:after]]).argmax(0)
        out[t, :m] = last[:m]
    return out


@lru_cache(maxsize=1)
def trained() -> Crf:
    """The model of the labelled table; trained once in a driver process."""
    table = pii_table.rows()
    random.Random(4).shuffle(table)
    return Crf().fit(table)


def plausible(kind: str, text: str) -> bool:
    """The exact check after the model: what an item of a kind must hold."""
    digits = sum(c.isdigit() for c in text)
    if "REDACTED" in text:
        return False
    if kind == "email":
        return len(text) >= 6 and (at := _AT.search(text)) is not None and _DOT.search(text, at.end()) is not None
    if kind == "phone":
        return digits >= 6 or len(_WORD_DIGITS.findall(text)) >= 6
    if kind == "id_number":
        return digits >= 3 or digits > 0 and bool(_CODE.search(text))
    if kind == "street_address":
        return digits >= 1 and sum(c.isalpha() for c in text) >= 3
    words = [w for w in _LETTERS.findall(text.lower()) if len(w) > 1 and w not in _TITLES]
    return sum(map(len, words)) >= 3 and len(words) <= 5 and digits == 0 and "@" not in text


_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of titles and forms of address; a name has at most five other words.
_TITLES = frozenset("herr herrn frau hr fr dr prof dipl ing med phil mr mrs ms miss sir pan pani mme mlle mevrouw dhr mw van von der de den la zu".split())
#: Formats that settle the kind of a number (fixed values: tax, insurance and passport layouts).
_IDENTITY = re.compile(r"756\.\d{4}\.\d{4}\.\d{2}|(?<!\d)\d{2}([ /])\d{3}\1\d{3}\1\d{3}(?!\d)|(?<!\d)\d{2}[ -]?\d{6}[ -]?[A-Z][ -]?\d{3}(?!\d)")
#: A document number of capitals and digits, in one run or in groups of three.
_CODE = re.compile(r"(?<![^\W_])(?:[A-Z\d]{6,}|[A-Z\d]{3}(?:[ -][A-Z\d]{3}){2})(?![^\W_])")
_BEFORE = re.compile(r"(?i)(?:steuer|idnr|tax|versicherung|svnr|sv-n|rv-n|ahv|pesel|ausweis|passport|pass n|bsn|insurance|security)[^\n]{0,24}$")
_JOINED = {"person_name": re.compile(r"\s+(?:und|oder|and|or|et|ou|en|of|i|lub)\s+"), "email": re.compile(r"\s+(?:und|oder|and|or|et|ou|en|of|lub)\s+"), "phone": re.compile(r"\s+(?:und|oder|and|or|mobil|mobile)\s+")}


def settle(text: str, start: int, end: int, kind: str) -> Iterator[tuple[int, int, str]]:
    """The items of one decoded span: joined ones apart, numbers of a settled format under their kind, implausible ones out."""
    if kind == "phone" and (_IDENTITY.search(text[start:end]) or _BEFORE.search(text[max(0, start - 40) : start])):
        kind = "id_number"
    elif kind == "id_number" and re.match(r"(?:tel:?\.?\s*)?\(?[+0]\d", text[start:end]) and not _IDENTITY.search(text[start:end]) and not _BEFORE.search(text[max(0, start - 40) : start]):
        kind = "phone"
    parts, at = [], start
    if kind in _JOINED:
        for m in _JOINED[kind].finditer(text, start, end):
            parts.append((at, m.start()))
            at = m.end()
    parts.append((at, end))
    for a, b in parts:
        if kind == "email" and (m := re.search(r"[^\s,;:<>()]+(?:@|＠|&#64;)[\w.-]*\w", text[a:b])):
            a, b = a + m.start(), a + m.end()
        if plausible(kind, text[a:b]):
            yield a, b, kind


def items(model: Crf, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """(row, [(start, end, kind)]) of the texts that hold items, in order."""
    lines: list[list[str]] = []
    place: list[tuple[int, int]] = []
    for r, text in enumerate(texts):
        if not text:
            continue
        at = 0
        for line in text.split("\n"):
            if line and not line.isspace():
                lines.append(_TOKEN.findall(line))
                place.append((r, at))
            at += len(line) + 1
    found: dict[int, list[tuple[int, int, str]]] = {}
    for (r, at), tokens, y in zip(place, lines, model.decode(lines)):
        if y is None:
            continue
        ends = np.cumsum([len(t) for t in tokens])
        text, i = texts[r], 0
        while i < len(y):
            if y[i] == 0:
                i += 1
                continue
            kind, j = (int(y[i]) - 1) // 2, i + 1
            while j < len(y) and y[j] == 2 + 2 * kind:
                j += 1
            start = at + int(ends[i]) - len(tokens[i].lstrip())
            end = at + int(ends[j - 1])
            found.setdefault(r, []).extend(settle(text, start, end, KINDS[kind]))
            i = j
    yield from sorted((r, spans) for r, spans in found.items() if spans)


def find_items(df: DataFrame, key: str = "job_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, field_name, kind, seq`` of every item, distinct. One Arrow pass; only the found items are shuffled."""
    model = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            for i, field in enumerate(fields, 1):
                column = batch.column(i).to_pylist()
                for a, b in slices(column, CHARACTERS):
                    for r, spans in items(model.value, column[a:b]):
                        seen: Counter = Counter()
                        for _, _, kind in spans:
                            seen[kind] += 1
                            out.append((keys[a + r], field, kind, seen[kind]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["key", "field_name", "kind", "seq"])

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *fields)
    return rows.mapInArrow(run, "key string, field_name string, kind string, seq bigint").distinct().withColumnRenamed("key", key)


def redact(df: DataFrame, key: str = "job_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows with every item replaced by its typed placeholder, such as [EMAIL]; all else unchanged."""
    model = df.sparkSession.sparkContext.broadcast(trained())
    places = [df.columns.index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for p in places:
                texts = columns[p].to_pylist()
                for a, b in slices(texts, CHARACTERS):
                    for r, spans in items(model.value, texts[a:b]):
                        t = texts[a + r]
                        for start, end, kind in reversed(spans):
                            t = f"{t[:start]}[{kind.upper()}]{t[end:]}"
                        texts[a + r] = t
                columns[p] = pa.array(texts, columns[p].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
