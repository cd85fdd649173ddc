"""Amounts recorded in different currencies, periods and scales, brought to euros a year.

Unit strings are segmented by dynamic programming over three tries: prefixes (``k``, ``Tsd.``), roots (currencies, minor
units, periods) and exponents (``/``, ``pro``, ``per``: the unit that follows has the exponent -1). Every lexeme has a
score that depends on the field it stands in (the prior of the field's dimension), so that ``t`` before ``eur`` is a
thousand, and ``t`` in ``tag`` is not.

Defined cases: a null amount gives no row; a null, empty or blank unit says nothing; contradicting statements in the text
lose against the field; an amount that is no number, or too large for 64 bits in euros, has null euros; repeated rows give equal rows, which count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.session import collect_bounded

PREFIXES = {"k": "thousand", "t": "thousand", "tsd.": "thousand", "tsd": "thousand", "tausend": "thousand", "thousand": "thousand", "thousands": "thousand", "x1000": "thousand", "x 1000": "thousand", "1000": "thousand", "tys.": "thousand", "tys": "thousand", "mille": "thousand", "duizend": "thousand"}
CURRENCIES = {
    "EUR": ("eur", "euro", "euros", "€"),
    "CHF": ("chf", "fr.", "sfr.", "fr", "sfr", "franken", "swiss franc", "swiss francs", "francs suisses", "schweizer franken"),
    "GBP": ("gbp", "£", "pfund", "pound", "pounds", "pounds sterling", "livres", "funtów", "pond", "britische pfund"),
    "USD": ("usd", "us$", "$", "us-dollar", "us dollar", "us dollars", "us-dollars", "dollar", "dollars", "dolarów", "usd$"),
    "PLN": ("pln", "zł", "zl", "zloty", "złoty", "zlotys", "złotych", "zlotych", "polnische zloty"),
    "CZK": ("czk", "kč", "kc", "kronen", "koruna", "korunas", "crowns", "czech crowns", "czech koruna", "tschechische kronen"),
}
MINOR = {"EUR": ("cent", "cents", "ct", "ct.", "euro cent", "euro cents", "eur-cent", "euro-cent", "eurocent", "eurocents", "eur cent"), "GBP": ("pence", "penny"), "CHF": ("rappen", "rp."), "PLN": ("grosz", "groszy"), "CZK": ("heller",)}
PERIODS = {
    "hour": ("h", "hr", "std.", "std", "stunde", "stunden", "stündlich", "stundenlohn", "stundensatz", "hour", "hourly", "heure", "uur", "godz.", "godz", "godzinę", "godzina"),
    "day": ("d", "tag", "tage", "täglich", "tagessatz", "arbeitstag", "day", "daily", "working day", "jour", "dag", "dzień"),
    "week": ("woche", "wochen", "wöchentlich", "wochenlohn", "week", "weekly", "semaine", "tydzień"),
    "month": ("monat", "monate", "monatlich", "mtl.", "mtl", "p.m.", "p. m.", "pm", "month", "monthly", "monatslohn", "monatsbrutto", "monatsgehalt", "mois", "mensuel", "maand", "miesiąc", "miesięcznie"),
    "year": ("jahr", "jahre", "jährlich", "jährl.", "p.a.", "p. a.", "pa", "annum", "annual", "annually", "yearly", "year", "jahresbrutto", "jahresgehalt", "an", "annuel", "jaar", "rok", "rocznie"),
}
EXPONENTS = ("/", "pro", "per", "je", "im", "am", "in der", "in", "die", "der", "das", "a", "an", "each", "par", "na", "za", "met", "brutto/", "gross/")
NOISE = ("brutto", "gross", "netto", "k. a.", "k.a.", "n/a", "von", "ab", "from")

#: Score of a lexeme by the dimension that the field is made for; a text has no such prior.
PRIORS = {"currency": {"currency": 0.0, "period": -2.0}, "period": {"currency": -2.0, "period": 0.0}, "text": {"currency": 0.0, "period": 0.0}}


#: From here on no rate brings an amount back into 64 bits.
BEYOND = 1e25


@dataclass(frozen=True)
class Unit:
    """What a unit string states; None where it says nothing."""

    currency: str | None = None
    period: str | None = None
    scale: str | None = None


def _trie(words: dict[str, tuple]) -> dict:
    root: dict = {}
    for word, meanings in words.items():
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).extend(meanings)
    return root


def _lexemes() -> tuple[dict, dict, dict]:
    roots: dict[str, list] = {}
    for code, words in CURRENCIES.items():
        for w in words:
            roots.setdefault(w, []).append(("currency", code, None))
    for code, words in MINOR.items():
        for w in words:
            roots.setdefault(w, []).append(("currency", code, "hundredth"))
    for code, words in PERIODS.items():
        for w in words:
            roots.setdefault(w, []).append(("period", code, None))
    return _trie({w: [("prefix", s, None)] for w, s in PREFIXES.items()}), _trie(roots), _trie({w: [("exponent", w, None)] for w in EXPONENTS} | {w: [("noise", w, None)] for w in NOISE})


_TRIES = _lexemes()
_FREE, _PREFIXED, _POWER = 0, 1, 2


def _arcs(text: str, start: int) -> Iterator[tuple[int, tuple]]:
    for trie in _TRIES:
        node, i = trie, start
        while i < len(text) and text[i] in node:
            node, i = node[text[i]], i + 1
            for meaning in node.get("", ()):
                yield i, meaning


@lru_cache(maxsize=65536)
def segment(text: str, field: str) -> Unit:
    """The best decomposition of a unit string: a Viterbi pass over positions and the state left by the last lexeme."""
    s = " ".join(text.casefold().replace(" ", " ").split())
    n, prior = len(s), PRIORS[field]
    best: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(n + 1)]
    best[0][_FREE] = (0.0, ())

    def offer(at: int, state: int, score: float, path: tuple) -> None:
        if state not in best[at] or best[at][state][0] < score:
            best[at][state] = (score, path)

    word = lambda ch: ch.isalnum()
    for i in range(n):
        for state, (score, path) in list(best[i].items()):
            if word(s[i]):
                j = i + 1
                while j < n and word(s[j]):
                    j += 1
                inside = i > 0 and word(s[i - 1])
                offer(j, _FREE, score - 1.2 - 0.25 * (j - i) - 1.5 * inside, path)  # an unknown word
            else:
                offer(i + 1, state, score - 0.01, path)
            for end, (kind, value, scale) in _arcs(s, i):
                starts_inside = i > 0 and word(s[i - 1]) and word(s[i])
                ends_inside = end < n and word(s[end]) and word(s[end - 1])
                cost = 0.1 * (end - i)  # longer lexemes explain more
                if kind == "prefix":
                    if starts_inside or (end - i == 1 and not (ends_inside or s[end : end + 1] in tuple("€$£") or s[end : end + 1] == " " and end + 1 < n)):
                        continue
                    offer(end, _PREFIXED, score + cost - 0.3, (*path, ("scale", value)))
                elif kind in ("exponent", "noise"):
                    if starts_inside or ends_inside:
                        continue
                    offer(end, _POWER if kind == "exponent" else state, score + cost - 0.2, path)
                else:
                    if starts_inside and state != _PREFIXED or ends_inside:
                        continue
                    if kind == "period" and end - i <= 2 and s[i:end].isalpha() and state != _POWER and n > end - i:
                        cost -= 2.0  # a lone "h" or "an" needs its exponent
                    if kind == "currency" and state == _POWER:
                        cost -= 1.0
                    gained = ((kind, value),) + ((("scale", scale),) if scale else ())
                    offer(end, _FREE, score + cost + 1.0 + prior[kind], path + gained)
    ends = best[n].values()
    if not ends:
        return Unit()
    path = max(ends, key=lambda x: (x[0], x[1]))[1]
    first: dict[str, str] = {}
    for kind, value in path:
        first.setdefault(kind, value)
    return Unit(first.get("currency"), first.get("period"), first.get("scale"))


_NUMBER = re.compile(r"(?<![\d.,'’])\d{1,3}(?:(?:\.\d{3})+(?:,\d{1,2})?|(?:,\d{3})+(?:\.\d{1,2})?|(?:['’]\d{3})+(?:[.,]\d{1,2})?|(?:[    ]\d{3})+(?:[.,]\d{1,2})?)(?!\d)|(?<![\d.,'’])\d+(?:[.,]\d{1,2})?(?!\d)")
_SENTENCE = re.compile(r"(?<!\bTsd)(?<!\bFr)(?<!\bSFr)(?<!\bp)(?<!\bct)[.!?]\s+(?=[A-ZÄÖÜ•])|\n|;")


def amounts(text: str) -> Iterator[tuple[Decimal, int, int]]:
    """Numbers of a text with their places. A dot or comma before three digits groups thousands; before one or two it is a decimal sign."""
    for m in _NUMBER.finditer(text):
        raw = re.sub(r"['’\s   ]", "", m.group())
        grouped = re.fullmatch(r"(\d{1,3}(?:[.,]\d{3})+)(?:[.,](\d{1,2}))?", raw)
        if grouped:
            raw = re.sub(r"[.,]", "", grouped[1]) + (f".{grouped[2]}" if grouped[2] else "")
        yield Decimal(raw.replace(",", ".")), m.start(), m.end()


def _left(text: str, start: int) -> int:
    """Where the words before an amount begin: after a sign, a number, a line break or a wide gap."""
    i = start
    while i and text[i - 1] not in ".,;:!?\n" and not text[i - 1].isdigit() and not (text[i - 1].isspace() and text[i - 2 : i - 1].isspace()):
        i -= 1
    return i


def beside(text: str, amount: Decimal) -> Unit:
    """The unit stated next to this amount: in its sentence up to the next number, or before it back to a sign or number. The nearest word of a dimension counts."""
    found: dict[str, str | None] = {}
    for value, start, end in amounts(text):
        if value != amount:
            continue
        stop = _SENTENCE.search(text, end)
        after = text[end : stop.start() if stop else len(text)]
        after = re.split(r"\d", after, maxsplit=1)[0] if not re.match(r"\s*[x(]", after) else after
        unit = segment(after, "text")
        before = segment(text[_left(text, start) : start].strip(), "text")
        for name in ("currency", "period", "scale"):
            value_of = getattr(unit, name) or (getattr(before, name) if name != "period" else None)
            if value_of and not found.get(name):
                found[name] = value_of
    return Unit(found.get("currency"), found.get("period"), found.get("scale"))


def resolve(amount: float, currency: str | None, period: str | None, text: str | None) -> Unit:
    """The unit of an amount: what its fields state, and the text next to the amount where they leave something open."""
    a, b = segment(currency or "", "currency"), segment(period or "", "period")
    got = Unit(a.currency or b.currency, b.period or a.period, a.scale or b.scale)
    if text and not (got.currency and got.period and got.scale) and amount > 0:
        t = beside(text, Decimal(repr(float(amount))).normalize())
        got = Unit(got.currency or t.currency, got.period or t.period, got.scale or t.scale)
    return got


def to_common_unit(df: DataFrame, rates: DataFrame, key: str = "job_id", amount: str = "salary_min", currency: str = "salary_currency", period: str = "salary_period", text: str = "description") -> DataFrame:
    """Rows ``key, currency, period, scale, eur_per_year`` of every non-null amount; the last is null while currency or period stay open.

    Distribution: a filter pushed to the scan, four columns read, one Arrow pass, no shuffle. `rates` is a fixed table.
    """
    factors = {(r["unit_kind"], r["unit"]): Decimal(repr(r["factor"])) for r in collect_bounded(rates.select("unit_kind", "unit", "factor"), 1000, "the table of rates")}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, cur, per, txt = (batch.column(i).to_pylist() for i in range(5))
            out: list[tuple] = []
            for v, c, p, t in zip(values, cur, per, txt):
                u, eur = resolve(v, c, p, t), None
                parts = [factors.get(("currency", u.currency)), factors.get(("period", u.period)), factors.get(("scale", u.scale or "one"), Decimal(1))]
                if None not in parts and abs(v) < BEYOND:  # not for NaN
                    eur = int((Decimal(repr(float(v))) * parts[0] * parts[1] * parts[2]).quantize(Decimal(1), ROUND_HALF_UP))
                    eur = eur if abs(eur) < 1 << 63 else None
                out.append((u.currency, u.period, u.scale, eur))
            cols = [list(x) for x in zip(*out)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["key", "currency", "period", "scale", "eur_per_year"])

    rows = df.filter(F.col(amount).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(amount).cast("double").alias("v"), F.col(currency).alias("c"), F.col(period).alias("p"), F.col(text).alias("t"))
    return rows.mapInArrow(convert, "key string, currency string, period string, scale string, eur_per_year long").withColumnRenamed("key", key)
