"""Text expressions: cleaning, redaction, tokens, dates, language guess. All run in the JVM but `unescape`."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Patterns whose results must agree with the reports they are compared with (fixed values).
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
EMAIL_RESIDUAL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+49|0049|0)(?:[\s()./-]*\d){7,12}"
TAG = r"<[^>]{1,300}>"
SPACE = r"[\s\p{Z}]+"
WORDS = r"[a-zäöüß]+"
#: Function words of the language guess (fixed values).
GERMAN = ("und", "der", "die", "das", "mit", "für", "von", "sie", "wir", "ihre", "oder", "ein")
ENGLISH = ("and", "the", "with", "for", "you", "we", "your", "or", "of", "to", "a", "our")
GUESS_PREFIX = 1500


def unescape(value: Column) -> Column:
    """The full HTML5 entity table, in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)

    return pandas_udf(run, "string")(value)


def clean(value: Column) -> Column:
    """Entities resolved (all of HTML5; only values with an ampersand go to Python), then tags replaced by blanks, white space collapsed, trimmed; empty becomes null."""
    s = value.cast("string")
    s = F.coalesce(unescape(F.when(s.contains("&"), s)), s)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, TAG, " "), SPACE, " "))
    return F.nullif(s, F.lit(""))


def redact(text: Column) -> Column:
    """Mail addresses, then phone numbers, replaced by their marks."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL REDACTED]"), PHONE, "[PHONE REDACTED]")


def redaction_counts(text: Column) -> tuple[Column, Column]:
    """Numbers of mail addresses and of phone numbers, the latter after the mail addresses are gone; 0 for null."""
    mails = F.coalesce(F.regexp_count(text, F.lit(EMAIL)), F.lit(0))
    phones = F.coalesce(F.regexp_count(F.regexp_replace(text, EMAIL, "[EMAIL REDACTED]"), F.lit(PHONE)), F.lit(0))
    return mails, phones


def fold(text: Column) -> Column:
    """Lower case with ss for ß: case folding for German and English."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Words, and single signs, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def parse_date(text: Column) -> Column:
    """ISO, day.month.year, or year/month/day (also yyyymmdd); null if none fits."""
    s = F.trim(text)
    date = lambda pattern, fmt: F.when(s.rlike(pattern), F.to_date(F.try_to_timestamp(s, F.lit(fmt))))
    return F.coalesce(date(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), date(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), date(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), date(r"^\d{8}$", "yyyyMMdd"))


def guess_language(text: Column) -> Column:
    """de if more German than English function words stand in the first 1,500 characters, else en. A guess for sampling, not a label."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, GUESS_PREFIX)), F.lit(WORDS), F.lit(0))
    n = lambda these: F.size(F.filter(words, lambda w: w.isin(*these)))
    return F.when(n(GERMAN) > n(ENGLISH), "de").otherwise("en")


def first_location(about: Column) -> Column:
    """A location given as a JSON list (its first entry), a JSON object (location or city), or text that is no JSON; other JSON gives null."""
    s = F.trim(about)
    scalar = s.rlike(r'^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity|"[^"\\]*")$')
    whole = lambda a, b: s.startswith(a) & s.endswith(b) & F.try_parse_json(s).isNotNull()
    named = F.coalesce(F.get_json_object(s, "$.location"), F.get_json_object(s, "$.city"))
    return F.when(whole("[", "]"), F.get_json_object(s, "$[0]")).when(whole("{", "}"), named).when(~scalar, about)
