"""Template residue, filler, error pages and script notices in text fields.

Texts are cut into messages (lines and sentences); addresses, dates and numbers are masked, and equal normalised messages
are grouped by hash with the number of postings, sources and companies. So are whole texts. What a group is, rules say:

- it recurs widely (in WIDELY postings of more than one source) and holds a weak phrase, or two words of pages and their
  machinery: page furniture;
- it is the whole text of postings of several sources and at least WIDELY companies: a repeated page, whatever it says;
- a placeholder or phrase rule that is residue wherever it stands decides a message alone: the second way, documented here,
  because an unfilled field needs no second posting to be one.

A field is residue as soon as it holds one such message. One Arrow pass reads the texts and writes what any rule could
judge: the hash of each whole text and the messages with a sign (one automaton pass finds those), a few bytes each. Groups
and rows are both made from that table; texts are not shuffled.

Defined cases: null, empty and blank fields are never residue; marks of an earlier redaction, vague places and sentences
about web pages or templates are content; repeated rows count once (by key); texts of any length are read whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.session import written_table

try:
    import ahocorasick
except ImportError:  # each sign is looked for by itself then
    ahocorasick = None

#: Unfilled placeholders: patterns on the message as it stands. None has a bound of length.
PLACEHOLDERS = (
    r"\{\{[^{}]*\}\}",
    r"\{%[^{}]*%\}",
    r"<%[^<>]*%>",
    r"\$\{[^{}]*\}",
    r"\{(?!(?i:at|ät|dot|punkt|a)\})[A-Za-z]+(?:[._][A-Za-z]+)+\}",
    r"%%[A-Za-z_]{2,}%%",
    r"(?<!\d)%[A-Z_]{3,}%",
    r"__[A-Z_]{2,}__",
    r"_{6,}",
    r"#[A-Z]{3,}(?:_\d+)?#",
    r"#(?:REF!|NV\b|N/A\b|NAME\?|VALUE!|WERT!|DIV/0!)",
    r"(?i:\[object object\])",
    r"\[(?![A-Z ]*(?:REDACTED|REMOVED|ENTFERNT|GELÖSCHT|MASKED|ANONYM)|EMAIL|PHONE|NAME\])[A-ZÄÖÜ][A-ZÄÖÜ _-]{2,}\]",
    r"(?i:\[(?:ort|standort|stadt|firma|firmenname|abteilung|name|datum|titel|position|location|city|company|date)(?: [^\]]*)?\])",
    r"(?i:[\[<(][^\[\]<>()]*(?:einfügen|einsetzen|ausfüllen|ergänzen|eintragen|insert |insert\b|replace me|fill in|to be completed)[^\[\]<>()]*[\]>)])",
    r"(?i:<(?:stadt|ort|firma|titel|aufgaben|profil|angebot|datum|city|company|date|location|position)>)",
    r"(?:<[A-ZÄÖÜ]{4,}> ?){2,}",
    r"[$€]?\bX{2,},X{2,}\b|\bX{4,}\b|\bx{5,}\b",
    r"\bXYZ (?:GmbH|AG|KG|SE|Ltd|Inc)\b",
    r"(?i:\btt\.mm\.jjjj\b|\bdd[./-]mm[./-]yyyy\b)",
    r"(?i:\b[a-z]+_placeholder\b)",
    r"(?i:\btodo\s*:)",
    r"(?i:\bundefined\b(?! behaviou?r))",
    r"(?i:\blocation\.name\b)",
)
#: Phrases of filler, error pages, script notices and page furniture: (kind, pattern on the lower-case message).
PHRASES = (
    ("filler", r"lorem ipsum|dolor sit amet|dies ist ein blindtext|blindtext nummer|hier steht später|beschreibung folgt in kürze|platzhalter bitte nicht|bitte ersetzen sie diesen|\(replace me\)|test test test|asdf|\bmuster(?:firma|stadt|mann|straße|strasse)\b|- aufgabe \d+ - aufgabe|abschnitt \d+: ?text\b|text to follow|section to follow|placeholder text|sample text only|hier folgt der abschnitt|text folgt\b"),
    ("error_page", r"seite nicht gefunden|page not found|\b40[0-9]\b\W{0,3}(?:not found|forbidden|unauthorized|bad request|seite)|\bnot found\b.*\b404\b|internal server error|service unavailable|bad gateway|gateway time-?out|too many requests|access denied|zugriff verweigert|permission to view this page|unable to complete your request|konnte ihre anfrage nicht verarbeiten|ist ein fehler aufgetreten|da ist etwas schiefgelaufen|something went wrong|http status \d|fehler \d+:|fehlercode:|traceback|keyerror|template nicht gefunden|existiert nicht mehr|nicht mehr verfügbar|no longer available|sitzung ist abgelaufen|session (?:has )?expired|http error"),
    ("script_notice", r"enable javascript|javascript (?:in ihrem browser )?aktivieren|aktivieren sie (?:bitte )?javascript|javascript eingeschaltet sein|javascript (?:is|must be|to be) (?:required|enabled|turned on)|enable scripts|diese seite benötigt skripte|browser wird (?:überprüft|nicht unterstützt)|browser is not supported|checking your browser|kein roboter sind|not a robot|verify (?:that )?you are human|sie sind ausgeschaltet|requires javascript"),
    ("page_furniture", r"wird geladen|\bloading ?(?:…|\.\.\.)|be among the first to apply|jetzt als erste bewerben|zu den ersten, die sich bewerben|\bselect location|bitte (?:aus)?wählen|please select|mehr anzeigen|show more\b|anmelden, um den ort|cookies? akzeptieren|accept (?:all )?cookies|verwenden cookies|we use cookies|einwilligung erforderlich|consent required|alle akzeptieren|nur notwendige|merken teilen|teilen drucken|bitte einloggen|kostenlos registrieren|log in to (?:read|see|view)|melden sie sich erneut an|datenschutz impressum|ähnliche stellen finden sie|zurück zur startseite|sign in to see"),
)
#: Words that are residue only as a whole location.
WHOLE_VALUES = r"(?i)^\W*(?:null|nan|none|n/?a|nil|undefined|test|asdf|tbd|xxx+|404(?: not found)?|javascript aktivieren|loading|wird geladen)\W*$"
#: Weak phrases: residue where the same message recurs widely.
WEAK = r"request id: \d|reference #\d|\bray \d{4,}|vorgang \d{4,}|prüfnummer \d{4,}|weiterlesen|read more|nach oben|back to top|newsletter"
#: Words of pages and their machinery; a message with two of them is residue where it recurs widely, whatever its wording.
CUES = (
    "seite", "page", "browser", "server", "cookie", "javascript", "login", "einloggen", "anmelden", "passwor", "konto", "account", "sitzung", "session", "laden", "loading", "refresh", "aktualisieren", "klicken", "click", "fehler", "error", "anfrage", "request", "captcha", "verbindung", "connection", "timeout", "zugriff", "access",
    "nicht verfügbar", "unavailable", "abgelaufen", "expired", "inhalt", "content", "angezeigt", "anzuzeigen", "displayed", "gesperrt", "blocked", "werbeblocker", "ad blocker", "erneut", "try again", "gelöscht", "removed", "deaktiviert", "disabled", "aktivieren", "enable", "datenschutz", "privacy", "impressum", "navigation",
)
#: Widely: in at least so many postings, of more than one source.
WIDELY = 3
#: Content that talks about pages, scripts or templates: someone's task, knowledge or training.
ABOUT = r"(?i)\b(?:sie|du|ihr|you) (?:pfleg|prüf|betreu|entwickel|programmier|test|gestalte|schreib|maintain|check|build|make sure|write|design|look after)|kenntnisse|erfahrung mit|knowledge of|experience with|familiar with|schulung|lehrgang|training on|course on"

#: Every rule needs one of these in the lower-case text. Looking for them first keeps the patterns off ordinary texts.
SIGNS = ("{", "<", "%", "__", "#", "[", "xxx", "xx,xx", "xyz ", "tt.mm.", "dd.mm", "dd/mm", "dd-mm", "_placeholder", "todo", "undefined", "location.name", "einfügen", "einsetzen", "ausfüllen", "ergänzen", "eintragen", "insert", "fill in", "to be completed")
LITERALS = (
    "lorem", "dolor sit", "blindtext", "hier steht später", "beschreibung folgt", "platzhalter bitte", "bitte ersetzen", "replace me", "test test", "asdf", "musterfirma", "musterstadt", "mustermann", "musterstra", "- aufgabe", "abschnitt", "to follow", "placeholder text", "sample text", "folgt der abschnitt", "text folgt",
    "nicht gefunden", "not found", "forbidden", "unauthorized", "bad request", "seite", "server error", "http error", "unavailable", "gateway", "too many", "access denied", "zugriff verw", "permission to", "unable to complete", "nicht verarbeiten", "fehler", "schiefgelaufen", "went wrong", "http status", "traceback", "keyerror", "existiert nicht", "nicht mehr verf", "no longer", "abgelaufen", "expired",
    "javascript", "scripts", "skripte", "browser", "roboter", "robot", "you are human", "ausgeschaltet", "wird geladen", "loading", "be among the", "als erste", "den ersten", "select location", "wählen", "please select", "mehr anzeigen", "show more", "anmelden", "cookie", "einwilligung", "consent", "alle akzeptieren", "nur notwendige", "merken teilen", "teilen drucken", "einloggen", "registrieren", "log in to", "melden sie sich", "datenschutz", "ähnliche stellen", "sign in to", "request id", "reference #", "ray ", "vorgang ", "prüfnummer", "weiterlesen", "read more", "nach oben", "back to top", "newsletter",
)
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
_PHRASES = tuple((kind, re.compile(pattern)) for kind, pattern in PHRASES)
_WHOLE, _WEAK, _ABOUT = re.compile(WHOLE_VALUES), re.compile(WEAK), re.compile(ABOUT)
_BREAK = re.compile(r"[\n\r]+|(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-ÞĀ-Ž\[{<$%#_•])")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.]+")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}")
_NUMBER = re.compile(r"\d+(?:[.,:-]\d+)*")
#: What a message is by itself: nothing, residue of a kind, or residue of a kind if it recurs widely.
KINDS = ("", "placeholder", *[k for k, _ in PHRASES])
RECURRING = len(KINDS)
#: Messages whose verdicts a worker remembers.
REMEMBERED = 200_000


@lru_cache(maxsize=1)
def _automaton():
    found = ahocorasick.Automaton()
    for w in dict.fromkeys(SIGNS + LITERALS):
        found.add_word(w, True)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _cues():
    found = ahocorasick.Automaton()
    for w in CUES:
        found.add_word(w, w)
    found.make_automaton()
    return found


def holds_sign(low: str) -> bool:
    """Whether the lower-case text holds a sign or literal: one pass of an Aho-Corasick automaton that ends at the first."""
    if ahocorasick is None:
        return any(w in low for w in SIGNS + LITERALS)
    return next(_automaton().iter(low), None) is not None


def cues_of(low: str) -> set[str]:
    """The words of pages that stand in the lower-case message."""
    if ahocorasick is None:
        return {w for w in CUES if w in low}
    return {w for _, w in _cues().iter(low)}


def normalised(text: str) -> str:
    """Lower case, with addresses, dates and numbers masked and white space collapsed."""
    s = text.lower()
    if "@" in s or "://" in s or "www." in s:
        s = _ADDRESS.sub("<addr>", s)
    return " ".join(_NUMBER.sub("0", _DATE.sub("<date>", s)).split())


def digest(text: str) -> int:
    """A 64-bit hash of the normalised text."""
    return int.from_bytes(hashlib.blake2b(normalised(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def verdict(message: str, whole: bool = False) -> int:
    """An index of KINDS, or RECURRING if the message is residue where it recurs widely; `whole` for values of short fields."""
    if _PLACEHOLDER.search(message) or whole and _WHOLE.search(message):
        return 1
    low = message.lower()
    if _ABOUT.search(low):
        return 0
    for i, (_, pattern) in enumerate(_PHRASES, 2):
        if pattern.search(low):
            return i
    return RECURRING if _WEAK.search(low) or len(cues_of(low)) >= 2 else 0


def judged(df: DataFrame, key: str, source: str, company: str | None, fields: tuple[str, ...], examples: bool = False) -> DataFrame:
    """``key, source, company, field_name, hash, verdict, page`` (and ``message``): what any rule could judge.

    `page` marks the hash of a whole text; locations are values, which recur honestly, and have none.
    """
    short = tuple(f == "location" for f in fields)
    maker = F.col(company) if company and company in df.columns else F.lit(None).cast("string")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(source).alias("source"), F.regexp_replace(F.lower(maker), r"[^\p{L}\p{N}]+", "").alias("company"), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], tuple[int, int]] = {}
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, field in enumerate(fields):
                for r, text in enumerate(batch.column(3 + i).to_pylist()):
                    if not text or text.isspace():
                        continue
                    if not short[i]:
                        at.append(r)
                        out.append((field, digest(text), 0, True, text if examples else None))
                    if not (short[i] or holds_sign(text.lower()) or len(cues_of(text.lower())) >= 2):
                        continue
                    if len(known) > REMEMBERED:
                        known.clear()
                    found = set()
                    for m in (text,) if short[i] else _BREAK.split(text):
                        if (m, short[i]) not in known:
                            v = verdict(m, short[i])
                            known[m, short[i]] = (v, digest(m) if v else 0)
                        v, h = known[m, short[i]]
                        if v and (h, v) not in found:
                            found.add((h, v))
                            at.append(r)
                            out.append((field, h, v, False, m if examples else None))
            take = pa.array(at, pa.int64())
            cols = list(zip(*out)) or [[], [], [], [], []]
            arrays = [*[batch.column(i).take(take) for i in range(3)], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())]
            names = ["key", "source", "company", "field_name", "hash", "verdict", "page", "message"]
            yield pa.RecordBatch.from_arrays(arrays[: 8 if examples else 7], names[: 8 if examples else 7])

    return rows.mapInArrow(run, "key string, source string, company string, field_name string, hash bigint, verdict int, page boolean" + (", message string" if examples else ""))


def groups(rows: DataFrame) -> DataFrame:
    """``page, hash, n_rows, across, n_companies, verdict`` of equal normalised messages and equal whole texts; a posting counts once."""
    one = [F.count_distinct("key").alias("n_rows"), (F.min("source") != F.max("source")).alias("across"), F.count_distinct("company").alias("n_companies"), F.max("verdict").alias("verdict")]
    return rows.groupBy("page", "hash").agg(*one, *([F.min("message").alias("example")] if "message" in rows.columns else []))


def kind_of() -> Column:
    """The kind of a group, null for content."""
    widely = (F.col("n_rows") >= WIDELY) & F.coalesce("across", F.lit(False))
    kinds = F.when(F.col("page") & widely & (F.col("n_companies") >= WIDELY), "repeated_page").when((F.col("verdict") == RECURRING) & widely, "page_furniture")
    for i, kind in enumerate(KINDS[1:], 1):
        kinds = kinds.when(F.col("verdict") == i, kind)
    return kinds


def residue(df: DataFrame, key: str = "job_id", source: str = "source", fields: tuple[str, ...] = ("location", "description"), company: str | None = "company") -> DataFrame:
    """``key, field_name, kind`` of every residue message, distinct."""
    rows = written_table(judged(df, key, source, company, fields), "messages")
    # groups of one posting say nothing about recurrence: they leave before the join
    open_ = rows.filter(F.col("page") | (F.col("verdict") == RECURRING))
    wide = groups(open_).withColumn("kind", kind_of()).filter("kind is not null").select("page", "hash", "kind")
    alone = rows.filter((F.col("verdict") > 0) & (F.col("verdict") < RECURRING)).select("key", "field_name", F.element_at(F.array(*map(F.lit, KINDS)), F.col("verdict") + 1).alias("kind"))
    shared = open_.join(wide, ["page", "hash"]).select("key", "field_name", "kind")
    return alone.unionByName(shared).distinct().withColumnRenamed("key", key)


def recurring_messages(df: DataFrame, key: str = "job_id", source: str = "source", fields: tuple[str, ...] = ("location", "description"), company: str | None = "company") -> DataFrame:
    """``kind, example, n_rows, across`` of every group of equal residue messages, and of repeated pages."""
    g = groups(judged(df, key, source, company, fields, examples=True)).withColumn("kind", kind_of())
    return g.filter("kind is not null").select("kind", "example", "n_rows", F.coalesce("across", F.lit(False)).alias("across"))


def without_residue(df: DataFrame, key: str = "job_id", source: str = "source", fields: tuple[str, ...] = ("location", "description"), company: str | None = "company") -> DataFrame:
    """The rows with residue fields set to null."""
    bad = residue(df, key, source, fields, company).groupBy(key).agg(F.collect_set("field_name").alias("_bad"))
    out = df.join(bad, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(F.array_contains("_bad", f), F.lit(False)), None).otherwise(F.col(f)))
    return out.drop("_bad")
