import inspect
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import bpe, language, pii, pii_table, residue, toxic

ODD = [None, "", "   ", "a", "\x00\x01﻿", "🙂👨‍👩‍👧 ok", "x" * 30000, "word " * 20000, "Zeile\r\nzwei\n\n drei", "aaaaaaaaaaaa", "naïve façade ﬁ １２", "a", "a"]


# p8


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cäß'\n1.😀don't") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "n") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids
    sizes = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.select("doc_id", "text")).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_long_texts_share_batches():
    assert list(bpe.slices(["a" * 10, "b" * 10, None, "c"], most=40)) == [(0, 2), (2, 4)]
    assert list(bpe.slices([])) == []


# p6


@pytest.mark.parametrize("text", ["Als {{JOB_TITLE}} unterstützen Sie uns.", "Ihr Arbeitsort ist ${standort}.", "Wir bieten undefined Urlaubstage.", "404 – Seite nicht gefunden.", "You need to enable JavaScript to run this app.", "Lorem ipsum dolor sit amet", "Start date: <insert date>.", "Bewerben bei %%RECRUITER%%", "Stand: TT.MM.JJJJ", "Gehalt: $XX,XXX.", "ACCESS DENIED.", "__________ (bitte ausfüllen)", "Wir, die [FIRMENNAME], suchen", "Wir verwenden Cookies, um Inhalte zu personalisieren."])
def test_residue_is_found(spark, text):
    df = spark.createDataFrame([("a", "s", None, "Wir suchen dich.\n" + text), ("a", "s", None, "Wir suchen dich.\n" + text)], "job_id string, source string, location string, description string")
    assert [r["field_name"] for r in residue.residue(df).select("field_name").distinct().collect()] == ["description"]


@pytest.mark.parametrize("text", ["Sie pflegen die Fehlerseiten 404 und 500 unseres Webshops und prüfen, ob JavaScript aktiv ist.", "Die Schulung zum Thema Blindtext und Satz findet statt.", "Erfahrung mit Templates, Platzhaltern und Serienbriefen ist hilfreich.", "You make sure that our 404 pages and cookie banners work even when JavaScript is disabled.", "Former contact: [EMAIL REDACTED].", "Schreib an a.b{at}x.example.", "<p>Wir bieten <b>viel</b></p>", "Kenntnisse in JavaScript sind von Vorteil.", None, "", " "])
def test_content_is_kept(spark, text):
    df = spark.createDataFrame([("a", "s", "Remote", text), ("b", "t", "bundesweit", text)], "job_id string, source string, location string, description string")
    assert residue.residue(df).count() == 0 and residue.without_residue(df).filter("location is not null").count() == 2


def test_residue_locations_and_recurrence(spark):
    places = ["{{ort}}", "#NV", "Bitte wählen ...", "null", "[object Object]", "12345 Musterstadt", "Loading…", "Select location"]
    good = ["Bonn", "Europa", "nach Vereinbarung", "Südalb", None]
    df = spark.createDataFrame([(str(i), f"s{i % 2}", x, "Vorgang 12345 beendet.") for i, x in enumerate(places + good)], "job_id string, source string, location string, description string")
    out = residue.residue(df)
    assert {r["job_id"] for r in out.filter("field_name = 'location'").collect()} == {str(i) for i in range(len(places))}
    assert out.filter("field_name = 'description'").select("job_id").distinct().count() == len(places + good)  # a weak message that recurs across sources
    one = df.limit(2).withColumn("source", F.lit("s"))
    assert residue.residue(one).filter("field_name = 'description'").count() == 0
    assert residue.residue(df.limit(0)).count() == 0 and residue.recurring_messages(df).filter("kind = 'page_furniture'").count() >= 1


def test_recurring_pages_and_notices_need_no_listed_phrase(spark):
    """A page of several companies, and a notice within texts, that hold none of the listed phrases; honest repetition is kept."""
    page, notice, honest = "Ein Moment noch, gleich geht es los 17.", "Dieses Fenster wird nach erneutem Klicken im Browser angezeigt 5.", "Wir freuen uns auf dich und deine Ideen."
    rows = [(f"p{i}", f"s{i % 5}", f"Firma {i % 9}", None, page.replace("17", str(i))) for i in range(100)]
    rows += [(f"n{i}", f"s{i % 5}", f"Firma {i % 9}", None, f"Wir suchen {chr(97 + i % 26) * (2 + i // 26)}.\n{notice.replace('5', str(i))}\n{honest}") for i in range(100)]
    rows += [(f"x{i}", f"s{i % 5}", "Kreuz & Quer AG" if i % 2 else "KREUZ  & QUER AG", None, "Dieselbe Anzeige auf vielen Seiten.") for i in range(20)]  # one company's advert on several boards
    rows += [("one", "s1", "Firma 1", None, "Ganz ruhig bleiben.")] * 5  # redelivered
    df = spark.createDataFrame(rows, "job_id string, source string, company string, location string, description string")
    out = {r["job_id"]: r["kind"] for r in residue.residue(df).collect()}
    assert set(out) == {f"{k}{i}" for k in "pn" for i in range(100)}
    assert out["p3"] == "repeated_page" and out["n3"] == "page_furniture"
    assert {"repeated_page", "page_furniture"} <= {r["kind"] for r in residue.recurring_messages(df).collect()}


def test_long_placeholders_are_residue(spark):
    df = spark.createDataFrame([("a", "s", None, "Wir sind {{" + "x" * 5000 + "}} und mehr")], "job_id string, source string, location string, description string")
    assert [r["kind"] for r in residue.residue(df).collect()] == ["placeholder"]


# p4


def test_label_notations(spark):
    labels = ["de", "German", "de-DE", "DEU", "ger", "en_GB", "pol", "und", "", None, "xx", "français"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(language.language_of_label(language.F.col("l"))).collect()]
    assert got == ["de", "de", "de", "de", "de", "en", "pl", None, None, None, None, "fr"]


def test_paragraph_languages(spark):
    de, en = "Wir suchen dich und die Kollegen für unser Team mit Python und Scrum.", "We are looking for you and the team will work with our customers."
    fr, nl, pl = "Vous avez une expérience avec nous et vous aimez les clients.", "Wij zijn op zoek naar een collega voor ons team.", "Szukamy osoby do pracy w naszym zespole i na hali oraz z klientami."
    rows = [("1", "s", "https://a.example/1", f"{de}\n\n{en}\r\n {fr}"), ("1", "s", "https://a.example/1", f"{de}\n\n{en}\r\n {fr}"), ("2", "s", None, f"{nl}\n{pl}"), ("3", "t", "bad url", None), ("4", None, "https://b.example", " \n "), (None, "s", None, de)]
    jobs = spark.createDataFrame([(*r, "x") for r in rows], "job_id string, source string, source_url string, description string, stated string")
    man = spark.createDataFrame([("1", "German"), ("2", None), ("9", "de"), ("1", "German")], "job_id string, heuristic_language string")
    gold = spark.createDataFrame([("1", "en")], "job_id string, primary_language string")
    got = {(r["label_table"], r["job_id"], r["para_no"], r["lang"]) for r in language.wrong_labels(jobs, man, gold).collect()}
    assert got == {("manifest", "1", 2, "en"), ("manifest", "1", 3, "fr"), ("manifest", "2", 1, "nl"), ("manifest", "2", 2, "pl"), ("skill_gold_v1", "1", 1, "de"), ("skill_gold_v1", "1", 3, "fr")}
    every = language.all_paragraphs(jobs, man, gold).collect()
    assert len(every) == 5 and all(0 < r["confidence"] <= 1 for r in every)
    assert language.wrong_labels(jobs.limit(0), man, gold).count() == 0


def test_markup_and_suffix_decide_where_the_text_says_nothing(spark):
    jobs = spark.createDataFrame([("1", "s", "https://x.pl/1", "12345"), ("2", "s", "https://x.example/1", '<p lang="fr">12345</p>')], "job_id string, source string, source_url string, description string")
    man = spark.createDataFrame([("1", None), ("2", None)], "job_id string, heuristic_language string")
    got = {r["job_id"]: r["lang"] for r in language.wrong_labels(jobs, man, spark.createDataFrame([], "job_id string, primary_language string")).collect()}
    assert got == {"1": "pl", "2": "fr"}


# p1


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_held_out_rows(model):
    """F1 of counts per kind on rows of the table's kind that the model has not seen."""
    hit = made = wanted = 0
    rows = pii_table.rows(copies=2, plain=1, seed=99)
    found = dict(pii.items(model, [t for t, _ in rows]))
    for i, (_, spans) in enumerate(rows):
        for kind in pii.KINDS:
            a, b = sum(k == kind for _, _, k in found.get(i, [])), sum(k == kind for _, _, k in spans)
            hit, made, wanted = hit + min(a, b), made + a, wanted + b
    assert 2 * hit / (made + wanted) > 0.93


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(4, 4)).astype(np.float32)
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 1, 4)).astype(np.float32)
        got = pii._viterbi(e, moves, np.array([n]))[:, 0]
        score = lambda y: sum(e[t, 0, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        best = max(np.ndindex(*(4,) * n), key=score)
        assert tuple(got) == best


def test_expectations_are_gradients():
    rng = np.random.default_rng(2)
    e, moves = rng.normal(size=(1, 3, 3)), rng.normal(size=(3, 3))
    y, mask = np.array([[0, 2, 1]]), np.ones((1, 3), bool)

    def loss(e, m):
        paths = {p: sum(e[0, t, p[t]] for t in range(3)) + m[p[0], p[1]] + m[p[1], p[2]] for p in np.ndindex(3, 3, 3)}
        return np.log(sum(np.exp(v) for v in paths.values())) - paths[0, 2, 1]

    g_e, g_m = pii._expectations(e, moves, y, mask)
    for t, k in np.ndindex(3, 3):
        up = e.copy()
        up[0, t, k] += 1e-5
        assert abs((loss(up, moves) - loss(e, moves)) / 1e-5 - g_e[0, t, k]) < 1e-3
    for a, b in np.ndindex(3, 3):
        up = moves.copy()
        up[a, b] += 1e-5
        assert abs((loss(e, up) - loss(e, moves)) / 1e-5 - g_m[a, b]) < 1e-3


def test_redaction(spark, model):
    text = "Wir suchen dich.\nKontakt: Frau Svenja Berghold, s.berghold@firma.example, Tel. 030 23125723.\nFolgen Sie uns unter @firma_karriere."
    rows = [("1", text, None, ""), ("1", text, None, ""), ("2", None, "x " * 20000, "\x00"), (None, text, None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "job_id string, description string, requirements string, benefits string, kind string")
    pii.trained.cache_clear()
    got = sorted(tuple(r) for r in pii.find_items(df).collect())
    assert ("1", "description", "email", 1) in got and ("1", "description", "phone", 1) in got and ("1", "description", "person_name", 1) in got
    assert len(got) == len(set(got)) and all(g[0] == "1" for g in got)
    out = {r["job_id"]: r for r in pii.redact(df).collect()}
    assert out["1"]["description"].startswith("Wir suchen dich.\nKontakt: ") and "[EMAIL]" in out["1"]["description"] and out["1"]["description"].endswith("@firma_karriere.")
    assert out["2"]["description"] is None and out["2"]["requirements"] == "x " * 20000 and out["2"]["kind"] == "z"
    assert pii.find_items(df.limit(0)).count() == 0


def test_the_model_takes_no_corpus():
    """No prefix of corpus fragments trains the model: it is fitted on the labelled table alone, at every size."""
    assert not inspect.signature(pii.trained).parameters and not hasattr(pii, "plain_fragments")


def test_a_contact_name_in_a_third_of_the_rows(spark, model):
    """One contact signs every third posting: each mention is found and redacted, in every field."""
    tasks = ["planen", "prüfen", "bauen", "messen", "liefern", "buchen", "testen", "montieren"]
    rows = []
    for i in range(90):
        text = f"Wir suchen dich für Auftrag {i}. Du wirst {tasks[i % 8]} und {tasks[i // 8 % 8]}."
        sign = "\nIhre Ansprechpartnerin ist Frau Svenja Berghold." if i % 3 == 0 else ""
        rows.append((str(i), text + sign, "Kontakt: Frau Svenja Berghold" if i % 3 == 0 else None, None))
    df = spark.createDataFrame(rows, "job_id string, description string, requirements string, benefits string")
    signed = {str(i) for i in range(0, 90, 3)}
    found = {(r["job_id"], r["field_name"]) for r in pii.find_items(df).filter("kind = 'person_name'").collect()}
    assert found == {(j, f) for j in signed for f in ("description", "requirements")}
    for r in pii.redact(df).collect():
        assert "Berghold" not in r["description"] + (r["requirements"] or "")


def test_a_very_long_line_needs_no_more_memory_than_its_own(model):
    """The batch of a line of 100,000 tokens beside 2,047 short ones is cut by cells."""
    import tracemalloc

    long = "Wir suchen dich und das Team " * 16_700 + "Kontakt: Bao Berg, bao@berg.example."
    lines = [pii._TOKEN.findall(t) for t in [long] + ["Rückfragen: 030 123 45 67"] * 2047]
    assert len(lines[0]) > 100_000
    tracemalloc.start()
    found = model.decode(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and found[0] is not None and all(y is not None for y in found)


def test_settled_kinds():
    assert pii.plausible("id_number", "ID card OJ6LRWRTX") and pii.plausible("id_number", "passport no. UY1 YMR GLZ") and not pii.plausible("id_number", "Personalausweis")
    assert pii.plausible("email", "a.b (at) c dot example") and not pii.plausible("email", "unter @firma_jobs")
    kinds = lambda t, k: [x[2] for x in pii.settle(t, 0, len(t), k)]
    assert kinds("756.0000.5560.24", "phone") == ["id_number"] and kinds("0174.9091.317", "id_number") == ["phone"]
    assert kinds("Bao Berg und Prof. Dr. Veit Tal", "person_name") == ["person_name"] * 2
    assert kinds("Gartenstraße", "street_address") == [] and kinds("[EMAIL REDACTED]", "email") == []


def test_every_placeholder_rule_passes_the_prefilter():
    """One sample per alternative, in the order of PLACEHOLDERS: the rule meets it, and so does the search for signs."""
    samples = (
        ("{{name}}",), ("{% if x %}",), ("<% x %>",), ("${x}",), ("{job.title}",), ("%%NAME%%",), ("%NAME%",), ("__NAME__",), ("______",), ("#NAME#",), ("#REF!", "#NV", "#N/A", "#NAME?", "#VALUE!", "#WERT!", "#DIV/0!"), ("[object Object]",), ("[FIRMA]",), ("[ort]",), ("(bitte einfügen)", "[insert text]", "(fill in)", "(replace me)", "(to be completed)", "[hier ausfüllen]", "[ergänzen]", "[eintragen]", "[einsetzen]"), ("<stadt>",), ("<ORTE> <FIRMA>",), ("XX,XX EUR", "XX,XXX", "XXXX", "xxxxx"), ("XYZ GmbH",), ("TT.MM.JJJJ", "dd.mm.yyyy", "dd/mm/yyyy", "dd-mm-yyyy"), ("city_placeholder",), ("TODO: x",), ("undefined",), ("location.name",),
    )
    assert len(samples) == len(residue.PLACEHOLDERS)
    for pattern, texts in zip(residue.PLACEHOLDERS, samples):
        for t in texts:
            assert re.search(pattern, t) and residue.holds_sign(t.lower()), (pattern, t)


def test_recurrence_counts_keys(spark):
    """A posting delivered three times does not recur; three postings of two sources do."""
    again = [("1", s, None, "Weiterlesen") for s in ("a", "b", "b")]
    others = [(k, s, None, "Nach oben") for k, s in (("2", "a"), ("3", "b"), ("4", "b"))]
    df = spark.createDataFrame(again + others, "job_id string, source string, location string, description string")
    assert {r["job_id"] for r in residue.residue(df).collect()} == {"2", "3", "4"}
    assert [(r["example"], r["n_rows"]) for r in residue.recurring_messages(df).collect()] == [("Nach oben", 3)]


# p10


def test_disguises():
    assert toxic.normalise("Du P e n n e r, Trоttellll!") == "du penner, trotel!" or toxic.normalise("Du P e n n e r") == "du penner"
    assert toxic.normalise("Dr​ecksack") == "drecksack" and toxic.normalise("v.o.l.l.i.d") == "vollid"
    a, b, c = toxic.features(["p3nn3r", "penner", "du p3nn3r du"])
    assert set(a) & set(b) and set(a) < set(c)
    assert [len(x) for x in toxic.features(["", "a a a a", "..."])] == [0, 3, 0] and toxic.features([]) == []


def test_nonnegative_risk_learns_from_positive_and_unlabelled():
    rng = np.random.default_rng(3)
    pos = [np.unique(np.r_[rng.integers(0, 50, 5), rng.integers(1000, 1010, 3)]) for _ in range(60)]
    neg = [np.unique(rng.integers(0, 50, 8)) for _ in range(900)]
    hidden = [np.unique(np.r_[rng.integers(0, 50, 5), rng.integers(1000, 1010, 3)]) for _ in range(40)]
    w, b = toxic.fit_nnpu(toxic.Rows(pos), toxic.Rows(neg + hidden), 0.04)
    s = lambda x: w[x].sum() / len(x) ** 0.5 + b
    assert min(map(s, hidden)) > max(map(s, neg))


def test_scores_and_rates(spark):
    bad, good = "Du bist ein dummer Idiot, verpiss dich!", "Das Team ist nett und die Kantine gut."
    texts = [bad, good, None, "", "  ", bad, "Die Einarbeitung dauert drei Wochen. " * 3000] + [f"{good} Abteilung {i} sucht Leute." for i in range(40)]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(0, "r", "Abusive "), (0, "r", "abusive"), (1, "r", "none"), (7, "r", "none"), (99, "r", "hateful"), (None, "r", "none")], "doc_id long, rater string, label string")
    assert {r["doc_id"] for r in toxic.found(docs, labels).collect()} == {0, 5}
    s = {r["doc_id"]: r["score"] for r in toxic.scored(docs, toxic.fitted(docs, labels)).collect()}
    assert len(s) == len(texts) and s[0] == s[5] and s[2] == s[3] == s[4] == 0.0
    assert {r["source"]: (r["n_docs"], r["n_toxic"]) for r in toxic.rates(docs, labels).collect()} == {"s0": (24, 1), "s1": (23, 1)}
    assert toxic.found(docs.limit(0), labels).count() == 0 and toxic.found(docs, labels.limit(0)).count() == 2


def test_majority_and_ties(spark):
    labels = spark.createDataFrame([(1, "a", "none"), (1, "b", "abusive"), (2, "a", "none"), (2, "b", "none"), (2, "c", "sexual"), (3, "a", None)], "doc_id long, rater string, label string")
    assert {r["doc_id"]: r["toxic"] for r in toxic.confirmed_ids(labels).collect()} == {1: True, 2: False}
