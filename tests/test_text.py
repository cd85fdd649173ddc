import re

from pyspark.sql import functions as F

from stellwerk.functions import ids, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_clean_unescapes_before_removing_tags(spark):
    assert one(spark, " A &amp; B&lt;b&gt;x&lt;/b&gt;  <i>y</i> z ", text.clean) == "A & B x y z"
    assert one(spark, "&lt;p&gt; ", text.clean) is None
    assert one(spark, None, text.clean) is None
    assert one(spark, "caf&eacute; &amp;lt;", text.clean) == "café &lt;"
    assert one(spark, "&amp;lt;", text.clean) == "&lt;"


def test_redaction_order_and_counts(spark):
    v = "Mail a.b@example.org or call +49 30 1234567 now"
    assert one(spark, v, text.redact) == "Mail [EMAIL REDACTED] or call [PHONE REDACTED] now"
    r = spark.createDataFrame([(v,), (None,)], "v string").select(*[c.alias(n) for n, c in zip("ab", text.redaction_counts(F.col("v")))]).collect()
    assert [tuple(x) for x in r] == [(1, 1), (0, 0)]


def test_dates(spark):
    for v, want in (("2023-05-04", "2023-05-04"), ("4.5.2023", "2023-05-04"), ("2023/5/4", "2023-05-04"), ("20230504", "2023-05-04"), ("2023-13-40", None), ("soon", None), (None, None)):
        got = one(spark, v, text.parse_date)
        assert (str(got) if got else None) == want


def test_tokens_are_those_of_unicode_python(spark):
    v = "C++ für ASP.NET, 3D-Größe naïve_x – ✓ 日本語"
    assert one(spark, v, text.tokens) == re.findall(r"\w+|[^\w\s]", v)


def test_location_forms(spark):
    for v, want in (('["Hamburg"]', "Hamburg"), ('{"city": "Kiel"}', "Kiel"), ("Bonn", "Bonn"), ("[Ort einfügen]", "[Ort einfügen]"), ("[]", None), ("30724", None), ("30724 Bonn", "30724 Bonn"), (None, None)):
        assert one(spark, v, text.first_location) == want


def test_language_guess(spark):
    assert one(spark, "Wir suchen dich und die Kollegen mit Freude", text.guess_language) == "de"
    assert one(spark, "we are looking for you and the team", text.guess_language) == "en"
    assert one(spark, "", text.guess_language) == "en"


def test_ids(spark):
    import hashlib

    url = "https://example.test/Job/1"
    df = spark.createDataFrame([(url, "T", None, "L", None), (None, "T", None, "L", None)], "u string, t string, c string, l string, d string")
    content = ids.content_hash(*(F.col(x) for x in "tcld"))
    rows = df.select(ids.job_id(F.col("u"), content), ids.dedup_key(F.col("u"), content)).collect()
    whole = hashlib.sha256("T\x1f\x1fL\x1f".encode()).hexdigest()
    assert tuple(rows[0]) == (hashlib.sha256(url.encode()).hexdigest()[:24], "url:https://example.test/job/1")
    assert tuple(rows[1]) == (whole[:24], "content:" + whole)


def test_split_and_half(spark):
    import hashlib

    keys = [f"job-{i}" for i in range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ids.split(F.col("k")).alias("s"), ids.corpus_half(F.col("k")).alias("h")).collect()
    for r in rows:
        bucket = int(hashlib.sha256(f"{ids.SEED}:split:{r['k']}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert r["s"] == ("dev" if bucket < 0.4 else "test")
        assert r["h"] == hashlib.sha256(r["k"].encode()).digest()[0] % 2
