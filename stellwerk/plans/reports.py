"""Queries of the report operators over the tables of a directory, and their SQL.

`posting` is the first delivery of each job_id; `side` holds each posting's known skill ids, sorted and distinct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.functions import ids, text
from stellwerk.operators import audits, cohorts, evaluation, ingest, lexicon, matching, sampling, star, vectors
from stellwerk.session import collect_bounded, written_table
from stellwerk.sources.tables import table
from stellwerk.sources.writers import dataset_hash
from stellwerk.streaming import weekly

PROFILE = ["python", "sql", "docker", "teamwork"]
GROUPED = ("source", "title", "company", "location", "description")


def posting(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first delivery of each posting: an aggregation that keeps the earliest row, combined before the shuffle."""
    names = [c for c in dict.fromkeys((*columns, "collection_date")) if c != "job_id"]
    rows = table(spark, d, "jobs", "job_id", *names).filter("job_id is not null")
    first = F.min_by(F.struct(*names), F.coalesce("collection_date", F.lit("9999-12-31").cast("date")))
    return rows.groupBy("job_id").agg(first.alias("r")).select("job_id", "r.*")


def known_skills(spark: SparkSession, d: str) -> list[str]:
    return sorted(r[0] for r in collect_bounded(table(spark, d, "dim_skill", "skill_id"), 10_000, "dim_skill"))


def side(spark: SparkSession, d: str) -> DataFrame:
    """``job_id, skill_ids``: known ids, sorted and distinct, of every posting in the sidecar."""
    known = F.array(*map(F.lit, known_skills(spark, d)))
    clean = F.array_intersect(F.transform(F.coalesce("skill_ids", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s))), known)
    rows = table(spark, d, "job_skills").filter("job_id is not null").select("job_id", clean.alias("x"))
    return rows.groupBy("job_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("x")))).alias("skill_ids"))


def taxonomy(spark: SparkSession, d: str) -> lexicon.Taxonomy:
    """The skills of dim_skill with their labels as aliases."""
    rows = collect_bounded(table(spark, d, "dim_skill").orderBy("skill_id"), 10_000, "dim_skill")
    return lexicon.Taxonomy.parse({"version": "dim_skill", "skills": [{"id": r["skill_id"], "label": r["label"], "category": r["category"], "aliases": [r["label"]], "case_sensitive_aliases": [r["label"]] if len(r["label"]) <= 3 else []} for r in rows], "exclusions": ["communication protocols"]})


def extracted(spark: SparkSession, d: str) -> DataFrame:
    p = posting(spark, d, "title", "description")
    return lexicon.skill_ids(p, lexicon.alias_table(spark, taxonomy(spark, d)), "job_id", lexicon.posting_text(F.col("title"), F.col("description")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_POSTING = "posting AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY collection_date NULLS LAST) AS rn FROM jobs WHERE job_id IS NOT NULL) WHERE rn = 1)"
_SIDE = """said AS (SELECT DISTINCT u.job_id, k.skill_id FROM (SELECT job_id, lower(trim(unnest(skill_ids))) AS s FROM job_skills WHERE job_id IS NOT NULL) u JOIN (SELECT DISTINCT skill_id FROM dim_skill) k ON k.skill_id = u.s),
side AS (SELECT b.job_id, coalesce(list_sort(list(s.skill_id) FILTER (WHERE s.skill_id IS NOT NULL)), []) AS skill_ids FROM (SELECT DISTINCT job_id FROM job_skills WHERE job_id IS NOT NULL) b LEFT JOIN said s USING (job_id) GROUP BY b.job_id)"""
_TOKEN_SQL = text.TOKEN.replace("'", "''")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$POSTING", _POSTING).replace("$SIDE", _SIDE)
        return f

    return add


# star schema


@query("WITH $POSTING, $SIDE SELECT p.job_id, p.location AS location_raw, p.collection_date, CASE WHEN p.location IN ('Sei einer der ersten Bewerber', 'Jetzt als Erste bewerben!', 'Gehöre zu den Ersten, die sich bewerben', 'Be among the first to apply') THEN NULL ELSE p.location END AS city, CAST(coalesce(len(s.skill_ids), 0) AS BIGINT) AS skill_count, coalesce(len(s.skill_ids), 0) > 0 AS has_skills FROM posting p LEFT JOIN side s USING (job_id)")
def star_fact_job(spark, d):
    return star.fact_job(posting(spark, d, "location"), side(spark, d))


@query("WITH r AS (SELECT DISTINCT job_id, skill_ids FROM job_skills) SELECT job_id, unnest(skill_ids) AS skill_id FROM r")
def star_bridge_job_skill(spark, d):
    return star.bridge_job_skill(table(spark, d, "job_skills").distinct())


@query("SELECT skill_id, label, category FROM dim_skill")
def star_dim_skill(spark, d):
    return star.dim_skill(table(spark, d, "dim_skill"))


@query("WITH b AS (SELECT s.job_id, unnest(s.skill_ids) AS skill_id FROM job_skills s), c AS (SELECT city, count(*) AS city_jobs FROM fact_job WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 40) SELECT c.city, b.skill_id, count(*) AS jobs, c.city_jobs, round(count(*) / c.city_jobs, 4) AS share_of_city_jobs FROM b JOIN fact_job f USING (job_id) JOIN c ON c.city = f.city GROUP BY c.city, b.skill_id, c.city_jobs")
def star_skill_by_city(spark, d):
    return star.skill_by_city(table(spark, d, "fact_job"), star.bridge_job_skill(table(spark, d, "job_skills")), least=40)


@query("WITH $SIDE SELECT a.skill_id AS skill_a, b.skill_id AS skill_b, count(*) AS jobs FROM said a JOIN said b ON a.job_id = b.job_id AND a.skill_id < b.skill_id GROUP BY ALL HAVING count(*) >= 20")
def star_skill_pairs(spark, d):
    return star.skill_pairs(star.bridge_job_skill(side(spark, d)))


@query("WITH b AS (SELECT DISTINCT job_id, unnest(skill_ids) AS skill_id FROM job_skills), t AS (SELECT count(DISTINCT job_id) AS n, round(100 * count(*) FILTER (WHERE has_skills) / count(*), 4) AS pct FROM fact_job) SELECT b.skill_id, count(DISTINCT b.job_id) AS jobs, round(count(DISTINCT b.job_id) / any_value(t.n), 4) AS skill_share, any_value(t.pct) AS ads_with_skills_pct FROM b, t GROUP BY b.skill_id")
def star_measures(spark, d):
    return star.measures(table(spark, d, "fact_job"), star.bridge_job_skill(table(spark, d, "job_skills").distinct()))


# ingest and quality


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS non_null, count(*) AS total, count({c}) / count(*) AS fraction FROM jobs" for c in ("job_id", "source", "source_url", "title", "company", "location", "federal_state", "remote_type", "employment_type", "experience_level", "salary_min", "salary_max", "salary_currency", "salary_period", "description", "requirements", "responsibilities", "benefits", "language_requirements", "extracted_skills", "normalized_skills", "embedding", "publication_date", "collection_date")))
def field_coverage(spark, d):
    return ingest.coverage(table(spark, d, "jobs"))


_CLEAN = "nullif(trim(regexp_replace(regexp_replace({e}, '<[^>]{{1,300}}>', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


#: Entities that stand in the test tables; `clean_entities` tests others.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&#64;", "@"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"), ("&euro;", "€"), ("&amp;", "&"))


def _clean_sql(column: str) -> str:
    s = column
    for entity, char in _ENTITIES:
        s = f"replace({s}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return _CLEAN.format(e=s)


_MAIL_SQL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_PHONE_SQL = r"(?:\+49|0049|0)(?:[\s()./-]*\d){7,12}"


def _redact_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_MAIL_SQL}', '[EMAIL REDACTED]', 'gi'), '{_PHONE_SQL}', '[PHONE REDACTED]', 'g')"


@query(f"SELECT DISTINCT job_id, {_clean_sql('title')} AS title, {_clean_sql('company')} AS company FROM jobs")
def clean_fields(spark, d):
    j = table(spark, d, "jobs", "job_id", "title", "company")
    return j.select("job_id", text.clean(F.col("title")).alias("title"), text.clean(F.col("company")).alias("company")).distinct()


@query("SELECT skill_id, skill_id || ' Café – ärzte € … &lt; © 5 ≥ x' AS cleaned FROM dim_skill")
def clean_entities(spark, d):
    """Named and numbered entities of all kinds, one that is escaped twice, and one without its semicolon."""
    k = table(spark, d, "dim_skill", "skill_id")
    return k.select("skill_id", text.clean(F.concat("skill_id", F.lit("<br> Caf&eacute; &ndash; &#228;rzte&nbsp;&#x20AC; &hellip; &amp;lt; &copy 5 &ge; x "))).alias("cleaned"))


@query(f"WITH t AS (SELECT DISTINCT job_id, {_clean_sql('description')} AS x FROM jobs) SELECT job_id, {_redact_sql('x')} AS description, coalesce(len(regexp_extract_all(x, '(?i){_MAIL_SQL}')), 0) AS emails, coalesce(len(regexp_extract_all(regexp_replace(x, '{_MAIL_SQL}', '[EMAIL REDACTED]', 'gi'), '{_PHONE_SQL}')), 0) AS phones FROM t")
def redact_descriptions(spark, d):
    j = table(spark, d, "jobs", "job_id", "description").select("job_id", text.clean(F.col("description")).alias("x")).distinct()
    mails, phones = text.redaction_counts(F.col("x"))
    return j.select("job_id", text.redact(F.col("x")).alias("description"), mails.alias("emails"), phones.alias("phones"))


@query(r"SELECT count(*) FILTER (WHERE regexp_matches(x, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}')) AS email_rows, count(*) FILTER (WHERE regexp_matches(x, '(?:\+49|0049|0)(?:[\s()./-]*\d){7,12}')) AS phone_rows FROM (SELECT concat_ws(' ', title, company, location, description) AS x FROM jobs)")
def residual_contacts(spark, d):
    return ingest.residual(table(spark, d, "jobs"))


@query("SELECT min(collection_date) AS first_date, max(collection_date) AS last_date, count(*) AS n, count(publication_date) AS dated FROM jobs")
def date_range(spark, d):
    return table(spark, d, "jobs").agg(F.min("collection_date").alias("first_date"), F.max("collection_date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.count("publication_date").alias("dated"))


_CONTENT = "concat(coalesce(title, ''), chr(31), coalesce(company, ''), chr(31), coalesce(location, ''), chr(31), coalesce(description, ''))"


@query(f"SELECT DISTINCT job_id AS given_id, substr(CASE WHEN source_url <> '' THEN sha256(source_url) ELSE sha256({_CONTENT}) END, 1, 24) AS job_id, CASE WHEN source_url <> '' THEN 'url:' || replace(lower(source_url), 'ß', 'ss') ELSE 'content:' || sha256({_CONTENT}) END AS dedup_key FROM jobs")
def derive_ids(spark, d):
    j = table(spark, d, "jobs", "job_id", "source_url", "title", "company", "location", "description")
    content = ids.content_hash(*(F.col(c) for c in ("title", "company", "location", "description")))
    return j.select(F.col("job_id").alias("given_id"), ids.job_id(F.col("source_url"), content).alias("job_id"), ids.dedup_key(F.col("source_url"), content).alias("dedup_key")).distinct()


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(lower(text)) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def first_wins_dedup(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null").withColumn("k", F.sha2(F.lower("text"), 256))
    return ingest.first_wins(docs, F.col("k"), [F.col("doc_id")]).select("doc_id", F.md5("text").alias("text_hash"))


def _records(spark, d):
    """Rows of jobs as raw records under other accepted names, in a declared order."""
    j = table(spark, d, "jobs", "job_id", "title", "company", "location", "description", "source_url", "collection_date").distinct()
    order = F.conv(F.substring(F.md5(F.concat("job_id", F.lit("/"), F.coalesce(F.col("collection_date").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    return j.select(order.alias("_pos"), F.when(~F.md5("job_id").startswith("0"), F.col("title")).alias("job_title"), F.col("company").alias("firm"), F.col("location").alias("about_work"), F.col("description").alias("info_1"), F.col("source_url").alias("oj_id"), F.col("collection_date").cast("string").alias("date_scrape"))


_JSON_PLACE = "CASE WHEN NOT json_valid(trim({c}, ' ')) THEN {c} WHEN json_type(trim({c}, ' ')) = 'ARRAY' THEN json_extract_string(trim({c}, ' '), '$[0]') WHEN json_type(trim({c}, ' ')) = 'OBJECT' THEN coalesce(json_extract_string({c}, '$.location'), json_extract_string({c}, '$.city')) ELSE NULL END"
_FIELDS = ("title", "company", "location", "description")
_MAILS = " + ".join(f"coalesce(len(regexp_extract_all({c}, '(?i){_MAIL_SQL}')), 0)" for c in _FIELDS)
_PHONES = " + ".join(f"coalesce(len(regexp_extract_all(regexp_replace({c}, '{_MAIL_SQL}', '[EMAIL REDACTED]', 'gi'), '{_PHONE_SQL}')), 0)" for c in _FIELDS)
#: Raw records cleaned (r1), redacted and counted (r2), with ids and keys (rec).
_RECORDS = f"""r0 AS (SELECT DISTINCT job_id, title, company, location, description, source_url, collection_date FROM jobs),
r1 AS (SELECT ('0x' || substr(md5(job_id || '/' || coalesce(CAST(collection_date AS VARCHAR), '')), 1, 15))::BIGINT AS pos, CASE WHEN md5(job_id) NOT LIKE '0%' THEN {_clean_sql('title')} END AS title, {_clean_sql('company')} AS company, {_clean_sql('(' + _JSON_PLACE.format(c='location') + ')')} AS location, {_clean_sql('description')} AS description, {_clean_sql('source_url')} AS url, collection_date FROM r0),
r2 AS (SELECT pos, url, collection_date, {', '.join(f"{_redact_sql(c)} AS {c}" for c in _FIELDS)}, {_MAILS} AS emails, {_PHONES} AS phones FROM r1),
rec AS (SELECT *, title IS NOT NULL AS valid, substr(sha256(CASE WHEN url <> '' THEN url ELSE {{content}} END), 1, 24) AS job_id, CASE WHEN url <> '' THEN 'url:' || replace(lower(url), 'ß', 'ss') ELSE 'content:' || sha256({{content}}) END AS dedup FROM r2)"""
_RECORDS = _RECORDS.replace("{content}", "concat(coalesce(title, ''), chr(31), coalesce(company, ''), chr(31), coalesce(location, ''), chr(31), coalesce(description, ''))")


@query(f"WITH {_RECORDS} SELECT job_id, 'raw' AS source, title, company, location, description, collection_date FROM (SELECT *, row_number() OVER (PARTITION BY dedup ORDER BY pos) AS rn FROM rec WHERE valid) WHERE rn = 1")
def ingest_postings(spark, d):
    """Canonical postings of raw records: projection, redaction, ids, rejection, first delivery."""
    return ingest.ingest(_records(spark, d), "raw").select("job_id", "source", "title", "company", "location", "description", "collection_date")


@query("SELECT count(*) AS records_read, count(*) - n AS records_valid, n AS records_invalid FROM (SELECT DISTINCT job_id, title, company, location, description, source_url, collection_date FROM jobs), (SELECT count(*) AS n FROM (SELECT DISTINCT job_id, title, company, location, description, source_url, collection_date FROM jobs) WHERE title IS NULL) GROUP BY n")
def ingest_counts(spark, d):
    j = table(spark, d, "jobs", "job_id", "title", "company", "location", "description", "source_url", "collection_date").distinct()
    s = ingest.statistics(j.withColumn("collection_date", F.col("collection_date").cast("string")), "raw")
    return s.select("records_read", "records_valid", "records_invalid")


@query(f"WITH {_RECORDS} SELECT count(*) AS records_read, count(*) FILTER (WHERE valid) AS records_valid, count(*) FILTER (WHERE NOT valid) AS records_invalid, count(DISTINCT dedup) FILTER (WHERE valid) AS records_output, count(*) FILTER (WHERE valid) - count(DISTINCT dedup) FILTER (WHERE valid) AS duplicates, CAST(coalesce(sum(emails) FILTER (WHERE valid), 0) AS BIGINT) AS email_redactions, CAST(coalesce(sum(phones) FILTER (WHERE valid), 0) AS BIGINT) AS phone_redactions FROM rec")
def ingest_statistics(spark, d):
    return ingest.statistics(_records(spark, d), "raw")


@query(f"WITH {_RECORDS} SELECT 'missing_title' AS reason, count(*) AS n FROM rec WHERE NOT valid HAVING count(*) > 0")
def reject_reasons(spark, d):
    return ingest.reject_reasons(_records(spark, d), "raw")


@query("SELECT location, CASE WHEN NOT json_valid(trim(location, ' ')) THEN location WHEN json_type(trim(location, ' ')) = 'ARRAY' THEN json_extract_string(trim(location, ' '), '$[0]') WHEN json_type(trim(location, ' ')) = 'OBJECT' THEN coalesce(json_extract_string(location, '$.location'), json_extract_string(location, '$.city')) ELSE NULL END AS city, count(*) AS n FROM jobs WHERE location IS NOT NULL GROUP BY 1, 2")
def json_location(spark, d):
    j = table(spark, d, "jobs", "location").filter("location is not null").groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return j.select("location", text.first_location(F.col("location")).alias("city"), "n")


@query("SELECT collection_date AS day, count(*) AS n FROM jobs WHERE collection_date IS NOT NULL GROUP BY 1")
def parse_dates(spark, d):
    """Dates written in four formats and read again."""
    c = F.col("collection_date")
    style = F.dayofyear(c) % 4
    written = F.when(style == 0, F.date_format(c, "yyyy-MM-dd")).when(style == 1, F.date_format(c, "d.M.yyyy")).when(style == 2, F.date_format(c, "yyyy/M/d")).otherwise(F.date_format(c, "yyyyMMdd"))
    j = table(spark, d, "jobs", "collection_date").filter(c.isNotNull()).select(text.parse_date(written).alias("day"))
    return j.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query()
def semantic_hash(spark, d):
    """A hash of all postings that does not depend on row order."""
    j = table(spark, d, "jobs").drop("embedding", "normalized_skills")
    return spark.createDataFrame([(dataset_hash(j), j.count())], "hash string, n bigint")


@query("SELECT 'job_family_volume' AS analysis, 'no validated job-family field is available' AS reason UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{r} no populated values' FROM jobs HAVING {' AND '.join(f'count(*) FILTER (WHERE {t}) = 0' for t in ts)}" for a, r, ts in (("publication_week_trends", "publication_date has", ("publication_date IS NOT NULL",)), ("geographic_trends", "federal_state has", ("trim(federal_state) <> ''",)), ("remote_work_trends", "remote_type has", ("trim(remote_type) <> ''",)), ("salary_trends", "salary_min and salary_max have", ("salary_min IS NOT NULL", "salary_max IS NOT NULL")), ("language_requirements", "language_requirements has", ("len(language_requirements) > 0",)))))
def unavailable_analyses(spark, d):
    """Analyses that the postings' fields can't support."""
    return ingest.unavailable_analyses(table(spark, d, "jobs"))


# lexicon


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_TOKEN_SQL}')), 0) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '{_TOKEN_SQL}'), '|')) AS tokens_hash FROM documents WHERE text IS NOT NULL")
def token_stats(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").filter("text is not null").withColumn("t", text.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_hash"))


_LEXICON = rf"""alias AS (SELECT skill_id, CASE WHEN length(label) <= 3 THEN label ELSE replace(lower(label), 'ß', 'ss') END AS a, length(label) <= 3 AS strict FROM dim_skill
  UNION ALL SELECT NULL, 'communication protocols', false),
grams AS (SELECT skill_id, strict, array_to_string(regexp_extract_all(a, '{_TOKEN_SQL}'), chr(31)) AS gram, len(regexp_extract_all(a, '{_TOKEN_SQL}')) AS n FROM alias),
tok AS (SELECT job_id, regexp_extract_all(concat_ws(' ', nullif(title, ''), nullif(description, '')), '{_TOKEN_SQL}') AS raw FROM posting),
low AS (SELECT job_id, raw, list_transform(raw, lambda x: replace(lower(x), 'ß', 'ss')) AS low FROM tok WHERE len(raw) > 0),
start AS (SELECT job_id, raw, low, unnest(generate_series(1, len(raw))) AS i FROM low),
cand AS (SELECT job_id, i, k.n, false AS strict, array_to_string(low[i:i + k.n - 1], chr(31)) AS gram FROM start, (SELECT unnest(generate_series(1, (SELECT max(n) FROM grams))) AS n) k WHERE i + k.n - 1 <= len(raw)
  UNION ALL SELECT job_id, i, k.n, true, array_to_string(raw[i:i + k.n - 1], chr(31)) FROM start, (SELECT unnest(generate_series(1, (SELECT max(n) FROM grams))) AS n) k WHERE i + k.n - 1 <= len(raw)),
hit AS (SELECT c.job_id, c.i, g.n, g.skill_id FROM cand c JOIN grams g ON g.gram = c.gram AND g.strict = c.strict),
best AS (SELECT job_id, skill_id FROM (SELECT *, max(n) OVER (PARTITION BY job_id, i) AS top FROM hit) WHERE n = top AND skill_id IS NOT NULL),
found AS (SELECT p.job_id, coalesce(list_sort(list(DISTINCT b.skill_id) FILTER (WHERE b.skill_id IS NOT NULL)), []) AS skill_ids FROM posting p LEFT JOIN best b USING (job_id) GROUP BY p.job_id)"""


@query(f"WITH $POSTING, {_LEXICON} SELECT job_id, array_to_string(skill_ids, ',') AS skill_ids FROM found")
def lexicon_skills(spark, d):
    return extracted(spark, d).select("job_id", F.array_join("skill_ids", ",").alias("skill_ids"))


@query(f"WITH $POSTING, {_LEXICON} SELECT unnest(skill_ids) AS skill_id, count(*) AS n FROM found GROUP BY 1 ORDER BY n DESC, skill_id LIMIT 20")
def lexicon_top_skills(spark, d):
    return lexicon.corpus_counts(extracted(spark, d))[1]


@query(f"WITH $POSTING, {_LEXICON} SELECT count(*) AS rows, count(*) FILTER (WHERE len(skill_ids) > 0) AS rows_with_skills, coalesce(sum(len(skill_ids)), 0) AS assignments FROM found")
def lexicon_totals(spark, d):
    return lexicon.corpus_counts(extracted(spark, d))[0]


@query()
def lexicon_spans(spark, d):
    p = posting(spark, d, "title", "description")
    return lexicon.spans(p, taxonomy(spark, d), "job_id", lexicon.posting_text(F.col("title"), F.col("description")))


_GUESS = "CASE WHEN len(list_filter(regexp_extract_all(lower(left({c}, 1500)), '[a-zäöüß]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in text.GERMAN) + "))) > len(list_filter(regexp_extract_all(lower(left({c}, 1500)), '[a-zäöüß]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in text.ENGLISH) + "))) THEN 'de' ELSE 'en' END"


@query(f"SELECT doc_id, {_GUESS.format(c='text')} AS guess FROM documents WHERE text IS NOT NULL")
def language_guess(spark, d):
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", text.guess_language(F.col("text")).alias("guess"))


@query(f"WITH g AS (SELECT lower(trim(lang)) AS lang, {_GUESS.format(c='text')} AS guess FROM documents WHERE text IS NOT NULL AND lower(trim(lang)) IN ('de', 'en')) SELECT l.lang, count(*) FILTER (WHERE g.lang = l.lang AND guess = l.lang) AS tp, count(*) FILTER (WHERE g.lang <> l.lang AND guess = l.lang) AS fp, count(*) FILTER (WHERE g.lang = l.lang AND guess <> l.lang) AS fn FROM g, (VALUES ('de'), ('en')) l(lang) GROUP BY l.lang")
def language_guess_eval(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "text").filter("text is not null and lower(trim(lang)) in ('de', 'en')")
    g = t.select("doc_id", F.lower(F.trim("lang")).alias("lang"), text.guess_language(F.col("text")).alias("guess"))
    pairs = evaluation.confusion(g.select("doc_id", "lang"), g.select("doc_id", F.col("guess").alias("lang")), ["doc_id", "lang"])
    return evaluation.precision_recall(pairs, ["lang"]).select("lang", "tp", "fp", "fn")


_EVAL = """goldrow AS (SELECT DISTINCT g.job_id, unnest(g.skill_ids) AS skill_id FROM skill_gold_v1 g WHERE g.job_id IN (SELECT job_id FROM posting)),
predrow AS (SELECT job_id, unnest(skill_ids) AS skill_id FROM found WHERE job_id IN (SELECT job_id FROM skill_gold_v1)),
cell AS (SELECT coalesce(g.job_id, p.job_id) AS job_id, coalesce(g.skill_id, p.skill_id) AS skill_id, g.job_id IS NOT NULL AS in_gold, p.job_id IS NOT NULL AS in_pred FROM goldrow g FULL JOIN predrow p ON g.job_id = p.job_id AND g.skill_id = p.skill_id)"""
_COUNTS = "count(*) FILTER (WHERE in_gold AND in_pred) AS tp, count(*) FILTER (WHERE NOT in_gold AND in_pred) AS fp, count(*) FILTER (WHERE in_gold AND NOT in_pred) AS fn"


def _eval_pairs(spark, d):
    gold = table(spark, d, "skill_gold_v1")
    judged = gold.select("job_id").filter("job_id is not null").distinct()
    p = posting(spark, d, "title", "description").join(judged, "job_id", "left_semi")  # texts of judged postings only
    pred = lexicon.skill_ids(p, lexicon.alias_table(spark, taxonomy(spark, d)), "job_id", lexicon.posting_text(F.col("title"), F.col("description")))
    g = gold.select("job_id", F.explode("skill_ids").alias("skill_id")).distinct().join(p.select("job_id"), "job_id", "left_semi")
    return evaluation.confusion(g, pred.select("job_id", F.explode("skill_ids").alias("skill_id")), ["job_id", "skill_id"])


@query(f"WITH $POSTING, {_LEXICON}, {_EVAL}, n AS (SELECT {_COUNTS} FROM cell) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n")
def extraction_eval(spark, d):
    r = evaluation.precision_recall(_eval_pairs(spark, d))
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH $POSTING, {_LEXICON}, {_EVAL} SELECT k.category, {_COUNTS} FROM cell JOIN dim_skill k USING (skill_id) GROUP BY k.category")
def extraction_eval_by_category(spark, d):
    pairs = _eval_pairs(spark, d).join(F.broadcast(table(spark, d, "dim_skill", "skill_id", "category")), "skill_id")
    return evaluation.precision_recall(pairs, ["category"]).select("category", "tp", "fp", "fn")


@query(f"WITH $POSTING, {_LEXICON}, {_EVAL}, m AS (SELECT DISTINCT job_id, 'split ' || split AS part FROM (SELECT job_id, CASE WHEN substr(sha256('20261004:split:' || job_id), 1, 8) < '66666666' THEN 'dev' ELSE 'test' END AS split FROM posting) UNION ALL SELECT job_id, 'all' FROM posting) SELECT m.part, {_COUNTS} FROM cell JOIN m USING (job_id) GROUP BY m.part")
def extraction_eval_by_slice(spark, d):
    """Overlapping slices: all, and each split."""
    pairs = _eval_pairs(spark, d).withColumn("part", F.explode(F.array(F.lit("all"), F.concat(F.lit("split "), ids.split(F.col("job_id"))))))
    return evaluation.precision_recall(pairs, ["part"]).select("part", "tp", "fp", "fn")


@query(f"WITH $POSTING, {_LEXICON}, {_EVAL} SELECT job_id, skill_id, CASE WHEN in_pred THEN 'false_positive' ELSE 'false_negative' END AS kind FROM cell WHERE in_gold <> in_pred")
def extraction_mistakes(spark, d):
    return _eval_pairs(spark, d).filter("in_gold <> in_pred").select("job_id", "skill_id", F.when(F.col("in_pred"), "false_positive").otherwise("false_negative").alias("kind"))


@query()
def extraction_bootstrap(spark, d):
    """95 % intervals of the extraction scores; postings with labels are few and bounded by the gold table."""
    per = evaluation.precision_recall(_eval_pairs(spark, d), ["job_id"]).orderBy("job_id").select("tp", "fp", "fn")
    counts = [tuple(r) for r in collect_bounded(per, 200_000, "the gold table")]
    r = evaluation.bootstrap(counts, ids.SEED)
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in r.items()], "metric string, low double, high double")


# matching

_RANKED = """scored AS (SELECT job_id, skill_ids, len(list_intersect(skill_ids, ['python', 'sql', 'docker', 'teamwork'])) AS m, len(skill_ids) AS n FROM side),
pc AS (SELECT *, m / 4 AS p, m / n AS c FROM scored WHERE m > 0),
best AS (SELECT job_id, skill_ids, m, n, round(2 * p * c / (p + c), 6) AS f1, round(c, 6) AS cov FROM pc ORDER BY f1 DESC, cov DESC, job_id LIMIT 25)"""


@query(f"WITH $SIDE, {_RANKED} SELECT row_number() OVER (ORDER BY f1 DESC, cov DESC, job_id) AS rank, job_id, f1 AS match_score, cov AS job_skill_coverage, m AS matched_skill_count, n AS job_skill_count, array_to_string(list_filter(['docker', 'python', 'sql', 'teamwork'], lambda s: list_contains(skill_ids, s)), ',') AS matched_skills, 'unverified' AS requirement_status FROM best")
def rank_overlap_topk(spark, d):
    r = matching.rank(side(spark, d), PROFILE, 25, known_skills(spark, d), strict=True)
    return r.select("rank", "job_id", "match_score", "job_skill_coverage", "matched_skill_count", "job_skill_count", F.array_join("matched_skills", ",").alias("matched_skills"), "requirement_status")


@query("WITH $SIDE SELECT count(*) AS postings_scanned, 0 AS postings_excluded_by_id, count(*) FILTER (WHERE len(skill_ids) > 0) AS postings_with_skills, count(*) FILTER (WHERE list_has_any(skill_ids, ['python', 'sql', 'docker', 'teamwork'])) AS postings_with_candidate_overlap FROM side")
def rank_counters(spark, d):
    return matching.counters(side(spark, d), PROFILE)


@query(f"WITH $SIDE, {_RANKED}, cnt AS (SELECT skill_id, count(*) AS n FROM said GROUP BY 1), gap AS (SELECT job_id, unnest(list_filter(skill_ids, lambda s: NOT list_contains(['python', 'sql', 'docker', 'teamwork'], s))) AS skill_id FROM best) SELECT g.job_id, g.skill_id, c.n AS corpus_posting_count, row_number() OVER (PARTITION BY g.job_id ORDER BY c.n DESC, g.skill_id) AS gap_rank FROM gap g JOIN cnt c USING (skill_id)")
def rank_gaps(spark, d):
    s = side(spark, d)
    return matching.gaps(matching.rank(s, PROFILE, 25), matching.corpus_counts(s)).select("job_id", "skill_id", "corpus_posting_count", "gap_rank")


@query()
def rank_gap_evidence(spark, d):
    s = side(spark, d)
    g = matching.gaps(matching.rank(s, PROFILE, 5), matching.corpus_counts(s))
    return matching.gap_evidence(g, posting(spark, d, "title", "description"), taxonomy(spark, d)).withColumn("snippets", F.array_join("snippets", " | "))


_QUERYROWS = """q AS (SELECT job_id AS query_id, list_sort(list(DISTINCT skill_id)) AS c FROM (SELECT job_id, unnest(skill_ids) AS skill_id FROM skill_gold_v1 WHERE job_id IS NOT NULL) GROUP BY job_id),
qs AS (SELECT query_id, len(c) AS n_c, unnest(c) AS skill_id FROM q), js AS (SELECT job_id, len(skill_ids) AS n_s, unnest(skill_ids) AS skill_id FROM side),
mt AS (SELECT query_id, n_c, job_id, n_s, count(*) AS m FROM qs JOIN js USING (skill_id) GROUP BY ALL),
sc AS (SELECT query_id, job_id, round(2 * (m / n_c) * (m / n_s) / (m / n_c + m / n_s), 6) AS f1, round(m / n_s, 6) AS cov FROM mt),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, cov DESC, job_id) AS rank FROM sc) WHERE rank <= 10)"""


def _gold_queries(spark, d):
    g = table(spark, d, "skill_gold_v1").filter("job_id is not null").select(F.col("job_id").alias("query_id"), F.explode("skill_ids").alias("s"))
    return g.groupBy("query_id").agg(F.array_sort(F.collect_set("s")).alias("candidate_skill_ids"))


@query(f"WITH $SIDE, {_QUERYROWS} SELECT query_id, job_id, rank, f1 AS harmonic_f1 FROM rk")
def rank_many_queries(spark, d):
    """The skills of every gold posting as a query; all queries in one join."""
    return matching.rank_queries(_gold_queries(spark, d), side(spark, d), 10).select("query_id", "job_id", "rank", "harmonic_f1")


@query(f"WITH $SIDE, {_QUERYROWS}, h AS (SELECT query_id, rank FROM rk WHERE job_id = query_id) SELECT q.query_id, round(coalesce(1 / 10 * (h.rank IS NOT NULL)::INT, 0), 6) AS precision_at_k, coalesce((h.rank IS NOT NULL)::INT, 0)::DOUBLE AS recall_at_k, round(coalesce(1 / h.rank, 0), 6) AS mrr, round(coalesce(1 / log2(h.rank + 1), 0), 6) AS ndcg_at_k FROM q LEFT JOIN h USING (query_id)")
def ranking_metrics_binary(spark, d):
    """Finding a posting again by its own gold skills."""
    q = _gold_queries(spark, d)
    r = evaluation.binary_ranking(matching.rank_queries(q, side(spark, d), 10), q.select("query_id", F.col("query_id").alias("job_id")), 10)
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k")])


_GRADES = "gr AS (SELECT query_id, job_id, least(3, m) AS grade FROM mt)"


@query(f"WITH $SIDE, {_QUERYROWS}, {_GRADES}, idl AS (SELECT query_id, count(*) FILTER (WHERE grade >= 2) AS n_rel, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, job_id) AS r FROM gr) GROUP BY query_id), got AS (SELECT rk.query_id, count(*) FILTER (WHERE grade >= 2) AS hits, min(rank) FILTER (WHERE grade >= 2) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM rk JOIN gr USING (query_id, job_id) GROUP BY rk.query_id) SELECT i.query_id, round(coalesce(hits, 0) / 10, 6) AS precision_at_k, round(CASE WHEN n_rel = 0 THEN 0 ELSE coalesce(hits, 0) / n_rel END, 6) AS recall_at_k_pooled, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg_at_k FROM idl i LEFT JOIN got USING (query_id)")
def ranking_metrics_graded(spark, d):
    """Grades from the number of common skills, at most 3."""
    rows = matching.answered(_gold_queries(spark, d), side(spark, d), 10, grades=True).filter("n1 > 0")
    top = F.transform("best", lambda x, i: F.struct((i + 1).alias("rank"), F.least(F.lit(3), x["m"]).alias("grade")))
    r = evaluation.graded_scores(rows.withColumn("top", top), 10)
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k_pooled", "mrr", "ndcg_at_k")])


@query(f"WITH $SIDE, {_QUERYROWS}, h AS (SELECT query_id, rank FROM rk WHERE job_id = query_id), m AS (SELECT q.query_id, coalesce(1 / 10 * (h.rank IS NOT NULL)::INT, 0) AS p, coalesce((h.rank IS NOT NULL)::INT, 0)::DOUBLE AS r, coalesce(1 / h.rank, 0) AS mrr, coalesce(1 / log2(h.rank + 1), 0) AS ndcg FROM q LEFT JOIN h USING (query_id)) SELECT count(*) AS queries_evaluated, round(avg(p), 6) AS precision_at_k, round(avg(r), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k FROM m")
def ranking_macro_means(spark, d):
    """Means over all queries of finding a posting again by its own gold skills."""
    q = _gold_queries(spark, d)
    r = evaluation.binary_ranking(matching.rank_queries(q, side(spark, d), 10), q.select("query_id", F.col("query_id").alias("job_id")), 10)
    return evaluation.macro_means(r, ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k"))


@query()
def matching_report(spark, d):
    """The matcher against random draws on the pools of all gold queries, graded by the number of common skills, at most 3."""
    q = _gold_queries(spark, d).withColumn("source_job_id", F.col("query_id"))
    pools = written_table(matching.pools(q, side(spark, d), 10, ids.SEED), "pools")
    sheet = pools.select("query_id", F.explode(F.arrays_zip("jobs", "shared")).alias("r")).select("query_id", "r.jobs", F.least(F.lit(3), "r.shared").alias("grade")).withColumnRenamed("jobs", "job_id")
    r = evaluation.matching_report(q, sheet, pools, 10, ids.SEED)
    rows = [(r["status"], r["queries_fully_judged"], system, metric, *map(float, v)) for system, metrics in r.get("systems", {}).items() for metric, v in metrics.items()]
    rows = rows or [(r["status"], r["queries_fully_judged"], None, None, None, None, None)]
    return spark.createDataFrame(rows, "status string, queries bigint, system string, metric string, mean double, low double, high double")


@query()
def match_pool(spark, d):
    """Judging pools of all gold queries: matcher's and random postings in blind order, without the query's own posting."""
    q = _gold_queries(spark, d).withColumn("source_job_id", F.col("query_id"))
    return matching.pools(q, side(spark, d), 10, ids.SEED).select("query_id", F.posexplode("jobs").alias("at", "job_id")).select("query_id", "job_id", (F.col("at") + 1).alias("place"))


# cohorts

_WEEKLY = "weekly AS (SELECT CAST(date_trunc('week', collection_date) AS DATE) AS week_start, count(*) AS postings FROM posting WHERE collection_date IS NOT NULL GROUP BY 1), wskill AS (SELECT CAST(date_trunc('week', p.collection_date) AS DATE) AS week_start, s.skill_id, count(*) AS postings FROM posting p JOIN said s USING (job_id) WHERE p.collection_date IS NOT NULL GROUP BY 1, 2)"


def _weekly(spark, d):
    p = posting(spark, d)
    return cohorts.weekly_postings(p), cohorts.weekly_skills(p, side(spark, d))


@query(f"WITH $POSTING, $SIDE, {_WEEKLY} SELECT week_start, postings FROM weekly")
def weekly_postings(spark, d):
    return cohorts.weekly_postings(posting(spark, d))


@query(f"WITH $POSTING, $SIDE, {_WEEKLY} SELECT week_start, skill_id, postings FROM wskill")
def weekly_skill_postings(spark, d):
    return _weekly(spark, d)[1]


@query(f"WITH $POSTING, $SIDE, {_WEEKLY}, seen AS (SELECT *, lag(week_start) OVER (ORDER BY week_start) AS prev FROM weekly), cal AS (SELECT CAST(unnest(generate_series((SELECT min(week_start) FROM weekly), (SELECT max(week_start) FROM weekly), INTERVAL 7 DAY)) AS DATE) AS week_start) SELECT c.week_start, coalesce(s.postings, 0) AS postings, s.postings IS NOT NULL AS has_observations, s.prev AS compared_with_week, CAST((c.week_start - s.prev) / 7 AS INT) AS weeks_since FROM cal c LEFT JOIN seen s USING (week_start)")
def weekly_spine(spark, d):
    return cohorts.spine(cohorts.weekly_postings(posting(spark, d)))


@query(f"WITH $POSTING, $SIDE, {_WEEKLY} SELECT week_start, rank, skill_id, postings, share_pct FROM (SELECT s.week_start, s.skill_id, s.postings, round(100 * s.postings / w.postings, 4) AS share_pct, row_number() OVER (PARTITION BY s.week_start ORDER BY s.postings DESC, s.skill_id) AS rank FROM wskill s JOIN weekly w USING (week_start)) WHERE rank <= 10")
def weekly_top_skills(spark, d):
    return cohorts.top_skills(*_weekly(spark, d))


@query(f"WITH $POSTING, $SIDE, {_WEEKLY}, seen AS (SELECT week_start, postings AS total, lag(week_start) OVER (ORDER BY week_start) AS prev, lag(postings) OVER (ORDER BY week_start) AS before FROM weekly), g AS (SELECT s.week_start, s.prev, k.skill_id, coalesce(a.postings, 0) AS cur, coalesce(b.postings, 0) AS bef, coalesce(a.postings, 0) / s.total - coalesce(b.postings, 0) / s.before AS delta FROM seen s CROSS JOIN (SELECT DISTINCT skill_id FROM dim_skill) k LEFT JOIN wskill a ON a.week_start = s.week_start AND a.skill_id = k.skill_id LEFT JOIN wskill b ON b.week_start = s.prev AND b.skill_id = k.skill_id WHERE s.prev IS NOT NULL), r AS (SELECT *, round(100 * delta, 4) AS delta_points FROM g WHERE delta <> 0), x AS (SELECT *, CASE WHEN delta_points > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM r WHERE delta_points <> 0) SELECT week_start, prev AS compared_with_week, direction, rank, skill_id, cur AS current_postings, bef AS previous_postings, delta_points FROM (SELECT *, row_number() OVER (PARTITION BY week_start, direction ORDER BY abs(delta_points) DESC, skill_id) AS rank FROM x) WHERE rank <= 5")
def weekly_share_deltas(spark, d):
    return cohorts.share_deltas(*_weekly(spark, d), table(spark, d, "dim_skill"))


@query(f"WITH $POSTING, $SIDE, {_WEEKLY}, s AS (SELECT count(*) AS observed_weeks, min(postings) AS lo, max(postings) AS hi, (max(week_start) - min(week_start)) // 7 + 1 AS cal FROM weekly) SELECT observed_weeks, cal AS calendar_weeks, cal - observed_weeks AS missing_weeks, lo AS min_postings, hi AS max_postings, round(hi / lo, 2) AS volume_ratio FROM s")
def weekly_summary(spark, d):
    return cohorts.summary(cohorts.weekly_postings(posting(spark, d)))


@query("WITH $POSTING, $SIDE, n AS (SELECT count(*) AS n FROM posting) SELECT s.skill_id, count(*) AS postings, round(100 * count(*) / any_value(n.n), 4) AS share_pct FROM said s SEMI JOIN posting p USING (job_id), n GROUP BY s.skill_id ORDER BY postings DESC, s.skill_id LIMIT 20")
def top_skills(spark, d):
    p = posting(spark, d).select("job_id")
    c = side(spark, d).join(p, "job_id", "left_semi").select(F.explode("skill_ids").alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("postings"))
    top = c.orderBy(F.desc("postings"), "skill_id").limit(20)
    return top.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))).select("skill_id", "postings", F.round(100 * F.col("postings") / F.col("n"), 4).alias("share_pct"))


@query()
def stream_weekly_postings(spark, d):
    """The weekly counts as a stream over the table's files, run to its end."""
    name = f"weekly_{abs(hash(d)) % 10**8}"
    weekly.run_to_end(weekly.weekly_counts(weekly.stream_postings(spark, d)), name)
    return spark.table(name)


# audits

_PERIODS = ", ".join(f"'{p}'" for p in audits.PERIODS)
_BOTH = "salary_min IS NOT NULL AND salary_max IS NOT NULL"
_OK = f"upper(trim(coalesce(salary_currency, ''))) IN ('EUR') AND lower(trim(coalesce(salary_period, ''))) IN ({_PERIODS})"


@query(f"SELECT count(*) AS postings, count(salary_min) AS salary_min, count(salary_max) AS salary_max, count(salary_currency) AS salary_currency, count(salary_period) AS salary_period, count(*) FILTER (WHERE salary_min IS NOT NULL OR salary_max IS NOT NULL) AS any_salary_bound, count(*) FILTER (WHERE {_BOTH}) AS complete_intervals, count(*) FILTER (WHERE (salary_min IS NULL) <> (salary_max IS NULL)) AS partial_intervals, count(*) FILTER (WHERE {_BOTH} AND (salary_min < 0 OR salary_max < 0 OR salary_min > salary_max)) AS invalid_numeric_intervals, count(*) FILTER (WHERE {_BOTH} AND NOT ({_OK})) AS unsupported_units, count(*) FILTER (WHERE {_BOTH} AND salary_min >= 0 AND salary_max >= salary_min AND {_OK}) AS valid_intervals, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '') AS {c}" for c in audits.TEXT_FIELDS) + ", count(*) FILTER (WHERE len(normalized_skills) > 0) AS normalized_skills FROM jobs")
def interval_audit(spark, d):
    return audits.intervals(table(spark, d, "jobs"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE len(s.skill_ids) > 0) AS rows_with_skills, coalesce(sum(len(s.skill_ids)), 0)::BIGINT AS assignments, count(DISTINCT s.job_id) AS distinct_ids, count(*) - count(DISTINCT s.job_id) AS duplicate_rows, count(DISTINCT s.job_id) FILTER (WHERE j.k IS NOT NULL) AS matched_ids, count(DISTINCT s.job_id) FILTER (WHERE j.k IS NULL) AS unmatched_ids FROM job_skills s LEFT JOIN (SELECT DISTINCT job_id AS k FROM jobs) j ON j.k = s.job_id")
def sidecar_audit(spark, d):
    return audits.sidecar(table(spark, d, "job_skills"), table(spark, d, "jobs"))


@query("SELECT (SELECT count(DISTINCT job_id) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM job_skills WHERE job_id IS NOT NULL)) AS postings_without_sidecar, (SELECT count(DISTINCT job_id) FROM job_skills WHERE job_id NOT IN (SELECT job_id FROM jobs)) AS sidecar_without_posting")
def orphan_counts(spark, d):
    return audits.orphans(table(spark, d, "jobs"), table(spark, d, "job_skills"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE job_id IS NULL OR trim(job_id) = '') AS rows_without_id, count(job_id) - count(DISTINCT job_id) AS repeated_ids, count(*) FILTER (WHERE primary_language IS NULL OR primary_language NOT IN ('de', 'en')) AS other_languages, count(*) FILTER (WHERE skill_ids IS NULL) AS null_lists, (SELECT count(*) FROM (SELECT g.rowid AS r, unnest(list_distinct(g.skill_ids)) AS s FROM (SELECT row_number() OVER () AS rowid, skill_ids FROM skill_gold_v1) g) u WHERE u.s IS NOT NULL AND u.s NOT IN (SELECT skill_id FROM dim_skill)) AS unknown_skills, coalesce(sum(len(skill_ids)), 0)::BIGINT AS positive_labels FROM skill_gold_v1")
def gold_audit(spark, d):
    return audits.gold(table(spark, d, "skill_gold_v1"), table(spark, d, "dim_skill"))


@query("WITH g AS (SELECT DISTINCT job_id FROM skill_gold_v1), s AS (SELECT job_id, max(coalesce(len(skill_ids), 0)) AS n FROM job_skills GROUP BY 1) SELECT count(*) AS gold_ids, count(s.n) AS in_sidecar, count(*) FILTER (WHERE s.n > 0) AS in_sidecar_with_skills FROM g LEFT JOIN s USING (job_id)")
def gold_leakage(spark, d):
    return audits.leakage(table(spark, d, "skill_gold_v1"), table(spark, d, "job_skills"))


@query("SELECT DISTINCT job_id FROM annotations WHERE job_id NOT IN (SELECT job_id FROM manifest)")
def annotations_outside_manifest(spark, d):
    return audits.outside_manifest(table(spark, d, "annotations"), table(spark, d, "manifest"))


def _annotations(spark, d):
    return table(spark, d, "annotations").withColumn("annotator", F.lower(F.trim("annotator")))


@query("WITH m AS (SELECT DISTINCT job_id, split FROM manifest), t AS (SELECT split, count(DISTINCT job_id) AS total FROM m GROUP BY 1), a AS (SELECT DISTINCT lower(trim(annotator)) AS annotator, job_id FROM annotations WHERE skills IS NOT NULL), n AS (SELECT annotator, split, count(DISTINCT job_id) AS done FROM a JOIN m USING (job_id) GROUP BY 1, 2), pilot AS (SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20261004:pilot:' || job_id), job_id) AS n FROM (SELECT DISTINCT job_id, stratum FROM manifest)) WHERE n <= 16), p AS (SELECT annotator, count(DISTINCT job_id) AS seen FROM a WHERE job_id IN (SELECT job_id FROM pilot) GROUP BY 1) SELECT e.annotator, t.split, coalesce(n.done, 0) AS done, t.total, t.total - coalesce(n.done, 0) AS remaining, (SELECT count(DISTINCT job_id) FROM pilot) - coalesce(p.seen, 0) AS pilot_remaining FROM (SELECT DISTINCT annotator FROM a) e CROSS JOIN t LEFT JOIN n ON n.annotator = e.annotator AND n.split = t.split LEFT JOIN p ON p.annotator = e.annotator")
def annotation_progress(spark, d):
    pilot = sampling.pilot(table(spark, d, "manifest", "job_id", "stratum").distinct())
    return audits.progress(_annotations(spark, d), table(spark, d, "manifest"), pilot)


_REVIEWS = "rev AS (SELECT lower(trim(annotator)) AS annotator, job_id, list_distinct(flatten(list(list_transform(map_keys(skills), lambda k: lower(trim(k)))))) AS ids FROM annotations WHERE skills IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_REVIEWS}, c AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, count(*) AS jobs, sum(len(list_intersect(a.ids, b.ids)))::BIGINT AS \"both\", sum(len(a.ids) - len(list_intersect(a.ids, b.ids)))::BIGINT AS only_a, sum(len(b.ids) - len(list_intersect(a.ids, b.ids)))::BIGINT AS only_b FROM rev a JOIN rev b ON a.job_id = b.job_id AND a.annotator < b.annotator GROUP BY 1, 2), p AS (SELECT *, 1 - (only_a + only_b) / (jobs * 114) AS o, (\"both\" + only_a) / (jobs * 114) AS pa, (\"both\" + only_b) / (jobs * 114) AS pb FROM c), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS x FROM p) SELECT annotator_a, annotator_b, jobs, \"both\", only_a, only_b, round(CASE WHEN x = 1 THEN NULL ELSE (o - x) / (1 - x) END, 6) AS kappa FROM e")
def annotator_kappa(spark, d):
    r = _annotations(spark, d).filter("skills is not null").select("annotator", "job_id", F.transform(F.map_keys("skills"), lambda k: F.lower(F.trim(k))).alias("k"))
    r = r.groupBy("annotator", "job_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("ids"))
    return evaluation.annotator_pairs(r, len(known_skills(spark, d))).withColumn("kappa", F.round("kappa", 6))


@query("WITH t AS (SELECT doc_id, doc_id // 2 AS seg, text, CASE lower(trim(lang)) WHEN 'de' THEN 'de-en' WHEN 'en' THEN 'en-de' ELSE lower(trim(lang)) END AS dir FROM documents), r AS (SELECT doc_id, seg, CASE WHEN doc_id % 13 <> 0 THEN dir END AS direction, CASE WHEN doc_id % 13 = 0 THEN 'invalid_json' WHEN dir IS NULL OR dir NOT IN ('de-en', 'en-de') THEN 'unsupported_direction' WHEN text IS NULL OR trim(text, ' ') = '' THEN 'missing_source' WHEN trim(left(text, 50), ' ') = '' THEN 'missing_reference' WHEN doc_id % 11 = 0 THEN 'missing_hypothesis' END AS reason FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, seg ORDER BY doc_id) AS rn FROM r) SELECT CASE WHEN reason IS NULL AND rn > 1 THEN 'duplicate_segment_id' ELSE reason END AS reason, direction, count(*) AS n FROM n GROUP BY 1, 2")
def translation_pair_audit(spark, d):
    """Documents written as translation-pair lines, some damaged, and audited."""
    t = table(spark, d, "documents", "doc_id", "text", "lang").withColumn("l", F.lower(F.trim("lang")))
    line = F.to_json(F.struct(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 2).cast("long")).alias("segment_id"), F.when(F.col("l") == "de", "de-en").when(F.col("l") == "en", "en-de").otherwise(F.col("l")).alias("direction"), F.col("text").alias("source"), F.substring("text", 1, 50).alias("reference"), F.when(F.col("doc_id") % 11 != 0, F.lit("x")).alias("hypothesis")))
    lines = t.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 13 == 0, F.lit("{broken")).otherwise(line).alias("value"))
    return audits.pair_lines(lines).groupBy("reason", "direction").agg(F.count(F.lit(1)).alias("n"))


# sampling


@query("WITH $POSTING SELECT CASE WHEN substr(sha256('20261004:split:' || job_id), 1, 8) < '66666666' THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM posting GROUP BY 1")
def hash_split_counts(spark, d):
    return posting(spark, d).groupBy(ids.split(F.col("job_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


_SAMPLE = f"""frame AS (SELECT p.job_id, len(s.skill_ids) > 0 AS hit, {_GUESS.format(c='p.description')} AS lang, md5('20261004' || p.job_id) AS o FROM posting p JOIN side s USING (job_id) WHERE p.description IS NOT NULL AND length(p.description) > 300 ORDER BY o, job_id LIMIT 8000),
gold AS (SELECT DISTINCT job_id FROM skill_gold_v1 WHERE job_id IS NOT NULL),
first AS (SELECT job_id, lang || '_sidecar_' || CASE WHEN hit THEN 'hit' ELSE 'empty' END AS stratum, lang AS heuristic_language FROM (SELECT *, row_number() OVER (PARTITION BY lang, hit ORDER BY o, job_id) AS n FROM frame WHERE job_id NOT IN (SELECT job_id FROM gold)) WHERE n <= 30),
odd AS (SELECT job_id FROM (SELECT job_id FROM posting WHERE regexp_matches(description, '(^|[^\\p{{L}}\\p{{N}}_])(Go|R|Spring|Excel)($|[^\\p{{L}}\\p{{N}}_])') ORDER BY md5('20261004' || job_id), job_id LIMIT 600) WHERE job_id NOT IN (SELECT job_id FROM gold) AND job_id NOT IN (SELECT job_id FROM first) ORDER BY sha256('20261004:' || job_id), job_id LIMIT 60),
picked AS (SELECT * FROM first UNION ALL SELECT job_id, 'ambiguous_token', 'unknown' FROM odd)"""


@query(f"WITH $POSTING, $SIDE, {_SAMPLE} SELECT job_id, CASE WHEN substr(sha256('20261004:split:' || job_id), 1, 8) < '66666666' THEN 'dev' ELSE 'test' END AS split, stratum, heuristic_language FROM picked")
def stratified_sample(spark, d):
    return sampling.stratified(posting(spark, d, "description"), side(spark, d), excluded=table(spark, d, "skill_gold_v1").filter("job_id is not null"))


@query("WITH m AS (SELECT DISTINCT job_id, stratum FROM manifest) SELECT job_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20261004:pilot:' || job_id), job_id) AS n FROM m) WHERE n <= 16")
def pilot_sample(spark, d):
    return sampling.pilot(table(spark, d, "manifest", "job_id", "stratum").distinct()).select("job_id", "stratum")


@query("WITH $POSTING SELECT job_id, title, left(description, 1500) AS description FROM posting WHERE job_id IN (SELECT job_id FROM manifest)")
def reading_pack(spark, d):
    return sampling.reading_pack(table(spark, d, "manifest"), posting(spark, d, "title", "description"))


# vectors

_HALF = "(CASE WHEN substr(sha256(job_id), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE 0 END)"


@query(f"WITH $SIDE, h AS (SELECT {_HALF} AS half, job_id, skill_id FROM said) SELECT a.half, a.skill_id AS a, b.skill_id AS b, count(*) AS n FROM h a JOIN h b ON a.job_id = b.job_id AND a.skill_id < b.skill_id GROUP BY 1, 2, 3")
def cooccurrence_halves(spark, d):
    return vectors.halves(side(spark, d))[1]


_PPMI = "cnt AS (SELECT skill_id, count(*) AS n FROM said GROUP BY 1), prs AS (SELECT a.skill_id AS a, b.skill_id AS b, count(*) AS n_ab FROM said a JOIN said b ON a.job_id = b.job_id AND a.skill_id < b.skill_id GROUP BY 1, 2), ppmi AS (SELECT p.a, p.b, p.n_ab, greatest(0, ln(p.n_ab::DOUBLE * (SELECT count(*) FROM side) / (x.n::DOUBLE * y.n))) AS v FROM prs p JOIN cnt x ON x.skill_id = p.a JOIN cnt y ON y.skill_id = p.b)"
_COS = "vec AS (SELECT a AS i, b AS j, v FROM ppmi WHERE v <> 0 UNION ALL SELECT b, a, v FROM ppmi WHERE v <> 0), nrm AS (SELECT i, sqrt(sum(v * v)) AS n FROM vec GROUP BY 1), dot AS (SELECT x.i AS a, y.i AS b, sum(x.v * y.v) AS d FROM vec x JOIN vec y ON x.j = y.j AND x.i < y.i GROUP BY 1, 2), cos AS (SELECT d.a, d.b, least(1, greatest(0, d.d / (m.n * n.n))) AS c FROM dot d JOIN nrm m ON m.i = d.a JOIN nrm n ON n.i = d.b)"


@query(f"WITH $SIDE, {_PPMI} SELECT a, b, n_ab, round(v, 6) AS ppmi FROM ppmi")
def ppmi(spark, d):
    return vectors.ppmi(*vectors.halves(side(spark, d))).withColumn("ppmi", F.round("ppmi", 6))


@query(f"WITH $SIDE, {_PPMI}, {_COS}, bt AS (SELECT a AS skill_id, b AS related_id, round(c, 6) AS cosine FROM cos UNION ALL SELECT b, a, round(c, 6) FROM cos) SELECT skill_id, rank, related_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY cosine DESC, related_id) AS rank FROM bt) WHERE rank <= 5")
def related_skills(spark, d):
    return vectors.related(vectors.cosine(vectors.symmetric(vectors.ppmi(*vectors.halves(side(spark, d))), "ppmi")))


@query(f"WITH $SIDE, {_PPMI} SELECT a, b, n_ab FROM prs ORDER BY n_ab DESC, a, b LIMIT 30")
def top_pairs(spark, d):
    return vectors.halves(side(spark, d))[1].groupBy("a", "b").agg(F.sum("n").alias("n_ab")).orderBy(F.desc("n_ab"), "a", "b").limit(30)


@query(f"WITH $SIDE, {_PPMI} SELECT k.skill_id FROM (SELECT DISTINCT skill_id FROM dim_skill) k WHERE k.skill_id NOT IN (SELECT a FROM ppmi WHERE v > 0 UNION SELECT b FROM ppmi WHERE v > 0)")
def skills_without_vector(spark, d):
    v = vectors.symmetric(vectors.ppmi(*vectors.halves(side(spark, d))), "ppmi").select(F.col("i").alias("skill_id")).distinct()
    return table(spark, d, "dim_skill", "skill_id").distinct().join(v, "skill_id", "left_anti")


@query()
def skill_clusters(spark, d):
    r = vectors.cluster_report(side(spark, d), table(spark, d, "dim_skill").orderBy("skill_id"))
    return spark.createDataFrame([(i, s, r["silhouette"], r["split_half_ari"]) for i, g in enumerate(r["clusters"]) for s in g], "cluster int, skill_id string, silhouette double, split_half_ari double")


@query(f"WITH g AS (SELECT lower(trim(lang)) AS a, {_GUESS.format(c='text')} AS b FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), c AS (SELECT a, b, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS cell, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((cell - x.v * y.v / (t * (t - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (t * (t - 1) / 2)), 6) AS ari FROM s, x, y")
def language_ari(spark, d):
    """Agreement of stated languages and guesses as partitions."""
    g = table(spark, d, "documents", "text", "lang").filter("text is not null and lang is not null").select(F.lower(F.trim("lang")).alias("a"), text.guess_language(F.col("text")).alias("b"))
    return evaluation.adjusted_rand(g, "a", "b").select(F.round("ari", 6).alias("ari"))
