import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import ingest
from stellwerk.schema import require_columns, require_one_to_one, require_values
from stellwerk.sources import readers, writers

RECORDS = [
    17,
    {"position": "Bäckerin &ndash; Nachtschicht", "employer": "Ofen &amp; Korn KG", "url": "https://ofenkorn.invalid/s/7", "about_work": '{"city": "Steinhafen"}', "date_scrape": "03.11.2024", "info_1": "Fragen? nacht@ofenkorn.invalid, sonst 0171 555 0199.", "shift": [1, 2]},
    {"job_title": "   ", "employer": "Ofen &amp; Korn KG"},
    {"position": "B&auml;ckerin, zweite Lieferung", "employer": "Ofen &amp; Korn KG", "url": "HTTPS://OFENKORN.INVALID/s/7", "about_work": {"city": "Steinhafen"}},
    {"job_title": "Fahrer", "company": "Kurier Nord", "location": "Salzdorf", "description": "Touren im Umland."},
]


@pytest.fixture()
def records(spark, tmp_path):
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("lieferung/stellen.json", json.dumps(RECORDS))
        z.writestr("lieferung/liesmich.txt", "Stand November")
    assert readers.archive_to_lines(archive, tmp_path / "r.jsonl") == 5
    return readers.read_records(spark, str(tmp_path / "r.jsonl"))


def test_archive_to_postings(records):
    rows = {r["company"]: r for r in ingest.ingest(records, "stellen").collect()}
    assert set(rows) == {"Ofen & Korn KG", "Kurier Nord"}
    r = rows["Ofen & Korn KG"]
    assert (r["title"], r["location"], str(r["collection_date"]), r["publication_date"], r["source"]) == ("Bäckerin – Nachtschicht", "Steinhafen", "2024-11-03", None, "stellen")
    assert r["description"] == "Fragen? [EMAIL REDACTED], sonst [PHONE REDACTED]."
    s = ingest.statistics(records, "stellen").first()
    assert s.asDict() == {"records_read": 5, "records_valid": 3, "records_invalid": 2, "records_output": 2, "duplicates": 1, "email_redactions": 1, "phone_redactions": 1}
    assert {r["reason"]: r["n"] for r in ingest.reject_reasons(records, "stellen").collect()} == {"missing_title": 1, "invalid_source_record": 1}


def test_quality_report(records, tmp_path):
    written = ingest.ingest(records, "stellen")
    q = ingest.quality_report(records, written, "stellen")
    assert q["passed"] and q["field_coverage"]["title"]["fraction"] == 1.0 and q["field_coverage"]["embedding"]["non_null"] == 0
    writers.write_report(q, "Quality", tmp_path / "q.json")
    assert "residual" in json.loads((tmp_path / "q.json").read_text()) and (tmp_path / "q.md").read_text().startswith("# Quality")


def test_plain_json_and_bad_archives(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS))
    assert readers.archive_to_lines(tmp_path / "a.json", tmp_path / "o.jsonl") == 5
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.archive_to_lines(tmp_path / "b.json", tmp_path / "o.jsonl")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.json", "[]")
        z.writestr("b.json", "[]")
    with pytest.raises(ValueError):
        readers.archive_to_lines(tmp_path / "two.zip", tmp_path / "o.jsonl")


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_items_are_the_same_at_any_block_size(size):
    import io

    items = [1, 23.5, "a]\\\" [", None, True, {"k": [1, {"x": "ä"}]}, [], {}, "z" * 300]
    for text in (json.dumps(items), "  [ " + " ,\n ".join(json.dumps(x) for x in items) + "\n] ", "[]"):
        assert list(readers._items(io.StringIO(text), size)) == (items if len(text) > 2 else [])
    for bad in ("{}", "[1, 2", "[1, tru]"):
        with pytest.raises(ValueError):
            list(readers._items(io.StringIO(bad), size))


def test_unavailable_analyses(spark):
    schema = "publication_date date, federal_state string, remote_type string, salary_min double, salary_max double, language_requirements array<string>"
    df = spark.createDataFrame([(None, " ", None, None, 5.0, []), (None, None, "remote", None, None, None)], schema)
    got = {r["analysis"]: r["reason"] for r in ingest.unavailable_analyses(df).collect()}
    assert set(got) == {"publication_week_trends", "geographic_trends", "language_requirements", "job_family_volume"} and got["geographic_trends"] == "federal_state has no populated values"
    assert "salary_trends" in {r["analysis"] for r in ingest.unavailable_analyses(df.limit(0)).collect()}


def test_dedup_is_idempotent_and_ordered(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "first"), ("b", 2, "x"), (None, 1, "n"), (None, 2, "m")], "k string, pos int, v string")
    once = ingest.first_wins(df, F.col("k"), [F.col("pos")])
    assert {r["v"] for r in once.collect()} == {"first", "x", "n"}
    assert ingest.first_wins(once, F.col("k"), [F.col("pos")]).count() == 3


def test_coverage_of_an_empty_table(spark):
    assert [tuple(r) for r in ingest.coverage(spark.createDataFrame([], "a string")).collect()] == [("a", 0, 0, 0.0)]


def test_checks(spark):
    df = spark.createDataFrame([("a",), ("b",)], "job_id string")
    with pytest.raises(ValueError, match="no column x"):
        require_columns(df, ["x"], "table")
    with pytest.raises(ValueError):
        require_values(spark.createDataFrame([("",)], "job_id string"), ("job_id",), "table")
    require_one_to_one(df, df)
    with pytest.raises(ValueError, match="not one-to-one"):
        require_one_to_one(df, df.union(df))


def test_dataset_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "n int, s string")
    assert writers.dataset_hash(a) == writers.dataset_hash(b) != writers.dataset_hash(a.union(a))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    writers.write_parquet(df, str(tmp_path / "p"))
    writers.write_lines(df, str(tmp_path / "j"))
    line = "".join(f.read_text() for f in (tmp_path / "j").glob("*.json")).strip()
    assert line == '{"a":"x","b":1}' and spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "f").write_bytes(b"x" * 3_000_000)
    assert len(readers.sha256_file(tmp_path / "f")) == 64
