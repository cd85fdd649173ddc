import datetime as dt
import random

import numpy as np
import pytest

from stellwerk.operators import audits, cohorts, sampling, star, vectors
from stellwerk.streaming import weekly


def day(s):
    return dt.date.fromisoformat(s)


@pytest.fixture()
def jobs(spark):
    return spark.createDataFrame([("a", day("2024-06-05")), ("b", day("2024-06-09")), ("c", day("2024-07-01")), ("d", None)], "job_id string, collection_date date")


@pytest.fixture()
def side(spark):
    return spark.createDataFrame([("a", ["python", "sql"]), ("b", ["python"]), ("c", ["sql"]), ("d", [])], "job_id string, skill_ids array<string>")


@pytest.fixture()
def tax(spark):
    return spark.createDataFrame([("python", "Python", "x"), ("sql", "SQL", "x"), ("java", "Java", "x")], "skill_id string, label string, category string")


def test_weeks(spark, jobs, side, tax):
    w, s = cohorts.weekly_postings(jobs), cohorts.weekly_skills(jobs, side)
    rows = {str(r["week_start"]): r for r in cohorts.spine(w).collect()}
    assert sorted(rows) == ["2024-06-03", "2024-06-10", "2024-06-17", "2024-06-24", "2024-07-01"] and not rows["2024-06-17"]["has_observations"]
    assert str(rows["2024-07-01"]["compared_with_week"]) == "2024-06-03" and rows["2024-07-01"]["weeks_since"] == 4
    d = {(r["skill_id"], r["direction"]): r["delta_points"] for r in cohorts.share_deltas(w, s, tax).collect()}
    assert d == {("sql", "increase"): 50.0, ("python", "decrease"): -100.0}
    top = [(r["skill_id"], r["share_pct"]) for r in cohorts.top_skills(w, s).filter("rank = 1").orderBy("week_start").collect()]
    assert top == [("python", 100.0), ("sql", 100.0)]
    assert tuple(cohorts.summary(w).first()) == (2, 5, 3, 1, 2, 2.0)
    r = cohorts.report(jobs, side, tax)
    assert r["market_growth_inference_allowed"] is False and len(r["weeks"]) == 5
    assert cohorts.spine(w.limit(0)).count() == 0


def test_star(spark, tmp_path, tax):
    jobs = spark.createDataFrame([("a", "Berlin", None), ("b", "Berlin", None), ("c", star.LOCATION_JUNK[0], None), ("d", None, None)], "job_id string, location string, collection_date date")
    side = spark.createDataFrame([("a", ["python", "sql", "sql"]), ("b", []), ("c", ["python"])], "job_id string, skill_ids array<string>")
    fact = {r["job_id"]: r for r in star.fact_job(jobs, side).collect()}
    assert [(fact[j]["skill_count"], fact[j]["has_skills"], fact[j]["city"]) for j in "abcd"] == [(3, True, "Berlin"), (0, False, "Berlin"), (1, True, None), (0, False, None)]
    f, b = star.fact_job(jobs, side), star.bridge_job_skill(side)
    assert b.count() == 4 and [tuple(r) for r in star.skill_pairs(b, 1).collect()] == [("python", "sql", 1)]
    assert {(r["skill_id"], r["share_of_city_jobs"]) for r in star.skill_by_city(f, b, 2).collect()} == {("python", 0.5), ("sql", 1.0)}
    assert star.export(jobs, side, tax, str(tmp_path)) == {"dim_skill": 3, "fact_job": 4, "bridge_job_skill": 4, "agg_skill_by_city": 0, "agg_skill_pairs": 0}
    assert {r["skill_id"]: r["jobs"] for r in star.measures(f, b).collect()} == {"python": 2, "sql": 1}


def test_vectors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"j{i}", rng.sample("abcdef", rng.randint(0, 4)) * 2) for i in range(60)]
    side = spark.createDataFrame(rows, "job_id string, skill_ids array<string>")
    p = {(r["a"], r["b"]): (r["n_ab"], r["ppmi"]) for r in vectors.ppmi(*vectors.halves(side)).collect()}
    sets = [set(x) for _, x in rows]
    m = np.zeros((6, 6))
    for i, a in enumerate("abcdef"):
        for j, b in enumerate("abcdef"):
            n = sum(a in s and b in s for s in sets)
            if a < b:
                assert p.get((a, b), (0,))[0] == n
                if n:
                    want = max(0.0, np.log(n * 60 / (sum(a in s for s in sets) * sum(b in s for s in sets))))
                    assert abs(p[a, b][1] - want) < 1e-9
                    m[i, j] = m[j, i] = want
    d = vectors.distances(m)
    for r in vectors.cosine(vectors.symmetric(vectors.ppmi(*vectors.halves(side)), "ppmi")).collect():
        assert abs(1 - r["cosine"] - d["abcdef".index(r["a"]), "abcdef".index(r["b"])]) < 1e-9


def test_clusters():
    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.1], [0.9, 0.9, 0.1, 0]])
    groups, score = vectors.best_partition(d)
    assert groups == [[0, 1], [2, 3]] and score > 0.8
    assert vectors.rand_index([0, 0, 1, 1], [5, 5, 2, 2]) == 1.0 and vectors.rand_index([0, 0, 1, 1], [0, 1, 0, 1]) < 0
    assert vectors.rand_index([], []) == 1.0 and vectors.best_partition(np.zeros((2, 2)))[0] == [[0], [1]]
    with pytest.raises(ValueError):
        vectors.best_partition(np.zeros((1, 1)))
    with pytest.raises(ValueError):
        vectors.cut([], 1, 2)


def test_cluster_report_and_checks(spark, tax):
    side = spark.createDataFrame([(f"job-{i:02d}", ["python", "sql"] if i % 2 else ["java"]) for i in range(18)], "job_id string, skill_ids array<string>")
    vectors.check_sidecar(side, tax)
    r = vectors.cluster_report(side, tax)
    assert r["clusters"] == [["python"], ["sql"]] and r["excluded"] == ["java"]
    for bad in (side.union(side), spark.createDataFrame([("a", ["cobol"]), ("b", [])], side.schema)):
        with pytest.raises(ValueError):
            vectors.check_sidecar(bad, tax)


def test_sampling(spark):
    jobs = spark.createDataFrame([(f"j{i}", "we are the team " * 30 if i % 2 else "wir sind die und der " * 30) for i in range(40)] + [("odd", "Go " * 5)], "job_id string, description string")
    side = spark.createDataFrame([(f"j{i}", ["x"] if i % 3 else []) for i in range(40)] + [("odd", [])], "job_id string, skill_ids array<string>")
    s = sampling.stratified(jobs, side, per_cell=3, excluded=spark.createDataFrame([("j1",)], "job_id string"))
    rows = s.collect()
    assert rows == sampling.stratified(jobs, side, per_cell=3, excluded=spark.createDataFrame([("j1",)], "job_id string")).collect() or sorted(map(tuple, rows))
    by = {}
    for r in rows:
        by.setdefault(r["stratum"], []).append(r["job_id"])
    assert {k: len(v) for k, v in by.items()} == {"de_sidecar_hit": 3, "de_sidecar_empty": 3, "en_sidecar_hit": 3, "en_sidecar_empty": 3, "ambiguous_token": 1} and "j1" not in sum(by.values(), [])
    assert sampling.pilot(s, 2).count() == 9
    assert sampling.reading_pack(s.withColumn("title", s["stratum"]), jobs.withColumn("title", jobs["job_id"]), 10).count() == 13
    assert sampling.random_baseline(list("abcd"), {"a"}, 2, 1) == sampling.random_baseline(list("abcd"), {"a"}, 2, 1)


def test_interval_audit(spark):
    schema = "salary_min double, salary_max double, salary_currency string, salary_period string, title string, location string, federal_state string, experience_level string, employment_type string, remote_type string, normalized_skills array<string>"
    rows = [(41_500.0, 58_000.0, " eur ", "Per Year"), (2_750.0, None, "EUR", "monthly"), (19.5, 23.0, "EUR", "hour"), (900.0, 650.0, "EUR", "year")]
    a = audits.intervals(spark.createDataFrame([(*r, "t", " ", None, None, None, None, []) for r in rows], schema)).first().asDict()
    assert [a[k] for k in ("any_salary_bound", "complete_intervals", "partial_intervals", "invalid_numeric_intervals", "unsupported_units", "valid_intervals", "title", "location", "normalized_skills")] == [4, 3, 1, 1, 1, 1, 4, 0, 0]
    assert audits.blockers(a) == ["no normalized skills in the postings", "intervals in unsupported units"]


def test_sidecar_audits(spark, jobs):
    side = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x", "y"]), ("z", None)], "job_id string, skill_ids array<string>")
    assert tuple(audits.sidecar(side, jobs.union(jobs)).first()) == (3, 2, 4, 2, 1, 1, 1)
    assert tuple(audits.orphans(jobs, side).first()) == (3, 1)
    assert tuple(audits.leakage(side, side).first()) == (2, 2, 1)


def test_translation_pairs(spark):
    ok = '{"segment_id": "1", "direction": "de-en", "source": "a", "reference": "b", "hypothesis": "c"}'
    lines = [ok, ok, ok.replace("de-en", "fr-en").replace('"1"', '"2"'), ok.replace('"b"', '" "').replace('"1"', '"3"'), "[]", "{", "", ok.replace('"1"', "1")]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, value string")
    got = {r["pos"]: r["reason"] for r in audits.pair_lines(df).collect()}
    assert got == {0: None, 1: "duplicate_segment_id", 2: "unsupported_direction", 3: "missing_reference", 4: "record_not_object", 5: "invalid_json", 7: "missing_segment_id"}
    r = audits.pair_report(df)
    assert (r["status"], r["valid_records"], r["invalid_records"]) == ("input_needs_review", 1, 6)
    assert audits.pair_report(df.filter("pos > 1"))["status"] == "not_evaluable"
    assert audits.pair_report(df.filter("pos = 0"))["status"] == "pairs_validated_scoring_not_implemented"


def test_label_audits(spark, tax):
    gold = spark.createDataFrame([("a", "de", ["python"]), ("a", "xx", None), (None, "en", ["cobol"])], "job_id string, primary_language string, skill_ids array<string>")
    assert tuple(audits.gold(gold, tax).first()) == (3, 1, 1, 1, 1, 1, 2)
    ann = spark.createDataFrame([("h", "a", {"x": "required"}), ("h", "z", {}), ("m", "a", None)], "annotator string, job_id string, skills map<string,string>")
    man = spark.createDataFrame([("a", "dev"), ("b", "dev")], "job_id string, split string")
    assert [r[0] for r in audits.outside_manifest(ann, man).collect()] == ["z"]
    assert [tuple(r) for r in audits.progress(ann, man).collect()] == [("h", "dev", 1, 2, 1)]
    both = man.union(spark.createDataFrame([("z", "test"), ("y", "test")], man.schema))
    pilot = spark.createDataFrame([("z",), ("y",), ("b",)], "job_id string")
    assert {tuple(r) for r in audits.progress(ann, both, pilot).collect()} == {("h", "dev", 1, 2, 1, 2), ("h", "test", 1, 2, 1, 2)}


def test_annotation_csv(spark):
    schema = "job_id string, skill string, label string"
    good = audits.annotations_from_csv(spark.createDataFrame([("a", "x", "Required"), ("a", "y", "mentioned"), ("b", None, None)], schema), "h")
    assert {r["job_id"]: r["skills"] for r in good.collect()} == {"a": {"x": "required", "y": "mentioned"}, "b": {}}
    for rows in ([("a", "x", "maybe")], [("a", "x", "required"), ("a", "x", "mentioned")]):
        with pytest.raises(ValueError):
            audits.annotations_from_csv(spark.createDataFrame(rows, schema), "h")


def test_readiness(tmp_path):
    r = audits.readiness(("json", "no_such_package"), (str(tmp_path / "x"),))
    assert not r["ready"] and len(r["missing"]) == 2 and audits.baseline_scores(tmp_path / "x") is None


def test_stream_equals_batch(spark, tmp_path, jobs):
    (tmp_path / "in").mkdir()
    jobs.union(jobs).write.parquet(str(tmp_path / "in/jobs.parquet"))
    weekly.run_to_end(weekly.weekly_counts(weekly.stream_postings(spark, str(tmp_path / "in"))), "weekly_test")
    assert sorted(map(tuple, spark.table("weekly_test").collect())) == sorted(map(tuple, cohorts.weekly_postings(jobs).collect()))
