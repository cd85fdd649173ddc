import math
import random

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import evaluation, lexicon, matching, skillsets
from tests.test_lexicon import skill

ROWS = [("a", ["python", "sql", "java"]), ("b", ["python"]), ("c", ["sql", "java"]), ("d", ["python", "sql"]), ("e", ["java"]), ("f", []), ("g", None)]


@pytest.fixture()
def side(spark):
    return spark.createDataFrame(ROWS, "job_id string, skill_ids array<string>")


def test_rank(side):
    r = matching.rank(side, ["python", "sql"], 3).orderBy("rank").collect()
    assert [x["job_id"] for x in r] == ["d", "a", "b"] and [x["match_score"] for x in r][:2] == [1.0, 0.8]
    assert r[1]["gap_skills"] == ["java"] and r[2]["candidate_skills_not_in_job"] == ["sql"] and r[0]["requirement_status"] == "unverified"
    g = matching.gaps(matching.rank(side, ["python", "sql"], 3), matching.corpus_counts(side)).collect()
    assert [(x["job_id"], x["skill_id"], x["corpus_posting_count"]) for x in g] == [("a", "java", 3)]


def test_counters_and_exclusion(side):
    assert tuple(matching.counters(side, ["python", "sql"], ["d"]).first()) == (7, 1, 4, 3)
    assert [x["job_id"] for x in matching.rank(side, ["python", "sql"], 2, excluded=["d"]).orderBy("rank").collect()] == ["a", "b"]


def test_bad_input(side):
    for args in (([], 3), (["python"], 0), (["cobol"], 1)):
        with pytest.raises(ValueError):
            matching.rank(side, *args, known={"python"})


def test_f1_is_twice_the_matches_over_the_sizes(side):
    for r in matching.rank(side, ["python", "sql", "x"], 9).collect():
        assert r["harmonic_f1"] == round(2 * r["matched_skill_count"] / (r["candidate_skill_count"] + r["job_skill_count"]), 6)


def test_evidence(spark, side):
    tax = lexicon.Taxonomy.parse({"version": "1", "skills": [skill("java", "Java"), skill("python", "Python"), skill("sql", "SQL")]})
    jobs = spark.createDataFrame([("a", "Java expert", "We use Java.\nAnd java."), ("b", None, None)], "job_id string, title string, description string")
    g = matching.gaps(matching.rank(side, ["python", "sql"], 3), matching.corpus_counts(side))
    r = matching.gap_evidence(g, jobs, tax, width=5).collect()
    assert r[0]["occurrences_in_ad"] == 3 and len(r[0]["snippets"]) == 2 and r[0]["snippets"][0].startswith("Java")


def test_many_queries_and_metrics(spark, side):
    q = spark.createDataFrame([("q", ["python", "sql"]), ("z", ["cobol"])], "query_id string, candidate_skill_ids array<string>")
    r = matching.rank_queries(q, side, 3)
    assert [x["job_id"] for x in r.orderBy("rank").collect()] == ["d", "a", "b"]
    ranked = spark.createDataFrame([("q", j, i) for i, j in enumerate("abc", 1)], "query_id string, job_id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, job_id string")
    m = evaluation.binary_ranking(ranked, rel, 2).first()
    assert (m["precision_at_k"], m["recall_at_k"], m["mrr"], round(m["ndcg_at_k"], 6)) == (0.5, 0.5, 0.5, 0.386853)
    grades = spark.createDataFrame([("q", "a", 0), ("q", "b", 2), ("q", "c", 1)], "query_id string, job_id string, grade int")
    g = evaluation.graded_ranking(ranked, grades, 3).first()
    assert (round(g["precision_at_k"], 6), g["mrr"], g["recall_at_k_pooled"]) == (0.333333, 0.5, 1.0)


def test_query_checks(spark):
    known = spark.createDataFrame([("x",)], "skill_id string")
    schema = "query_id string, candidate_id string, split string, candidate_skill_ids array<string>"
    matching.check_queries(spark.createDataFrame([("1", "c", "dev", ["x"])], schema), known)
    for rows in ([("1", "c", "dev", ["x"]), ("1", "d", "dev", ["x"])], [("1", "c", "no", ["x"])], [("1", "c", "dev", ["x"]), ("2", "c", "test", ["x"])], [("1", "c", "dev", ["y"])]):
        with pytest.raises(ValueError):
            matching.check_queries(spark.createDataFrame(rows, schema), known)


def test_pool_is_repeatable_and_without_the_source(spark, side):
    q = spark.createDataFrame([("q", ["python"], "e")], "query_id string, candidate_skill_ids array<string>, source_job_id string")
    a, b = matching.pool(q, side, 2, 1), matching.pool(q, side, 2, 1)
    assert a == b and "e" not in a[0]["random"] and not set(a[0]["matcher"]) & set(a[0]["random"])


def test_pools_leave_the_source_to_neither_side(spark, side):
    """The source posting is the matcher's best answer, and the next one takes its place; a query without matches has a pool."""
    q = spark.createDataFrame([("q", ["python", "sql"], "d"), ("r", ["cobol"], "a"), ("s", ["python"], None)], "query_id string, candidate_skill_ids array<string>, source_job_id string")
    got = {r["query_id"]: r for r in matching.pools(q, side, 2, 1).collect()}
    assert got["q"]["matcher"] == ["a", "b"] and got["r"]["matcher"] == [] and got["s"]["matcher"] == ["b", "d"]
    for i, source in (("q", "d"), ("r", "a"), ("s", None)):
        r = got[i]
        assert source not in r["jobs"] and len(r["random"]) == 2 and sorted(r["jobs"]) == sorted(r["matcher"] + r["random"])


def test_match_pool_has_every_gold_query(spark, tmp_path):
    from stellwerk.plans import reports

    gold = [(f"j{i:03}", ["python"]) for i in range(70)]
    spark.createDataFrame(gold, "job_id string, skill_ids array<string>").write.parquet(f"{tmp_path}/skill_gold_v1.parquet")
    spark.createDataFrame(gold, "job_id string, skill_ids array<string>").write.parquet(f"{tmp_path}/job_skills.parquet")
    spark.createDataFrame([("python", "Python", "x")], "skill_id string, label string, category string").write.parquet(f"{tmp_path}/dim_skill.parquet")
    rows = reports.match_pool(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in rows} == {j for j, _ in gold} and not [r for r in rows if r["query_id"] == r["job_id"]]
    assert max(r["place"] for r in rows) == 20 and len(rows) == 70 * 20


def test_scores_kappa_bootstrap(spark):
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "job_id string, skill_id string")
    pred = spark.createDataFrame([("a", "x"), ("b", "z")], "job_id string, skill_id string")
    r = evaluation.precision_recall(evaluation.confusion(gold, pred, ["job_id", "skill_id"])).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], round(r["recall"], 4)) == (1, 1, 2, 0.5, 0.3333)
    empty = spark.createDataFrame([], "job_id string, skill_id string")
    assert evaluation.precision_recall(evaluation.confusion(empty, empty, ["job_id", "skill_id"])).first()["f1"] == 0.0
    rev = spark.createDataFrame([("h", "1", ["x"]), ("h", "2", []), ("m", "1", ["x"]), ("m", "2", [])], "annotator string, job_id string, ids array<string>")
    pairs = evaluation.annotator_pairs(rev, 5)
    assert pairs.first()["kappa"] == 1.0 and evaluation.review_status(pairs, 2) == "insufficient_overlap" and evaluation.review_status(pairs, 2, 2) == "multi_annotator_reviewed"
    counts = [(3, 1, 1), (0, 2, 1), (5, 0, 0)]
    assert evaluation.bootstrap(counts, 7) == evaluation.bootstrap(counts, 7)


def test_rand_index(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 6, 1), (2, 6, 2)], "a int, b int, c int")
    assert evaluation.adjusted_rand(df, "a", "b").first()["ari"] == 1.0 and evaluation.adjusted_rand(df, "a", "c").first()["ari"] < 0


def test_matching_report_and_its_gates(spark):
    n = 24
    queries = spark.createDataFrame([(f"q{i}", f"own{i}") for i in range(n)], "query_id string, source_job_id string")
    pools = spark.createDataFrame([(f"q{i}", ["a", "b", "c"], ["d", "a", "e"]) for i in range(n)], "query_id string, matcher array<string>, random array<string>")
    grade = {"a": 3, "b": 2, "c": 0, "d": 0, "e": 1}
    rows = [(f"q{i}", j, g) for i in range(n) for j, g in grade.items()]
    sheet = lambda rows: spark.createDataFrame(rows, "query_id string, job_id string, grade int")
    r = evaluation.matching_report(queries, sheet(rows), pools, 3, 7)
    assert (r["status"], r["queries_fully_judged"]) == ("scored", n)
    m, d = r["systems"]["matcher"], r["systems"]["random"]
    assert m["precision_at_k"][0] == pytest.approx(2 / 3) and m["mrr"] == (1.0, 1.0, 1.0) and m["recall_at_k_pooled"][0] == 1.0
    gain = lambda gs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gs))
    assert d["ndcg_at_k"][0] == pytest.approx(gain([0, 3, 1]) / gain([3, 2, 1])) and m["ndcg_at_k"][0] == pytest.approx(gain([3, 2, 0]) / gain([3, 2, 1]))
    open_ = [(q, j, None if q in ("q1", "q2", "q3", "q4", "q5") and j == "c" else g) for q, j, g in rows]
    few = evaluation.matching_report(queries, sheet(open_), pools, 3, 7)
    assert few["status"] == "insufficient_labels" and few["queries_fully_judged"] == n - 5 and "systems" not in few
    with pytest.raises(ValueError, match="unknown query"):
        evaluation.matching_report(queries, sheet([*rows, ("zz", "a", 1)]), pools, 3, 7)
    with pytest.raises(ValueError, match="grade"):
        evaluation.matching_report(queries, sheet([*rows, ("q1", "f", 4)]), pools, 3, 7)
    with pytest.raises(ValueError, match="own ranking"):
        evaluation.matching_report(queries.withColumn("source_job_id", F.lit("e")), sheet(rows), pools, 3, 7)


def test_profiles_in_taxonomy_order_and_strict_sidecars(spark):
    side = spark.createDataFrame([("a", ["z", "y", "x"]), ("b", ["x", "odd"])], "job_id string, skill_ids array<string>")
    assert matching.rank(side, ["z", "x"], 1, ["x", "y", "z"]).first()["matched_skills"] == ["x", "z"]
    with pytest.raises(ValueError, match="odd"):
        matching.rank(side, ["x"], 1, ["x", "y", "z"], strict=True)
    assert evaluation.macro_means(spark.createDataFrame([(0.5,), (0.25,), (0.0,)], "m double"), ("m",)).first().asDict() == {"queries_evaluated": 3, "m": 0.25}


def _brute_force(queries, side, k):
    """The k best postings of each query by every pair."""
    out = {}
    for query, wanted, own in queries:
        rows = []
        for job, skills in side:
            s, c = set(skills or []), set(wanted)
            if (m := len(s & c)) and job != own:
                p, v = m / len(c), m / len(s)
                rows.append((-round(2 * p * v / (p + v), 6), -round(v, 6), job))
        out[query] = [(job, -f1) for f1, _, job in sorted(rows)[:k]]
    return out


def _random_sets(seed, n, most):
    rng = random.Random(seed)
    return [rng.sample("abcdefghij", rng.randint(0, most)) for _ in range(n)]


@pytest.mark.parametrize("cells", [10**6, 300])
def test_best_postings_are_those_of_all_pairs(spark, monkeypatch, cells):
    """One shard of the index and several; ties by id, hot sets, own postings, skills that no posting has, duplicate skills."""
    monkeypatch.setattr(skillsets, "CELLS", cells)
    side = [(f"j{i * 7919 % 1000:03}", s) for i, s in enumerate(_random_sets(1, 400, 5))] + [(f"h{i:02}", ["a", "a"]) for i in range(30)] + [("n", None)]
    queries = [(f"q{i}", [*c, *(["none"] if i % 5 == 0 else [])], side[i][0] if i % 3 else None) for i, c in enumerate(_random_sets(2, 60, 4))] + [("own", ["a"], "h03"), ("same", ["a"], "h04")]
    q = spark.createDataFrame(queries, "query_id string, candidate_skill_ids array<string>, source_job_id string")
    s = spark.createDataFrame(side, "job_id string, skill_ids array<string>")
    got = {query: [] for query, *_ in queries}
    for r in matching.rank_queries(q, s, 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["job_id"], r["harmonic_f1"]))
    assert got == _brute_force(queries, side, 4)
    pairs = {query: [len(set(c) & set(x or [])) for _, x in side] for query, c, _ in queries}
    for r in matching.answered(q, s, 4, grades=True).collect():
        assert [r["n1"], r["n2"], r["n3"]] == [sum(m >= g for m in pairs[r["query_id"]]) for g in (1, 2, 3)]


def _shuffled(spark):
    """Rows written to shuffles in this session."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def shared(tmp_path_factory, spark):
    """700 gold postings of 700 sets that all share a skill: 490,000 pairs."""
    d = str(tmp_path_factory.mktemp("shared"))
    rows = [(f"j{i:03}", ["a", f"s{i % 26}", f"t{i // 26}", f"u{i}"]) for i in range(700)]
    for name in ("skill_gold_v1", "job_skills"):
        spark.createDataFrame(rows, "job_id string, skill_ids array<string>").repartition(4).write.parquet(f"{d}/{name}.parquet")
    spark.createDataFrame([(s, s, "x") for s in sorted({s for _, x in rows for s in x})], "skill_id string, label string, category string").write.parquet(f"{d}/dim_skill.parquet")
    return d


def _in_few_rows(spark, shared, name):
    """A query's rows, which must take fewer shuffled rows than a quarter of the pairs, as where no table is small enough to be sent."""
    from stellwerk.plans import reports

    before, bounds = _shuffled(spark), ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for bound in bounds:
        spark.conf.set(bound, "-1")
    try:
        rows = getattr(reports, name)(spark, shared).collect()
    finally:
        for bound in bounds:
            spark.conf.unset(bound)
    assert _shuffled(spark) - before < 490_000 / 4
    return rows


def test_match_pool_has_no_table_of_pairs(spark, shared):
    rows = _in_few_rows(spark, shared, "match_pool")
    assert len({r["query_id"] for r in rows}) == 700 and max(r["place"] for r in rows) == 20


def test_rank_many_queries_has_no_table_of_pairs(spark, shared):
    rows = _in_few_rows(spark, shared, "rank_many_queries")
    assert len(rows) == 7000 and all(r["job_id"] == r["query_id"] and r["harmonic_f1"] == 1 for r in rows if r["rank"] == 1)


def test_ranking_metrics_binary_has_no_table_of_pairs(spark, shared):
    rows = _in_few_rows(spark, shared, "ranking_metrics_binary")
    assert [tuple(r)[1:] for r in rows] == [(0.1, 1.0, 1.0, 1.0)] * 700


def test_matching_report_has_no_table_of_pairs(spark, shared):
    rows = _in_few_rows(spark, shared, "matching_report")
    assert len(rows) == 8 and {(r["status"], r["queries"]) for r in rows} == {("scored", 700)}


def test_resampled_means_are_those_of_pythons_generator():
    rng = random.Random(3)
    rows = [[rng.random(), 1.0] for _ in range(50)]
    draw = random.Random(7)
    means = sorted(sum(draw.choices([a for a, _ in rows], k=50)) / 50 for _ in range(1000))
    assert evaluation.mean_intervals(rows, 7) == [(sum(a for a, _ in rows) / 50, means[25], means[974]), (1.0, 1.0, 1.0)]


def test_ranking_macro_means_has_no_table_of_pairs(spark, shared):
    assert tuple(_in_few_rows(spark, shared, "ranking_macro_means")[0]) == (700, 0.1, 1.0, 1.0, 1.0)


def test_ranking_metrics_graded_has_no_table_of_pairs(spark, shared):
    rows = _in_few_rows(spark, shared, "ranking_metrics_graded")
    assert len(rows) == 700 and all(r["precision_at_k"] == 1 and r["mrr"] == 1 for r in rows)
