import pytest
from pyspark.sql import functions as F

from stellwerk.operators import lexicon


def skill(id, *aliases, strict=()):
    return {"id": id, "label": aliases[0], "category": "c", "aliases": list(aliases), "case_sensitive_aliases": list(strict)}


TAXONOMY = lexicon.Taxonomy.parse({
    "version": "1",
    "skills": [skill("python", "Python", "Python-Kenntnisse"), skill("java", "Java"), skill("javascript", "JavaScript", "Java Script"), skill("cpp", "C++"), skill("csharp", "C#"), skill("dotnet", "ASP.NET", ".NET"), skill("rest_api", "REST", "REST API", strict=("REST",)), skill("communication", "communication", "Kommunikation"), skill("git", "Git"), skill("teamwork", "Teamfähigkeit")],
    "exclusions": ["communication protocols"],
})
CASES = {
    "Python-Kenntnisse, Java Script, Java, C++ und Teamfähigkeit.": ["python", "java", "javascript", "cpp", "teamwork"],
    "JavaScript developer": ["javascript"],
    "digital strategy": [],
    "Den Rest lernen Sie bei uns.": [],
    "Expose the REST endpoint.": ["rest_api"],
    "a rest api": ["rest_api"],
    "Knowledge of communication protocols": [],
    "Strong communication skills": ["communication"],
    "C # and . NET": ["csharp", "dotnet"],
    "ASP.NET": ["dotnet"],
    "": [],
    None: [],
    "x " * 50000 + "git": ["git"],
}


def test_ids_and_spans_agree(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "k long, t string").withColumn("k", F.col("k").cast("string"))
    got = {r["k"]: r["skill_ids"] for r in lexicon.skill_ids(df, lexicon.alias_table(spark, TAXONOMY), "k", F.col("t")).collect()}
    order = [s.id for s in TAXONOMY.skills]
    find = lexicon.span_finder(TAXONOMY)
    for i, (t, want) in enumerate(CASES.items()):
        assert got[str(i)] == sorted(want, key=order.index), t
        assert sorted(find(t), key=order.index) == sorted(want, key=order.index), t


def test_nested_start_survives():
    assert lexicon.span_finder(TAXONOMY)("ASP.NET") == {"dotnet": [(0, 7), (3, 7)]}
    t = "We use Python and git."
    assert {t[a:b] for places in lexicon.span_finder(TAXONOMY)(t).values() for a, b in places} == {"Python", "git"}


def test_spans_in_spark(spark):
    df = spark.createDataFrame([("a", "Java, java"), ("b", None)], "k string, t string")
    assert sorted((r["start"], r["end"]) for r in lexicon.spans(df, TAXONOMY, "k", F.col("t")).collect()) == [(0, 4), (6, 10)]


def test_counts(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", [])], "k string, skill_ids array<string>")
    totals, top = lexicon.corpus_counts(df)
    assert tuple(totals.first()) == (3, 2, 3) and [tuple(r) for r in top.collect()] == [("y", 2), ("x", 1)]


def test_posting_text(spark):
    df = spark.createDataFrame([("T", "D"), ("", "D"), (None, None)], "t string, d string")
    assert [r[0] for r in df.select(lexicon.posting_text(F.col("t"), F.col("d"))).collect()] == ["T D", "D", ""]


@pytest.mark.parametrize("raw", [
    {}, {"version": "1", "skills": []}, {"version": "1", "skills": [{"id": "a"}]},
    {"version": "1", "skills": [skill("a", "x"), skill("a", "y")]}, {"version": "1", "skills": [skill("a", "x", strict=("z",))]},
    {"version": "1", "skills": [skill("a", "X  y"), skill("b", "x Y")]}, {"version": "1", "skills": [skill("a", " ")]},
])
def test_invalid_taxonomies(raw):
    with pytest.raises(ValueError):
        lexicon.Taxonomy.parse(raw)
