import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import canonical, consensus, cooccur, mixing

CITIES = [
    (1, "Bad Königssieden", None, "Nordmark", "688"), (2, "Falkenmünde", None, "Südalb", "522"), (3, "Steinhafen", "Stonehaven", "Küstenmark", "648"), (4, "Altenmoor (Tessel)", None, "Südalb", "897"), (5, "Altenmoor (Murne)", None, "Nordmark", "965"),
    (6, "Heideloh an der Tessel", None, "Oberharl", "911"), (7, "Falkendorf", None, "Seelande", "115"), (8, "Salzdorf", None, "Mittelau", "557"), (9, "Salzmünde", None, "Mittelau", "558"), (10, "Steinbrück", None, "Seelande", "509"), (11, "Kirchbrück", None, "Seelande", "510"), (12, "Rosenhafen", None, "Seelande", "511"),
]
DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")
SCHEMA = "city_id long, city_name string, alt_name string, federal_state string, postal_prefix string"


# p3


def test_distance_is_levenshtein_and_the_tree_is_exact():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    for a, b in itertools.islice(itertools.product(words, words), 3000):
        assert canonical.distance(a, b) == slow(a, b)
    tree = canonical.BKTree()
    for w in words:
        tree.add(w)
    for q in words[:30]:
        for most in (0, 1, 2, 3):
            assert tree.within(q, most) == sorted((slow(q, w), w) for w in set(words) if slow(q, w) <= most)


@pytest.mark.parametrize(("value", "city"), [
    ("FALKENMÜNDE ", 2), ("Falkenmuende", 2), ("Falkenmunde-West", 2), ("Faklenmünde", 2), ('["Falkenmünde"]', 2), ("52287 Falkenmünde", 2), ("D-52260", 2), ("PLZ 52260", 2), ("Falkenmünde (Südalb)", 2), ("Falkenmünde / Salzdorf", 2), ("Standort: Salzdorf", 8),
    ("B. Königssieden", 1), ("bad-Königssieden", 1), ("Bda Königssieden", 1), ("Stonehaven und Umgebung", 3), ("Altenmoor/Murne", 5), ("ALTENMOOR (Tessel)", 4), ("Altenmoor a. d. Murne", 5), ("Altenmoor", 0), ("Altenmoor (Nordmark)", 5), ("Heideloh an dre Tessel", 6), ("Heideloh", 6),
    ("Salzdorf, Bahnhofstraße 3", 8), ("Salzbrück", 0), ("00987 Salzbrück", 0), ("Europa", 0), ("Remote", 0), ("{{ort}}", 0), ("Südalb", 0), ("Homeoffice oder Falkendorf", 7), ("Lorem ipsum", 0), ("x" * 5000, 0),
])
def test_meaning(value, city):
    assert canonical.Gazetteer.build(CITIES).meant(value) == city


def test_mapping(spark, monkeypatch):
    ref = spark.createDataFrame([(*c, "x") for c in CITIES], SCHEMA + ", job_id string")
    rows = [("a", "Falkenmünde"), ("a", "falkenmünde"), ("a", "falkenmünde"), ("b", None), ("c", " "), ("d", "Nirgendwo"), (None, "Salzdorf")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "job_id string, location string, city_id int")
    want = {("a", 2), ("d", 0)}
    assert {tuple(r) for r in canonical.typed_places(df, ref).collect()} == want
    assert canonical.typed_places(df.limit(0), ref).count() == 0
    assert {r["city_id"] for r in canonical.typed_places(df, ref.limit(0)).collect()} == {0}
    monkeypatch.setattr(canonical, "SHARD", 4)
    assert {tuple(r) for r in canonical.typed_places(df, ref).collect()} == want
    assert canonical.typed_places(df.limit(0), ref).count() == 0


def test_short_names_are_searched_too():
    g = canonical.Gazetteer.build([(1, "Rhön", None, None, None), (2, "Alb", None, None, None), (3, "Eichenhain", None, None, None)])
    assert [g.meant(x) for x in ("Rhn", "Alp", "Al", "Eichnhain", "Xyz")] == [1, 2, 0, 3, 0]


PLACES = ["Falkenmünde", "Faklenmünde", "52287 Falkenmnde", "Altenmoor/Murne", "Altenmor / Murne", "Altenmoor (Nordmark)", "Heideloh an dre Tessel", "Salzbrück", "00987 Salzbrück", "50912 Steinbrück", "B. Königssieden", "Stonehavn", "Salzdorf, Bahnhofstraße 3", "Falkendorf + Rosenhafen", "D-52260", "Südalb", "Remote", "Bahnhofstr. 5", "PLZ 99999", "Standort: Kirchbrück"]


@pytest.mark.parametrize("shards", [2, 3, 12])
def test_merged_shards_decide_like_one_tree(shards):
    """Every lookup of the decision meets the same entries, whatever shard they stand in."""
    whole = canonical.Gazetteer.build(CITIES)
    parts = [canonical.Gazetteer.build([c for c in CITIES if c[0] % shards == i], whole.any_state) for i in range(shards)]
    rng = random.Random(shards)
    values = PLACES + ["".join(ch for ch in v if rng.random() > 0.06) for v in PLACES for _ in range(8)]
    for v in values:
        found = [canonical.hits(g, v) for g in parts]
        merged = canonical.Gazetteer.build([e for es, _ in found for e in es], whole.any_state, [r for _, rs in found for r in rs])
        assert merged.meant(v) == whole.meant(v), v


@needs_data
@pytest.mark.parametrize("shard", [20, 50, 100])
def test_shards_of_the_test_tables(spark, monkeypatch, shard):
    jobs, ref = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("jobs", "city_reference"))
    want = {tuple(r) for r in canonical.typed_places(jobs, ref).collect()}
    monkeypatch.setattr(canonical, "SHARD", shard)
    assert {tuple(r) for r in canonical.typed_places(jobs, ref).collect()} == want


# p7


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    items = [f"s{i}" for i in range(8)]
    rows = [(f"j{rng.randint(0, 150)}", rng.choice([None, [], [rng.choice([*items, "?", None, " S1 ", "S2", ""]) for _ in range(rng.randint(1, 6))]])) for _ in range(300)] + [(None, ["s1", "s2"])]
    df = spark.createDataFrame(rows, "job_id string, skill_ids array<string>")
    dim = spark.createDataFrame([(i, "x") for i in items] + [(None, "y")], "skill_id string, label string")
    sets: dict = {}
    for j, x in rows:
        if j is not None:
            sets.setdefault(j, set()).update(s for s in ((y or "").strip().lower() for y in x or []) if s in items)
    want = {}
    for a, b in itertools.combinations(items, 2):
        if n := sum(a in s and b in s for s in sets.values()):
            want[a, b] = (n, sum(a in s for s in sets.values()), sum(b in s for s in sets.values()), len(sets))
    got = cooccur.associated_pairs(df, dim).collect()
    assert {(r["skill_a"], r["skill_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_all"]) for r in got} == want
    assert all(0 <= r["p_value"] <= r["q_value"] <= 1 for r in got)
    kept = {(r["skill_a"], r["skill_b"]) for r in cooccur.frequent_together(df, dim, 3, 1).collect()}
    assert kept == {k for k, (n, a, b, t) in want.items() if n >= 3 and n * t >= a * b}
    assert cooccur.associated_pairs(df.limit(0), dim).count() == 0


def test_long_lists_are_counted_sparsely_with_equal_results(spark, monkeypatch):
    rng = random.Random(5)
    items = [f"s{i}" for i in range(40)]
    rows = [(f"j{i}", rng.sample(items, rng.randint(0, 12)) * rng.randint(1, 2)) for i in range(300)]
    df, dim = spark.createDataFrame(rows, "job_id string, skill_ids array<string>"), spark.createDataFrame([(i,) for i in items], "skill_id string")
    rounded = lambda rows: {(r["skill_a"], r["skill_b"]): (r["n_ab"], r["n_a"], r["n_all"], round(r["expected"], 9), round(r["p_value"], 9), round(r["q_value"], 9)) for r in rows}
    want = rounded(cooccur.associated_pairs(df, dim).collect())
    p = np.array([v[4] for v in want.values()])
    assert np.allclose(cooccur.false_discovery(p, 40 * 39 // 2), [v[5] for v in want.values()], atol=1e-6)
    for name, value in (("MOST_ITEMS", 10), ("LITERALS", 5), ("CELLS", 50)):
        monkeypatch.setattr(cooccur, name, value)
    assert rounded(cooccur.associated_pairs(df, dim).collect()) == want


def test_null_keeps_counts_and_sizes():
    rng = np.random.default_rng(1)
    m = (rng.random((400, 12)) < rng.uniform(0.05, 0.5, 12)).astype(int)
    size = m.sum(1)
    sizes, times = np.unique(size, return_counts=True)
    p = cooccur.fit_null(m.sum(0), sizes, times)
    assert np.allclose(times @ p, m.sum(0), rtol=1e-4) and np.allclose(p.sum(1), sizes, rtol=1e-4)


def test_tails_against_convolution():
    rng = np.random.default_rng(4)
    for _ in range(6):
        chances, times = rng.uniform(0, 0.1, 10), rng.integers(1, 40, 10).astype(float)
        d = np.array([1.0])
        for p, n in zip(chances, times):
            for _ in range(int(n)):
                d = np.convolve(d, [1 - p, p])
        for k in (0, 1, 3, 8, 15, 25, len(d) - 1, len(d)):
            exact = d[k:].sum()
            assert abs(cooccur.upper_tail(k, chances, times) - exact) <= 0.02 * exact + 1e-12


def test_false_discovery():
    q = cooccur.false_discovery(np.array([0.01, 0.04, 0.03, 0.9]), 4)
    assert np.allclose(q, [0.04, 0.0533333, 0.0533333, 0.9])


# p5


def simulated(seed=1, jobs=400):
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(20)]
    care = {"a": (0.97, 0.002, 0.95), "b": (0.9, 0.004, 0.9), "c": (0.9, 0.004, 0.9), "d": (0.6, 0.03, 0.6), "llm": (0.9, 0.01, 0.9), "mixed": (0.97, 0.002, 0.1)}
    truth, rows = {}, []
    for j in range(jobs):
        t = {s: rng.choice(["required", "required", "mentioned"]) for s in rng.sample(skills, rng.randint(0, 4))}
        truth |= {(f"j{j}", s): v for s, v in t.items()}
        for who in rng.sample(sorted(care), 4):
            hit, false, right = care[who]
            said = {s: v if rng.random() < right else {"required": "mentioned", "mentioned": "required"}[v] for s, v in t.items() if rng.random() < hit}
            said |= {s: "mentioned" for s in skills if s not in t and rng.random() < false}
            rows.append((rng.choice([who, who.upper(), f" {who} "]), f"j{j}", said))
    return truth, rows


def test_consensus_beats_annotators(spark):
    truth, rows = simulated()
    df = spark.createDataFrame(rows + rows[:50] + [("a", "j0", None), (None, "j0", {}), ("a", None, {})], "annotator string, job_id string, skills map<string,string>")
    got = {(r["job_id"], r["skill_id"]): r["label"] for r in consensus.consensus(df).collect()}
    right = sum(truth.get(k) == v for k, v in got.items())
    assert 2 * right / (len(got) + len(truth)) > 0.93
    rel = {r["annotator"]: r for r in consensus.reliability(df).collect()}
    assert set(rel) == {"a", "b", "c", "d", "llm", "mixed"}
    assert rel["a"]["hit_rate"] > rel["b"]["hit_rate"] > rel["d"]["hit_rate"] and rel["mixed"]["required_hit_rate"] < rel["mixed"]["required_false_alarm_rate"]
    assert consensus.agreement(df).count() == 15
    settled = spark.createDataFrame([("adjudicated", "j1", {"S5": " Required"}), ("adjudicated", "nowhere", {"s1": "required"})], df.schema)
    fixed = {(r["job_id"], r["skill_id"]): r["label"] for r in consensus.consensus(df, settled).collect()}
    assert {k for k in fixed if k[0] == "j1"} == {("j1", "s5")} and ("nowhere", "s1") not in fixed


def test_triplets_are_exact_on_exact_covariances():
    f = np.array([0.3, 0.2, 0.25, -0.1])
    assert np.allclose(consensus.triplet_factors(np.outer(f, f), np.full((4, 4), 100)), f)


def test_consensus_of_few(spark):
    schema = "annotator string, job_id string, skills map<string,string>"
    one = spark.createDataFrame([("a", "j", {"x": "Required ", "y": "odd", " ": "required"}), ("a", "k", {})], schema)
    assert {(r["job_id"], r["skill_id"]) for r in consensus.consensus(one).collect()} <= {("j", "x")}
    assert consensus.consensus(one.limit(0)).count() == 0


def test_thresholds_come_from_all_settled_postings(spark):
    """A skill that only c shows is right in most settled postings, but in none of the 5,000 with the smallest hashes."""
    schema = "annotator string, job_id string, skills map<string,string>"
    order = [r["job_id"] for r in spark.range(5400).select(F.concat(F.lit("j"), "id").alias("job_id")).orderBy(F.xxhash64("job_id"), "job_id").collect()]
    both, one = {"s": "required", "w": "required"}, {"s": "required"}
    settled = [("adjudicated", j, both if at >= 5000 else one) for at, j in enumerate(order)]
    rows = [(who, j, both if who == "c" and (at >= 5000 or at % 50 == 0) else one) for at, j in enumerate(order) for who in "abc"]
    rows += [("a", "new", one), ("b", "new", one), ("c", "new", both)]
    got = consensus.consensus(spark.createDataFrame(rows, schema), spark.createDataFrame(settled, schema))
    assert {(r["skill_id"], r["label"]) for r in got.filter("job_id = 'new'").collect()} == {("s", "required"), ("w", "required")}


def test_thresholds_are_the_best_of_all_cuts(spark):
    rng = random.Random(3)
    unit, levels = consensus.UNIT, {}
    for j in range(60):
        levels |= {(f"j{j}", f"s{s}"): rng.choice([1, 2, 2]) for s in range(12) if rng.random() < 0.5}
    levels |= {("silent", "s1"): 2}  # nobody shows it: a miss at any cut
    # scores near each other and far apart, many of them equal
    rows = [(f"j{j}", f"s{s}", rng.choice([rng.randint(-9, 9) * unit // 2, rng.randint(-400, 400)]) + (2 * unit if (f"j{j}", f"s{s}") in levels else 0), rng.choice([rng.randint(-6, 6) * unit, rng.randint(-300, 300)]) + (unit if levels.get((f"j{j}", f"s{s}")) == 2 else 0)) for j in range(60) for s in range(12) if rng.random() < 0.8]
    other = [("unsettled", "s1", 50 * unit, 0)]
    settled = [(*k, v) for k, v in levels.items()] + [(j, None, None) for j in [f"j{j}" for j in range(60)] + ["silent"]]
    cut, cut2 = consensus._thresholds(spark.createDataFrame(rows + other, "job_id string, skill_id string, a bigint, b bigint"), spark.createDataFrame(settled, "job_id string, skill_id string, level int"))

    def f1(at):
        kept = [(j, s) in levels for j, s, a, _ in rows if a > at]
        return 2 * sum(kept) / (len(kept) + len(levels))

    def mistakes(at):
        return sum((b > at) != (levels[j, s] == 2) for j, s, _, b in rows if (j, s) in levels)

    assert f1(cut) == max(f1(a - 1) for _, _, a, _ in rows)
    assert mistakes(cut2) == min(mistakes(b - d) for _, _, _, b in rows for d in (0, 1))


# p9


def test_rates():
    r = mixing.solve_rates({"a": 100, "b": 1000, "c": 0}, {"a": (0.5, 3), "b": (0.4, 1), "c": (0.1, 2)})
    assert r["a"] == 3.0 and r["c"] == 0.0 and abs(r["b"] - 0.8) < 1e-12
    assert mixing.solve_rates({}, {"a": (1.0, 1)}) == {"a": 0.0}


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, "wort " * rng.randint(1, 30), rng.choice(["a"] * 8 + ["b", "b", "c", None]), "x") for i in range(3000)] + [(3001, None, "a", "x"), (3002, "", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, None)], "source string, target_share double, max_repeats long")
    s = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert s["none"]["status"] == "no tokens" and s["c"]["status"] == "not listed" and s["b"]["status"] == "capped" and s[None]["emitted_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    e = mixing.emitted(df, targets)
    per = e.groupBy("source", "doc_id").agg(F.max("copy_no").alias("m"), F.count(F.lit(1)).alias("n"))
    assert {r["source"] for r in per.collect()} == {"a", "b"} and all(r["m"] == r["n"] <= {"a": 1, "b": 2}[r["source"]] for r in per.collect())
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, mixing.emitted(df, targets).collect()))
    assert all(r["actual_share"] == 0 for r in mixing.shares(df.limit(0), targets).collect())


def test_found_queries_have_their_columns(spark):
    from pathlib import Path

    from stellwerk.llm import plans

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("test tables are missing")
    want = {"p1_found": {"job_id", "field_name", "kind", "seq"}, "p3_found": {"job_id", "city_id"}, "p4_found": {"label_table", "job_id", "para_no", "lang"}, "p5_found": {"job_id", "skill_id", "label"}, "p6_found": {"job_id", "field_name"}, "p7_found": {"skill_a", "skill_b"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"}}
    for name, cols in want.items():
        df = plans.QUERIES[name](spark, d)
        assert set(df.columns) == cols
        if name != "p8_ids":
            assert df.count() == df.distinct().count()
