from decimal import Decimal

import pytest

from stellwerk.operators.units import Unit, amounts, beside, resolve, segment, to_common_unit

RATES = [("currency", "EUR", 1.0), ("currency", "CHF", 1.04), ("period", "year", 1.0), ("period", "month", 12.0), ("period", "hour", 1720.0), ("scale", "one", 1.0), ("scale", "thousand", 1000.0), ("scale", "hundredth", 0.01)]
SCHEMA = "job_id string, salary_min double, salary_currency string, salary_period string, description string, factor string"


@pytest.mark.parametrize(
    ("text", "field", "unit"),
    [
        ("TEUR", "currency", Unit("EUR", None, "thousand")),
        ("T€", "currency", Unit("EUR", None, "thousand")),
        (" EUR ", "currency", Unit("EUR")),
        ("euro cents", "currency", Unit("EUR", None, "hundredth")),
        ("kGBP", "currency", Unit("GBP", None, "thousand")),
        ("SFr.", "currency", Unit("CHF")),
        ("brutto/Monat", "period", Unit(None, "month")),
        ("p.a. (in Tsd.)", "period", Unit(None, "year", "thousand")),
        ("/h", "period", Unit(None, "hour")),
        ("Tagessatz", "period", Unit(None, "day")),
        ("k. A.", "period", Unit()),
        ("", "period", Unit()),
        ("Swiss francs per hour", "text", Unit("CHF", "hour")),
        ("tausend € pro Jahr", "text", Unit("EUR", "year", "thousand")),
        ("and a friendly team", "text", Unit()),
    ],
)
def test_segment(text, field, unit):
    assert segment(text, field) == unit


@pytest.mark.parametrize(("text", "value"), [("43.500 €", "43500"), ("43.50 €", "43.50"), ("44'000.00", "44000.00"), ("3 120 EUR", "3120"), ("28,40", "28.40"), ("1.025,00", "1025.00"), ("47,000.00", "47000.00")])
def test_amounts(text, value):
    assert [a for a, _, _ in amounts(text)] == [Decimal(value)]


def test_beside_reads_only_the_unit_of_the_amount():
    text = "Die Prämie beträgt 1.232 € einmalig. Wir zahlen ab 28,40 CHF pro Stunde. Freuen Sie sich auf 30 Tage im Jahr."
    assert beside(text, Decimal("28.4")) == Unit("CHF", "hour")
    assert beside(text, Decimal("99")) == Unit()
    assert beside("Gehalt: ab US$321, pro Arbeitstag.", Decimal(321)) == Unit("USD", "day")


def test_fields_win_over_text():
    assert resolve(30.0, "EUR", "pro Jahr", "ab 30 CHF pro Stunde") == Unit("EUR", "year")
    assert resolve(46.0, "EUR", None, "ab 46 T€ im Jahr") == Unit("EUR", "year", "thousand")


def test_conversion(spark):
    rows = [
        ("a", 3000.0, "EUR", "monthly", None, "x"),
        ("a", 3000.0, "EUR", "monthly", None, "x"),
        ("b", 29.1, None, None, "Wir zahlen ab 29,10 CHF pro Stunde.", "x"),
        ("c", 50.0, "kEUR", "year", "", None),
        ("d", None, "EUR", "year", None, None),
        ("e", 10.0, None, "year", "nothing " * 20000, None),
        (None, 1.0, "EUR", "year", None, None),
        ("f", float("nan"), "EUR", "year", None, None),
    ]
    rates = spark.createDataFrame(RATES, "unit_kind string, unit string, factor double")
    out = {(r["job_id"], r["eur_per_year"]) for r in to_common_unit(spark.createDataFrame(rows, SCHEMA), rates).collect()}
    assert out == {("a", 36000), ("b", 52054), ("c", 50000), ("e", None), ("f", None)}
    assert to_common_unit(spark.createDataFrame([], SCHEMA), rates).count() == 0


def test_a_unit_far_from_its_amount_is_read_in_its_sentence():
    far = "Wir zahlen 44000 und das ist für Sie und für uns alle hier bei uns am Standort ganz sicher viel, in Euro pro Jahr. Der Rest kostet 5 Dollar."
    assert beside(far, Decimal(44000)) == Unit("EUR", "year", None)
    assert beside("Unser Gehalt in Schweizer Franken liegt bei 44000 im Monat.", Decimal(44000)).period == "month"
    assert beside("x" * 100_000 + " 44000 EUR p. a. " + "y" * 100_000, Decimal(44000)).currency == "EUR"


def test_amounts_beyond_the_range_have_no_euros(spark):
    rates = spark.createDataFrame([("currency", "EUR", 1.0), ("period", "year", 1.0)], "unit_kind string, unit string, factor double")
    rows = [("a", 2e15), ("b", 1e19), ("c", 1e300), ("d", float("nan")), ("e", float("inf"))]
    df = spark.createDataFrame([(k, v, "EUR", "year", None) for k, v in rows], "job_id string, salary_min double, salary_currency string, salary_period string, description string")
    assert {r["job_id"]: r["eur_per_year"] for r in to_common_unit(df, rates).collect()} == {"a": 2 * 10**15, "b": None, "c": None, "d": None, "e": None}
