import datetime as dt
from decimal import Decimal
from fractions import Fraction

import pytest

from factweave.operators import units

DAY = dt.date(2026, 6, 30)
RATES = [{"currency": "USD", "rate_date": DAY, "quoted_units": 1, "krw_amount": 1400.0}, {"currency": "JPY", "rate_date": DAY, "quoted_units": 100, "krw_amount": 900.0}, {"currency": None, "rate_date": DAY, "quoted_units": 1, "krw_amount": 1.0}]


def test_affine_compositions_are_exact():
    g = units.UnitGraph().add("F", "C", Fraction(5, 9), Fraction(-160, 9)).add("C", "K", 1, Fraction(27315, 100))
    assert g.compositions("K")["F"] == (Fraction(5, 9), Fraction(-160, 9) + Fraction(27315, 100))
    assert g.compositions("F")["K"][0] == Fraction(9, 5)


def test_inconsistent_cycles_are_found():
    g = units.UnitGraph().add("a", "b", 2).add("b", "c", 3).add("c", "a", Fraction(1, 6))
    assert g.compositions("c")["a"] == (6, 0)
    with pytest.raises(units.InconsistentUnits):
        units.UnitGraph().add("a", "b", 2).add("b", "c", 3).add("c", "a", Fraction(1, 7)).compositions("c")
    with pytest.raises(ValueError):
        units.UnitGraph().add("a", "b", 0)


CASES = [  # raw text, number, unit, scale, weight scale, currency -> value
    ("12.5%", None, "RATIO", None, None, None, "R", 12.5), ("연 -7.5퍼센트", None, None, None, None, None, "R", -7.5), ("150 bps", None, None, None, None, None, "R", 1.5), ("3 %p", None, None, None, None, None, "R", 3.0),
    ("0.02", 0.02, "RATIO", "RATIO_0_1", None, None, "R", 2.0), ("2.5", 2.5, None, None, None, None, "R", 0.025), (None, 4.0, None, "SOURCE_PERCENT", None, None, "R", 4.0),
    ("4억 4,192만원", None, None, None, None, None, "A", 441_920_000.0), ("2조 3,594억 2,089만 원", None, None, None, None, None, "A", 2_359_420_890_000.0), ("₩1,000", None, None, None, None, None, "A", 1000.0), ("2.5백만원", None, None, None, None, None, "A", 2_500_000.0), ("3 천원", None, None, None, None, None, "A", 3000.0),
    ("US$2.5bn", None, None, None, None, None, "A", 2.5e9 * 1400), ("1,000 thousand JPY", None, None, None, None, None, "A", 9_000_000.0), ("10", 10.0, "CURRENCY_AMOUNT", "MILLION", None, "USD", "A", 1.4e10), ("10", 10.0, None, None, None, None, "A", 10_000.0), ("EUR 5", None, None, None, None, None, "A", None),
    ("1.5만주", None, None, None, None, None, "V", 15000.0), ("2M shares", None, None, None, None, None, "V", 2e6), ("7k 주", None, None, None, None, None, "V", 7000.0), ("3", 3.0, "COUNT", "THOUSAND", None, None, "V", 3000.0),
    ("비중 4％", None, None, None, None, None, "W", 4.0), ("35‰", None, None, None, None, None, "W", 3.5), ("0.5", 0.5, "WEIGHT", None, "0_TO_1", None, "W", 50.0), ("40", 40.0, None, None, None, None, "W", 0.4), ("", None, None, None, None, None, "W", None),
]
CONTRACTS = [("R", "D", "BASIS_POINT", "BASIS_POINT", None), ("A", "D", "CURRENCY_AMOUNT", "THOUSAND", "KRW"), ("V", "D", "COUNT", "UNIT", None), ("W", "D", "WEIGHT", "BASIS_POINT", None)]


def values(spark, cases):
    rows = [(f"f{i:02}", m, "s", raw, Decimal(str(n)) if n is not None else None, unit, scale, weight, currency, DAY, "D", dt.datetime(2026, 7, 1), 1) for i, (raw, n, unit, scale, weight, currency, m, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "fact_id string, metric_code string, subject_entity_id string, raw_value string, numeric_value decimal(38,15), unit string, scale_basis string, weight_scale string, currency string, observed_on date, source_dataset string, recorded_at timestamp_ntz, number int")
    contracts = spark.createDataFrame(CONTRACTS, "metric string, dataset string, unit string, scale_basis string, currency string")
    rates = spark.createDataFrame([tuple(r.values()) for r in RATES], "currency string, rate_date date, quoted_units int, krw_amount double")
    return units.common_values(df, contracts, rates)


def test_text_columns_and_contracts(spark):
    got = {r["fact_id"]: r["common_value"] for r in values(spark, CASES).collect()}
    for i, case in enumerate(CASES):
        want = case[-1]
        assert (got[f"f{i:02}"] is None) if want is None else abs(got[f"f{i:02}"] - want) <= 1e-9 * abs(want), case


def test_pairs_equal_brute_force(spark):
    v = values(spark, CASES)
    rows = [r for r in v.collect() if r["common_value"] is not None]
    want = {(a["fact_id"], b["fact_id"]) for a in rows for b in rows if a["fact_id"] < b["fact_id"] and a["metric_code"] == b["metric_code"] and abs(a["common_value"] - b["common_value"]) > 0.01 * max(abs(a["common_value"]), abs(b["common_value"]))}
    assert {tuple(r) for r in units.disagreeing_pairs(v).collect()} == want


def test_no_observations(spark):
    assert units.disagreeing_pairs(values(spark, [])).count() == 0
