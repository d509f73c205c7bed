"""Quantities in common units: conversions are edges of a graph with affine functions.

The graph is small and fixed by tables of units and rates. Shortest compositions to the canonical units are computed
once, every cycle is checked for consistency, and the data meets the result in one equi-join on source unit and
canonical unit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import parsing

#: Conversions that are broadcast; a larger table is joined by a shuffle.
MAX_BROADCAST_CONVERSIONS = 100_000

# Scales of amounts and counts, and the rates' units.
SCALES = {"UNIT": 1, "THOUSAND": 10**3, "TEN_THOUSAND": 10**4, "MILLION": 10**6, "HUNDRED_MILLION": 10**8, "BILLION": 10**9, "TRILLION": 10**12}
RATES = {"PERCENT": Fraction(1), "RATIO": Fraction(100), "BASIS_POINT": Fraction(1, 100), "PER_MILLE": Fraction(1, 10)}


class InconsistentUnits(ValueError):
    """Two ways between the same units give different values."""


class UnitGraph:
    """Units with affine conversions ``target = factor * source + offset``, kept exact."""

    def __init__(self) -> None:
        self.edges: dict[str, list[tuple[str, Fraction, Fraction]]] = {}

    def add(self, source: str, target: str, factor: Fraction | int, offset: Fraction | int = 0) -> UnitGraph:
        factor, offset = Fraction(factor), Fraction(offset)
        if not factor:
            raise ValueError(f"{source} -> {target}: a factor of 0 can't be turned round")
        self.edges.setdefault(source, []).append((target, factor, offset))
        self.edges.setdefault(target, []).append((source, 1 / factor, -offset / factor))
        return self

    def compositions(self, canonical: str, tolerance: Fraction = Fraction(1, 10**9)) -> dict[str, tuple[Fraction, Fraction]]:
        """(factor, offset) from every unit connected to the canonical one, by the fewest steps.

        Raises InconsistentUnits if any other way deviates by more than the tolerance, which is relative.
        """
        found = {canonical: (Fraction(1), Fraction(0))}
        queue = deque([canonical])
        while queue:
            unit = queue.popleft()
            factor, offset = found[unit]
            for other, f, o in self.edges.get(unit, []):
                # other -> unit is the inverse of unit -> other
                composed = (factor / f, offset - factor * o / f)
                if other not in found:
                    found[other] = composed
                    queue.append(other)
                elif any(abs(a - b) > tolerance * max(abs(a), abs(b), 1 if i else 0) for i, (a, b) in enumerate(zip(composed, found[other]))):
                    raise InconsistentUnits(f"{other} -> {canonical}: {found[other]} and {composed}")
        return found

    def conversions(self, canonical: Iterable[str]) -> list[tuple[str, str, float, float]]:
        """(source unit, canonical unit, factor, offset) for all units that reach one of the canonical units."""
        return [(unit, target, float(f), float(o)) for target in canonical for unit, (f, o) in sorted(self.compositions(target).items())]


def scaled(currency_day: str, scale: str) -> str:
    return f"{currency_day}:{scale}"


def product_units(rates: Iterable[Mapping]) -> UnitGraph:
    """Amounts (KRW), rates (PERCENT) and counts (SHARE); currencies per day of their rate.

    A rate is a mapping with currency, rate_date, quoted_units and krw_amount; rates with a NULL are left out. Every
    distinct rate is an edge, so two that contradict each other on a day make a cycle that ``compositions`` refuses.
    """
    graph = UnitGraph()
    for name, factor in RATES.items():
        if name != "PERCENT":
            graph.add(name, "PERCENT", factor)
    bases = {"KRW": None, "SHARE": None}
    seen = set()
    for r in rates:
        if None in (r["currency"], r["rate_date"], r["quoted_units"], r["krw_amount"]):
            continue
        base = f"{r['currency'].strip().upper()}@{r['rate_date']}"
        factor = Fraction(str(r["krw_amount"])) / Fraction(r["quoted_units"])
        if (base, factor) not in seen:
            graph.add(base, "KRW", factor)
        seen.add((base, factor))
        bases[base] = None
    for base in bases:
        for scale, factor in SCALES.items():
            graph.add(scaled(base, scale), base, factor)
    return graph


def conversion_table(spark: SparkSession, graph: UnitGraph, canonical: Iterable[str]) -> DataFrame:
    rows = graph.conversions(canonical)
    table = spark.createDataFrame(rows, "source_unit string, canonical_unit string, factor double, offset double")
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_CONVERSIONS else table


def converted(values: DataFrame, conversions: DataFrame, number: str, source_unit: str, canonical_unit: str, out: str = "common_value") -> DataFrame:
    """values with ``out`` in the canonical unit; NULL where number or unit is missing or no way leads there."""
    table = conversions.select(F.col("source_unit").alias("_su"), F.col("canonical_unit").alias("_cu"), F.col("factor").alias("_f"), F.col("offset").alias("_o"))
    joined = values.join(table, (F.col(source_unit) == F.col("_su")) & (F.col(canonical_unit) == F.col("_cu")), "left")
    return joined.withColumn(out, F.col(number) * F.col("_f") + F.col("_o")).drop("_su", "_cu", "_f", "_o")


# How text names currencies, scales and rates. The first pattern that matches decides.
TEXT_CURRENCIES = [("KRW", r"₩|원|KRW"), ("USD", r"US\$|USD|\$"), ("EUR", r"€|EUR"), ("CNY", r"CNY|RMB|CN¥|元"), ("JPY", r"JP¥|JPY|¥|엔")]
TEXT_RATES = [("BASIS_POINT", r"(?i)bps?\b|베이시스"), ("PER_MILLE", r"‰"), ("PERCENT", r"(?i)%|pct|퍼센트|percent")]
TEXT_COUNTS = r"(?i)주|shares?"
TEXT_SCALES = [
    ("TRILLION", r"(?i)[0-9.]\s*(조|tn\b|trillion)"),
    ("HUNDRED_MILLION", r"[0-9.]\s*억"),
    ("BILLION", r"(?i)[0-9.]\s*(십억|bn\b|billion|b\b)"),
    ("MILLION", r"(?i)[0-9.]\s*(백만|mn\b|million|m\b)"),
    ("TEN_THOUSAND", r"[0-9.]\s*만"),
    ("THOUSAND", r"(?i)[0-9.]\s*(천|k\b|thousand)"),
]
#: What columns and contracts may state.
COLUMN_SCALES = {"CURRENCY_UNIT": "UNIT", **{k: k for k in SCALES}}
COLUMN_RATES = {"PERCENT": "PERCENT", "SOURCE_PERCENT": "PERCENT", "PERCENT_POINTS": "PERCENT", "0_TO_100": "PERCENT", "RATIO": "RATIO", "RATIO_0_1": "RATIO", "0_TO_1": "RATIO", "BASIS_POINT": "BASIS_POINT", "PER_MILLE": "PER_MILLE"}
_NUMBER = r"([+-]?\s*[0-9][0-9,]*(?:\.[0-9]+)?)"


def _first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns])


def _number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def read_text(rows: DataFrame, text: str) -> DataFrame:
    """rows with what a text says: ``_number``, ``_currency``, ``_scale``, ``_rate``, ``_count``; NULL if it does not.

    Parts in several Korean scales ("4억 4,192만원") add up to single units.
    """
    plain = F.translate(parsing.stripped(F.col(text)), "％＄．，０１２３４５６７８９", "%$.,0123456789")
    t = F.col("_text")
    part = lambda mark: F.coalesce(_number(F.regexp_extract(t, rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*{mark}", 1)), F.lit(0.0))
    total = part("조") * 1e12 + part("억") * 1e8 + part("만") * 1e4 + part("천") * 1e3 + part("(?<=[조억만천]\\s{0,3}[0-9,.]{1,20}\\s{0,3})(?:원|주|$)")
    several = t.rlike(r"[0-9]\s*[조억만천]\s*[0-9]")
    rows = rows.withColumn("_text", plain).withColumn("_several", several)
    return (
        rows.withColumn("_number", F.when(F.col("_several"), F.when(t.rlike(r"^[^0-9]*-"), -total).otherwise(total)).otherwise(_number(F.regexp_extract(t, _NUMBER, 1))))
        .withColumn("_currency", _first(t, TEXT_CURRENCIES))
        .withColumn("_rate", _first(t, TEXT_RATES))
        .withColumn("_count", F.coalesce(t.rlike(TEXT_COUNTS), F.lit(False)))
        .withColumn("_scale", F.when(F.col("_several"), F.lit("UNIT")).otherwise(_first(t, TEXT_SCALES)))
    )


def _lookup(column: str, names: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.upper(F.trim(F.col(column))))


def observation_units(observations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Observations with ``number``, ``source_unit`` and ``canonical_unit``.

    Text that names a unit decides, then the row's columns, then the contract of metric and dataset; currency and
    scale are looked for each by itself. A metric's kind (amount, rate, count) is its contracts' or the row's own.
    """
    clean = lambda c: F.upper(F.trim(F.col(c)))
    rules = contracts.groupBy(clean("metric").alias("_metric"), clean("dataset").alias("_dataset")).agg(F.max(clean("unit")).alias("_k_unit"), F.max(clean("scale_basis")).alias("_k_scale"), F.max(clean("currency")).alias("_k_currency"))
    kinds = contracts.groupBy(clean("metric").alias("_metric")).agg(F.max(F.when(clean("unit").isin("CURRENCY_AMOUNT", "COUNT"), clean("unit")).otherwise("RATE")).alias("_kind"))
    names = observations.columns
    rows = observations.withColumn("_metric", clean("metric_code")).withColumn("_dataset", clean("source_dataset"))
    rows = read_text(rows.join(F.broadcast(rules), ["_metric", "_dataset"], "left").join(F.broadcast(kinds), "_metric", "left"), "raw_value")
    c = F.col
    own = F.when((clean("unit") == "CURRENCY_AMOUNT") | clean("scale_basis").eqNullSafe("CURRENCY_UNIT"), "CURRENCY_AMOUNT").when(clean("unit") == "COUNT", "COUNT").when(clean("unit").isNotNull(), "RATE")
    by_text = F.when(c("_rate").isNotNull(), "RATE").when(c("_count") & c("_currency").isNull(), "COUNT").when(c("_currency").isNotNull(), "CURRENCY_AMOUNT")
    # a currency or "shares" named without a scale means single units
    named = F.coalesce(c("_scale"), F.when(c("_currency").isNotNull() | c("_count"), F.lit("UNIT")))
    rows = (
        rows.withColumn("_scale", F.coalesce(named, _lookup("scale_basis", COLUMN_SCALES), _lookup("_k_scale", COLUMN_SCALES)))
        .withColumn("_currency", F.coalesce(c("_currency"), clean("currency"), c("_k_currency")))
        .withColumn("_rate", F.coalesce(c("_rate"), *[_lookup(x, COLUMN_RATES) for x in ("weight_scale", "unit", "scale_basis", "_k_scale", "_k_unit")]))
        .withColumn("_kind", F.coalesce(c("_kind"), own, by_text))
        .withColumn("_base", F.when(c("_currency") == "KRW", F.lit("KRW")).otherwise(F.concat(c("_currency"), F.lit("@"), c("observed_on").cast("string"))))
    )
    return rows.select(
        *names,
        F.coalesce(c("_number"), c("numeric_value").cast("double")).alias("number"),
        F.when(c("_kind") == "CURRENCY_AMOUNT", F.concat(c("_base"), F.lit(":"), c("_scale"))).when(c("_kind") == "COUNT", F.concat(F.lit("SHARE:"), c("_scale"))).when(c("_kind") == "RATE", c("_rate")).alias("source_unit"),
        F.when(c("_kind") == "CURRENCY_AMOUNT", "KRW").when(c("_kind") == "COUNT", "SHARE").when(c("_kind") == "RATE", "PERCENT").alias("canonical_unit"),
    )


def common_values(observations: DataFrame, contracts: DataFrame, rates: DataFrame) -> DataFrame:
    """Each observation once (the latest row of a fact_id) with ``common_value`` in ``canonical_unit``.

    ``common_value`` is NULL without a number, a unit or a rate for the day; rows without fact_id are left out; an
    empty table gives no rows; other columns are dropped, whatever their names. The rates are a small fixed table and the only rows that reach the driver.
    """
    columns = ["fact_id", "metric_code", "subject_entity_id", "raw_value", "numeric_value", "unit", "scale_basis", "weight_scale", "currency", "observed_on", "source_dataset", "recorded_at"]
    read = observation_units(observations.select(*columns).where("fact_id IS NOT NULL"), contracts)
    state = F.struct("recorded_at", "metric_code", "subject_entity_id", "observed_on", "number", "source_unit", "canonical_unit")
    latest = read.groupBy("fact_id").agg(F.max(state).alias("o")).select("fact_id", "o.*").drop("recorded_at")
    graph = product_units(r.asDict() for r in rates.select("currency", "rate_date", "quoted_units", "krw_amount").collect())
    conversions = conversion_table(observations.sparkSession, graph, ["KRW", "PERCENT", "SHARE"])
    return converted(latest, conversions, "number", "source_unit", "canonical_unit")


def disagreeing_pairs(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """fact_id_1 < fact_id_2 of the same subject, metric and day whose values differ by more than the tolerance.

    Facts without a value or a day make no pair. The pairs are the result asked for; a skewed key is split by the adaptive skew join.
    """
    keys = ["subject_entity_id", "metric_code", "observed_on"]
    known = values.where(F.col("common_value").isNotNull() & F.col("observed_on").isNotNull()).select(*keys, "fact_id", "common_value")
    a = known.select(*keys, F.col("fact_id").alias("fact_id_1"), F.col("common_value").alias("v1"))
    b = known.select(*keys, F.col("fact_id").alias("fact_id_2"), F.col("common_value").alias("v2"))
    pairs = a.join(b, keys).where("fact_id_1 < fact_id_2")
    return pairs.where(F.abs(F.col("v1") - F.col("v2")) > tolerance * F.greatest(F.abs("v1"), F.abs("v2"))).select("fact_id_1", "fact_id_2")
