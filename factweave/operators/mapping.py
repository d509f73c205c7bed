"""Source records brought to the canonical model: classes of values, codes, parents, metrics, categories.

What differs between sources (columns, codes, placeholders, contracts) comes in as parameters or small tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import parsing
from factweave.operators.predicates import RequestRefused
from factweave.operators.quality import DATE_SENTINELS, cleaned, dated

#: What an index that is none is called, and marks of blends.
NO_INDEX = ("not provided", "not available", "해당없음", "없음")
BLENDS = (" 25%", " 50%", " 75%", " 90%")


def _table(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _coded(value: Column, codes: Mapping[str, str]) -> Column:
    return F.try_element_at(_table(codes), value) if codes else F.lit(None).cast("string")


def assertion_class(value: Column, is_date: Column, sentinel: Column, malformed: Column, by_policy: Column, placeholder: Column) -> Column:
    """Struct (quality, normalized) of a source field's value.

    In this order: MISSING (blank), SENTINEL (a date or a value that stands for none), INVALID (no date where one must
    be, or malformed), UNUSABLE_BY_POLICY (kept, but for provenance only), the placeholder's own class, VALID. Only
    VALID and UNUSABLE_BY_POLICY keep a value; a valid date comes as year-month-day.
    """
    text = cleaned(value)
    day, day_quality = dated(text)
    made = lambda quality, kept=None: F.struct(F.lit(quality).alias("quality") if isinstance(quality, str) else quality.alias("quality"), (F.lit(None) if kept is None else kept).cast("string").alias("normalized"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(text.isNull(), made("MISSING"))
        .when(no(is_date) & text.isin(list(DATE_SENTINELS)) | no(sentinel), made("SENTINEL"))
        .when(no(is_date) & (day_quality == "INVALID") | no(malformed), made("INVALID"))
        .when(no(by_policy), made("UNUSABLE_BY_POLICY", text))
        .when(placeholder.isNotNull(), made(placeholder))
        .otherwise(made("VALID", F.when(no(is_date), day.cast("string")).otherwise(text)))
    )


def type_violations(cells: DataFrame, value: str, value_type: str) -> DataFrame:
    """Cells whose text suits not the declared type; blank cells suit any, unknown types nothing."""
    from factweave.operators.wide import fits

    return cells.where(cleaned(F.col(value)).isNotNull() & ~F.coalesce(fits(parsing.stripped(F.col(value)), F.col(value_type)), F.lit(False)))


def namespaced(namespace: Column, *keys: Column) -> Column:
    """An id of a namespace and its keys; NULL if a key is missing."""
    parts = [cleaned(k.cast("string")) for k in keys]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole &= p.isNotNull()
    return F.when(whole, F.concat_ws(":", namespace, *parts))


def mapped(records: DataFrame, payload: str, dataset: str, layouts: Mapping[str, Mapping[str, Sequence[str]]], namespaces: Mapping[str, str], key: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``product_id`` and one column per canonical field, from JSON payloads of several datasets.

    A layout names, for a dataset, the payload fields a canonical field is taken from: the first that is filled.
    Payloads are parsed once, into the fields that any layout names.
    """
    fields = sorted({f for layout in layouts.values() for sources in layout.values() for f in sources})
    parsed = records.withColumn("_p", F.from_json(F.col(payload), ", ".join(f"`{f}` string" for f in fields)))
    which = F.upper(F.trim(F.col(dataset)))
    out = []
    for name in dict.fromkeys(c for layout in layouts.values() for c in layout):
        value = F.lit(None).cast("string")
        for ds, layout in layouts.items():
            if name in layout:
                value = F.when(which == ds, F.coalesce(*[cleaned(F.col(f"_p.{f}")) for f in layout[name]])).otherwise(value)
        out.append(value.alias(name))
    return parsed.where(which.isin(list(layouts))).select(*keep, namespaced(_coded(which, namespaces), F.col(key)).alias("product_id"), *out)


def parent_key(representative: Column, legacy_class: Column, own: Column, pattern: str = "^[A-Za-z0-9]{12}$") -> tuple[Column, Column]:
    """(parent id, rule) of a share class: a well-formed representative id, else its own id if it has a class code.

    Without either no parent is invented: the id is NULL and the rule UNRESOLVED.
    """
    usable = F.when(cleaned(representative).rlike(pattern) & ~cleaned(representative).rlike("^0+$"), cleaned(representative))
    legacy = cleaned(legacy_class)
    return F.coalesce(usable, F.when(legacy.isNotNull(), cleaned(own))), F.when(usable.isNotNull(), "REPRESENTATIVE").when(legacy.isNotNull(), "CLASS_CODE").otherwise("UNRESOLVED")


def code(value: Column, pattern: str, prefix: str = "") -> Column:
    """An upper-case code of a pattern, a known prefix taken off; NULL for anything else, all zeros included."""
    text = F.regexp_replace(F.upper(cleaned(value)), f"^{prefix.upper()}", "") if prefix else F.upper(cleaned(value))
    return F.when(text.rlike(pattern) & ~text.rlike("^0+$"), text)


def code_state(value: Column, states: Mapping[str, str], other: str | None = "UNKNOWN") -> Column:
    """A code's state by a table; codes it doesn't list, and missing ones, have the other state."""
    return F.coalesce(_coded(cleaned(value), states), F.lit(other))


def atomic_index(value: Column) -> Column:
    """Whether a text names one index: no placeholder, no sum, no weighted blend. NULL stays NULL."""
    plain = F.lower(value)
    named = ~F.contains(value, F.lit("+"))
    for mark in (*NO_INDEX, *BLENDS):
        named &= ~F.contains(plain, F.lit(mark))
    return named


def relation_target(value: str, controlled: Mapping[str, str] | None, prefix: str = "") -> str:
    """The canonical target of a relation from a code, a dotted or a prefixed form; unknown ones are refused."""
    if not isinstance(value, str) or not value.strip():
        raise RequestRefused("a relation needs a target")
    if controlled is None:
        return value
    raw = value.strip()
    short = raw[len(prefix) :] if prefix and raw.startswith(prefix) else raw.rsplit(".", 1)[-1]
    if short.upper() not in controlled:
        raise RequestRefused(f"{value} is no known target")
    return controlled[short.upper()]


def by_category(assertions: DataFrame, mapping: DataFrame, categories: Mapping[str, str], valid: Column) -> dict[str, DataFrame]:
    """Valid assertions as one frame per kind (identifier, observation, relation ...), by a mapping of columns.

    ``mapping`` has source_dataset, source_column and category and is as small as the sources' layouts; columns it does
    not list, and categories without a kind, belong to no frame. All frames read one join.
    """
    kinds = mapping.select("source_dataset", "source_column", _coded(F.col("category"), categories).alias("kind")).where("kind IS NOT NULL").dropDuplicates(["source_dataset", "source_column"])
    sorted_out = assertions.where(valid).join(kinds, ["source_dataset", "source_column"])
    return {kind: sorted_out.where(F.col("kind") == kind).drop("kind") for kind in dict.fromkeys(categories.values())}


def emitted_metrics(rows: DataFrame, ids: Sequence[str], metrics: Mapping[str, tuple[str, str, str]], currency: str, observed_on: str, contracts: DataFrame, dataset: str, may_be_zero: Sequence[str] = ()) -> DataFrame:
    """One observation per filled metric column, with quality and comparability.

    ``metrics`` gives (metric, unit, scale) of each column. A zero is SOURCE_ZERO unless the metric may be zero. An
    observation is COMPARABLE if a contract (metric, dataset, unit, scale_basis, currency; NULL for any) lists it and it
    has a day.
    """
    base = [*ids, dataset, currency, observed_on]
    long = rows.select(*base, *[F.col(c).cast("decimal(38,15)").alias(c) for c in metrics]).unpivot(base, list(metrics), "_column", "numeric_value").where("numeric_value IS NOT NULL")
    part = lambda i: _coded(F.col("_column"), {c: m[i] for c, m in metrics.items()})
    told = long.select(*ids, F.col(dataset).alias("dataset"), part(0).alias("metric"), part(1).alias("unit"), part(2).alias("scale_basis"), F.col(currency).alias("currency"), F.col(observed_on).alias("observed_on"), "numeric_value")
    quality = F.when((F.col("numeric_value") == 0) & ~F.col("metric").isin(list(may_be_zero)), "SOURCE_ZERO").otherwise("VALID")
    keys = ["metric", "dataset", "unit", "scale_basis"]
    listed = contracts.groupBy(*keys).agg(F.collect_set("currency").alias("_currencies"), F.bool_or(F.col("currency").isNull()).alias("_any"))
    joined = told.join(listed, keys, "left")
    fits = F.coalesce(F.col("_any") | F.array_contains("_currencies", F.col("currency")), F.lit(False)) & F.col("observed_on").isNotNull()
    return joined.select(*ids, *keys, "currency", "observed_on", "numeric_value", quality.alias("quality_status"), F.when(fits, "COMPARABLE").otherwise("NOT_COMPARABLE").alias("comparability"))
