"""Cleaning, validation, profiles, conflicts and reconciliation of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import parsing

#: Texts that stand for no date.
DATE_SENTINELS = ("0", "00000000", "10001231", "99991231")


def cleaned(value: Column, null_words: Sequence[str] = ()) -> Column:
    """Trimmed text; blank and the null words become NULL."""
    text = F.nullif(F.trim(value), F.lit(""))
    return F.when(~text.isin(list(null_words)), text) if null_words else text


def changed_values(df: DataFrame, fields: Sequence[str], null_words: Sequence[str] = ()) -> Column:
    """A map of the raw values that cleaning changes."""
    pairs = F.create_map(*[x for c in fields for x in (F.lit(c), F.when(~cleaned(F.col(c), null_words).eqNullSafe(F.col(c)), F.col(c)))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def dated(value: Column) -> tuple[Column, Column]:
    """(date, quality): quality is VALID, MISSING, SENTINEL or INVALID; 8 digits or divided by . / -."""
    text = F.nullif(F.trim(value), F.lit(""))
    date = F.when(~text.isin(list(DATE_SENTINELS)), parsing.day_divided(text))
    quality = F.when(text.isNull(), "MISSING").when(text.isin(list(DATE_SENTINELS)), "SENTINEL").when(date.isNull(), "INVALID").otherwise("VALID")
    return date, quality


def decimal_of(value: Column, scale: int = 15) -> Column:
    """A decimal without its commas, NULL for what is none."""
    return F.regexp_replace(F.trim(value), ",", "").try_cast(f"decimal(38,{scale})")


def first_reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that a row breaks (its column is not true), else NULL."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


def split_valid(df: DataFrame, reason: Column, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of one input; together they are all rows."""
    judged = df.withColumn(name, reason)
    return judged.where(F.col(name).isNull()).drop(name), judged.where(F.col(name).isNotNull())


def reconciled(source: DataFrame, loaded: DataFrame, quarantined: DataFrame, group: str) -> DataFrame:
    """group, source, loaded, quarantined rows and ``whole``: whether loaded and quarantined make up the source."""
    count = lambda df, name: df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    rows = count(source, "source").join(count(loaded, "loaded"), group, "full").join(count(quarantined, "quarantined"), group, "full")
    of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(group, of("source"), of("loaded"), of("quarantined")).withColumn("whole", F.col("source") == F.col("loaded") + F.col("quarantined"))


def ingestion_report(rows: DataFrame, dataset: str, record: str, value: str, valid: Column, at: str) -> DataFrame:
    """What was delivered by dataset: assertions, records, valid and blank ones, and the newest day."""
    blank = cleaned(F.col(value)).isNull()
    return rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("assertions"), F.count_distinct(record).alias("records"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"), F.count_if(blank).alias("blank"), F.to_date(F.max(at)).alias("newest"))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with ``duplicate_no``: 1 for the first row of a key in source order, more for later ones."""
    return df.withColumn("duplicate_no", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def last_write(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, that of the greatest version; partial results per task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(*version, F.struct(*rest).alias("_row")))["_row"].alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def profile(df: DataFrame, scopes: Sequence[str], fields: Sequence[str], all_label: str = "__all__") -> DataFrame:
    """total, valid, missing, coverage, distinct values and constancy of each field in every scope and over all.

    One set of groupings over the scopes instead of a query per scope. Rows are counted by value first, so the groupings
    and their distinct counts meet each value of a scope once.
    """
    long = df.select(*scopes, *[cleaned(F.col(c).cast("string")).alias(c) for c in fields]).unpivot(list(scopes), list(fields), "field", "value")
    values = long.groupBy(*scopes, "field", "value").agg(F.count(F.lit(1)).alias("_n"))
    sets = [[*chosen, "field"] for k in range(len(scopes) + 1) for chosen in combinations(scopes, k)]
    counted = values.groupingSets([[F.col(c) for c in one] for one in sets], *scopes, "field").agg(F.sum("_n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("valid"), F.count_distinct("value").alias("unique_values"), F.min("value").alias("_v"), *[F.grouping(s).alias(f"_g_{s}") for s in scopes])
    named = [F.when(F.col(f"_g_{s}") == 1, all_label).otherwise(F.col(s)).alias(s) for s in scopes]
    constant = F.col("unique_values") == 1
    return counted.select(*named, "field", "total", "valid", (F.col("total") - F.col("valid")).alias("missing"), F.round(F.col("valid") / F.col("total"), 6).alias("coverage"), "unique_values", constant.alias("is_constant"), F.when(constant, F.col("_v")).alias("constant_value"))


def coverage(df: DataFrame, qualities: Mapping[str, Column]) -> DataFrame:
    """field, total and rows by quality for fields given with their quality column."""
    states = ("VALID", "MISSING", "SENTINEL", "INVALID")
    long = df.select(*[q.alias(n) for n, q in qualities.items()]).unpivot([], list(qualities), "field", "quality")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("quality") == s).alias(s.lower()) for s in states])


def shared_identifiers(df: DataFrame, identifier: Sequence[str], entity: str, out: str = "entities") -> DataFrame:
    """Identifiers that belong to more than one entity, with their number. Members stay in the data: join back for them."""
    return df.dropna(subset=[*identifier, entity]).groupBy(*identifier).agg(F.count_distinct(entity).alias(out)).where(F.col(out) > 1)


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct value; no vote is taken."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.min(value).alias("least"), F.max(value).alias("greatest")).where(F.col("values") > 1)


def contract_violations(df: DataFrame, keys: Sequence[str], contract: DataFrame) -> DataFrame:
    """Counts of key combinations that the contract does not list."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).join(contract.select(*keys).distinct(), list(keys), "left_anti")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; NULL keys are orphans too."""
    return df.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows repeat an earlier one: the sum of group sizes less one."""
    return df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("duplicates"))


def identifier(value: Column) -> tuple[Column, Column]:
    """(normalized ISIN-like identifier, validation): VALIDATED, ZERO or INVALID."""
    text = F.upper(F.trim(value))
    return text, F.when(text.isNull() | (text == ""), None).when(text.rlike("^0+$"), "ZERO").when(text.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), "VALIDATED").otherwise("INVALID")


def proportion(percent: Column) -> Column:
    """A percentage from 0 to 100 as a proportion; others NULL."""
    number = decimal_of(percent.cast("string"), 10)
    return F.when(number.between(0, 100), (number / 100).cast("decimal(38,12)"))


def cutoff_violations(df: DataFrame, on: str, cutoff: str) -> DataFrame:
    """Rows dated after the cutoff, or not dated."""
    return df.where(F.col(on).isNull() | (F.col(on) > F.lit(cutoff).cast("date")))


def released_scope(items: DataFrame, product: str, status: Column, ready: str, links: DataFrame, sources: DataFrame, on: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, links, problems) of products whose every row is ready.

    Links and sources are followed by ``item_id`` and ``source_id``. Problems, which must be empty, are links without a
    source and products with more than one day.
    """
    whole = items.groupBy(product).agg(F.bool_and(F.coalesce(status == ready, F.lit(False))).alias("_ready"), F.count_distinct(on).alias("_days"))
    kept = items.join(whole.where("_ready").select(product), product, "left_semi")
    used = links.join(kept.select("item_id"), "item_id", "left_semi")
    lost = used.join(sources.select("source_id"), "source_id", "left_anti").select(F.lit("NO_SOURCE").alias("problem"), F.col("source_id").cast("string").alias("key"))
    days = whole.where("_ready AND _days > 1").select(F.lit("SEVERAL_DAYS").alias("problem"), F.col(product).cast("string").alias("key"))
    return kept, used, lost.unionByName(days)
