"""Projections of facts onto entities: values, roll-ups, provenance and long records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_list(fields: Sequence[str], sort: Sequence[str] = (), ordered: Sequence[str] = (), default: str = "name") -> list[str]:
    """Fields to project: the asked or the default, those sorted by and compared by, each once in order."""
    return list(dict.fromkeys([*(fields or [default]), *sort, *ordered]))


def joined_set(values: Column, separator: str = "|") -> Column:
    """Distinct values in byte order as one text; NULL for none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(values)), separator), F.lit(""))


def multi_value(facts: DataFrame, entity: str, value: str, out: str) -> DataFrame:
    """entity and its distinct values: one as it is, several joined."""
    return facts.where(F.col(value).isNotNull()).groupBy(entity).agg(joined_set(F.col(value).cast("string")).alias(out))


def rolled_up(parents: DataFrame, parent: str, own: str, children: DataFrame, value: str, out: str, keep_many: bool) -> DataFrame:
    """A parent's own value, else its children's: all of them, or only if they agree."""
    texts = children.where(F.col(value).isNotNull()).groupBy(parent).agg(F.count_distinct(value).alias("_n"), joined_set(F.col(value).cast("string")).alias("_v"))
    told = F.col("_v") if keep_many else F.when(F.col("_n") == 1, F.col("_v"))
    return parents.join(texts, parent, "left").select(parent, F.coalesce(F.col(own), told).alias(out))


def relation_names(relations: DataFrame, subject: str, target: str, entities: DataFrame, entity: str, name: str, out: str) -> DataFrame:
    """subject and the names of its targets; a target without a name shows its id."""
    named = relations.join(entities.select(F.col(entity).alias(target), F.col(name).alias("_name")), target, "left")
    return multi_value(named.withColumn("_shown", F.coalesce("_name", F.col(target).cast("string"))), subject, "_shown", out)


def provenance(evidence: DataFrame, entity: str, sets: dict[str, str]) -> DataFrame:
    """entity, ``kind``, ``member``: the distinct values of each (kind, column), a row for each, NULL values not.

    Sets stay rows: an entity may hold a third of all evidence, and no cell could take its members.
    """
    rows = evidence.select(entity, *[F.col(c).cast("string").alias(out) for out, c in sets.items()]).unpivot(entity, list(sets), "kind", "member")
    return rows.where(F.col("member").isNotNull()).distinct()


def provenance_counts(members: DataFrame, entity: str, counts: dict[str, str]) -> DataFrame:
    """entity and the number of its members of each (out, kind)."""
    return members.groupBy(entity).agg(*[F.count_if(F.col("kind") == kind).alias(out) for out, kind in counts.items()])


def long_records(df: DataFrame, entity: str, fields: Sequence[str]) -> DataFrame:
    """One row per (entity, field) with the value as text; empty cells are kept."""
    return df.select(entity, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(entity, list(fields), "field", "value")


def melt_filled(df: DataFrame, ids: Sequence[str], fields: Sequence[str], keep_missing: Sequence[str] = ()) -> DataFrame:
    """Long assertions of filled cells, and of missing ones for the fields that keep them."""
    rows = df.select(*ids, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in fields]).unpivot(list(ids), list(fields), "source_column", "raw_value")
    return rows.where(F.col("raw_value").isNotNull() | F.col("source_column").isin(list(keep_missing)))


def field_evidence(assertions: DataFrame, observations: DataFrame, record: str, column: str) -> DataFrame:
    """Assertions with the observation made from the same record and column, if any."""
    return assertions.join(observations, [record, column], "left")


def display_name(*names: Column) -> Column:
    """The first name that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


#: Qualities of an observation that may be shown.
SHOWN_QUALITIES = ("VALID", "SOURCE_ZERO")


def metric_details(observations: DataFrame, evidence: DataFrame, day: str, contract: DataFrame | None = None) -> DataFrame:
    """The latest valid, evidenced observation of every (entity, metric), whole, with the number of its evidence rows.

    ``observations`` has entity_id, metric, fact_id, observed_on, quality_status and what else is to be shown;
    ``evidence`` names a fact_id in each row. Days after ``day`` are out, missing days last, of equal ones the least
    fact_id. With contracts (any of metric, dataset, unit, scale_basis, currency as columns) only what they list and
    what has a day counts. Evidence is counted before the join, so a hot fact adds one row.
    """
    rows = observations.where(F.col("quality_status").isin(list(SHOWN_QUALITIES)) & (F.col("observed_on").isNull() | (F.col("observed_on") <= F.lit(day).cast("date"))))
    if contract is not None:
        rows = rows.where(F.col("observed_on").isNotNull()).join(contract.distinct(), contract.columns, "left_semi")
    backed = evidence.where(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(F.count(F.lit(1)).alias("evidence"))
    shown = [c for c in rows.columns if c not in ("entity_id", "metric", "evidence")]
    best = F.min(F.struct(F.col("observed_on").isNull().alias("_late"), (-F.unix_date("observed_on")).alias("_at"), "fact_id", F.struct(*shown, "evidence").alias("_row")))
    return rows.drop("evidence").join(backed, "fact_id").groupBy("entity_id", "metric").agg(best["_row"].alias("_row")).select("entity_id", "metric", "_row.*")


def profile_fields(outputs: Sequence[str], filters: Sequence, sorts: Sequence, entities: int) -> list[str]:
    """What to show of a request that only names one entity: name, type and identifiers; else what was asked."""
    return list(BASIC_PROFILE) if entities == 1 and not (outputs or filters or sorts) else list(outputs)


#: The fields of a basic profile.
BASIC_PROFILE = ("name", "type", "ticker", "isin")


def identifiers(rows: DataFrame, entity: str, value: str, shared: DataFrame) -> DataFrame:
    """entity and its identifiers that are well-formed and belong to no other entity (``shared`` has the others)."""
    from factweave.operators.quality import identifier

    normal, validation = identifier(F.col(value))
    known = rows.select(entity, normal.alias(value), validation.alias("_v")).where("_v = 'VALIDATED'").drop("_v").distinct()
    return known.join(shared.select(value).distinct(), value, "left_anti")


def missing_fields(records: DataFrame, assertions: DataFrame, record: str, payload: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(missing, unasserted) of records and fields without an assertion.

    A field the payload leaves empty is evidence of a missing value; one it fills should have been asserted.
    """
    from factweave.operators.quality import cleaned

    cells = records.select(record, F.from_json(F.col(payload), "map<string,string>").alias("_p")).select(record, F.explode(F.array(*[F.lit(f) for f in fields])).alias("source_column"), "_p")
    cells = cells.select(record, "source_column", cleaned(F.try_element_at("_p", F.col("source_column"))).alias("raw_value"))
    lacking = cells.join(assertions.where(F.col("source_column").isin(list(fields))).select(record, "source_column").distinct(), [record, "source_column"], "left_anti")
    return lacking.where("raw_value IS NULL").select(record, "source_column", F.lit("MISSING").alias("quality_status")), lacking.where("raw_value IS NOT NULL")
