"""Checks of an answer's evidence as rows: (code, severity, entity_id, field, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ("code", "severity", "entity_id", "field", "detail")


def _row(df: DataFrame, code: str, severity: Column | str, detail: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(code).alias("code"), level.alias("severity"), "entity_id", "field", detail.cast("string").alias("detail"))


def conflicting(evidence: DataFrame, required: Sequence[str], multi_valued: Sequence[str] = ()) -> DataFrame:
    """Fields with several values for one entity: blocking where required; fields that may have many are exempt."""
    rows = evidence.where(~F.col("field").isin(list(multi_valued))).groupBy("entity_id", "field").agg(F.count_distinct("value").alias("_n")).where("_n > 1")
    return _row(rows, "CONFLICT", F.when(F.col("field").isin(list(required)), "BLOCKING").otherwise("WARNING"), F.col("_n"))


def missing(entities: DataFrame, evidence: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required fields an entity has no value for."""
    wanted = entities.select("entity_id").distinct().select("entity_id", F.explode(F.array(*[F.lit(f) for f in required])).alias("field"))
    have = evidence.where(F.col("value").isNotNull()).select("entity_id", "field").distinct()
    return _row(wanted.join(have, ["entity_id", "field"], "left_anti"), "MISSING", "BLOCKING", F.lit(None))


def sentinels(evidence: DataFrame, words: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Values that stand for no value."""
    rows = evidence.where(F.col("value").isin(list(words)))
    return _row(rows, "SENTINEL", F.when(F.col("field").isin(list(required)), "BLOCKING").otherwise("WARNING"), F.col("value"))


def mixed_dates(evidence: DataFrame) -> DataFrame:
    """Fields compared across entities with different days of observation."""
    rows = evidence.groupBy("field").agg(F.count_distinct("observed_on").alias("_n")).where("_n > 1").withColumn("entity_id", F.lit(None).cast("string"))
    return _row(rows, "OBSERVATION_DATES_DIFFER", "WARNING", F.col("_n"))


def incomparable(evidence: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Fields whose values don't share dataset, unit, scale and so on, or that fewer than two entities have."""
    same = [F.count_distinct(c) for c in contract]
    rows = evidence.groupBy("field").agg(F.count_distinct("entity_id").alias("_e"), F.greatest(*same, F.lit(0)).alias("_n") if len(same) > 1 else same[0].alias("_n")).where("_e < 2 OR _n > 1").withColumn("entity_id", F.lit(None).cast("string"))
    return _row(rows, "CONTRACT_BROKEN", "BLOCKING", F.concat_ws("/", F.col("_e").cast("string"), F.col("_n").cast("string")))


def low_coverage(entities: DataFrame, evidence: DataFrame, fields: Sequence[str], least: float) -> DataFrame:
    """Fields that too few of the entities have a value for, those that none has included."""
    total = entities.agg(F.count_distinct("entity_id")).scalar()
    counts = [F.count_distinct(F.when((F.col("field") == f) & F.col("value").isNotNull(), F.col("entity_id"))) for f in fields]
    have = evidence.agg(F.array(*[F.struct(F.lit(f).alias("field"), n.alias("_have")) for f, n in zip(fields, counts)]).alias("_f")).select(F.inline("_f"))
    rows = have.withColumn("_all", total).where(F.col("_have") / F.col("_all") < least).withColumn("entity_id", F.lit(None).cast("string"))
    return _row(rows, "LOW_COVERAGE", "BLOCKING", F.round(F.col("_have") / F.col("_all"), 6))


def unresolved(resolved: DataFrame, hits: DataFrame, mention: str) -> DataFrame:
    """Mentions (of ``entity.resolution``) that name no entity, or several: each of those is blocked as a whole."""
    none = resolved.where("status = 'UNRESOLVED'").select(mention, F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("field"))
    many = hits.join(resolved.where("status = 'AMBIGUOUS'").select(mention), mention, "left_semi").select(mention, "entity_id", F.lit(None).cast("string").alias("field")).distinct()
    return _row(none, "ENTITY_UNRESOLVED", "BLOCKING", F.col(mention)).unionByName(_row(many, "AMBIGUOUS_ENTITY", "BLOCKING", F.col(mention)))


def mismatched(resolved: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities that evidence speaks of although others were resolved."""
    expected = resolved.where("status = 'RESOLVED'").select("entity_id").distinct()
    other = evidence.where(F.col("entity_id").isNotNull()).select("entity_id").distinct().join(expected, "entity_id", "left_anti")
    rows = other.where(expected.agg(F.count(F.lit(1))).scalar() > 0).withColumn("field", F.lit(None).cast("string"))
    return _row(rows, "ENTITY_MISMATCH", "BLOCKING", F.lit(None))


def all_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict_matrix(entities: DataFrame, fields: Sequence[str], findings: DataFrame) -> DataFrame:
    """entity_id, answerable fields, verdict: FULLY, PARTIALLY or UNANSWERABLE, from the blocking findings.

    A finding without a field blocks all fields of its entity.
    """
    cells = entities.select("entity_id").distinct().select("entity_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    touched = F.when(F.col("field").isNull(), F.array(*[F.lit(f) for f in fields])).otherwise(F.array("field"))
    bad = findings.where("severity = 'BLOCKING'").select("entity_id", F.explode(touched).alias("field")).distinct().withColumn("_bad", F.lit(1))
    counted = cells.join(bad, ["entity_id", "field"], "left").groupBy("entity_id").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_bad").isNull()).alias("answerable"))
    return counted.select("entity_id", "answerable", F.when(F.col("answerable") == F.col("_all"), "FULLY").when(F.col("answerable") > 0, "PARTIALLY").otherwise("UNANSWERABLE").alias("verdict"))


def empty_result(candidates: int | None, evidenced: int, retrieved: int | None = None) -> str | None:
    """Why a result is empty: nothing matched, matches have no evidence at all, or none that can be used.

    candidates: None if no search told; retrieved: evidence found, usable or not, None if not counted.
    """
    if evidenced:
        return None
    if candidates == 0:
        return "ZERO_MATCH"
    return "NO_EVIDENCE" if retrieved == 0 else "INSUFFICIENT_EVIDENCE"


def step_problems(statuses: dict[str, str]) -> list[tuple[str, str]]:
    """(code, step) of the steps that did not succeed: each blocks the answer."""
    codes = {"FAILED": "STEP_FAILED", "TIMED_OUT": "STEP_TIMED_OUT", "SKIPPED": "STEP_SKIPPED"}
    return [(codes[s], name) for name, s in statuses.items() if s in codes]


def receipt_problems(asked: Sequence[str], applied: Sequence[str], has_or: bool = False, or_applied: bool = False, sorted_by: str | None = None, ranked_by: str | None = None) -> list[tuple[str, str]]:
    """What was asked but not applied, or applied unasked: constraints, an OR, the order."""
    out = [("CONSTRAINT_NOT_APPLIED", k) for k in asked if k not in applied] + [("CONSTRAINT_NOT_ASKED", k) for k in applied if k not in asked]
    if has_or and not or_applied:
        out.append(("OR_NOT_APPLIED", "tree"))
    if sorted_by is not None and sorted_by != ranked_by:
        out.append(("RANKING_NOT_APPLIED", sorted_by))
    return out


def snapshots_differ(evidence: DataFrame, policy: dict[str, str]) -> DataFrame:
    """Fields whose values come from several snapshots; the severity is the field's, BLOCKING if none is given."""
    rows = evidence.groupBy("field").agg(F.count_distinct("snapshot_id").alias("_n")).where("_n > 1").withColumn("entity_id", F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for pair in (policy or {"": "BLOCKING"}).items() for x in pair])
    return _row(rows, "SNAPSHOT_MISMATCH", F.coalesce(F.try_element_at(table, F.col("field")), F.lit("BLOCKING")), F.col("_n"))
