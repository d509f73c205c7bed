"""Queries of the operators in this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import linkage, mixing, packing, spelling, subjects, survivor, tokens
from factweave.session import checkpointed, table


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Items that are shares of listed companies, with issuer and confidence."""
    return linkage.link_securities(table(spark, d, "kodex_holding_items"), table(spark, d, "krx_kind_companies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("item_id", "issuer_code")


def _linked_aliases(spark: SparkSession, d: str) -> DataFrame:
    return spelling.link_aliases(table(spark, d, "entity_aliases"), table(spark, d, "canonical_products"), table(spark, d, "canonical_entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of aliases that name the same entity."""
    return spelling.same_entity_pairs(_linked_aliases(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every readable alias with the entity class it names."""
    return _linked_aliases(spark, d)


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    candidates = survivor.case_candidates(table(spark, d, "fact_conflict_cases"), table(spark, d, "metric_observations"), table(spark, d, "canonical_entities"))
    return survivor.surviving_facts(candidates)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each undecided case."""
    return _survivors(spark, d).select("conflict_case_id", F.col("survivor").alias("fact_id"))


def p6_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Undecided cases with winner, new status and the record built field by field."""
    return _survivors(spark, d).withColumnRenamed("survivor", "winning_fact_id").withColumn("status", F.lit("RESOLVED"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of every size."""
    sized = checkpointed(tokens.token_counts(table(spark, d, "documents"), ["doc_id"]))
    return packing.document_containers(sized, table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_containers(spark, d), ["container_name"])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The selection with its schedule, one row per use of a document."""
    sized = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mixture(sized, table(spark, d, "mixture_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mixing.shares_reached(p9_mixture(spark, d), table(spark, d, "mixture_targets"))


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Every document's subjects with the part of its sentences on each."""
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "document_subject_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p6_resolved": p6_resolved, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_subjects": p10_subjects}


_P6_SQL = """
WITH one AS (SELECT conflict_case_id, any_value(upper(trim(status))) AS status, any_value(winning_fact_id) AS winner, any_value(from_json(candidate_fact_ids, '["VARCHAR"]')) AS ids FROM fact_conflict_cases GROUP BY 1),
asked AS (SELECT DISTINCT conflict_case_id, unnest(ids) AS fact_id FROM one WHERE coalesce(status, '') <> 'REJECTED' AND NOT coalesce(list_contains(ids, trim(winner)), false)),
fact AS (SELECT * FROM metric_observations QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at DESC NULLS LAST) = 1),
c AS (SELECT a.conflict_case_id, a.fact_id,
    CASE regexp_replace(upper(trim(e.name_status)), '[ -]+', '_', 'g') WHEN 'AUTHORITATIVE' THEN 3 WHEN 'SOURCE_ONLY' THEN 2 WHEN 'NO_AUTHORITATIVE_FAMILY_NAME' THEN 1 ELSE 0 END AS standing,
    (raw_value IS NOT NULL)::INT + (numeric_value IS NOT NULL)::INT + (unit IS NOT NULL)::INT + (currency IS NOT NULL)::INT AS complete,
    CASE WHEN observed_on <= DATE '2026-08-24' THEN observed_on ELSE DATE '0001-01-01' END AS day
  FROM asked a JOIN fact f USING (fact_id) LEFT JOIN canonical_entities e ON f.subject_entity_id = e.entity_id
  WHERE upper(trim(coalesce(quality_status, ''))) NOT IN ('INVALID', 'MISSING', 'NOT_APPLICABLE'))
SELECT conflict_case_id, fact_id FROM c QUALIFY row_number() OVER (PARTITION BY conflict_case_id ORDER BY standing DESC, complete DESC, day DESC, fact_id) = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _P6_SQL}
