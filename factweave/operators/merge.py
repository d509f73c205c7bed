"""Results of several sources combined: candidate intersection, ranking kept, differences, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intersected(parts: Sequence[DataFrame], entity: str) -> DataFrame:
    """Entities in all parts."""
    return reduce(lambda a, b: a.join(b.select(entity).distinct(), entity, "left_semi"), parts[1:], parts[0].select(entity).distinct())


def kept_records(records: Sequence[DataFrame], chosen: DataFrame, entity: str) -> DataFrame:
    """All records of the chosen entities, each (source, source_id, field) once."""
    rows = reduce(DataFrame.unionByName, records)
    return rows.join(chosen.select(entity).distinct(), entity, "left_semi").dropDuplicates(["source", "source_id", "field"])


def ranked(primary: DataFrame, others: Sequence[DataFrame], entity: str, rank: str, limit: int) -> DataFrame:
    """Rows of a ranked, complete result that all others hold too, in its order; the limit comes last."""
    both = reduce(lambda a, b: a.join(b.select(entity).distinct(), entity, "left_semi"), others, primary)
    return both.orderBy(rank, entity).limit(limit)


def key_changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: new, removed or changed between two versions of a table with unique keys."""
    a, b = before.select(key, F.col(content).alias("_a"), F.lit(1).alias("_in_a")), after.select(key, F.col(content).alias("_b"), F.lit(1).alias("_in_b"))
    kind = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")


def compared(left: DataFrame, right: DataFrame, entity: str) -> DataFrame:
    """One row: entities on both sides, only left, only right, and the verdict on two results."""
    l, r = left.select(entity).distinct().withColumn("_l", F.lit(1)), right.select(entity).distinct().withColumn("_r", F.lit(1))
    n = l.join(r, entity, "full").agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))
    verdict = F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "EQUAL").when(F.col("only_left") == 0, "SUBSET").when(F.col("only_right") == 0, "SUPERSET").when(F.col("both") == 0, "DISJOINT").otherwise("OVERLAP")
    return n.withColumn("verdict", verdict)


def first_of_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def attached(primary: DataFrame, matches: DataFrame, entity: str, fields: Sequence[str], out: str) -> DataFrame:
    """primary with the matches of each entity as a sorted array of structs, at most one per match row."""
    lists = matches.groupBy(entity).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(out))
    return primary.join(lists, entity, "left")
