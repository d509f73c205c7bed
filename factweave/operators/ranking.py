"""Latest observations, ranking, top-k and the counts that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.predicates import RequestRefused, rank_of
from factweave.session import checkpointed

#: The greatest limit and the default ones.
MAX_LIMIT, DEFAULT_LIMIT, DEFAULT_TOP = 10_000, 10, 5


def checked_limit(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    if limit is None:
        return default
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise RequestRefused("a limit is a positive whole number")
    return min(limit, MAX_LIMIT)


def latest(observations: DataFrame, keys: Sequence[str], on: str, tie: str, values: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """keys and values of each key's latest observation: latest day, NULL days last, then least tie.

    One aggregation with partial results per task; a window would sort every observation of a key in one task.
    """
    rows = observations if as_of is None else observations.where(F.col(on) <= as_of)
    best = F.min(F.struct(F.col(on).isNull().alias("_late"), (-F.unix_micros(F.col(on).cast("timestamp"))).alias("_at"), F.col(tie).alias("_tie"), F.struct(on, *[c for c in values if c != on]).alias("_row")))
    return rows.groupBy(*keys).agg(best["_row"].alias("_row")).select(*keys, F.col(f"_row.{on}").alias(on), *[F.col(f"_row.{c}").alias(c) for c in values if c != on])


def top(df: DataFrame, order: Sequence[tuple[str, bool]], tie: str, limit: int | None) -> DataFrame:
    """The first rows by (column, descending) keys, then tie; rows that lack a key are left out."""
    for column, _ in order:
        df = df.where(F.col(column).isNotNull())
    keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    return df.orderBy(*keys, F.col(tie).asc()).limit(checked_limit(limit))


def ordered_nulls_last(df: DataFrame, column: str, descending: bool, tie: str, limit: int | None) -> DataFrame:
    """The older order: rows without a value come last in either direction."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, F.col(tie).asc()).limit(checked_limit(limit))


def rank_counts(entities: DataFrame, entity: str, metric: str) -> DataFrame:
    """filtered, rankable and missing entities in one pass."""
    return entities.agg(F.count_distinct(entity).alias("filtered_count"), F.count_distinct(F.when(F.col(metric).isNotNull(), F.col(entity))).alias("rankable_count")).withColumn("missing_count", F.col("filtered_count") - F.col("rankable_count"))


def top_per_group(df: DataFrame, group: Sequence[str], metric: str, descending: bool, tie: str, k: int) -> DataFrame:
    """The first k of each group with their ``rank``; Spark limits rows per group before the shuffle."""
    key = F.col(metric).desc() if descending else F.col(metric).asc()
    ranked = df.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(key, F.col(tie))))
    return ranked.where(F.col("rank") <= k)


def by_vocabulary(df: DataFrame, column: str, ranks: Mapping[str, int], descending: bool, tie: str, limit: int | None) -> DataFrame:
    """The first rows by the place of a value in an ordered vocabulary."""
    return top(df.withColumn("_rank", rank_of(F.col(column), ranks)), [("_rank", descending)], tie, limit).drop("_rank")


def freshness(rows: DataFrame, group: str, on: str) -> DataFrame:
    """rows with ``freshness``: LATEST on the group's last day, STALE before, UNKNOWN without a day."""
    last = rows.groupBy(group).agg(F.max(on).alias("_last"))
    state = F.when(F.col(on).isNull(), "UNKNOWN").when(F.col(on) == F.col("_last"), "LATEST").otherwise("STALE")
    return rows.join(last, group, "left").withColumn("freshness", state).drop("_last")


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Percentiles by nearest rank (the least value with at least that part at or below it), exact.

    Equal values are counted first, then the counts are laid out by value over all tasks and each task's rows are
    ranked from where the tasks before it end, so a group of any size is never sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # written once: both readers below must see the same layout, also after a lost executor
    laid = checkpointed(counts.repartitionByRange(*group, "_v").withColumn("_task", F.spark_partition_id()))
    sums = laid.groupBy(*group, "_task").agg(F.sum("_n").alias("_sum"))
    by_task = Window.partitionBy(*group).orderBy("_task")
    before = sums.select(*group, "_task", (F.sum("_sum").over(by_task) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"))
    inner = F.sum("_n").over(Window.partitionBy(*group, "_task").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("l._task") == F.col("b._task")]
    ranked = laid.withColumn("_inner", inner).alias("l").join(before.alias("b"), keys).select(*[F.col(f"l.{g}").alias(g) for g in group], "_v", (F.col("_before") + F.col("_inner")).alias("_upto"), "_total")
    return ranked.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.lit(q) * F.col("_total")), F.col("_v"))).alias(name) for name, q in quantiles.items()])
