"""Attribute-value rows to wide rows by log-structured upserts.

A batch of attribute-value rows becomes one sparse delta per entity, a map from attribute to its newest cell in the
batch; the cell carries its version. Compaction merges the runs of deltas and keeps the newest version of every cell.
Late, repeated and repaired rows are later versions, so the order in which batches arrive does not matter. ``RunStore``
keeps the runs on disk, where later batches are appended and levels compacted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import parsing

#: Declared types.
TYPES = ("text", "numeric", "integer", "date", "flag")
CELL = "struct<fits:boolean,at:timestamp_ntz,tie:string,value:string>"


def fits(value: Column, value_type: Column) -> Column:
    """Whether text suits a declared type; unknown types suit nothing."""
    return (
        F.when(value_type == "text", F.lit(True))
        .when(value_type == "numeric", value.rlike(parsing.DECIMAL_GROUPED))
        .when(value_type == "integer", value.rlike(parsing.INTEGER))
        .when(value_type == "date", parsing.day_divided(value).isNotNull())
        .when(value_type == "flag", value.rlike(parsing.FLAG))
        .otherwise(F.lit(False))
    )


def typed(value: Column, value_type: str) -> Column:
    """Text that suits its type as a value of it."""
    return {
        "text": lambda: value,
        "numeric": lambda: parsing.decimal(value),
        "integer": lambda: value.try_cast("long"),
        "date": lambda: parsing.day_divided(value),
        "flag": lambda: F.upper(value) == "Y",
    }[value_type]()


def deltas(rows: DataFrame, entity: Sequence[str], attribute: str, value_type: str, value: str, at: str, tie: str, batch: Column) -> DataFrame:
    """One row per entity and batch: entity columns, ``_batch``, ``cells`` (map attribute -> cell).

    Cells that suit their type beat those that do not, then later ``at``, then greater ``tie``; a NULL ``at`` is the
    earliest. Rows without an entity, attribute or value make no cell. Repeated rows are combined before the
    shuffle, so a hot entity sends at most one cell per attribute, batch and task.
    """
    text = parsing.stripped(F.col(value))
    cell = F.struct(fits(text, F.col(value_type)).alias("fits"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(tie).cast("string").alias("tie"), text.alias("value"))
    known = F.col(attribute).isNotNull() & F.col(value).isNotNull()
    for c in entity:
        known &= F.col(c).isNotNull()
    newest = rows.where(known).select(*entity, batch.alias("_batch"), F.col(attribute).alias("_attribute"), cell.alias("_cell")).groupBy(*entity, "_batch", "_attribute").agg(F.max("_cell").alias("_cell"))
    return newest.repartition(*entity).groupBy(*entity, "_batch").agg(F.map_from_entries(F.collect_list(F.struct("_attribute", "_cell"))).alias("cells"))


def merged(left: Column, right: Column) -> Column:
    """Two maps of cells as one with the newest version of each."""
    return F.map_zip_with(left, right, lambda _, a, b: F.greatest(a, b))


def compact(runs: DataFrame, entity: Sequence[str]) -> DataFrame:
    """One row per entity with the newest version of each cell, whatever the number and order of runs.

    Deltas of one run are already grouped by entity, so this adds no shuffle to them. An entity has as many deltas as
    batches, not as rows.
    """
    all_runs = runs.groupBy(*entity).agg(F.collect_list("cells").alias("_runs"))
    first = F.col("_runs")[0]
    rest = F.slice("_runs", 2, F.greatest(F.size("_runs") - 1, F.lit(0)))
    return all_runs.select(*entity, F.when(F.size("_runs") == 1, first).otherwise(F.aggregate(rest, first, merged)).alias("cells"))


class RunStore:
    """Runs of deltas on disk: every batch is appended as one sorted run, and compaction replaces runs by their merge.

    A run holds a delta per entity, bucketed by the entity's hash and sorted within, under ``path/level=L/run=R``; level
    0 takes the appended runs, compaction of a level writes one run of the next. A run is complete once its _SUCCESS
    file is there; a run written again replaces itself, so a batch may be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, entity: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.entity, self.buckets = spark, path, list(entity), buckets

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, level: int | None = None) -> list[str]:
        """Folders of the complete runs, of one level or of all."""
        root, fs = self._fs(self.path)
        if not fs.exists(root):
            return []
        found = []
        for one in fs.listStatus(root):
            if level is None or one.getPath().getName() == f"level={level}":
                found += [str(r.getPath().toString()) for r in fs.listStatus(one.getPath())] if one.isDirectory() else []
        return sorted(r for r in found if fs.exists(self._fs(f"{r}/_SUCCESS")[0]))

    def _write(self, cells: DataFrame, level: int, name: str) -> str:
        to = f"{self.path}/level={level}/run={name}"
        bucket = F.pmod(F.xxhash64(*self.entity), F.lit(self.buckets))
        cells.repartition(self.buckets, bucket).sortWithinPartitions(*self.entity).write.mode("overwrite").parquet(to)
        return to

    def append(self, batch: DataFrame, name: str) -> str:
        """One batch of deltas (entity, cells) as a run of level 0."""
        return self._write(compact(batch, self.entity), 0, name)

    def read(self) -> DataFrame | None:
        """The newest version of every cell over all runs; None if there are none."""
        folders = self.runs()
        return compact(self.spark.read.parquet(*folders).select(*self.entity, "cells"), self.entity) if folders else None

    def compact_level(self, level: int, fan_in: int = 4) -> str | None:
        """Merge a level's runs into one of the next once there are ``fan_in``; the merged are then deleted.

        A crash before the delete leaves runs twice, which changes nothing: a cell's newest version stays the same.
        """
        folders = self.runs(level)
        if len(folders) < fan_in:
            return None
        merged_runs = compact(self.spark.read.parquet(*folders).select(*self.entity, "cells"), self.entity)
        to = self._write(merged_runs, level + 1, f"{folders[0].rsplit('run=', 1)[1]}-{folders[-1].rsplit('run=', 1)[1]}")
        for one in folders:
            folder, fs = self._fs(one)
            fs.delete(folder, True)
        return to


def wide(compacted: DataFrame, entity: Sequence[str], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Typed columns for (attribute, value_type) pairs; a cell without a suitable value is NULL.

    An attribute named like an entity column comes out with ``_value`` appended.
    """
    taken = {e.lower() for e in entity}
    out = []
    for name, kind in columns:
        cell = F.try_element_at("cells", F.lit(name))
        value = F.when(cell["fits"], typed(cell["value"], kind))
        out.append(value.alias(f"{name}_value" if name.lower() in taken else name))
    return compacted.select(*entity, *out)


def unfit_cells(compacted: DataFrame, entity: Sequence[str], attribute: str) -> DataFrame:
    """(entity, attribute) of the cells that had values but none that suits the type."""
    bad = F.map_keys(F.map_filter("cells", lambda _, c: ~c["fits"]))
    return compacted.where(F.size(bad) > 0).select(*entity, F.explode(bad).alias(attribute))


def assertion_cells(assertions: DataFrame, types: DataFrame) -> DataFrame:
    """Assertions with the declared column and type; the declared table is fixed and small.

    The notation of a column name (case, blanks) does not matter; undeclared columns are left out.
    """
    declared = types.select(F.upper(F.trim("source_dataset")).alias("_ds"), F.lower(F.trim("source_column")).alias("_col"), F.col("source_column").alias("_declared"), F.lower(F.trim("value_type")).alias("_type")).dropDuplicates(["_ds", "_col"])
    keyed = assertions.select(
        F.trim("source_record_id").alias("source_record_id"),
        F.upper(F.trim("source_dataset")).alias("_ds"),
        F.lower(parsing.stripped(F.col("source_column"))).alias("_col"),
        "normalized_value",
        "asserted_at",
        "assertion_id",
    )
    return keyed.join(F.broadcast(declared), ["_ds", "_col"]).withColumnRenamed("_ds", "source_dataset")


def declared_columns(types: DataFrame, dataset: str) -> list[tuple[str, str]]:
    """(column, type) of a dataset as declared, by name; of a column declared twice the least type counts.

    The declared table is fixed and small. A type that ``typed`` doesn't know is an error.
    """
    rows = types.where(F.upper(F.trim("source_dataset")) == dataset.upper()).select(F.trim("source_column").alias("c"), F.lower(F.trim("value_type")).alias("t")).dropna().distinct().collect()
    kinds: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["c"], r["t"]), reverse=True):
        if r["t"] not in TYPES:
            raise ValueError(f"{dataset}.{r['c']} is declared as {r['t']}")
        kinds[r["c"]] = r["t"]
    return sorted(kinds.items())


def compacted_assertions(assertions: DataFrame, types: DataFrame) -> DataFrame:
    """source_record_id, source_dataset, cells: the day of an assertion is its batch."""
    entity = ["source_record_id", "source_dataset"]
    runs = deltas(assertion_cells(assertions, types), entity, "_declared", "_type", "normalized_value", "asserted_at", "assertion_id", F.to_date("asserted_at"))
    return compact(runs, entity)
