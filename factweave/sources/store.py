"""Sinks: snapshot replacement, upserts, manifests with fingerprints and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.quality import last_write


class NotReady(ValueError):
    """A snapshot is missing, given twice, or not released."""


def replace_snapshot(df: DataFrame, path: str, snapshot: str = "snapshot_id") -> None:
    """Write the snapshots in df in place of the same ones at path; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(snapshot).parquet(path)


def upserted(existing: DataFrame, incoming: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """existing and incoming with one row per key, that of the greatest version. Applying it again changes nothing."""
    return last_write(existing.unionByName(incoming), key, version)


def inserted(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing and those incoming rows whose key is new, each key once."""
    return existing.unionByName(incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row count and an order-free digest of the columns' contents.

    Two sums of differently seeded hashes: repeated rows add up, where an exclusive or would cancel them.
    """
    hashed = df.select(F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *columns).alias("_b"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", total("_a"), total("_b")).alias("digest"))


def unchanged(manifest: DataFrame, dataset: str, parts: dict[str, str]) -> bool:
    """Whether the newest READY manifest row of a dataset has the same data, schema, mapping and code."""
    row = manifest.where((F.col("dataset_id") == dataset) & (F.col("status") == "READY")).orderBy(F.desc("created_at")).limit(1).collect()
    return bool(row) and all(row[0][k] == v for k, v in parts.items())


def released(snapshots: DataFrame) -> DataFrame:
    """Manifest rows of released, reconciled snapshots."""
    return snapshots.where((F.upper(F.trim("status")) == "READY") & (F.upper(F.trim("reconciliation_status")) == "PASSED") & F.col("row_count_reconciled"))


def selected_snapshots(snapshots: DataFrame, datasets: Sequence[str], day: str | None, versions: dict[str, str] | None = None) -> DataFrame:
    """dataset_id, released snapshots on the day, snapshot_id and ``problem`` (MISSING, AMBIGUOUS or NULL) per dataset.

    ``versions`` are further columns of the manifest and what they must hold: generation, ontology, transformer and
    schema version. Every dataset asked for has a row. Without a day the manifest must hold one released snapshot of each
    dataset, as manifests of trusted scopes do.
    """
    chosen = released(snapshots)
    if day is not None:
        chosen = chosen.where(F.col("snapshot_date") == F.lit(day).cast("date"))
    for column, value in (versions or {}).items():
        chosen = chosen.where(F.col(column) == value)
    counted = chosen.groupBy("dataset_id").agg(F.count_distinct("snapshot_id").alias("snapshots"), F.min("snapshot_id").alias("snapshot_id"))
    asked = snapshots.sparkSession.createDataFrame([(d,) for d in dict.fromkeys(datasets)], "dataset_id string")
    n = F.coalesce("snapshots", F.lit(0))
    return asked.join(counted, "dataset_id", "left").select("dataset_id", n.alias("snapshots"), F.when(n == 1, F.col("snapshot_id")).alias("snapshot_id"), F.when(n == 0, "MISSING").when(n > 1, "AMBIGUOUS").alias("problem"))


def chosen_ids(selection: DataFrame) -> list[str]:
    """The snapshot of every dataset of a selection; raises with all datasets that have none or several."""
    rows = selection.orderBy("dataset_id").collect()  # one row per dataset asked for
    bad = [f"{r['dataset_id']} {r['problem']}" for r in rows if r["problem"]]
    if bad:
        raise NotReady("; ".join(bad))
    return [r["snapshot_id"] for r in rows]


def health(selection: DataFrame) -> DataFrame:
    """One row: ``ready`` and the problems of a selection, sorted; ready only if every dataset has its snapshot."""
    told = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.concat_ws(" ", "dataset_id", "problem"))))
    return selection.agg(told.alias("problems")).select((F.size("problems") == 0).alias("ready"), "problems")


def eligible_entities(entities: DataFrame, facts: DataFrame, entity: str, snapshot: str, snapshots: Sequence[str], resolved: bool = False) -> DataFrame:
    """Entities that may be asked about and have a fact in the chosen snapshots (a resolved one if asked)."""
    inside = facts.where(F.col(snapshot).isin(list(snapshots)))
    if resolved:
        inside = inside.where("resolution_status = 'RESOLVED'")
    return entities.where("query_eligible").join(inside.select(entity), entity, "left_semi")


def ready_snapshots(snapshots: DataFrame, datasets: Sequence[str], day: str | None = None) -> dict[str, str]:
    """snapshot_id of each dataset: exactly one released snapshot on the day, or the newest released one.

    The manifest is a small table; a missing or repeated snapshot names its dataset.
    """
    ready = released(snapshots).where(F.col("dataset_id").isin(list(datasets)))
    if day is not None:
        ready = ready.where(F.col("snapshot_date") == F.lit(day).cast("date"))
    found: dict[str, list] = {d: [] for d in datasets}
    for r in ready.select("dataset_id", "snapshot_date", "snapshot_id").distinct().orderBy("snapshot_date", "snapshot_id").collect():
        found[r["dataset_id"]].append(r["snapshot_id"])
    for d, ids in found.items():
        if not ids or (day is not None and len(ids) > 1):
            raise NotReady(f"{d}: {len(ids)} released snapshots")
    return {d: ids[-1] for d, ids in found.items()}


def _state(spark: SparkSession, path: str, state: str, detail: str = "") -> None:
    spark.createDataFrame([(state, detail)], "state string, detail string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def graph_state(spark: SparkSession, path: str) -> str:
    """BUILDING, READY or FAILED; readers take READY graphs only."""
    return spark.read.schema("state string, detail string").json(f"{path}/manifest").first()["state"]


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Write nodes and edges and verify what was written; returns the counts. The manifest tells the state all along."""
    spark = nodes.sparkSession
    _state(spark, path, "BUILDING")
    try:
        counts = _write_and_verify(nodes, edges, path)
    except Exception as e:
        _state(spark, path, "FAILED", str(e)[:500])
        raise
    _state(spark, path, "READY", str(counts))
    return counts


def _write_and_verify(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark: SparkSession = nodes.sparkSession
    written = {k: spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges")}
    known = written["nodes"].select(F.col("node").alias("_n")).distinct()
    lost = written["edges"].join(known, F.col("subject") == F.col("_n"), "left_anti").count() + written["edges"].join(known, F.col("object") == F.col("_n"), "left_anti").count()
    if lost:
        raise NotReady(f"{lost} edge ends are no nodes")
    return {k: v.count() for k, v in written.items()}
