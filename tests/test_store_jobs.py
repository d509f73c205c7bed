"""Paged catalogs, manifests, vectors reused, plan checks and jobs."""

import json

import pytest
from pyspark.sql import functions as F

from factweave import cli
from factweave.functions import text as ftext
from factweave.operators import graph, text
from factweave.plans import dag
from factweave.sources import files, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_paged_catalogs(spark):
    page = lambda total, *ids: json.dumps({"totalCnt": total, "list": [{"id": i, "nm": f"n{i}"} for i in ids]})
    pages = [("ok", 1, page(3, 1, 2)), ("ok", 2, page(3, 3)), ("ok", 2, page(3, 3)), ("gap", 1, page(2, 1)), ("gap", 3, page(2, 2)), ("few", 1, page(5, 1)), ("bad", 1, "no json"), ("two", 1, page(2, 1)), ("two", 2, page(3, 2))]
    items, problems = files.paged_items(spark.createDataFrame(pages, "c string, p int, j string"), "c", "p", "j", "struct<id:int,nm:string>")
    assert rows(items.where("c = 'ok'")) == [("ok", 1, "n1"), ("ok", 2, "n2"), ("ok", 3, "n3")]
    assert sorted(r["c"] for r in problems.collect()) == ["bad", "few", "gap", "two"]


def test_declared_totals_and_pending_files(spark):
    got = files.declared_totals(spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "k string"), "k", spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "k string, n int"), "n")
    assert rows(got) == [("b", 3, 1), ("c", 1, 0), ("d", None, 1)]
    f = spark.createDataFrame([("p", 1, "x"), ("q", 1, "y")], "path string, length int, sha256 string")
    assert rows(files.pending_files(f, f.withColumn("sha256", F.when(F.col("path") == "p", "old").otherwise(F.col("sha256"))))) == [("p", "x", 1)]


def test_health_and_manifest(spark):
    selection = spark.createDataFrame([("b", "MISSING"), ("a", None), ("c", "AMBIGUOUS")], "dataset_id string, problem string")
    assert tuple(store.health(selection).first()) == (False, ["b MISSING", "c AMBIGUOUS"])
    assert store.health(selection.where("problem IS NULL")).first()["ready"]
    edges = spark.createDataFrame([("R",), ("Q",), ("R",)], "relation string")
    assert graph.manifest(edges).first() == graph.manifest(edges.orderBy("relation")).first() and graph.manifest(edges).first()["edges"] == 3
    assert graph.manifest(edges).first() != graph.manifest(edges.limit(2)).first()


def test_vectors_are_reused(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, t string")
    first = text.vector_index(docs, "id", "t")
    assert {r["id"]: r["embedding"] for r in first.collect()} == {r["id"]: r["e"] for r in docs.where("t IS NOT NULL").select("id", ftext.hash_embedding("t").alias("e")).collect()}
    known = first.withColumn("embedding", F.array(F.lit(7.0).cast("float")))
    again = {r["id"]: len(r["embedding"]) for r in text.vector_index(docs.unionByName(spark.createDataFrame([(5, "new")], docs.schema)), "id", "t", known=known).collect()}
    assert again == {1: 1, 2: 1, 3: 1, 5: 384}
    assert [r["embedding"] for r in text.vector_index(docs, "id", "t", lambda c: F.array(F.length(c))).orderBy("id").collect()] == [[3], [3], [1]]


def test_plans_are_checked():
    steps = [dag.Step("graph1", None), dag.Step("extra", None)]
    got = dag.plan_problems(steps, {"graph1": "graph", "store": "store"}, {"graph1": ("text", "C1"), "extra": ("store",)}, ["C1", "C2"])
    assert got == [("STEP_INVENTED", "extra"), ("STEP_OMITTED", "store"), ("OPERATOR_CHANGED", "graph1"), ("CONSTRAINT_NOT_COVERED", "C2")]


def test_jobs(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "flagship_request" in capsys.readouterr().out
    assert cli.main(["run", "rank_groupwise", sf_dir, str(tmp_path / "q")], spark) == 0 and spark.read.parquet(str(tmp_path / "q")).count() > 0
    assert cli.main(["report", sf_dir, str(tmp_path / "r")], spark) == 0
    assert cli.main(["index", sf_dir, str(tmp_path / "i")], spark) == 0
    index, held = (spark.read.parquet(f"{tmp_path}/i/{x}") for x in ("tokens", "documents"))
    assert text.bm25_indexed(index, held, "doc_id", ["dividend"], 3).count() <= 3
    assert cli.main(["check", sf_dir], spark) in (0, 1)
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
