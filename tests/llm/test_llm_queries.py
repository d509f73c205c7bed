"""The subpackage's queries on whole tables."""

import math

import pytest

from compare import compare, database
from factweave.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    only_spark, only_sql, _ = compare(spark, database(sf_dir), queries.queries()[name], SQL[name], sf_dir)
    assert not only_spark and not only_sql


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_containers_hold_every_document_once(spark, sf_dir):
    from factweave.llm import tokens
    from factweave.session import table

    rows = queries.p8_containers(spark, sf_dir).toPandas()
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"]).toPandas().groupby("doc_id").tokens.sum()
    assert (rows.groupby(["container_name", "container_id"]).tokens.sum() <= rows.groupby(["container_name", "container_id"]).capacity.first()).all()
    for (_, capacity), own in rows.groupby(["container_name", "capacity"]):
        assert own.groupby("doc_id").tokens.sum().to_dict() == sizes.to_dict()
        assert not own.doc_id[own.doc_id.map(sizes) <= capacity].duplicated().any()
        assert own.container_id.nunique() <= math.ceil(1.02 * own.tokens.sum() / capacity)


def test_mixture_reaches_its_shares(spark, sf_dir):
    rows = {r["source"]: r for r in queries.p9_shares(spark, sf_dir).collect()}
    mixed = queries.p9_mixture(spark, sf_dir).toPandas()
    present = {k: r for k, r in rows.items() if r["tokens"]}
    whole = sum(r["target_share"] for r in present.values())
    assert present and not mixed.duplicated(["doc_id", "use"]).any()
    assert all(r["most_uses"] <= r["max_repeats"] for r in present.values())
    longest = mixed.tokens.max() / mixed.tokens.sum()
    assert all(abs(r["actual_share"] - r["target_share"] / whole) <= longest for r in present.values())
    assert all(mixed[mixed.source == k].tokens.sum() == r["tokens"] for k, r in present.items())


def test_queries_of_one_problem_agree(spark, sf_dir):
    run = lambda name: queries.queries()[name](spark, sf_dir).toPandas()
    links, found = run("p4_links"), run("p4_found")
    assert sorted(zip(links.item_id, links.issuer_code)) == sorted(zip(found.item_id, found.issuer_code)) and links.confidence.between(0, 1).all()
    classes, pairs = run("p5_classes"), run("p5_found")
    sizes = classes.groupby(["kind", "exact", "root"]).size()
    assert len(pairs) == (sizes * (sizes - 1) // 2).sum() and classes.alias_id.is_unique
    resolved, best = run("p6_resolved"), run("p6_found")
    assert dict(zip(resolved.conflict_case_id, resolved.winning_fact_id)) == dict(zip(best.conflict_case_id, best.fact_id)) and (resolved.status == "RESOLVED").all()
