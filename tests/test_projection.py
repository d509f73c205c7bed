import pytest

from factweave.plans import fact_queries


@pytest.fixture
def hot(spark, tmp_path):
    rows = [("bond_kr:HOT1", "a" if i % 2 else "b", f"r{i % 3}") for i in range(999)] + [("x", None, None), (None, "a", "r9")]
    spark.createDataFrame(rows, "canonical_product_id string, source_dataset string, source_record_id string").write.parquet(f"{tmp_path}/source_field_assertions.parquet")
    return str(tmp_path)


def test_provenance_keeps_hot_products(spark, hot):
    got = sorted(map(tuple, fact_queries.queries()["provenance_sets"](spark, hot).collect()), key=str)
    assert got == sorted([("bond_kr:HOT1", "dataset", x) for x in "ab"] + [("bond_kr:HOT1", "record", f"r{i}") for i in range(3)] + [(None, "dataset", "a"), (None, "record", "r9")], key=str)
    counts = {r[0]: (r[1], r[2]) for r in fact_queries.queries()["provenance_counts"](spark, hot).collect()}
    assert counts == {"bond_kr:HOT1": (2, 3), None: (1, 1)}


def test_field_evidence_covers_all_columns_and_spellings(spark, tmp_path):
    asserted = [("a1", "r1", " PD_NM"), ("a2", "r1", "curr_cd"), ("a3", "r2", "pd_nm"), ("a4", None, "pd_nm")]
    spark.createDataFrame(asserted, "assertion_id string, source_record_id string, source_column string").write.parquet(f"{tmp_path}/source_field_assertions.parquet")
    records = [("r1", "OK", '{"pd_nm": "x", "CURR_CD ": 3}'), ("r1", "OK", '{"pd_nm": "x", "CURR_CD ": 3}'), ("r2", "OK", "no json")]
    spark.createDataFrame(records, "source_record_id string, quality_status string, raw_payload string").write.parquet(f"{tmp_path}/source_records.parquet")
    got = sorted(tuple(r) for r in fact_queries.queries()["field_evidence"](spark, str(tmp_path)).collect())
    assert got == [("a1", "r1", "pd_nm", "OK", "x"), ("a2", "r1", "curr_cd", "OK", "3"), ("a3", "r2", "pd_nm", None, None), ("a4", None, "pd_nm", None, None)]


def test_merge_ranked_limits_after_the_intersection(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "cast(5000 - id AS double) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id AS l_partkey", "if(id = 3 OR id >= 600, 'R', 'A') AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["rank"], r["p_partkey"]) for r in fact_queries.queries()["merge_ranked"](spark, str(tmp_path)).collect())
    assert got == [(4, 3), *[(i + 1, i) for i in range(600, 649)]]
