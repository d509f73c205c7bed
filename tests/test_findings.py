from factweave.operators import findings, graph


def test_entities_that_are_not_clear_block(spark):
    resolved = spark.createDataFrame([("m1", "RESOLVED", "a"), ("m2", "AMBIGUOUS", None), ("m3", "UNRESOLVED", None)], "m string, status string, entity_id string")
    hits = spark.createDataFrame([("m1", "a"), ("m2", "b"), ("m2", "c")], "m string, entity_id string")
    found = findings.unresolved(resolved, hits, "m")
    assert sorted((r["code"], r["entity_id"] or "", r["severity"], r["detail"]) for r in found.collect()) == [("AMBIGUOUS_ENTITY", "b", "BLOCKING", "m2"), ("AMBIGUOUS_ENTITY", "c", "BLOCKING", "m2"), ("ENTITY_UNRESOLVED", "", "BLOCKING", "m3")]
    e = spark.createDataFrame([("a", "f", "1"), ("b", "f", "1"), ("d", "f", None)], "entity_id string, field string, value string")
    other = findings.mismatched(resolved, e)
    assert sorted(r["entity_id"] for r in other.collect()) == ["b", "d"]
    assert findings.mismatched(resolved.where("status <> 'RESOLVED'"), e).count() == 0
    assert sorted(map(tuple, findings.verdict_matrix(e, ["f", "g"], found).collect())) == [("a", 2, "FULLY"), ("b", 0, "UNANSWERABLE"), ("d", 2, "FULLY")]


def test_fields_without_any_value_are_reported(spark):
    e = spark.createDataFrame([("a", "f", "1"), ("b", "g", None)], "entity_id string, field string, value string")
    rows = findings.low_coverage(e, e, ["f", "g", "h"], 0.9).collect()
    assert sorted((r["field"], r["detail"]) for r in rows) == [("f", "0.5"), ("g", "0.0"), ("h", "0.0")]


def test_no_evidence_is_a_class_of_its_own():
    assert [findings.empty_result(*x) for x in ((3, 0, 0), (3, 0, 2), (0, 0, 0), (None, 0, 0))] == ["NO_EVIDENCE", "INSUFFICIENT_EVIDENCE", "ZERO_MATCH", "NO_EVIDENCE"]


def test_closure_has_no_limit_of_links(spark):
    links = spark.range(100_500).selectExpr("concat('n', id) AS child", "concat('n', id % 7 + 200000) AS parent")
    deep = spark.range(3000).selectExpr("concat('d', id) AS child", "concat('d', id + 1) AS parent")
    up = graph.closure(links, "child", "parent")
    assert len(up) == 100_500 and up["n100499"] == {"n200000"}
    assert len(graph.closure(deep, "child", "parent")["d0"]) == 3000
