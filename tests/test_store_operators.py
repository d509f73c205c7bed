"""Operators of the fact store's life on small fixtures: repaired faults, edge cases, brute force."""

import datetime as dt
import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from factweave.operators import entity, graph, mapping, predicates, projection, quality, ranking, text, units, wide
from factweave.operators.graph import Hop
from factweave.operators.predicates import Field, Filter, RequestRefused, Tree
from factweave.plans import dag, request
from factweave.sources import store
from factweave.streaming import latest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints_tell_doubled_rows_apart(spark):
    one = lambda *v: store.fingerprint(spark.createDataFrame([(x,) for x in v], "v string"), ["v"]).first()
    assert one("a", "a") != one("b", "b") and one("a", "b") == one("b", "a")
    assert one(None) != one() and one() == one()


def test_a_step_that_takes_too_long_is_given_up_at_once(spark):
    steps = [dag.Step("slow", lambda _: time.sleep(5) or dag.StepResult(None)), dag.Step("quick", lambda _: dag.StepResult(spark.range(1))), dag.Step("after", lambda _: dag.StepResult(None), ("slow",))]
    began = time.monotonic()
    out = dag.execute(steps, timeout=0.5, spark=spark)
    assert time.monotonic() - began < 3
    assert [out.results[n].status for n in ("slow", "quick", "after")] == [dag.Status.TIMED_OUT, dag.Status.SUCCESS, dag.Status.SKIPPED]

    def wrong(_):
        raise KeyError("a bug")

    with pytest.raises(KeyError):
        dag.execute([dag.Step("x", wrong)])


def test_a_stream_that_cannot_read_its_table_stops(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    run = lambda: latest.upsert_stream(spark.readStream.schema("k int, at int").parquet(str(src)), out, str(tmp_path / "cp"), ["k"], ["at"], 4).awaitTermination()
    spark.createDataFrame([(1, 1), (2, 1)], "k int, at int").coalesce(1).write.mode("append").parquet(str(src))
    run()
    spark.createDataFrame([(1, 2)], "k int, at int").coalesce(1).write.mode("append").parquet(str(src))
    run()
    latest.vacuum(spark, out, 9)
    assert rows(latest.current(spark.read.parquet(out)).select("k", "at")) == [(1, 2), (2, 1)]
    spark.createDataFrame([("x",)], "other string").write.mode("overwrite").parquet(out)
    spark.createDataFrame([(3, 3)], "k int, at int").coalesce(1).write.mode("append").parquet(str(src))
    with pytest.raises(Exception, match="_generation|_bucket|UNRESOLVED"):
        run()


def test_graph_states(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("e", "a", "R", "b")], "edge_id string, subject string, relation string, object string")
    store.write_graph(nodes, edges, str(tmp_path / "g"))
    assert store.graph_state(spark, str(tmp_path / "g")) == "READY"
    with pytest.raises(store.NotReady):
        store.write_graph(nodes.limit(0), edges, str(tmp_path / "g"))
    assert store.graph_state(spark, str(tmp_path / "g")) == "FAILED"


def test_near_ties_keep_their_order_and_tiny_scores_stay(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0 + 1e-9, 0.0]), (3, None)], "id int, v array<double>")
    assert [r["id"] for r in text.cosine(vectors, "id", "v", [1.0, 0.0], 2).collect()] == [2, 1]
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3)) for i in range(60)] + [(99, None), (98, "")], "id int, t string")
    assert text.bm25(docs, "id", "t", ["common"]).count() == 60


def test_an_index_gives_the_scores_of_the_texts(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["fee", "fund", "금리", "a.b", "ＦＥＥ"], k=rng.randrange(1, 12)))) for i in range(80)] + [(99, None), (98, "")], "id int, t string")
    plain = docs.withColumn("t", F.translate("t", "ＦＥ", "FE"))
    index, lengths = text.token_index(docs, "id", "t"), text.document_lengths(docs, "id", "t")
    for query in (["fee"], ["fee", "금리", "fee"], ["nothing"]):
        assert rows(text.bm25_indexed(index, lengths.withColumn("length", F.greatest("length", F.lit(0))), "id", query)) == rows(text.bm25(plain.withColumn("t", F.coalesce("t", F.lit(""))), "id", "t", query))
    some = docs.where("id < 30").select("id")
    assert rows(text.bm25_indexed(index, lengths, "id", ["fee"], candidates=some)) == rows(text.bm25(plain.where("id < 30"), "id", "t", ["fee"]))


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "id int, t string")
    text.write_index(text.token_index(docs, "id", "t"), text.document_lengths(docs, "id", "t"), str(tmp_path))
    index, held = spark.read.parquet(f"{tmp_path}/tokens"), spark.read.parquet(f"{tmp_path}/documents")
    assert [(r["id"], r["rank"]) for r in text.bm25_indexed(index, held, "id", ["a"], 5).collect()] == [(1, 1)]
    assert rows(text.pending_documents(spark.createDataFrame([(1, "a b a"), (2, "changed"), (3, "new")], "id int, t string"), held, "id", "t").select("id")) == [(2,), (3,)]


def test_percentiles_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([1.0, 2.5, rng.random()])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 200))] + [("a", None), ("empty", None)]
    got = {r["g"]: (r["p50"], r["p95"]) for r in ranking.nearest_rank(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted(v for k, v in data if k == g and v is not None)
        want[g] = tuple(own[math.ceil(q * len(own)) - 1] for q in (0.5, 0.95))
    assert got == want


def test_trees_equal_brute_force(spark):
    rng = random.Random(7)
    base = [(i, rng.randrange(5)) for i in range(60)]
    facts = {k: [(rng.randrange(60), rng.choice("xyz")) for _ in range(70)] + [(None, "x"), (3, None)] for k in ("cls", "rel", "flag")}
    frame = lambda k: spark.createDataFrame(facts[k], "id int, value string")
    fields = {"size": Field("attribute", "size"), "cls": Field("classification", facts=frame("cls")), "rel": Field("relation", facts=frame("rel")), "flag": Field("flag", facts=frame("flag"))}
    df = spark.createDataFrame(base, "id int, size int")

    def holds(f, row):
        if f.field == "size":
            return {"eq": row[1] == f.values[0], "gt": row[1] > f.values[0]}[f.op]
        own = {v for i, v in facts[f.field] if i == row[0] and v is not None}
        if f.op == "eq":
            return f.values[0] in own
        known = {"cls": len(own) == 1, "rel": bool(own), "flag": True}[f.field]
        return known and f.values[0] not in own

    filters = [Filter("a", "size", "gt", (1,)), Filter("b", "cls", "ne", ("x",)), Filter("c", "rel", "eq", ("y",)), Filter("d", "flag", "ne", ("z",)), Filter("e", "rel", "ne", ("x",))]
    by = {f.key: f for f in filters}

    def check(node, row):
        if isinstance(node, str):
            return holds(by[node], row)
        return (all if node.op == "and" else any)(check(c, row) for c in node.children)

    for tree in (None, Tree("and", ("a", "b")), Tree("or", ("a", Tree("and", ("b", "c")))), Tree("and", (Tree("or", ("c", "d")), "e")), "d"):
        used = set()
        stack = [tree]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                used.add(n)
            elif n is not None:
                stack += n.children
        want = [r for r in base if (tree is None or check(tree, r)) and all(holds(f, r) for f in filters if f.key not in used)]
        assert rows(predicates.select_entities(df, "id", filters, fields, tree)) == sorted(want, key=str), tree
    for bad in (Tree("and", ()), Tree("or", ("a", "a")), "zz"):
        with pytest.raises(RequestRefused):
            predicates.select_entities(df, "id", filters, fields, bad)


def test_contradictory_rates_are_refused():
    rate = lambda x: {"currency": "usd", "rate_date": dt.date(2026, 6, 30), "quoted_units": 1, "krw_amount": x}
    for order in ([rate(1300.0), rate(1500.0)], [rate(1500.0), rate(1300.0)]):
        with pytest.raises(units.InconsistentUnits):
            units.product_units(order).compositions("KRW")
    assert units.product_units([rate(1300.0), rate(1300.0)]).compositions("KRW")["USD@2026-06-30"] == (1300, 0)


def test_runs_are_appended_and_compacted(spark, tmp_path):
    schema = "e string, a string, v string, at timestamp_ntz, id string"
    t = lambda day: dt.datetime(2026, 1, day)
    batches = [[("1", "x", "5", t(1), "i1"), ("1", "y", "bad", t(1), "i2")], [("1", "x", "6", t(3), "i3"), ("2", "x", "7", t(2), "i4")], [("1", "x", "4", t(2), "late"), ("1", "y", "9", None, "i5")]]
    delta = lambda b: wide.deltas(spark.createDataFrame(b, schema).withColumn("t", F.lit("integer")), ["e"], "a", "t", "v", "at", "id", F.lit("b"))
    runs = wide.RunStore(spark, str(tmp_path / "runs"), ["e"], 4)
    assert runs.read() is None and runs.compact_level(0) is None
    want = rows(wide.wide(wide.compact(delta(list(itertools.chain(*batches))), ["e"]), ["e"], [("x", "integer"), ("y", "integer")]))
    assert want == [("1", 6, 9), ("2", 7, None)]
    for i, b in enumerate(batches):
        runs.append(delta(b), f"{i}")
    runs.append(delta(batches[0]), "0")  # a batch given again
    shown = lambda: rows(wide.wide(runs.read(), ["e"], [("x", "integer"), ("y", "integer")]))
    assert len(runs.runs(0)) == 3 and shown() == want
    assert runs.compact_level(0, 3) and not runs.runs(0) and len(runs.runs(1)) == 1 and shown() == want
    runs.append(delta([("2", "y", "1", t(9), "i9")]), "9")
    assert shown() == [("1", 6, 9), ("2", 7, 1)]


def test_declared_columns(spark):
    types = spark.createDataFrame([("ds", " b ", "Date"), ("DS", "a", "text"), ("ds", "a", "numeric"), ("o", "c", "text"), ("ds", None, "text")], "source_dataset string, source_column string, value_type string")
    assert wide.declared_columns(types, "DS") == [("a", "numeric"), ("b", "date")]
    with pytest.raises(ValueError):
        wide.declared_columns(spark.createDataFrame([("ds", "a", "blob")], types.schema), "ds")


def test_shared_identifiers_multiply_nothing(spark):
    known = spark.createDataFrame([("i", f"e{n}") for n in range(50)] + [("j", "e1"), ("k", "e2")], "isin string, entity_id string")
    asked = spark.createDataFrame([("a", "i", None), ("b", "j", None), ("c", "j", "k"), ("d", None, None)], "key string, isin string, other string")
    got = rows(entity.by_identifiers(asked, "key", [(["isin"], known), (["other"], known.withColumnRenamed("isin", "other"))]))
    assert got == [("a", None, "AMBIGUOUS"), ("b", "e1", "RESOLVED"), ("c", None, "AMBIGUOUS"), ("d", None, "UNRESOLVED")]


def test_profile_counts_empty_and_constant_fields(spark):
    df = spark.createDataFrame([("d", "x", None), ("d", "x", " "), ("e", "y", "1")], "ds string, a string, b string")
    got = {(r["ds"], r["field"]): (r["total"], r["valid"], r["unique_values"], r["constant_value"]) for r in quality.profile(df, ["ds"], ["a", "b"]).collect()}
    assert got == {("d", "a"): (2, 2, 1, "x"), ("e", "a"): (1, 1, 1, "y"), ("__all__", "a"): (3, 3, 2, None), ("d", "b"): (2, 0, 0, None), ("e", "b"): (1, 1, 1, "1"), ("__all__", "b"): (3, 1, 1, "1")}
    assert quality.profile(df.limit(0), ["ds"], ["a"]).count() == 0


def test_path_records_and_results(spark):
    nodes = spark.createDataFrame([("p1", "PRODUCT", "One", None), ("p2", "PRODUCT", None, None), ("m", "ORG", "Manager", "M-1")], "node string, type string, display_name string, identifier_value string")
    edges = spark.createDataFrame([("e1", "p1", "BY", "m", "D"), ("e2", "p2", "BY", "m", None)], "edge_id string, subject string, relation string, object string, source string")
    assert rows(graph.anchors(nodes, ["M-1", "One"])) == [("m",), ("p1",)] and rows(graph.anchors(nodes, ["One"], "ORG")) == []
    hops = [Hop("BY"), Hop("BY", False)]
    found = graph.paths(edges, hops, ["BY"], start=graph.anchors(nodes, ["One"]))
    records = graph.path_records(graph.result_entities(found, hops, spark.createDataFrame([("p2",)], "node string")), hops, nodes, edges, ["source"])
    got = {r["source_id"]: (r["entity_id"], r["value"], r["text"], [tuple(x) for x in r["path"]]) for r in records.collect()}
    assert got == {"graph:e1:e2": ("p2", "p2", "One -> Manager -> p2", [("e1", "D"), ("e2", None)]), "graph:e1:e1": ("p1", "One", "One -> Manager -> One", [("e1", "D"), ("e1", "D")])}
    back = [Hop("BY", False)]
    assert [r["result"] for r in graph.result_entities(graph.paths(edges, back, ["BY"], end=graph.anchors(nodes, ["p1"])), back).collect()] == ["p1"]
    shown, state = graph.path_window(found, 1, ["n2"])
    assert shown.count() == 1 and tuple(state.first()) == (1, False)


def test_hierarchies_and_contracts(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), (None, "a")], "k string, p string")
    assert rows(graph.ancestors(links, "k", "p")) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    assert graph.ancestors(links.limit(0), "k", "p").count() == 0
    edges = spark.createDataFrame([("1", "f", "R", "i"), ("2", "i", "R", "f"), ("3", "f", "Q", "i"), ("4", "u", "R", "i")], "edge_id string, subject string, relation string, object string")
    types = spark.createDataFrame([("f", "ETF"), ("i", "INDEX")], "node string, type string")
    above = graph.ancestors(spark.createDataFrame([("ETF", "FUND")], "child string, parent string"), "child", "parent")
    contract = spark.createDataFrame([("R", "FUND", "INDEX")], "relation string, domain string, range string")
    assert rows(graph.incompatible(edges, types, contract, above).select("edge_id")) == [("2",), ("3",), ("4",)]


def test_snapshot_selection(spark):
    snaps = spark.createDataFrame([("x", "D", dt.date(2026, 1, 1), "READY", "PASSED", True, "V2"), ("y", "D", dt.date(2026, 1, 1), "READY", "PASSED", True, "V1"), ("z", "E", dt.date(2026, 1, 1), "READY", "PASSED", False, "V2")], "snapshot_id string, dataset_id string, snapshot_date date, status string, reconciliation_status string, row_count_reconciled boolean, generation string")
    got = rows(store.selected_snapshots(snaps, ["D", "E"], "2026-01-01"))
    assert got == [("D", 2, None, "AMBIGUOUS"), ("E", 0, None, "MISSING")]
    with pytest.raises(store.NotReady, match="D AMBIGUOUS; E MISSING"):
        store.chosen_ids(store.selected_snapshots(snaps, ["D", "E"], "2026-01-01"))
    assert store.chosen_ids(store.selected_snapshots(snaps, ["D"], "2026-01-01", {"generation": "V2"})) == ["x"]


def test_metric_details_edge_cases(spark):
    o = spark.createDataFrame([("e", "m", "f2", dt.date(2026, 1, 2), "VALID", 1), ("e", "m", "f1", dt.date(2026, 1, 2), "SOURCE_ZERO", 2), ("e", "m", "f0", dt.date(2027, 1, 2), "VALID", 3), ("e", "m", "f9", None, "VALID", 4), ("e", "n", "f8", None, "VALID", 5), ("e", "k", "f7", dt.date(2026, 1, 1), "INVALID", 6), ("g", "m", "bare", dt.date(2026, 1, 1), "VALID", 7)], "entity_id string, metric string, fact_id string, observed_on date, quality_status string, v int")
    evidence = spark.createDataFrame([(f"f{i}",) for i in range(10)] + [("f1",), (None,)], "fact_id string")
    got = {(r["entity_id"], r["metric"]): (r["fact_id"], r["evidence"]) for r in projection.metric_details(o, evidence, "2026-08-24").collect()}
    assert got == {("e", "m"): ("f1", 2), ("e", "n"): ("f8", 1)}
    contract = spark.createDataFrame([("m", 1)], "metric string, v int")
    assert [r["fact_id"] for r in projection.metric_details(o, evidence, "2026-08-24", contract).collect()] == ["f2"]


def test_assertion_classes_and_codes(spark):
    df = spark.createDataFrame([("1", None), ("2", " "), ("3", "99991231"), ("4", "2026.01.02"), ("5", "2026-13-01"), ("6", "P"), ("7", "not provided"), ("8", "x")], "k string, v string")
    told = mapping.assertion_class(F.col("v"), F.col("k").isin("3", "4", "5"), F.lit(False), F.lit(None).cast("boolean"), F.col("v") == "P", F.when(F.col("v") == "not provided", "VENDOR"))
    got = {r["k"]: (r["c"]["quality"], r["c"]["normalized"]) for r in df.select("k", told.alias("c")).collect()}
    assert got == {"1": ("MISSING", None), "2": ("MISSING", None), "3": ("SENTINEL", None), "4": ("VALID", "2026-01-02"), "5": ("INVALID", None), "6": ("UNUSABLE_BY_POLICY", "P"), "7": ("VENDOR", None), "8": ("VALID", "x")}
    codes = spark.createDataFrame([("CURR_CD_usd",), ("000",), ("EURO",), (None,)], "v string").select(mapping.code(F.col("v"), "^[A-Z]{3}$", "CURR_CD_").alias("c"), mapping.code_state(F.col("v"), {"000": "ZERO"}).alias("s"))
    assert [tuple(r) for r in codes.collect()] == [("USD", "UNKNOWN"), (None, "ZERO"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    index = spark.createDataFrame([("KOSPI 200",), ("A 50% B",), ("A+B",), ("Not Provided",), (None,)], "v string").select(mapping.atomic_index(F.col("v")).alias("a"))
    assert [r["a"] for r in index.collect()] == [True, False, False, False, None]
    parent, rule = mapping.parent_key(F.col("r"), F.col("c"), F.col("o"))
    rows_ = spark.createDataFrame([("KR0123456789", None, "o"), ("000000000000", "A", "o"), (None, " ", "o")], "r string, c string, o string").select(parent, rule)
    assert [tuple(r) for r in rows_.collect()] == [("KR0123456789", "REPRESENTATIVE"), ("o", "CLASS_CODE"), (None, "UNRESOLVED")]


def test_relation_targets_and_trees():
    assert mapping.relation_target("code.usd", {"USD": "currency:USD"}) == "currency:USD" and mapping.relation_target("any", None) == "any"
    for bad in ("", None, "xyz"):
        with pytest.raises(RequestRefused):
            mapping.relation_target(bad, {"USD": "x"})
    nested = Tree("and", ("a", Tree("or", ("b", "c"))))
    assert request.local_tree(nested, ["b", "c"], ["a", "b", "c"]) == Tree("or", ("b", "c"))
    with pytest.raises(RequestRefused):
        request.local_tree(nested, ["a", "b"], ["a", "b", "c"])
    with pytest.raises(RequestRefused):
        request.local_tree("q", ["q"], ["a"])
    assert request.without_filters(nested, ["a"]) == Tree("or", ("b", "c")) and request.without_filters(None, ["a"]) is None
    with pytest.raises(RequestRefused):
        request.without_filters(nested, ["c"])


def test_issuers_by_ticker_and_name(spark):
    companies = spark.createDataFrame([("C1", "111111", "가나(주)"), ("C2", "222222", "다라"), ("C3", "333333", "마바"), ("C4", "333333", "사아"), ("C5", None, "자차"), ("C6", None, "자차")], "issuer_code string, ticker string, name string")
    securities = spark.createDataFrame([("s1", " 111111", "x"), ("s2", None, "다라 "), ("s3", "111111", "다라"), ("s4", "333333", "zz"), ("s5", None, "자차"), ("s6", None, None), ("s1", "111111", "x")], "security_id string, ticker string, name string")
    links, conflicts = entity.integrated_issuers(securities, companies)
    assert rows(links) == [("s1", "C1"), ("s2", "C2")] and rows(conflicts) == [("s3", "DIFFERENT_ISSUERS"), ("s4", "SHARED_TICKER")]


def test_category_frames_and_metrics(spark):
    a = spark.createDataFrame([("D", "c1", "VALID", 1), ("D", "c2", "VALID", 2), ("D", "c3", "VALID", 3), ("D", "c1", "INVALID", 4)], "source_dataset string, source_column string, q string, n int")
    layout = spark.createDataFrame([("D", "c1", "ID"), ("D", "c2", "NUM"), ("D", "c3", "OTHER"), ("D", "c1", "ID")], "source_dataset string, source_column string, category string")
    parts = mapping.by_category(a, layout, {"ID": "identifier", "NUM": "observation"}, F.col("q") == "VALID")
    assert {k: [r["n"] for r in v.collect()] for k, v in parts.items()} == {"identifier": [1], "observation": [2]}
    df = spark.createDataFrame([("p", "D", "KRW", dt.date(2026, 1, 1), 5.0, 0.0), ("q", "D", "USD", None, None, 1.0)], "id string, ds string, cur string, day date, aum double, fee double")
    contracts = spark.createDataFrame([("AUM", "D", "AMOUNT", "ONE", "KRW"), ("FEE", "D", "PCT", "ONE", None)], "metric string, dataset string, unit string, scale_basis string, currency string")
    made = mapping.emitted_metrics(df, ["id"], {"aum": ("AUM", "AMOUNT", "ONE"), "fee": ("FEE", "PCT", "ONE")}, "cur", "day", contracts, "ds")
    assert {(r["id"], r["metric"]): (r["quality_status"], r["comparability"]) for r in made.collect()} == {("p", "AUM"): ("VALID", "COMPARABLE"), ("p", "FEE"): ("SOURCE_ZERO", "COMPARABLE"), ("q", "FEE"): ("VALID", "NOT_COMPARABLE")}


def test_a_broken_subpackage_is_not_passed_over(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "factweave.llm.queries", None)
    if importlib.util.find_spec("factweave.llm") is not None:
        with pytest.raises(ImportError):
            importlib.reload(__spark_entry__)
        monkeypatch.undo()
    importlib.reload(__spark_entry__)
