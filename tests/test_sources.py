import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as ftext
from factweave.operators import entity, findings, graph, quality
from factweave.sources import files, store
from factweave.streaming import latest


def test_report_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Fund X\nFund Holdings as of,"Aug 24, 2026"\n\nTicker,Name,Weight (%)\nA,"B, C",1.5\nD,E,2\n\nfooter,x,y\n')
    rows = files.report_csv(spark, str(tmp_path), "Ticker", ["Ticker", "Name", "Weight (%)"]).orderBy("Ticker").collect()
    assert [(r["as_of"], r["Ticker"], r["Name"], r["Weight (%)"]) for r in rows] == [(dt.date(2026, 8, 24), "A", "B, C", "1.5"), (dt.date(2026, 8, 24), "D", "E", "2")]
    with pytest.raises(Exception, match="header differs"):
        files.report_csv(spark, str(tmp_path), "Ticker", ["Ticker", "Name"]).collect()


def test_declared_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,x\n")
    assert files.declared_csv(spark, str(tmp_path), [("a", "integer"), ("b", "text")]).collect()[0]["b"] == "x"
    with pytest.raises(Exception):
        files.declared_csv(spark, str(tmp_path), [("a", "integer"), ("c", "text")]).collect()
    with pytest.raises(files.ContractBroken):
        files.declared_schema([("a", "blob")])


def test_html_and_json(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1 <b>x</b></td><td> 2</td></tr></table>"), (2, "<tr><td>only</td></tr>"), (3, None), (4, "")], "id int, html string")
    rows, problems = files.html_rows(pages, "id", "html", 2)
    assert sorted((r["id"], r["row_no"], r["c0"], r["c1"]) for r in rows.collect()) == [(1, 0, "a", "b"), (1, 1, "1 x", "2")]
    assert [(r["id"], r["cells"]) for r in problems.collect()] == [(2, 1)]
    good = json.dumps({"pdf": {"gijunYMD": "20260824", "totalCnt": 1, "nowCnt": 1, "list": [{"secNm": "s", "itmNo": "1"}]}})
    items, bad = files.json_holdings(spark.createDataFrame([(1, good), (2, good.replace('"totalCnt": 1', '"totalCnt": 2')), (3, "{"), (4, None)], "id int, p string"), "id", "p")
    assert [r["secNm"] for r in items.collect()] == ["s"]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 4]


def test_discovery_and_lines(spark, tmp_path):
    for name in ("PRBD01N001_20260605_data.csv", "PRBD01N001_20260605_schema.csv", "PREF01N001_260608_data.csv"):
        (tmp_path / name).write_text("x")
    found = files.discovered(spark, str(tmp_path))
    assert {(r["dataset"], str(r["snapshot_date"]), r["kind"]) for r in found.collect()} == {("PRBD01N001", "2026-06-05", "data"), ("PRBD01N001", "2026-06-05", "schema"), ("PREF01N001", "2026-06-08", "data")}
    assert [r["dataset"] for r in files.one_of_each(found).collect()] == ["PREF01N001"]
    assert {r["sha256"] for r in files.checksums(spark, str(tmp_path)).collect()} == {hashlib.sha256(b"x").hexdigest()}
    merged, clashes = files.merged_lines(spark.createDataFrame([("k", "1"), ("k", "1"), ("q", "1"), ("q", "2")], "key string, line string"), ["key"], "line")
    assert (merged.collect()[0]["key"], clashes.collect()[0]["key"]) == ("k", "q")


def test_store(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), "snapshot_id string, k int, v int")
    path = str(tmp_path / "t")
    store.replace_snapshot(frame(("s1", 1, 1), ("s2", 1, 1)), path)
    store.replace_snapshot(frame(("s1", 2, 5)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("snapshot_id", "k", "v").collect()) == [("s1", 2, 5), ("s2", 1, 1)]
    a, b = frame(("s", 1, 1)), frame(("s", 1, 2), ("s", 2, 1), ("s", 2, 1))
    once = store.upserted(a, b, ["k"], ["v"])
    assert sorted((r["k"], r["v"]) for r in store.upserted(once, b, ["k"], ["v"]).collect()) == [(1, 2), (2, 1)]
    assert sorted((r["k"], r["v"]) for r in store.inserted(a, b, ["k"]).collect()) == [(1, 1), (2, 1)]
    assert store.fingerprint(b, ["k", "v"]).collect() == store.fingerprint(b.orderBy("k"), ["k", "v"]).collect()
    snaps = spark.createDataFrame([("x", "D", dt.date(2026, 1, 1), "READY", "PASSED", True), ("y", "D", dt.date(2026, 1, 2), "ready", "PASSED", True), ("z", "D", dt.date(2026, 1, 3), "READY", "FAILED", True)], "snapshot_id string, dataset_id string, snapshot_date date, status string, reconciliation_status string, row_count_reconciled boolean")
    assert store.ready_snapshots(snaps, ["D"]) == {"D": "y"}
    assert store.ready_snapshots(snaps, ["D"], "2026-01-01") == {"D": "x"}
    with pytest.raises(store.NotReady, match="E"):
        store.ready_snapshots(snaps, ["D", "E"])
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("e", "a", "R", "b")], "edge_id string, subject string, relation string, object string")
    assert store.write_graph(nodes, edges, str(tmp_path / "g")) == {"nodes": 2, "edges": 1}
    with pytest.raises(store.NotReady):
        store.write_graph(nodes.limit(0), edges, str(tmp_path / "h"))
    assert graph.dangling(edges, nodes.where("node = 'a'")).count() == 1


def test_stream_keeps_the_latest_whatever_the_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "k int, at int, v string"
    rows = [[(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "late")], [(3, 1, "d"), (1, 3, "c")]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = latest.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["at"], 4)
        q.awaitTermination()
    got = latest.current(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_text_forms(spark):
    df = spark.createDataFrame([("ＡＢ　Ｃ ß", "HTTP://u@Ex.com:80?b=1&a=2#f"), (None, None), ("", "https://h/p")], "t string, u string")
    rows = df.select(ftext.lookup_form("t").alias("l"), ftext.search_form("t").alias("s"), ftext.normalized_url(F.col("u")).alias("u"), ftext.hash_embedding("t").alias("e")).collect()
    assert [r["l"] for r in rows] == ["abcss", None, ""]
    assert rows[0]["s"] == "ab c ss"
    assert [r["u"] for r in rows] == ["http://ex.com/?a=2&b=1", None, "https://h/p"]
    assert abs(sum(x * x for x in rows[0]["e"]) - 1) < 1e-6 and not any(rows[2]["e"]) and rows[1]["e"] is None


def test_near_matches_and_findings(spark):
    names = spark.createDataFrame([("abcdefgh", "e1"), ("abcdefgx", "e2"), ("zzzz", "e3"), ("qwertyuiop", "e4")], "name string, entity_id string")
    out = {(r["m"], r["entity_id"]): r["status"] for r in entity.near_matches(spark.createDataFrame([("qwertyuiol",), ("abcdefgy",), ("ab",), (None,)], "m string"), "m", names).collect()}
    assert out[("qwertyuiol", "e4")] == "RESOLVED" and out[("abcdefgy", "e1")] == out[("abcdefgy", "e2")] == "CANDIDATE" and len(out) == 3
    e = spark.createDataFrame([("a", "f", "1", "d1"), ("b", "f", "N/A", "d2")], "entity_id string, field string, value string, observed_on string")
    assert findings.sentinels(e, ["N/A"], ["f"]).collect()[0]["severity"] == "BLOCKING"
    assert findings.mixed_dates(e).count() == 1
    assert findings.incomparable(e, ["observed_on"]).count() == 1
    assert findings.low_coverage(spark.createDataFrame([(x,) for x in "abcd"], "entity_id string"), e, ["f"], 0.9).collect()[0]["detail"] == "0.5"
    assert [findings.empty_result(*x) for x in ((0, 0), (3, 0), (3, 1))] == ["ZERO_MATCH", "INSUFFICIENT_EVIDENCE", None]


def test_quality_edges(spark):
    df = spark.createDataFrame([(" a ", "NULL"), (None, "x")], "p string, q string")
    r = df.select(quality.cleaned(F.col("p")).alias("p"), quality.cleaned(F.col("q"), ["NULL"]).alias("q"), quality.changed_values(df, ["p", "q"], ["NULL"]).alias("m")).collect()
    assert (r[0]["p"], r[0]["q"], r[0]["m"], r[1]["m"]) == ("a", None, {"p": " a ", "q": "NULL"}, {})
    dates = spark.createDataFrame([("20260230",), ("2026.02-28",), ("99991231",), ("",), ("2026/02/28",)], "d string")
    assert [x[0] for x in dates.select(quality.dated(F.col("d"))[1]).collect()] == ["INVALID", "INVALID", "SENTINEL", "MISSING", "VALID"]


def test_lookup_helpers(spark):
    df = spark.createDataFrame([("가나 자산운용(주)", "KRX:005930"), ("AB Trust Ltd", "aapl.o"), (None, "AAPL"), ("", "005930")], "n string, t string")
    rows = df.select(entity.lookup_keys(F.col("n"), ["자산운용", "trust"]).alias("k"), *[c.alias(x) for c, x in zip(entity.exchange_ticker(F.col("t")), "tex")]).collect()
    assert [r["k"] for r in rows] == [["가나자산운용", "가나"], ["abtrust", "ab"], [], []]
    assert [(r["t"], r["e"], r["x"]) for r in rows] == [("005930", "KRX", True), ("AAPL", "O", True), ("AAPL", None, False), ("005930", None, True)]
    hits = spark.createDataFrame([("m", "e1"), ("q", "e2")], "m string, entity_id string")
    cases = spark.createDataFrame([("m", '["e1","e3"]', "OPEN"), ("q", '["e4"]', "RESOLVED"), ("z", '["e5"]', None)], "key string, candidates string, status string")
    assert sorted(map(tuple, entity.with_open_cases(hits, "m", cases).collect())) == [("m", "e1"), ("m", "e3"), ("q", "e2")]
    edges = spark.createDataFrame([("MANAGED_BY", "e2")], "relation string, object string")
    assert [r["m"] for r in entity.in_role(hits, edges, "MANAGED_BY").collect()] == ["q"]
    pair = spark.createDataFrame([("가나신탁", "가나 신탁", True), ("가나신탁", "가나캐피탈", False), ("가나", "가나캐피탈", True)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in pair.select(entity.compatible_kinds(F.col("a"), F.col("b"), ["신탁", "캐피탈"]), "w").collect())


def test_scopes_and_receipts(spark):
    items = spark.createDataFrame([(1, "a", "READY", dt.date(2026, 1, 1)), (2, "a", "READY", dt.date(2026, 1, 1)), (3, "b", "READY", dt.date(2026, 1, 1)), (4, "b", "BAD", None), (5, "c", "READY", dt.date(2026, 1, 1)), (6, "c", "READY", dt.date(2026, 1, 2))], "item_id int, p string, s string, d date")
    links = spark.createDataFrame([(1, "x"), (3, "y"), (5, "z")], "item_id int, source_id string")
    kept, used, problems = quality.released_scope(items, "p", F.col("s"), "READY", links, links.where("source_id <> 'z'").select("source_id"), "d")
    assert sorted(r["item_id"] for r in kept.collect()) == [1, 2, 5, 6]
    assert sorted(r["source_id"] for r in used.collect()) == ["x", "z"]
    assert sorted(map(tuple, problems.collect())) == [("NO_SOURCE", "z"), ("SEVERAL_DAYS", "c")]
    assert [r["item_id"] for r in quality.cutoff_violations(items, "d", "2026-01-01").orderBy("item_id").collect()] == [4, 6]
    p = spark.createDataFrame([("12.5",), ("101",), ("-1",), ("x",), (None,)], "v string").select(quality.proportion(F.col("v"))).collect()
    assert [None if x[0] is None else float(x[0]) for x in p] == [0.125, None, None, None, None]
    assert findings.step_problems({"a": "SUCCESS", "b": "FAILED", "c": "SKIPPED"}) == [("STEP_FAILED", "b"), ("STEP_SKIPPED", "c")]
    assert findings.receipt_problems(["a", "b"], ["a", "c"], True, False, "m", None) == [("CONSTRAINT_NOT_APPLIED", "b"), ("CONSTRAINT_NOT_ASKED", "c"), ("OR_NOT_APPLIED", "tree"), ("RANKING_NOT_APPLIED", "m")]
    e = spark.createDataFrame([("f", "s1"), ("f", "s2"), ("g", "s1")], "field string, snapshot_id string")
    assert findings.snapshots_differ(e, {"f": "WARNING"}).collect()[0]["severity"] == "WARNING"
