"""The question front end on words alone."""

import pytest

from factweave.operators.predicates import Filter, RequestRefused, Tree
from factweave.plans import question as q
from factweave.plans.request import Catalog, Contract, Request, Sort, gate

WORDS = {"한국": [q.Term("value", "region", "KR")], "한국 국채": [q.Term("value", "type", "GOV")], "미국": [q.Term("value", "region", "US")], "etf": [q.Term("universe", "etf")], "수익률": [q.Term("field", "return")], "운용사": [q.Term("relation", "MANAGED_BY", "org:1")], "금": [q.Term("value", "asset", "GOLD"), q.Term("field", "amount")]}


def test_longest_aliases_win_and_do_not_overlap():
    assert [m[2] for m in q.matches("한국 국채 한국", WORDS)] == ["한국 국채", "한국"]
    assert q.matches("setf etfs", WORDS) == [] and [m[2] for m in q.matches("etf!", WORDS)] == ["etf"]


def test_filters_sorts_and_limits():
    p = q.parse("ＥＴＦ 중 한국 또는 미국의 수익률 낮은 순으로 top 3", WORDS)
    assert p.complete and q.route(p) == "STORE"
    assert p.request == Request(filters=(Filter("C2", "region", "in", ("KR", "US")),), sort=(Sort("return", False),), limit=3, universe="etf")
    assert [c.key for c in p.constraints] == ["C1", "C2", "C3", "C4"]
    assert q.parse("한국 제외 수익률", WORDS).request.filters == (Filter("C1", "region", "ne", ("KR",)),)
    assert q.parse("상위 5", WORDS).request.wishes == ("top",)


def test_what_is_not_understood_is_told():
    assert q.parse("한국 미국", WORDS).ambiguous == ["region"]
    assert q.parse("금 한국", WORDS).ambiguous == ["금"]
    p = q.parse("한국의 용한 것", WORDS)
    assert p.residual == ["용한", "것"] and not p.complete and q.route(p) == "INCOMPLETE"
    p = q.parse("한국 1,000억원 이상", WORDS)
    assert p.thresholds == [("gte", 1e11, "KRW")] and q.route(p) == "REFUSED"
    assert q.parse("top 5000", WORDS).residual == ["top 5000"]
    assert q.parse("", WORDS).complete and q.parse(None, WORDS).constraints == []


def test_plans():
    p = q.parse("운용사 한국", WORDS)
    assert q.route(p) == "FEDERATED" and p.relations == [("MANAGED_BY", "org:1")]
    assert [s[:2] for s in q.federated_steps(p, "clean energy funds")] == [("graph1", "graph"), ("text", "bm25"), ("store", "store"), ("merge", "merge")]
    assert q.federated_steps(q.parse("한국", WORDS)) == [("store", "store", ())]
    assert q.text_search("에너지 etf") == "vector" and q.text_search("clean energy", ["energy"]) == "vector"
    assert q.uncovered(p, ["C2"]) == ["C1"]
    assert q.maturity_range("만기 2027년") == ("2027-01-01", "2027-12-31") and q.maturity_range("12027년") is None


def test_a_currency_must_be_certain():
    catalog = Catalog(None, "id", {"currency": q.Term, "x": q.Term}, contracts={"aum": Contract("AUM", "D", "AMOUNT", currency_field="currency")})
    catalog.fields = {"currency": type("F", (), {"kind": "classification"})(), "x": type("F", (), {"kind": "classification"})()}
    one, other = Filter("a", "currency", "eq", ("KRW",)), Filter("b", "x", "eq", (1,))
    assert gate(Request(filters=(one,), sort=(Sort("aum"),)), catalog) == []
    assert gate(Request(filters=(one, other), tree=Tree("or", ("a", "b")), sort=(Sort("aum"),)), catalog) == ["aum needs one currency"]
    assert gate(Request(sort=(Sort("aum"),)), catalog) == ["aum needs one currency"]
    with pytest.raises(RequestRefused):
        Filter("a", "x", "eq", ())
