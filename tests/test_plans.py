import pytest

from factweave.operators.predicates import Field, Filter, RequestRefused, Tree, select_entities
from factweave.operators.ranking import checked_limit
from factweave.plans import dag
from factweave.plans.request import Catalog, Contract, Request, Sort, certain_values, gate, run, supported_sorts


@pytest.fixture
def catalog(spark):
    base = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(6)], "id int, name string, size int")
    region = spark.createDataFrame([(0, "A"), (1, "A"), (1, "B"), (2, "B"), (3, None)], "id int, value string")
    flag = spark.createDataFrame([(0, "y")], "id int, value string")
    metrics = spark.createDataFrame([(0, "p", "d", "u", None, None, True, 1, "f1", 5.0), (1, "p", "d", "u", None, None, True, 2, "f2", 7.0), (1, "p", "d", "u", None, None, True, 1, "f0", 9.0), (2, "p", "x", "u", None, None, True, 1, "f3", 99.0), (4, "p", "d", "u", None, None, False, 1, "f4", 99.0)], "entity_id int, metric string, dataset string, unit string, scale string, currency string, comparable boolean, day int, fact_id string, value double")
    metrics = metrics.selectExpr("*", "cast(date_add(date'2026-01-01', day) as timestamp_ntz) AS observed_on")
    fields = {"name": Field("attribute", "name"), "size": Field("attribute", "size"), "region": Field("classification", facts=region), "flag": Field("flag", facts=flag), "tier": Field("vocabulary", facts=region, ranks={"B": 1, "A": 2})}
    return Catalog(base, "id", fields, metrics, {"p": Contract("p", "d", "u")})


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_three_ways_to_negate(catalog):
    pick = lambda *f, tree=None: ids(select_entities(catalog.base, "id", f, catalog.fields, tree))
    assert pick(Filter("a", "region", "ne", ("A",))) == [2]  # known to be exactly one, and another
    assert pick(Filter("a", "flag", "ne", ("y",))) == [1, 2, 3, 4, 5]  # unknown counts
    assert pick(Filter("a", "size", "ne", (0,))) == [1, 2, 4, 5]
    assert pick(Filter("a", "tier", "gte", ("A",))) == [0, 1]
    tree = Tree("or", (Tree("and", ("a", "b")), "c"))
    assert pick(Filter("a", "region", "eq", ("B",)), Filter("b", "size", "eq", (1,)), Filter("c", "name", "contains", ("5",)), tree=tree) == [1, 5]
    assert pick(Filter("a", "size", "in", ())) == []


def test_refusals(catalog):
    with pytest.raises(RequestRefused):
        Tree("not", ("a",))
    with pytest.raises(RequestRefused):
        Filter("a", "size", "between", (3, 1))
    with pytest.raises(RequestRefused):
        select_entities(catalog.base, "id", [Filter("a", "size", "eq", (1,))], catalog.fields, Tree("and", ("a", "a")))
    deep = "a"
    for _ in range(40):
        deep = Tree("and", (deep,))
    with pytest.raises(RequestRefused):
        select_entities(catalog.base, "id", [Filter("a", "size", "eq", (1,))], catalog.fields, deep)
    reasons = gate(Request(filters=(Filter("a", "nope", "eq", (1,)), Filter("b", "region", "gt", ("A",))), sort=(Sort("q"),), wishes=("count",), limit=0), catalog)
    assert len(reasons) == 5
    for bad in (True, 0, -1, "5"):
        with pytest.raises(RequestRefused):
            checked_limit(bad)
    assert checked_limit(10**9) == 10_000
    with pytest.raises(RequestRefused):
        supported_sorts([Sort("q")], catalog.contracts)
    assert supported_sorts([Sort("p"), Sort("q")], catalog.contracts) == ([Sort("p")], ["q"])


def test_run_excludes_what_cannot_be_ranked(catalog, spark):
    answer = run(Request(sort=(Sort("p"),), outputs=("name", "region")), catalog)
    assert [tuple(r) for r in answer.rows.collect()] == [(1, "n1", "A|B", 7.0), (0, "n0", "A", 5.0)]
    assert answer.stats.collect()[0].asDict() == {"filtered_count": 6, "rankable_count": 2, "missing_count": 4}
    assert answer.notes == ["limit 5"]
    assert run(Request(), catalog, spark.createDataFrame([], "id int")).rows.count() == 0


def test_certain_values():
    f = [Filter("a", "cur", "eq", ("KRW",)), Filter("b", "cur", "in", ("USD", "KRW")), Filter("c", "size", "eq", (1,))]
    assert certain_values(None, f[:1], "cur") == {"KRW"}
    assert certain_values(Tree("or", ("a", "c")), [f[0], f[2]], "cur") is None
    assert certain_values(Tree("or", ("a", "b")), f[:2], "cur") == {"KRW", "USD"}
    assert certain_values(Tree("and", ("a", "b", "c")), f, "cur") == {"KRW"}


def test_dag(spark):
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    give = lambda df, **k: lambda _: dag.StepResult(df, **k)

    def fail(_):
        raise dag.StepFailed("no")

    steps = [dag.Step("a", give(frame(1, 2))), dag.Step("b", give(frame(2, 3))), dag.Step("m", lambda r: dag.StepResult(dag.candidates_of(r, "id")), ("a", "b")), dag.Step("x", fail), dag.Step("y", give(frame(1)), ("x",))]
    out = dag.execute(steps)
    assert ids(out.results["m"].rows) == [2]
    assert (out.results["x"].status, out.results["y"].status) == (dag.Status.FAILED, dag.Status.SKIPPED)
    assert dag.final_names(steps, out) == ["m"]
    with pytest.raises(RequestRefused):
        dag.layers([dag.Step("a", fail, ("b",)), dag.Step("b", fail, ("a",))])
    for bad in (dag.StepResult(frame(1), complete=False), dag.StepResult(None, status=dag.Status.FAILED)):
        with pytest.raises(dag.StepFailed):
            dag.candidates_of({"a": bad}, "id")
    with pytest.raises(dag.StepFailed):
        dag.candidates_of({"a": dag.StepResult(frame(1), identity=("s1",)), "b": dag.StepResult(frame(1), identity=("s2",))}, "id")
    assert dag.candidates_of({"a": dag.StepResult(frame())}, "id").count() == 0
