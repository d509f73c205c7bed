import random

import pytest
from pyspark.sql import functions as F

from factweave.llm import survivor as sv


def test_consensus_of_tokens():
    out = sv.consensus(sv.profile([("12 Main St", 1.0), ("12 Main Street", 1.2), ("12 Maine St", 0.9)]))
    assert out == ["12", "Main", "St"]
    assert sv.consensus(sv.profile([("a b c", 1), ("a c", 1.1), ("a b c", 0.5)])) == ["a", "b", "c"]
    assert sv.profile([]) == [] and sv.consensus([]) == []
    assert sv.distance("a b", ["a", "b"]) == 0 and sv.distance(None, ["a"]) == 1 and 0 < sv.distance("a x", ["a", "b"]) < 1
    assert sv.distance("w " * 3000, ["w"] * 3000) == 0


def members(spark, rows):
    return spark.createDataFrame(rows, "g string, m string, name string, city string, q int, d int, survivor string")


def test_a_leader_survives_and_fields_come_from_all(spark):
    df = members(spark, [("1", "a", "ACME Corp", None, 2, 2, ""), ("1", "b", "ACME Corp", "Seoul", 1, 1, ""), ("1", "c", "Acne", "Seoul", 1, 2, ""), ("2", "x", None, None, 0, 0, ""), (None, "y", "n", "c", 0, 0, "")])
    got = {r["g"]: r for r in sv.survivors(df, "g", "m", ["name", "city"], ["q", "d"], F.col("q") + 1.0).collect()}
    assert (got["1"]["survivor"], got["1"]["best_name"], got["1"]["best_city"]) == ("a", "ACME Corp", "Seoul")
    assert (got["2"]["survivor"], got["2"]["best_name"]) == ("x", None) and len(got) == 2


def test_ties_repeats_and_an_empty_table(spark):
    rows = [("1", m, "same", "x", 1, 1, "") for m in "cab"] * 2
    assert sv.survivors(members(spark, rows), "g", "m", ["name"], ["q"], F.lit(1)).collect()[0]["survivor"] == "a"
    assert sv.survivors(members(spark, []), "g", "m", ["name"], ["q"], F.lit(1)).count() == 0


def test_a_huge_group_is_aligned_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sv, "BLOCK", 8)
    rng = random.Random(2)
    rows = [("hot", f"m{i:04}", rng.choice(["red apple pie", "red apple", "green apple pie", "red pie"]) if i % 3 else "red apple pie", "x", 0, 0, "") for i in range(900)] + [("cold", "z", "one", "y", 0, 0, "")]
    got = {r["g"]: r["best_name"] for r in sv.survivors(members(spark, rows), "g", "m", ["name"], ["q"], F.lit(1)).collect()}
    assert got == {"hot": "red apple pie", "cold": "one"}


def test_null_qualities_and_clashing_columns(spark):
    rows = [("1", "a", "x", "y", None, 1, "s"), ("1", "b", "x", "y", None, 2, "s")]
    df = members(spark, rows).withColumn("distance", F.lit(9)).withColumn("target", F.lit("t")).withColumn("d_name", F.lit(0))
    assert sv.survivors(df, "g", "m", ["name"], ["q", "d"], F.lit(1)).collect()[0]["survivor"] == "b"


def test_long_values_are_aligned_too(monkeypatch):
    words = [str(i) for i in range(600)]
    assert sv.distance(" ".join(words), ["x", *words]) == pytest.approx(1 - 600 / 601)
    r = random.Random(1)
    for _ in range(40):
        gains = [[r.choice([1.0, -0.1, 0.4]) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 12))]
        width = min(map(len, gains))
        total = lambda pairs: sum(gains[i][j] if i is not None and j is not None else -0.01 for i, j in pairs)
        monkeypatch.setattr(sv, "MAX_CELLS", 250_000)
        whole = sv._paired(len(gains), width, lambda i, j: gains[i][j])
        monkeypatch.setattr(sv, "MAX_CELLS", 6)
        halved = sv._paired(len(gains), width, lambda i, j: gains[i][j])
        assert total(halved) == pytest.approx(total(whole))
        assert [i for i, _ in halved if i is not None] == list(range(len(gains))) and [j for _, j in halved if j is not None] == list(range(width))


def test_beaten_members_never_survive_and_the_consensus_decides_among_the_rest(spark, monkeypatch):
    rows = [("1", "a", "red pie", "x", 2, 0, ""), ("1", "b", "blue pie", "x", 0, 2, ""), ("1", "c", "blue pie", "x", 0, 1, ""), ("1", "e", "blue pie", "x", 0, 1, "")]
    assert sv.survivors(members(spark, rows), "g", "m", ["name"], ["q", "d"], F.lit(1)).first()["survivor"] == "b"
    red = sv.survivors(members(spark, rows), "g", "m", ["name"], ["q", "d"], F.when(F.col("m") == "a", 9).otherwise(1)).first()
    assert (red["survivor"], red["best_name"]) == ("a", "red pie")
    monkeypatch.setattr(sv, "BLOCK", 2)  # the same by the way of larger groups
    assert sv.survivors(members(spark, rows), "g", "m", ["name"], ["q", "d"], F.lit(1)).first()["survivor"] == "b"


def test_survivors_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(str(g), f"{g}-{i}", rng.choice(["red apple pie", "red pie", None, "apple pie"]), rng.choice(["x y", "x", None]), rng.choice([0, 1, 2, None]), rng.randrange(3), "") for g in range(40) for i in range(rng.randrange(1, 9))]
    df = members(spark, rows)

    def brute(own):
        over = lambda a, b: all((x if x is not None else -1) >= (y if y is not None else -1) for x, y in zip(a[4:6], b[4:6]))
        front = [r for r in own if not any(over(o, r) and not over(r, o) for o in own)]
        target = [sv.consensus(sv.profile([(r[k], 1.0) for r in own if r[k] is not None])) for k in (2, 3)]
        return min(front, key=lambda r: (sum(sv.distance(r[k + 2], target[k]) for k in (0, 1)), r[1]))[1]

    want = {g: brute([r for r in rows if r[0] == g]) for g in {r[0] for r in rows}}
    got = {r["g"]: r["survivor"] for r in sv.survivors(df, "g", "m", ["name", "city"], ["q", "d"], F.lit(1)).collect()}
    assert got == want
    monkeypatch.setattr(sv, "BLOCK", 2)
    large = {r["g"]: r["survivor"] for r in sv.survivors(df, "g", "m", ["name", "city"], ["q", "d"], F.lit(1)).collect()}
    assert large.keys() == want.keys()


def test_a_repeated_case_counts_by_its_latest_row(spark):
    cases = spark.createDataFrame([("k", "OPEN", None, '["f1", "f2"]', "2026-01-01 00:00:00"), ("k", "rejected", None, '["f1"]', "2026-01-02 00:00:00"), ("j", "open", " f9", '["f1 ", "f1"]', None)], "conflict_case_id string, status string, winning_fact_id string, candidate_fact_ids string, created_at string")
    facts = spark.createDataFrame([("f1", "e", "m", "1", None, "u", None, None, None, "VALID", "2026-01-01")], "fact_id string, subject_entity_id string, metric_code string, raw_value string, numeric_value double, unit string, currency string, scale_basis string, observed_on date, quality_status string, recorded_at string")
    entities = spark.createDataFrame([("e", "Source only", "x")], "entity_id string, name_status string, updated_at string")
    got = [(r["conflict_case_id"], r["fact_id"], r["standing"], r["completeness"]) for r in sv.case_candidates(cases, facts, entities).collect()]
    assert got == [("j", "f1", 2, 2)]
