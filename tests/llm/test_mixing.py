import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import mixing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7))
def test_schedule_deviates_by_less_than_a_block(weights):
    period = sum(weights)
    slots = {f"s{i}": w for i, w in enumerate(weights)}
    got = mixing.schedule(period, slots)
    seen = dict.fromkeys(slots, 0)
    for t, k in enumerate(got, 1):
        seen[k] += 1
        assert all(abs(seen[s] - Fraction(t * w, period)) < 1 for s, w in slots.items())
    assert seen == slots


def test_plan_takes_the_most():
    got = {q.source: q for q in mixing.plan({"a": 100, "b": 1000, "zz": 5}, {"a": (Fraction(1, 2), 3), "b": (Fraction(1, 2), 1), "none": (Fraction(1, 2), 9)})}
    assert (got["a"].wanted, got["a"].passes, got["a"].rest, got["b"].wanted) == (300, 3, 0, 300)
    assert mixing.plan({}, {"a": (Fraction(1), 1)}) == []


def mixed(spark, docs, targets):
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, slot int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mixing.mixture(df, t, block_tokens=50)
    return out.toPandas(), {r["source"]: r for r in mixing.shares_reached(out, t).collect()}


def test_shares_repeats_and_order(spark):
    docs = [(i, "Big-One " if i % 2 else "big_one", 5 + i % 13, 0) for i in range(900)] + [(1000 + i, "small", 7 + i % 5, 0) for i in range(60)] + [(5000, "other", 9, 0), (5001, None, 9, 0), (5002, "small", None, 0), (5003, "small", 0, 0)]
    rows, shares = mixed(spark, docs, [("big_one", 0.7, 1), ("small", 0.3, 4), ("absent", 0.1, 2)])
    small = sum(t or 0 for _, s, t, _ in docs if s == "small")
    assert shares["small"]["tokens"] == 4 * small and shares["small"]["most_uses"] == 4
    assert abs(shares["big_one"]["actual_share"] - 0.7) < 0.005 and shares["big_one"]["most_uses"] == 1 and shares["absent"]["tokens"] == 0
    assert not rows.duplicated(["doc_id", "use"]).any()
    rows = rows.sort_values(["slot", "offset"])
    total = rows.tokens.cumsum()
    off = (rows.tokens.where(rows.source == "small", 0).cumsum() - 0.3 * total).abs().max()
    assert off < 3 * 50


def test_every_prefix_of_the_order_is_within_a_block(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("aaab"), rng.randrange(3, 40), 0) for i in range(1500)] + [(9000 + i, "c", rng.randrange(3, 40), 0) for i in range(40)]
    rows, shares = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9)])
    rows = rows.assign(block=rows.slot * 50 + rows.offset)
    longest, total = 39, rows.tokens.sum()
    for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        own = rows[rows.source == k].sort_values(["slot", "offset"])
        ends = own.tokens.cumsum()
        # documents lie end to end: each starts where the ones before it end, save the gap that nothing fills
        slots = sorted(set(rows.slot[rows.source == k]))
        assert ((own.tokens.cumsum() - own.tokens) // 50).tolist() == [slots.index(x) for x in own.slot]
        for slot in range(0, int(rows.slot.max()) + 1):
            laid = ends[own.slot <= slot].max() if (own.slot <= slot).any() else 0
            assert abs(laid - share * 50 * (slot + 1)) < 50 + longest or slot * 50 > total - 150
        assert abs(shares[k]["actual_share"] - share) < 0.005
    assert rows.slot.max() <= total // 50 + 3
    assert not rows.duplicated(["doc_id", "use"]).any()


def test_fillers_lie_in_the_gap(spark):
    docs = [(i, "a", 30, 0) for i in range(10)] + [(100 + i, "b", 1, 0) for i in range(100)] + [(200, "a", 7, 0), (201, "a", 2, 0), (202, "a", 1, 0)]
    rows, shares = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["a"]["tokens"] == shares["b"]["tokens"] == 100
    assert rows.slot.max() == 3


def test_shares_are_exact_or_refused():
    period, slots = mixing.quotas({"a": Fraction("0.123457"), "b": 1 - Fraction("0.123457")})
    assert period == 10**6 and slots["a"] == 123457
    with pytest.raises(ValueError):
        mixing.quotas({"a": Fraction("0.1234567"), "b": 1 - Fraction("0.1234567")})


def test_nothing_to_mix(spark):
    rows, shares = mixed(spark, [], [("a", 1.0, 1)])
    assert len(rows) == 0 and shares["a"]["tokens"] == 0


def test_token_counts(spark):
    text = "안녕 hello world 123"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, (text + " ") * 30_000, 0)], "doc_id long, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and got[1] > 4
    assert "".join(tokens.pieces("ab cd ef " * 9, 10)) == "ab cd ef " * 9
    count = tokens.encoder(tokens.TOKENIZER)
    assert got[4] == count((text + " ") * 30_000)
